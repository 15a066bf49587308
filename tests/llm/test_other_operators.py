"""Shards, preferences, main text, audio, the queries and the pipeline on small tables."""

import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from formspark.llm import audio, preferences, shards, wrapper
from formspark.llm.common import shared_folder
from formspark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


class TestShards:
    @pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
    def test_permutation(self, size):
        for key in (0, 7, 20_011):
            there = shards.permute(np.arange(size), size, key)
            assert sorted(there) == list(range(size))
            assert np.array_equal(shards.permute(there, size, key, back=True), np.arange(size))
        assert size < 17 or not np.array_equal(shards.permute(np.arange(size), size, 1), shards.permute(np.arange(size), size, 2))

    def test_round_trip_and_resume(self, spark):
        texts = ["one", "", None, "line\nfeed\r\n", "long " * 200, "é" * 30, "one"]
        rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id int, text string, slot string").repartition(3, "doc_id")
        rows.write.parquet(table := f"{shared_folder(spark)}/rows-{np.random.default_rng().integers(1 << 60)}")
        rows = spark.read.parquet(table)
        order = shards.write_order(rows, "text", f"{table}-order", key=5, length=64, shard_records=4)
        out = shards.read_order(spark, order).collect()
        assert sorted(r["slot"] for r in out) == list(range(order.sequences)) and all(len(r["record"]) == 64 for r in out)
        stream = b"".join(bytes(r["record"]) for r in sorted(out, key=lambda r: r["sequence"])).rstrip(bytes([shards.PAD]))
        assert sorted(stream.split(bytes([shards.END]))[:-1]) == sorted((t or "").encode() for t in texts)
        half = order.sequences // 2
        rest = shards.read_order(spark, order, half).collect()
        assert {(r["slot"], bytes(r["record"])) for r in rest} == {(r["slot"], bytes(r["record"])) for r in out if r["slot"] >= half}
        some = shards.read_order(spark, order, 5, 9)  # slots 5 to 8 lie in the shards 1 and 2
        assert sorted(f.rsplit("/", 1)[1][:10] for f in some.inputFiles()) == ["part-00001", "part-00002"]
        assert sorted(r["slot"] for r in some.collect()) == [5, 6, 7, 8]

    def test_reserved_ids_and_changed_partitions_are_errors(self, spark):
        folder = f"{shared_folder(spark)}/bad-{np.random.default_rng().integers(1 << 60)}"
        for value in (b"a\xfeb", b"\xff"):
            with pytest.raises(Exception, match="kept for pads"):
                shards.write_order(spark.createDataFrame([(value,)], "ids binary"), "ids", folder)
        changing = F.udf(lambda: "y" * (time.time_ns() % 100_003), "string").asNondeterministic()
        with pytest.raises(Exception, match="has changed"):
            shards.write_order(spark.range(3).select(changing().alias("ids")), "ids", folder)

    def test_empty_table(self, spark):
        order = shards.write_order(spark.createDataFrame([], "text string"), "text", f"{shared_folder(spark)}/none")
        assert order.sequences == 0 and shards.read_order(spark, order).count() == 0


class TestPreferences:
    def test_prefix_and_masks(self, spark):
        schema = "pair_id bigint, turn bigint, role string, text string, part string"
        chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (1, 2, "user", "more"), (1, 3, "assistant", "fine"), (2, 0, "user", "same"), (2, 0, "user", "same"), (3, 0, None, None), (None, 0, "user", "x"), (4, None, "user", "x")]
        rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (2, 0, "user", "same"), (5, 7, "assistant", "alone")]
        out = {r["pair_id"]: r for r in preferences.format_preferences(*(spark.createDataFrame([(*r, "x") for r in rows], schema) for rows in (chosen, rejected))).collect()}
        assert sorted(out) == [1, 2, 3, 5]
        one = out[1]
        assert one["prompt"] == "<|user|>\nhi<|end|>\n" and one["rejected"] == "<|assistant|>\nbad<|end|>\n"
        assert [one["chosen"][s["start"]:s["stop"]] for s in one["chosen_mask"]] == ["good<|end|>\n", "fine<|end|>\n"]
        assert (out[2]["prompt"], out[2]["chosen"], out[2]["rejected"], out[2]["chosen_mask"]) == ("<|user|>\nsame<|end|>\n", "", "", [])
        assert (out[3]["prompt"], out[3]["chosen"], out[3]["rejected"]) == ("", "<||>\n<|end|>\n", "")
        assert out[5]["rejected"].endswith("alone<|end|>\n")

    def test_long_conversations_go_on_in_further_rows(self, spark):
        rows = spark.range(25).select(F.lit(1).alias("pair_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
        out = preferences.format_preferences(rows, rows.where("turn < 14"), turns=10).orderBy("part").collect()
        assert [r["prompt_turns"] for r in out] == [10, 4, 0] and out[2]["chosen"].count("<|end|>") == 5 and not any(r["rejected"] for r in out)

    def test_no_python(self, spark):
        plan = QUERIES["op4_preferences"](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan

    def test_empty_tables(self, spark):
        none = spark.createDataFrame([], "pair_id bigint, turn bigint, role string, text string")
        assert preferences.format_preferences(none, none).count() == 0


class TestMainText:
    ARTICLE = "<article><h1>Title &amp; more</h1><p>First <b>bo</b>ld\n text<p>Second&nbsp;&lt;x&gt;</article>"

    def test_marked_article(self, spark):
        page = ("<!DOCTYPE html><html><head><title>no</title><script>var t='</p>'</script></head><body><header>Site</header><nav><a>menu</a></nav><div class='cookie-notice'>no</div><div class=ad>no</div>"
                f"<main>{self.ARTICLE}<section id='comments'><p>no</p></section></main><aside>no</aside><form>no</form><footer>no</footer>")
        rows = [(1, "http://A.example/x", page), (2, "http://a.example/y", page.replace("First", "Other")), (3, None, None), (4, "http://b.example", ""), (5, "nonsense", "<p>plain"), (1, "http://A.example/x", page), (None, "", "<"),
                (6, "http://c.example", "<div>" * 5000 + "deep" + "</div>" * 5000)]
        out = wrapper.main_text(spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, host string")).collect()
        text = {r["page_id"]: r["text"] for r in out}
        assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
        assert text == {1: "Title & more First bold text Second <x>", 2: "Title & more Other bold text Second <x>", 3: "", 4: "", 5: "plain", None: "<", 6: "deep"}

    def test_constant_slots_are_template(self, spark):
        rows = [(k, "http://host.example/", f"<body><div class='t'>Our shop</div><div class='c'><p>text {k}</p><p>more {k}</p></div><div class='f'>All rights</div></body>") for k in range(6)]
        out = wrapper.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
        assert {r["page_id"]: r["text"] for r in out} == {k: f"text {k} more {k}" for k in range(6)}

    @pytest.mark.parametrize("page", ["<body><div id='top'>Our shop</div><div id='main'>text {k}</div><div id='foot'>All rights</div>", "<body><div>Our shop</div><div>text {k}</div><div>All rights</div>",
                                      "<div><p>Our shop</p><p>text {k}</p>{more}<p>All rights</p></div>"])
    def test_equal_siblings_are_judged_one_by_one(self, spark, page):
        rows = [(k, "http://host.example/", page.format(k=k, more=f"<p>more {k}</p>" * (k % 3))) for k in range(9)]
        out = wrapper.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
        assert {r["page_id"]: r["text"] for r in out} == {k: " ".join([f"text {k}", *[f"more {k}"] * ("{more}" in page) * (k % 3)]) for k in range(9)}

    @pytest.mark.parametrize("page", ["<div class='layout has-sidebar'><article><h2>T {k}</h2><p>text {k}</p></article></div>", "<form id='aspnetForm'><div><h2>T {k}</h2><p>text {k}</p></div></form>", "<div class='content no-sidebar'><h2>T {k}</h2><p>text {k}</p></div>",
                                      "<div class='sidebar'><article><h2>T {k}</h2><p>text {k}</p></article></div><p>menu", "<article><h2>T {k}</h2><section class='share-prices'>text {k}</section></article>",
                                      "<article><h2>T {k}</h2><p class='notice'>text {k}</p><p class='share'>Share</p></article>"])
    def test_names_do_not_cut_articles(self, spark, page):
        rows = [(k, "http://host.example/", page.format(k=k)) for k in range(6)]
        out = wrapper.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
        assert {r["page_id"]: r["text"] for r in out} == {k: f"T {k} text {k}" for k in range(6)}

    def test_names_of_parts_hold(self, spark):
        page = "<div class='cookie-notice'>no {k}</div><div class='site-footer'>no {k}</div><article><h1>T {k}</h1><div class='ad'>no {k}</div><div class='share'>no</div><section class='related'><article>no {k}</article></section><p>text and more text {k}</p></article>"
        rows = [(k, "http://host.example/", page.format(k=k)) for k in range(6)]
        out = wrapper.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
        assert {r["page_id"]: r["text"] for r in out} == {k: f"T {k} text and more text {k}" for k in range(6)}

    @pytest.mark.parametrize("page", ["<article><h1>T {k}</h1><p>Read our letter</p><p>text {k}</p></article>", "<article><p>An advert line</p>{more}<p>text {k}</p><p>Read also</p></article>"])
    def test_repeated_text_inside_articles(self, spark, page):
        rows = [(k, "http://host.example/", page.format(k=k, more=f"<p>more {k}</p>" * (k % 3))) for k in range(10)]
        out = wrapper.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
        assert {r["page_id"]: r["text"] for r in out} == {k: f"T {k} text {k}" if "{more}" not in page else " ".join([*[f"more {k}"] * (k % 3), f"text {k}"]) for k in range(10)}

    def test_copies_are_no_template(self, spark):
        article = "<article><h1>Title</h1>" + "".join(f"<p>Paragraph {k} of the text</p>" for k in range(8)) + "<p>last {n}</p></article>"
        whole = "Title " + " ".join(f"Paragraph {k} of the text" for k in range(8))
        rows = [(n, "http://host.example/", article.format(n=n)) for n in range(9)] + [(20 + n, "http://other.example/", "<div><p>one</p><p>two</p></div>") for n in range(5)]
        out = wrapper.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
        assert {r["page_id"]: r["text"] for r in out} == {n: f"{whole} last {n}" for n in range(9)} | {20 + n: "one two" for n in range(5)}

    @pytest.mark.parametrize("most", [wrapper.SEED_BYTES, 0])
    def test_each_layout_has_a_seed(self, spark, monkeypatch, most):
        monkeypatch.setattr(wrapper, "SEED_BYTES", most)
        shop = "<html><body class='page-{w}'><div class='top'>Our shop</div><div class='c'><p>text {k}</p></div><div class='f'>All rights</div></body></html>"
        blog = "<div id='wrap'><div class='menu-line'>Our blog</div><div class='post'><p>entry {k}</p></div><div class='end'>Some rights</div></div>"
        rows = [(k, f"http://host.example/{k}", (shop if k < 24 else blog).format(k=k, w=chr(97 + k % 26))) for k in range(36)]
        rows += [(k, f"http://host.example/{k}", h) for k, h in enumerate(["", "<", "<html>", "<html><body>Error", "<div></div>", "<script>"] * 6, 100)]
        out = {r["page_id"]: r["text"] for r in wrapper.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
        assert {k: t for k, t in out.items() if k < 100} == {k: f"text {k}" if k < 24 else f"entry {k}" for k in range(36)}
        assert len(out) == len(rows)

    def test_long_lists_keep_their_anchors(self):
        a, b = (wrapper.shape(wrapper.tree("".join(f"<p>{x} {k}</p>" for k in range(400)) + "<p>same</p>" + "".join(f"<p>{x} {k}</p>" for k in range(300)))) for x in "ab")
        pairs = []
        wrapper.matched(a, b, pairs)
        assert len(pairs) == 1 + 2 * 701 and sum(x.text == y.text for x, y in pairs) == 2

    def test_matching(self):
        a, b = (wrapper.shape(wrapper.tree(h)) for h in ("<ul><li>1</ul><div><p>x</div><table><tr><td>y</table>", "<h2>new</h2><ul><li>1</ul><table><tr><td>z</table>"))
        pairs = []
        assert wrapper.matched(a, b, pairs) == len(pairs) == 8
        assert {x.label for x, _ in pairs} == {"#root", "ul", "li", "#text", "table", "tr", "td"}

    def test_empty_table(self, spark):
        assert wrapper.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def sound(seed, notes=64):
    return audio.melody(np.random.default_rng(seed).normal(size=notes))


class TestAudio:
    def test_clips_are_found_where_they_were_cut(self, spark):
        sounds = [(k, sound(k)) for k in range(60)] + [(100, sound(3)), (101, None), (102, b""), (103, b"\1"), (None, sound(4)), (7, sound(7))]
        clips = [(k, audio.clip(sound(k), 10 * audio.HOP + 40, 54 * audio.HOP, k)) for k in range(0, 60, 5)] + [(200, sound(1000)), (201, None)]
        prints = [audio.fingerprints(spark.createDataFrame(rows, "id bigint, pcm binary")).drop("pcm") for rows in (clips, sounds)]
        classes, links = audio.align(*prints)
        members = [(r["id"], r["class_id"]) for r in classes.collect()]
        assert len(members) == 65 and (100, 3) in members and members.count((7, 7)) == 2 and {c for k, c in members if k in (101, 102, 103)} == {101}
        found = {(r["id"], r["class_id"]): r["offset"] for r in links.collect()}
        assert found == {(k, k): 10 for k in range(0, 60, 5)}

    def test_recall_against_brute_force(self, spark):
        rng = np.random.default_rng(9)
        base = rng.normal(size=(12, 64))
        sounds = [(k, audio.melody(base[k % 12] + (k >= 12) * rng.normal(size=64) * 0.03)) for k in range(60)]
        prints = audio.fingerprints(spark.createDataFrame(sounds, "id bigint, pcm binary")).drop("pcm")
        found = {(r["id"], r["class_id"]) for r in audio.align(prints.where("id % 5 = 0"), prints)[1].collect()}
        rows = {r["id"]: bytes(r["fingerprint"]) for r in prints.collect()}
        want = set()
        for q in range(0, 60, 5):
            for r, other in rows.items():
                n = len(other) // 4
                judged = [audio.differing(rows[q], other, o) for o in range(-n + 1, n)]
                if any(bits >= 32 * audio.LEAST_OVERLAP and errors <= audio.MOST_ERRORS * bits for errors, bits in judged):
                    want.add((q, r))
        assert found <= want and len(found) >= 0.9 * len(want) > 12

    def test_empty_table(self, spark):
        none = spark.createDataFrame([], "id bigint, fingerprint binary")
        classes, links = audio.align(none, none)
        assert classes.count() == 0 and links.count() == 0


class TestQueries:
    def test_preferences_match_sql(self, spark):
        from tools.check import canonical
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
        df = QUERIES["op4_preferences"](spark, SF)
        cursor = con.execute(ORACLE_SQL["op4_preferences"])
        columns = [c[0] for c in cursor.description]
        assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), columns)

    def test_pipeline(self, spark):
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        names, counts = docs.columns, [docs.count()]
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "tokens":
                assert docs.columns == names
            docs.write.parquet(path := f"{shared_folder(spark)}/{name}-{np.random.default_rng().integers(1 << 60)}")
            docs = spark.read.parquet(path)
            counts.append(docs.count())
        assert counts == sorted(counts, reverse=True) and counts[-1] > 100
        assert docs.where("ids_sha256 is null or decoded_sha256 is null").count() == 0

    def test_pipeline_of_odd_documents(self, spark):
        """nulls, repeated rows, clashing and oddly named columns, and no rows at all"""
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, `a.b` string, row string"
        rows = [(None, None, None, None, None, 1.0, "x", "y"), (1, "", "en", "s", 0, 1.0, "x", "y"), (2, "The river of the house and the street. " * 8, "en", "s", 1, None, None, "y")]
        for docs in (spark.createDataFrame([*rows, rows[2]], schema), spark.createDataFrame([], schema)):
            for name, stage in corpus_pipeline.STAGES:
                out = stage(spark, docs, SF)
                assert name == "tokens" or out.columns == docs.columns
                out.write.parquet(path := f"{shared_folder(spark)}/{name}-{np.random.default_rng().integers(1 << 60)}")
                docs = spark.read.parquet(path)
            assert docs.count() <= 1
