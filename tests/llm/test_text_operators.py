"""BPE, decontamination, SimHash, language, quality and masked LM on small tables, against plain Python."""

import base64
import re
import zlib

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from formspark.llm import bpe, langid, masked_lm, quality, simhash
from formspark.llm.components import components
from formspark.llm.decontaminate import decontaminate
from formspark.llm.queries import VOCABULARY

ODD = [None, "", " ", "\n\n", "a", "Hello  world's  end\n\n 12 ½ ǆ 中文 😀 ", "x" * 3000, " " * 700, "ab " * 900, "<|endoftext|>", "\x1c\x85\xa0", "näive ՘ Ⅷ"]
SCHEMA = "doc_id bigint, text string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def reference():
    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    import public_tokenizers
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class TestBpe:
    def test_ids_and_round_trip(self, spark, reference):
        rows = [(k, t, "kept") for k, t in enumerate(ODD)] + [(0, None, "kept")]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")  # clashes with the result
        out = bpe.decode(bpe.encode(df, VOCABULARY), VOCABULARY).withColumn("n", bpe.n_tokens()).collect()
        assert sorted(map(str, bpe.round_trip(df, VOCABULARY).withColumn("n", bpe.n_tokens()).collect())) == sorted(map(str, out))
        assert len(out) == len(rows)
        for r in out:
            want = reference.encode_ordinary(r["text"] or "")
            assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n"] == len(want)
            assert bytes(r["decoded"]).decode() == (r["text"] or "")

    def test_both_mergers_agree(self):
        codec = bpe.codec(VOCABULARY)
        rng = np.random.default_rng(3)
        letters = np.frombuffer("abcdethin é".encode(), np.uint8)
        words = [rng.choice(letters, rng.integers(2, 60)).tobytes() for _ in range(400)]
        assert codec.merge_many(words, 64) == [codec.merge_one(w) for w in words]

    def test_blocks_of_a_long_text(self, reference, monkeypatch):
        monkeypatch.setattr(bpe, "PIECES", 7)
        text = "the quick brown fox  jumps\nover 12 lazy dogs, " * 40
        assert np.frombuffer(bpe.Codec(VOCABULARY).encode([text, "a", None])[0], "<u4").tolist() == reference.encode_ordinary(text)

    def test_empty_table(self, spark):
        assert bpe.encode(spark.createDataFrame([], SCHEMA), VOCABULARY).count() == 0


class TestDecontaminate:
    ITEMS = [(1, " ".join(f"w{k}" for k in range(20))), (2, "Short item"), (3, None), (4, ""), (None, "one two three"), (5, " ".join(f"w{k}" for k in range(13))), (1, "Short item"), (6, "--- !!")]
    DOCS = [(1, "before " + " ".join(f"W{k}," for k in range(15)) + " after"), (2, "a short, ITEM here; short item"), (3, None), (4, ""), (5, "w1 w2 w3"), (6, "One--two three"),
            (7, "x " * 50 + "short item"), (7, "x " * 50 + "short item"), (None, "shortitem"), (8, "long " * 3000 + "short item")]

    @staticmethod
    def plain(docs, items):
        word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        windows = {}
        for key, text in items:
            words = word.findall(lower(text))
            for at in range(max(1, len(words) - 12) if words else 0):
                windows.setdefault(tuple(words[at:at + 13]), set()).add("" if key is None else str(key))
        for key, text in docs:
            words, hit, met = word.findall(lower(text)), set(), set()
            for window, ids in windows.items():
                for at in range(len(words) - len(window) + 1):
                    if tuple(words[at:at + len(window)]) == window:
                        hit.update(range(at, at + len(window)))
                        met |= ids
            yield key, len(words), len(hit), sorted(met), bool(hit) and 20 * len(hit) >= len(words)

    @pytest.mark.parametrize("block", [1 << 20, 40])
    def test_against_brute_force(self, spark, block):
        docs = spark.createDataFrame([(k, t, "x") for k, t in self.DOCS], "doc_id bigint, text string, items string")
        out = decontaminate(docs, spark.createDataFrame(self.ITEMS, "item_id bigint, text string"), block_bytes=block).collect()
        key = lambda r: (r[0] is None, str(r))
        assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in out], key=key) == sorted(self.plain(self.DOCS, self.ITEMS), key=key)
        for r in out:
            assert r["n_items"] == len(r["items"])
            for s in r["spans"]:
                assert len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r["text"][s["start"]:s["stop"]]))) == s["last"] - s["first"] + 1

    def test_chunks_keep_windows_that_cross_them(self, monkeypatch):
        from formspark.llm import decontaminate as module
        monkeypatch.setattr(module, "CHUNK", 16)
        scanner = module.Scanner([("1", " ".join(f"w{k}" for k in range(13)))])
        assert scanner.scan("a b c " + " ".join(f"w{k}" for k in range(13)) + " d")[2] == [(3, 15)]

    def test_empty_tables(self, spark):
        none = spark.createDataFrame([], "item_id bigint, text string")
        assert decontaminate(spark.createDataFrame([(1, "a b")], SCHEMA), none).first()["n_hit"] == 0
        assert decontaminate(spark.createDataFrame([], SCHEMA), none).count() == 0


class TestSimhash:
    @staticmethod
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        if not words:
            return 0
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    @staticmethod
    def groups(values):
        values = list(values)
        label = list(range(len(values)))
        for i, a in enumerate(values):
            for j in range(i):
                if (a ^ values[j]).bit_count() <= 4 and label[i] != label[j]:
                    old, new = max(label[i], label[j]), min(label[i], label[j])
                    label = [new if x == old else x for x in label]
        return label

    def docs(self):
        rng = np.random.default_rng(5)
        rows = [(k, t) for k, t in enumerate(ODD)]
        for k in range(40):
            words = [f"t{x}" for x in rng.integers(0, 50, 300)]
            rows.append((100 + 3 * k, " ".join(words)))
            words[rng.integers(0, 300)] = "changed"
            rows.append((101 + 3 * k, " ".join(words)))
            rows.append((99 - k, " ".join(words).upper()))
        return [*rows, rows[20], (None, rows[20][1]), (None, "only here"), (None, "only here")]

    @pytest.mark.parametrize("tile", [4, 2048])
    def test_against_brute_force(self, spark, tile):
        rows = self.docs()
        df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, fp int")
        out = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df, tile=tile).collect()), key=str)
        prints = [self.fingerprint(t) for _, t in rows]
        label = self.groups(prints)
        least = {g: min((k for (k, _), x in zip(rows, label, strict=True) if x == g and k is not None), default=None) for g in label}
        assert out == sorted(((k, f"{p:016x}", least[g]) for (k, _), p, g in zip(rows, prints, label, strict=True)), key=str)

    def test_long_texts_in_blocks(self, monkeypatch):
        text = "a b c d e f g " * 50
        want = self.fingerprint(text)
        monkeypatch.setattr(simhash, "CHUNK", 9)
        assert simhash.fingerprint(text) % 2**64 == want

    @pytest.mark.parametrize("tile", [8, 64])
    def test_links_of_a_dense_group(self, spark, tile):
        rng = np.random.default_rng(2)
        values = {int(x) for x in rng.integers(0, 2**63, 200, dtype=np.uint64)}
        for base in list(values)[:2]:
            for _ in range(150):
                x = base
                for b in rng.integers(0, 64, rng.integers(0, 5)):
                    x ^= 1 << int(b)
                values.add(x)
        values = sorted(values)
        signed = [int(np.uint64(v).view(np.int64)) for v in values]
        found = {r["node"]: r["label"] for r in components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp bigint"), tile)).collect()}
        label = self.groups(values)
        least = {g: min(s for s, x in zip(signed, label, strict=True) if x == g) for g in label}
        assert [found.get(s, s) for s in signed] == [least[g] for g in label]

    def test_one_of_each_group(self, spark):
        rows = [(5, "same text as the others here", "e"), (3, "same text as the others here", None), (3, "same text as the others here", None), (9, "", "x"), (None, None, "y"), (None, "alone alone alone alone", "z"),
                (None, "alone alone alone alone", "z")]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, row string")
        out = simhash.one_of_each_group(df)
        assert out.columns == df.columns
        assert sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=str) == sorted([(3, "same text as the others here"), (9, ""), (None, "alone alone alone alone")], key=str)
        assert simhash.one_of_each_group(df.limit(0)).count() == 0

    def test_components_of_a_path(self, spark):
        edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 90), (90, 100), (7, 7)], "u bigint, v bigint")
        found = {r["node"]: r["label"] for r in components(edges).collect()}
        assert found == {**{k: 1 for k in range(1, 61)}, 90: 90, 100: 90}


def language_rows():
    rng = np.random.default_rng(4)
    words = {"en": "the of and house that street with river over under".split(), "de": "der die und haus dass straße mit fluss über unter".split(), "el": "το και σπίτι ότι δρόμος με ποτάμι πάνω κάτω".split()}
    return [(k, " ".join(rng.choice(words[lang], 40)), lang) for k, lang in enumerate(np.repeat(list(words), 40).tolist())], words


class TestLanguage:
    def test_held_out_and_odd_texts(self, spark):
        rows, words = language_rows()
        docs = spark.createDataFrame([*rows, (500, None, "en"), (501, "12 !!", "de"), (None, "the house of the river", None)], "doc_id bigint, text string, lang string")
        model = langid.fit(langid.learnable(docs))
        assert model.languages == ["de", "el", "en"]
        out = langid.identify(docs.withColumn("score", F.lit("old")), model).collect()
        assert len(out) == len(rows) + 3
        for r in out:
            if r["text"] is None or r["text"] == "12 !!":
                assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            else:
                assert r["lang_pred"] == (r["lang"] or "en") and 0 <= r["score"] <= 1 and not r["rejected"]
        assert model.judge("qxz wvkj pqzx kkjw zzqx vvxq jjkq " * 20)[3]
        assert langid.identify(docs.limit(0), model).count() == 0

    def test_probabilities_sum_to_one(self, spark):
        rows, _ = language_rows()
        model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
        letters = sorted({c for _, t, _ in rows for c in t.lower()})
        for context in ("the", "der", "xyz"):
            p = np.zeros(3)
            for c in letters:
                codes = np.frombuffer((context + c).encode("utf-32-le"), "<u4").astype(np.uint64)
                p += np.exp(model.positions(codes)[0])
            assert np.allclose(p + np.exp(unknown_share(model, context)), 1, atol=1e-3)

    def test_chunks_do_not_change_a_score(self, spark, monkeypatch):
        rows, _ = language_rows()
        model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
        whole = model.entropies(rows[0][1])[1]
        monkeypatch.setattr(langid, "CHUNK", 10)
        assert np.allclose(model.entropies(rows[0][1])[1], whole)

    def test_nothing_to_learn(self, spark):
        docs = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
        assert langid.identify(docs, langid.fit(docs)).first()["lang_pred"] == "und"


def unknown_share(model, context):
    """Log-probability of a character that no language has seen."""
    codes = np.frombuffer((context + "一").encode("utf-32-le"), "<u4").astype(np.uint64)
    return model.positions(codes)[0]


class TestQuality:
    def rows(self):
        rng = np.random.default_rng(6)
        docs, labels = [], []
        for k in range(300):
            words = [f"w{x}" for x in rng.integers(0, 400, 60)]
            good = k % 4 > 0
            docs.append((k, " ".join(words if good else [w + "%%%" for w in words] if k % 8 else np.repeat(words[:10], 6))))
            labels.append((k, int(good)))
        return docs, labels

    def test_held_out(self, spark):
        docs, labels = self.rows()
        df = spark.createDataFrame([*docs, (900, None), (901, ""), (None, "w1 w2"), docs[0]], SCHEMA)
        table = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 7), (9999, 1)], "doc_id bigint, quality int")
        model = quality.fit(df, table)
        out = quality.score(df.withColumn("score", F.lit("old")), model).collect()
        assert len(out) == len(docs) + 4
        want = dict(labels)
        for r in out:
            assert 0 <= r["score"] <= 1
            if r["doc_id"] in want and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                assert (r["score"] >= 0.5) == bool(want[r["doc_id"]])
        assert len({r["score"] for r in out if not r["text"]}) == 1

    def test_nothing_to_learn(self, spark):
        df = spark.createDataFrame([(1, "a b")], SCHEMA)
        model = quality.fit(df, spark.createDataFrame([], "doc_id bigint, quality int"))
        assert quality.score(df, model).first()["score"] == 0.5
        assert quality.score(df.limit(0), model).count() == 0

    def test_blocks_give_the_same_features(self, monkeypatch):
        text = "One two, two THREE 44 ... five " * 20
        whole = np.sort(np.concatenate(list(quality.features(text))))
        monkeypatch.setattr(quality, "CHUNK", 25)
        assert np.array_equal(np.sort(np.concatenate(list(quality.features(text)))), whole)


class TestMaskedLm:
    def test_words_in_order_are_likelier(self, spark):
        cycle = "a b c d e f g h".split()
        texts = [" ".join((cycle * 9)[k % 8:k % 8 + 60]) for k in range(200)]
        rng = np.random.default_rng(0)
        mixed = [" ".join(rng.permutation(t.split())) for t in texts[:20]]
        docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
        model = masked_lm.train(docs, rounds=3)
        out = masked_lm.score(spark.createDataFrame(list(enumerate(texts[:20] + mixed)), SCHEMA), model).orderBy("doc_id").collect()
        assert np.mean([r["per_word"] for r in out[:20]]) > np.mean([r["per_word"] for r in out[20:]]) + 0.5

    def test_sums_by_brute_force(self, spark):
        texts = [None, "", " ", "the of and", "The OF the unseen word " * 30, "x"]
        docs = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)], "doc_id bigint, text string, per_word double")
        model = masked_lm.train(docs)
        words, w = masked_lm.Vocabulary(model.frequent), model.weights
        for r in masked_lm.score(docs, model).collect():
            ids = [words[x] for x in (r["text"] or "").lower().split()]
            padded = [0] * masked_lm.SIDE + ids + [0] * masked_lm.SIDE
            total = 0.0
            for k, target in enumerate(ids):
                around = [padded[k + masked_lm.SIDE + j] for j in masked_lm.CONTEXT]
                logits = np.tanh(w["embed"][around].ravel() @ w["inner"] + w["inner_bias"]) @ w["outer"] + w["outer_bias"]
                total += logits[target] - np.log(np.exp(logits).sum())
            assert r["n_words"] == len(ids) and r["log_likelihood"] == pytest.approx(total, abs=1e-3)
            assert (r["per_word"] is None) == (not ids)

    def test_every_position_is_trained_on(self, spark):
        """one step over all positions, by the plain formula"""
        texts = ["a", None, "b a c d a b", "", "the of a " * 40]
        docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).coalesce(1)
        model = masked_lm.train(docs)
        w, words = masked_lm.start(), masked_lm.Vocabulary(model.frequent)
        tokens, _ = masked_lm.laid_out(words.numbers([t for t in texts if t is not None])[0])
        spots = np.flatnonzero(tokens)
        assert len(spots) == sum(len((t or "").split()) for t in texts)
        around, target, n = tokens[spots[:, None] + np.array(masked_lm.CONTEXT)], tokens[spots], len(spots)
        x = w["embed"][around].reshape(n, -1)
        a = np.tanh(x @ w["inner"] + w["inner_bias"])
        p = np.exp(a @ w["outer"] + w["outer_bias"])
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), target] -= 1
        p /= n
        back = (p @ w["outer"].T) * (1 - a * a)
        embed = np.zeros_like(w["embed"])
        np.add.at(embed, around.ravel(), (back @ w["inner"].T).reshape(-1, masked_lm.WIDTH))
        for name, g in (("outer", a.T @ p), ("outer_bias", p.sum(axis=0)), ("inner", x.T @ back), ("inner_bias", back.sum(axis=0)), ("embed", embed)):
            assert model.weights[name] == pytest.approx(w[name] - masked_lm.STEP * g / np.sqrt(1e-3 + g * g), abs=1e-6)

    def test_large_logits(self):
        """a model whose logits have no exponentials scores and trains all the same"""
        trainer = masked_lm.Trainer({k: v * 400 for k, v in masked_lm.start().items()})
        tokens = np.array([0, 0, 0, 1, 2, 3, 2, 1, 0, 0, 0], np.int16)
        for _ in range(3):
            trainer.step(tokens)
            model = masked_lm.Model([], trainer.w)
            assert np.isfinite(model.log_p(tokens, model.tables())).all() and all(np.isfinite(v).all() for v in trainer.w.values())

    def test_spelling_sums_to_one_in_a_class(self):
        """over words of one and two characters, and what goes on from there"""
        pairs = np.zeros((masked_lm.SYMBOLS, masked_lm.SYMBOLS), np.int64)
        end = masked_lm.SYMBOLS - 1
        for word, n in (("ab", 5), ("abba", 2), ("\u6f22b", 3), ("b", 1)):
            last = end
            for s in masked_lm.symbols(word):
                pairs[last, s] += n
                last = s
        spelling = masked_lm.Spelling(pairs, ["own"])
        chain = np.exp(spelling.chain)
        assert chain.sum(axis=1) == pytest.approx(1) and chain[end, end] == 0
        begins = chain[end][:, None] * chain  # every pair of first symbols, the end among the second ones
        for k in range(0, masked_lm.SIZE - masked_lm.FREQUENT - 1, 17):
            assert begins[:-1][masked_lm._CLASSES[:-1] == k].sum() == pytest.approx(np.exp(spelling.classes[k]))
        a, b = ord("a"), ord("b")
        assert spelling.log_p("ab") == pytest.approx(np.log(chain[end, a] * chain[a, b] * chain[b, end]) - spelling.classes[masked_lm._CLASSES[a, b]])
        assert spelling.log_p("own") == 0.0 and spelling.log_p("\u6f22") < spelling.log_p("b")

    def test_rare_words_are_spelled(self, spark):
        common = [f"w{k}" for k in range(127)] * 9
        texts = [" ".join(common), "rarely rarer rarest", "w1 rarely\u2003rarely", None, "w1"]
        docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
        model = masked_lm.train(docs)
        spelling = masked_lm.Spelling(model.pairs, model.frequent)
        want = {"rarely": 3, "rarer": 1, "rarest": 1}
        assert model.pairs[ord("y"), masked_lm.SYMBOLS - 1] == want["rarely"] and model.pairs[masked_lm.SYMBOLS - 1, ord("r")] == sum(want.values())
        inside = masked_lm.score(docs, masked_lm.Model(model.frequent, model.weights)).orderBy("doc_id").collect()
        whole = masked_lm.score(docs, model).orderBy("doc_id").collect()
        spelled = [sum(spelling.log_p(w) for w in (t or "").split()) for t in texts]
        assert [b["log_likelihood"] - a["log_likelihood"] for a, b in zip(inside, whole)] == pytest.approx(spelled)
        odd = masked_lm.score(spark.createDataFrame([(1, "rarely"), (2, "rxqzjw")], SCHEMA), model).orderBy("doc_id").collect()
        assert odd[0]["log_likelihood"] > odd[1]["log_likelihood"] + 5

    def test_empty_table(self, spark):
        none = spark.createDataFrame([], SCHEMA)
        assert masked_lm.score(none, masked_lm.train(none)).count() == 0
