"""The kernels against plain windows and brute force, with slices of every size."""

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from formspark import session
from formspark.functions.text import edit_similarity
from formspark.kernels import ancestors, carry_above, islands, ordered_scan, ranked_join, suffixes
from formspark.operators import fuzzy


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    data = [(rnd.choice("aab"), i, rnd.choice([None, 1, 2, 3]), rnd.choice("xxyz")) for i in rnd.sample(range(1000), 200)]
    return spark.createDataFrame(data, "k string, ord int, v int, t string").repartition(5).cache()


@pytest.mark.parametrize("size", [1, 7, 100000])
def test_ordered_scan(rows, size):
    got = ordered_scan(rows, ["k"], [F.col("ord")], F.floor(F.col("ord") / size), number="n", previous={"p": F.col("v")},
                       running={"s": F.coalesce("v", F.lit(0))}, carried={"c": F.col("v")}, carried_before={"b": F.col("v")})
    w = Window.partitionBy("k").orderBy("ord")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("*", F.row_number().over(w).alias("n"), F.lag("v").over(w).alias("p"), F.sum(F.coalesce("v", F.lit(0))).over(upto).alias("s"),
                       F.last("v", True).over(upto).alias("c"), F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("b"))
    cols = ["k", "ord", "v", "n", "p", "s", "c", "b"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


@pytest.mark.parametrize("size", [1, 13, 100000])
def test_islands(rows, size):
    got = islands(rows, ["k"], [F.col("ord")], F.floor(F.col("ord") / size), {"_p": F.col("t")}, F.col("_p") != F.col("t"), ["t"], name="run")
    w = Window.partitionBy("k").orderBy("ord")
    flag = rows.withColumn("f", F.when(F.lag("t").over(w).eqNullSafe(F.col("t")), 0).otherwise(1))
    want = flag.withColumn("run", F.sum("f").over(w))
    assert sorted(map(tuple, got.select("k", "ord", "run").collect())) == sorted(map(tuple, want.select("k", "ord", "run").collect()))


def test_no_window_over_a_whole_key(rows):
    got = islands(rows, ["k"], [F.col("ord")], F.floor(F.col("ord") / 10), {"_p": F.col("t")}, F.col("_p") != F.col("t"), ["t"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_slice" in line for line in windows), windows


@pytest.mark.parametrize("size", [3, 1000])
def test_carry_above_is_strict(spark, size):
    points = spark.createDataFrame([("f", 10.0, 1), ("f", 20.0, 2), ("f", 5.0, 3), ("g", 50.0, 4)], "k string, at double, id int")
    marks = spark.createDataFrame([("f", 10.0, "a", 1), ("f", 10.0, "b", 2), ("f", 4.0, "c", 3)], "k string, at double, m string, ord int")
    got = carry_above(points, marks, ["k"], "at", F.floor(F.col("at") / size), {"m": F.col("m")}, ties=["ord"])
    assert {r.id: r.m for r in got.collect()} == {1: "c", 2: "b", 3: "c", 4: None}


def test_ranked_join_keeps_first_hit_and_never_multiplies(spark):
    left = spark.createDataFrame([("f", 1, "x", "y"), ("f", 2, "q", "y"), ("f", 3, "", "z")], "form_id string, ord int, a string, b string")
    right = spark.createDataFrame([("f", 1, "y"), ("f", 2, "y"), ("f", 3, "x")], "form_id string, r int, n string")
    got = ranked_join(left, ["ord"], [(1, "n", F.col("a")), (2, "n", F.col("b"))], right, [("n", F.col("n"))], ["r"], ["r"], ["form_id"])
    assert sorted((r.ord, r.match_rank, r.r) for r in got.collect()) == [(1, 1, 3), (2, 2, 1), (3, None, None)]
    last = ranked_join(left, ["ord"], [(1, "n", F.col("b"))], right, [("n", F.col("n"))], ["r"], ["r"], ["form_id"], last_wins=True)
    assert {r.ord: r.r for r in last.collect()} == {1: 2, 2: 2, 3: None}


def test_ranked_join_ends_a_round_at_its_first_hit(spark):
    left = spark.createDataFrame([("f", 1, "x", "y"), ("f", 2, "q", "y"), ("f", 3, "x", "q")], "form_id string, ord int, a string, b string")
    right = spark.createDataFrame([("f", 1, "y"), ("f", 3, "x")], "form_id string, r int, n string")
    tries = [(1, "n", F.col("a")), (2, "n", F.col("b")), (11, "n", F.col("b"))]
    got = ranked_join(left, ["ord"], tries, right, [("n", F.col("n"))], ["r"], ["r"], ["form_id"], rounds=[[1, 2], [11]], passing=[2, 11])
    assert sorted((r.ord, r.match_rank, r.r) for r in got.collect()) == [(1, 11, 1), (2, 2, 1), (3, None, None)]


def test_scan_within_slices_of_another(spark):
    """rows exploded from dealt rows are scanned where they are, by a further key"""
    df = spark.range(40).selectExpr("if(id % 4 = 0, NULL, 'k') AS k", "id", "array(id % 3, id % 5) AS parts")
    first = ordered_scan(df, ["k"], [F.col("id")], F.floor(F.col("id") / 7), running={"sofar": F.lit(1)}, room=2)
    exploded = first.select("k", "id", "sofar", "_slice", F.posexplode("parts").alias("at", "part"))
    got = ordered_scan(exploded, ["k", "part"], [F.col("id"), F.col("at")], None, number="n", previous={"p": F.col("id")}, carried_before={"c": F.col("at")}, within="part", room=2).collect()
    seen, count = {}, {}
    for r in sorted(got, key=lambda r: (r.id, r.at)):
        count.setdefault(r.k, set()).add(r.id)
        n, p, c = seen.get((r.k, r.part), (0, None, None))
        assert (r.sofar, r.n, r.p, r.c) == (len(count[r.k]), n + 1, p, c)
        seen[r.k, r.part] = n + 1, r.id, r.at
    assert len(got) == 80


def test_what_is_written_down_leaves_no_shuffles(spark):
    def files():
        found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}
    before = files()
    kept = session.cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition("count"))
    deadline = time.time() + 20
    while files() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not files() - before
    assert kept.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


@pytest.mark.parametrize("scope", [[], ["k"]])
def test_texts_with_shared_beginnings_meet_by_what_follows(spark, monkeypatch, scope):
    rng = random.Random(3)
    names = [f"{head}{rng.randint(0, 10 ** rng.randint(2, 5)):0{w}d}" for head, w in (("Supplier#", 9), ("Customer#", 9), ("Custodio#", 8), ("Supl", 5)) for _ in range(25)]
    names += ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(20)]
    rows = [(rng.choice("xy") if scope else "x", n) for n in names]
    t = spark.createDataFrame(rows, "k string, key string")
    left, right = t.where("key NOT LIKE 'Custom%'"), t
    monkeypatch.setattr(fuzzy, "SHARED", 4)
    assert not fuzzy._exits(left.distinct(), right.distinct(), scope, 0.65).isEmpty()
    for strict in (False, True):
        got = fuzzy.similar_pairs(left, right, scope, 0.65, strict).select(*scope, "left_key", "right_key").collect()
        a, b = ({r[2 - len(r):] if scope else r[1:] for r in df} for df in ([tuple(r) for r in left.collect()], [tuple(r) for r in right.collect()]))
        all_pairs = [(*x, y[-1]) for x in a for y in b if x[:-1] == y[:-1]]
        plain = spark.createDataFrame([(i, p[-2], p[-1]) for i, p in enumerate(all_pairs)], "i int, l string, r string").withColumn("s", edit_similarity(F.col("l"), F.col("r")))
        want = {all_pairs[r.i] for r in plain.where("s > 0.65" if strict else "s >= 0.65").collect()}
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_path_pieces(one):
    assert one(ancestors(F.col("x")), x="a.b[0].c") == ["a", "a.b", "a.b[0]"]
    assert [(s["n"], s["text"]) for s in one(suffixes(F.col("x")), x="a.b.c")] == [(2, "b.c"), (3, "a.b.c")]


@pytest.mark.parametrize("threshold,strict", [(0.65, False), (0.72, True), (0.9, False)])
def test_similar_pairs_loses_nothing(spark, threshold, strict):
    rnd = random.Random(3)
    words = ["nombre", "apellido", "primer", "segundo", "fecha", "de", "nacimiento", "la", "poliza"]
    texts = {" ".join(rnd.choices(words, k=rnd.randint(1, 4))) for _ in range(120)}
    texts |= {t.replace("e", "a", 1) for t in texts} | {t[1:] for t in texts if len(t) > 2} | {"a", "ab", "aaaa", "aaab"}
    names = sorted(texts)
    left = spark.createDataFrame([("f", t) for t in names[::2]], "form_id string, key string")
    right = spark.createDataFrame([("f", t) for t in names[1::2]], "form_id string, key string")
    got = fuzzy.similar_pairs(left, right, ["form_id"], threshold, strict)
    brute = left.alias("l").crossJoin(right.alias("r")).select(F.col("l.key").alias("a"), F.col("r.key").alias("b"))
    score = edit_similarity(F.col("a"), F.col("b"))
    want = brute.where(score > threshold if strict else score >= threshold)
    assert {(r.left_key, r.right_key) for r in got.collect()} == {(r.a, r.b) for r in want.collect()}


def test_typo_keys_against_brute_force(spark):
    rnd = random.Random(5)
    keys = ["".join(rnd.choices("abcd", k=rnd.randint(3, 9))) for _ in range(60)]
    names = [k[:i] + rnd.choice("abcdX") + k[i + rnd.randint(0, 2):] for k in keys for i in (0, len(k) // 2)]
    df = fuzzy.typo_keys(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(k,) for k in keys], "key string"))

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for n in set(names) - set(keys) - {""}:
        hits = [k for k in keys if (len(k) > 4 and lev(k.lower(), n.lower()) <= 2) or k.upper() == n.upper()]
        if hits:
            want[n] = min(hits)
    assert {r["name"]: r.suggestion for r in df.collect()} == want


def test_containing_pairs_against_brute_force(spark):
    rnd = random.Random(11)
    def some(n):
        return sorted({"".join(rnd.choices("abc ", k=rnd.randint(1, 6))).strip() for _ in range(n)} - {""})
    a, b = some(80), some(80)
    got = fuzzy.containing_pairs(spark.createDataFrame([("f", x) for x in a], "k string, key string"), spark.createDataFrame([("f", x) for x in b], "k string, key string"), ["k"])
    assert {(r.left_key, r.right_key) for r in got.collect()} == {(x, y) for x in a for y in b if x in y or y in x}


def test_texts_that_share_beginnings_and_ends_meet_few_others(spark):
    """sections that begin alike, end alike or both: candidates grow with the texts, not with their square"""
    def of(n, low):
        texts = [f"{a}{i:05d}{b}" for i in range(low, low + n) for a, b in (("datos generales de la persona asegurada ", ""), ("", " de la persona asegurada"), ("alta ", " de una persona"))]
        return spark.createDataFrame([("f", x) for x in texts], "k string, key string")
    counts = [fuzzy.containment_candidates(of(n, 0), of(n, n // 2), ["k"]).count() for n in (200, 800)]
    assert counts[1] <= 4.2 * counts[0] and counts[1] <= 4 * 2400
    left = spark.createDataFrame([("f", x) for x in ("\U0001F600\U0001F601\U0001F602", "\U0001F601", "á", None, "")], "k string, key string")
    right = spark.createDataFrame([("f", "\U0001F601\U0001F602"), ("g", "á"), (None, "á")], "k string, key string")
    got = {(r.left_key, r.right_key) for r in fuzzy.containing_pairs(left, right, ["k"]).collect()}
    assert got == {("\U0001F600\U0001F601\U0001F602", "\U0001F601\U0001F602"), ("\U0001F601", "\U0001F601\U0001F602")}


def test_one_key_with_sparse_order(spark):
    """every row is a slice of its own, in one key; rows are moved once for rows and totals"""
    df = spark.range(500).select(F.when(F.col("id") < 0, "b").alias("k"), ((F.col("id") * 7919) % 1000003).alias("ord"), (F.col("id") % 5).alias("v"))
    got = ordered_scan(df, ["k"], [F.col("ord")], F.floor(F.col("ord") / 10), number="n", running={"s": F.col("v")})
    out = sorted((r["ord"], r["n"], r["s"]) for r in got.collect())
    rows = sorted((r["ord"], r["v"]) for r in df.collect())
    assert out == [(o, i + 1, sum(v for _, v in rows[:i + 1])) for i, (o, _) in enumerate(rows)]
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()


def test_sparse_orders_are_cut_into_ranges(spark):
    """one key with hashed order values: slices by value would hold a row each, ranges do not"""
    from formspark import kernels

    rows = spark.range(5000).select(F.lit("k").alias("key"), F.xxhash64("id").alias("at"), F.col("id").alias("v")).unionByName(
        spark.createDataFrame([("a", 5, 1), ("a", -7, 2), (None, 3, 9)], "key string, at bigint, v bigint"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join ranges as small as these
    try:
        dealt, _ = kernels._dealt(rows, ["key"], None, [F.col("at")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in dealt.groupBy("_slice").count().collect()]
    assert len(sizes) <= 4 + 2 and max(sizes) < 3000  # at most a slice for each range, and two for where keys meet
    got = kernels.ordered_scan(rows, ["key"], [F.col("at")], None, number="n", running={"total": F.col("v")}, previous={"before": F.col("v")}).collect()
    for key in ("k", "a", None):
        mine = sorted((r for r in got if r["key"] == key), key=lambda r: r["at"])
        assert [r["n"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r["before"] for r in mine] == [None, *[r["v"] for r in mine[:-1]]]
        assert mine[-1]["total"] == sum(r["v"] for r in mine)
