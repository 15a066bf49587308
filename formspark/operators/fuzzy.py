"""Similarity joins without a cross join, and without losing a pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formspark.functions.text import edit_similarity, fold_upper
from formspark.kernels import by_key, first_by
from formspark.session import cut_lineage

_PAD = "\x01"
#: A beginning is looked at by itself from so many texts of a side on.
SHARED = 64


def _grams(keys: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, key, len, gram, pos) of padded bigrams, one row per occurrence"""
    padded = F.concat(F.lit(_PAD), F.col("key"), F.lit(_PAD))
    grams = F.transform(F.sequence(F.lit(1), F.length("key") + 1), lambda i: F.struct(
        F.substring(padded, i, F.lit(2)).alias("gram"), i.alias("pos")))
    return keys.select(*scope, "key", F.length("key").alias("len"), F.explode(grams).alias("g")).select(
        *scope, "key", "len", "g.gram", "g.pos")


def _rarest(grams: DataFrame, frequency: DataFrame, scope: Sequence[str], threshold: float) -> DataFrame:
    """The rarest bigrams of each text, as many as are needed to meet every partner.

    A text of n characters has n+1 padded bigrams and shares at least 1+(2t-1)n of them with
    any text of similarity t or more (each edit spoils two). So two such texts share one of
    their n+1-ceil((2t-1)n) rarest bigrams: frequent ones need not be joined on.
    """
    ranked = grams.join(by_key(frequency), "gram").groupBy(*scope, "key", "len").agg(
        F.array_sort(F.collect_list(F.struct("n", "gram", "pos"))).alias("all"))
    keep = F.greatest(F.lit(1), F.col("len") + 1 - F.ceil(F.lit(2 * threshold - 1) * F.col("len") - 1e-9)).cast("int")
    return ranked.select(*scope, "key", "len", F.explode(F.slice("all", F.lit(1), keep)).alias("g")).select(
        *scope, "key", "len", "g.gram", "g.pos")


def _head() -> Column:
    """the first half of a text"""
    return F.substring("key", F.lit(1), F.floor(F.length("key") / 2).cast("int"))


def _exits(lefts: DataFrame, rights: DataFrame, scope: Sequence[str], threshold: float) -> DataFrame:
    """(scope, lh, rh, exits): beginnings that many texts of a side share, where two texts that begin so and are similar can differ
    by one edit at most in what follows.

    An alignment of two texts leaves what lies within both beginnings at an exit (i, j): past the whole of one of them. It has
    spent the edits of these parts then, and what follows may take the rest of those the threshold allows.
    """
    def shared(df: DataFrame, name: str) -> DataFrame:
        counted = df.groupBy(*scope, _head().alias(f"{name}h")).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("key")).alias(f"{name}n"))
        return counted.where((F.col("n") >= SHARED) & (F.col(f"{name}h") != "")).drop("n")
    heads, others = shared(lefts, "l"), shared(rights, "r")
    both = heads.join(others, list(scope)) if scope else heads.crossJoin(others)
    most = F.floor(F.lit(1 - threshold) * F.greatest("ln", "rn") + 1e-9).cast("int")
    n, m = F.length("lh"), F.length("rh")

    def part(name: str, size: Column) -> Column:
        return F.substring(F.col(name), F.lit(1), size)

    def exit_at(i: Column, j: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), (F.col("most") - F.levenshtein(part("lh", i), part("rh", j))).alias("rest"))
    exits = F.concat(F.transform(F.sequence(F.lit(0), m), lambda j: exit_at(n, j)), F.transform(F.sequence(F.lit(0), n - 1), lambda i: exit_at(i, m)))
    found = both.withColumn("most", most).select(*scope, "lh", "rh", F.filter(exits, lambda x: x["rest"] >= 0).alias("exits"))
    return cut_lineage(found.where(~F.exists("exits", lambda x: x["rest"] > 1)))


def _after(texts: DataFrame, exits: DataFrame, scope: Sequence[str], name: str, at: str) -> DataFrame:
    """(scope, lh, rh, i, j, rest, key): what follows an exit, and that less any one character where an edit is left: two texts
    within one edit have one of these in common"""
    told = exits.select(*scope, "lh", "rh", F.explode("exits").alias("x")).select(*scope, "lh", "rh", "x.i", "x.j", F.col("x.rest").alias("left"))
    met = texts.withColumn(name, _head()).join(told, [*scope, name]).withColumn("rest", F.substr("key", F.col(at) + 1))
    without = F.transform(F.sequence(F.lit(1), F.length("rest")), lambda k: F.concat(F.substring(F.col("rest"), F.lit(1), k - 1), F.substr("rest", k + 1)))
    less = F.when((F.col("left") > 0) & (F.length("rest") > 0), without).otherwise(F.array().cast("array<string>"))
    return met.select(*scope, "lh", "rh", "i", "j", F.explode(F.array_distinct(F.concat(F.array("rest"), less))).alias("rest"), "key")


def similar_pairs(left: DataFrame, right: DataFrame, scope: Sequence[str], threshold: float, strict: bool = False) -> DataFrame:
    """All pairs of distinct ``key`` texts with edit similarity >= (or >) ``threshold``.

    Exact for any threshold above one half. Texts are made distinct first, so copies cost
    nothing; candidates share a rare bigram at a near position and have close lengths. Where many texts
    begin alike and so differ from those of the other side that one edit is left, they are met by what follows instead.
    """
    if threshold <= 0.5:
        raise ValueError("the bigram bound needs a threshold above 0.5")
    lefts = left.select(*scope, "key").where(F.col("key") != "").distinct()
    rights = right.select(*scope, "key").where(F.col("key") != "").distinct()
    exits = _exits(lefts, rights, scope, threshold)
    lg, rg = _grams(lefts, scope), _grams(rights, scope)
    frequency = lg.select("gram").unionAll(rg.select("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    a = _rarest(lg, frequency, scope, threshold).withColumnsRenamed({"key": "left_key", "len": "la", "pos": "pa"})
    b = _rarest(rg, frequency, scope, threshold).withColumnsRenamed({"key": "right_key", "len": "lb", "pos": "pb"})
    most = F.floor(F.lit(1 - threshold) * F.greatest("la", "lb") + 1e-9).cast("int")
    near = (F.abs(F.col("la") - F.col("lb")) <= most) & (F.abs(F.col("pa") - F.col("pb")) <= most)
    on = [*scope, "gram"]
    apart = not exits.isEmpty()
    if apart:
        a, b, on = *_kinds(a, b, exits, scope), [*on, "kind"]
    pairs = a.join(by_key(b), on).where(near).select(*scope, "left_key", "right_key")
    if apart:
        met = _after(lefts, exits, scope, "lh", "i").withColumnRenamed("key", "left_key")
        met = met.join(by_key(_after(rights, exits, scope, "rh", "j").withColumnRenamed("key", "right_key")), [*scope, "lh", "rh", "i", "j", "rest"])
        pairs = pairs.unionByName(met.select(*scope, "left_key", "right_key"))
    scored = pairs.distinct().withColumn("score", edit_similarity(F.col("left_key"), F.col("right_key")))
    return scored.where(F.col("score") > threshold if strict else F.col("score") >= threshold)


def _kinds(a: DataFrame, b: DataFrame, exits: DataFrame, scope: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """bigrams of both sides with a ``kind`` to be joined on as well, so that texts whose beginnings have exits do not meet by their bigrams.

    On the right a text without such a beginning is of the kind "", another of the kinds "*" and of its beginning. On the left a text without one
    asks for "" and "*", another for "" and for the beginnings that have no exits with its own.
    """
    others = exits.select(*scope, "rh").distinct()
    heads = exits.select(*scope, "lh").distinct()
    both = heads.join(others, list(scope)) if scope else heads.crossJoin(others)
    open_to = both.join(exits.select(*scope, "lh", "rh"), [*scope, "lh", "rh"], "left_anti").groupBy(*scope, "lh").agg(F.collect_list(F.concat(F.lit("="), "rh")).alias("_more"))
    asks = heads.join(open_to, [*scope, "lh"], "left").select(*scope, F.col("lh").alias("_head"), F.concat(F.array(F.lit("")), F.coalesce("_more", F.array().cast("array<string>"))).alias("_kinds"))
    is_of = others.select(*scope, F.col("rh").alias("_head"), F.array(F.lit("*"), F.concat(F.lit("="), "rh")).alias("_kinds"))

    def dealt(df: DataFrame, key: str, known: DataFrame, plain: Column) -> DataFrame:
        told = df.withColumnRenamed(key, "key").withColumn("_head", _head()).withColumnRenamed("key", key).join(known, [*scope, "_head"], "left")
        return told.withColumn("kind", F.explode(F.coalesce("_kinds", plain))).drop("_head", "_kinds")
    return dealt(a, "left_key", asks, F.array(F.lit(""), F.lit("*"))), dealt(b, "right_key", is_of, F.array(F.lit("")))


def best_similar(left: DataFrame, left_id: Sequence[str], right: DataFrame, right_order: Sequence[str], right_cols: Sequence[str],
                 scope: Sequence[str], threshold: float, strict: bool = True) -> DataFrame:
    """For each left row (with a ``key``) the right row of the most similar key; the first
    right row on ties. Several keys per left row may be given with a ``key_rank``."""
    index = first_by(right.where(F.col("key") != ""), [*scope, "key"], right_order, [*right_order, *[c for c in right_cols if c not in right_order]])
    pairs = similar_pairs(left, index, scope, threshold, strict)
    # best partner per distinct text first: copies on the left then join one row each
    hits = pairs.join(by_key(index.withColumnRenamed("key", "right_key")), [*scope, "right_key"])
    cols = list(dict.fromkeys(["right_key", "score", *right_order, *right_cols]))
    best = hits.groupBy(*scope, "left_key").agg(F.min_by(F.struct(*cols), F.struct(-F.col("score"), *right_order)).alias("b"))
    found = left.join(by_key(best.withColumnRenamed("left_key", "key")), [*scope, "key"])
    rank = [F.col("key_rank")] if "key_rank" in left.columns else []
    ids = [*scope, *[c for c in left_id if c not in scope]]
    return found.groupBy(*ids).agg(F.min_by(F.struct("key", "b.*"), F.struct(-F.col("b.score"), *rank)).alias("m")).select(*ids, "m.*")


def contained_words(left: DataFrame, right: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Pairs (left_key, right_key) where every word of the left text is a word of the right.

    Each left text probes with its rarest word only, then the rest is verified; a word as
    common as "de" is joined on only by texts made of such words alone.
    """
    lefts = left.select(*scope, "key").where(F.col("key") != "").distinct()
    rights = right.select(*scope, "key").where(F.col("key") != "").distinct().withColumn("words", F.array_distinct(F.split("key", " ")))
    spread = rights.select(*scope, F.col("key").alias("right_key"), "words", F.explode("words").alias("word"))
    frequency = spread.groupBy(*scope, "word").agg(F.count(F.lit(1)).alias("n"))
    probe = lefts.select(*scope, F.col("key").alias("left_key"), F.explode(F.array_distinct(F.split("key", " "))).alias("word"))
    probe = probe.join(by_key(frequency), [*scope, "word"], "left").groupBy(*scope, "left_key").agg(
        F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    pairs = probe.join(by_key(spread), [*scope, "word"])
    return pairs.where(F.size(F.array_except(F.split("left_key", " "), "words")) == 0).select(*scope, "left_key", "right_key")


def typo_keys(names: DataFrame, known: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Names missing from a key list but folded-equal to, or within two edits of, a longer
    than four letter key: (name, suggestion).

    Two edits leave one of three consecutive parts of a text untouched, moved by at most
    two places, so the parts of each key are met with the substrings of each name.
    """
    wanted = names.select(*scope, "name").where(F.col("name") != "").distinct()
    keys = known.select(*scope, F.col("key")).distinct()
    missing = wanted.join(keys.withColumnRenamed("key", "name"), [*scope, "name"], "left_anti").withColumn("low", F.lower("name"))
    rights = keys.withColumn("low", F.lower("key")).withColumn("size", F.length("low"))
    step = F.floor(F.col("size") / 3).cast("int")
    parts = F.array(F.struct(F.lit(1).alias("at"), step.alias("n")), F.struct((step + 1).alias("at"), step.alias("n")),
                    F.struct((step * 2 + 1).alias("at"), (F.col("size") - step * 2).alias("n")))
    blocks = rights.where(F.col("size") > 4).select(*scope, "key", F.col("low").alias("key_low"), "size", F.explode(parts).alias("p")).select(
        *scope, "key", "key_low", "size", F.col("p.at").alias("at"), F.substring("key_low", F.col("p.at"), F.col("p.n")).alias("part"))

    def pieces(low: Column) -> Column:
        """substrings that may equal a part of a key two lengths apart at most"""
        def of(delta: Column) -> Column:
            n = F.length(low) + delta
            s = F.floor(n / 3).cast("int")
            marks = F.array(F.struct(F.lit(1).alias("at"), s.alias("n")), F.struct((s + 1).alias("at"), s.alias("n")),
                            F.struct((s * 2 + 1).alias("at"), (n - s * 2).alias("n")))
            return F.flatten(F.transform(marks, lambda m: F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda shift: F.when(
                (m.at + shift >= 1) & (m.n > 0), F.struct(n.alias("size"), m.at.alias("at"), F.substring(low, m.at + shift, m.n).alias("part"))))))
        return F.flatten(F.transform(F.sequence(F.lit(-2), F.lit(2)), of))

    probe = missing.select(*scope, "name", "low", F.explode(F.array_distinct(F.filter(pieces(F.col("low")), lambda x: x.isNotNull()))).alias("q")).select(
        *scope, "name", "low", "q.*")
    near = probe.join(blocks, [*scope, "size", "at", "part"]).where(F.levenshtein("low", "key_low", 2) >= 0).select(*scope, "name", "key")
    same = missing.withColumn("f", fold_upper("name")).join(keys.withColumn("f", fold_upper("key")), [*scope, "f"]).select(*scope, "name", "key")
    return near.unionByName(same).groupBy(*scope, "name").agg(F.min("key").alias("suggestion"))


def _parts(size: Column) -> Column:
    """hashes of the distinct parts of ``key`` that are ``size`` long"""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("key") - size + 1), lambda i: F.xxhash64(F.substring("key", i, size))))


def containment_candidates(left: DataFrame, right: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, side, short, long): pairs that share the rarest long part of the shorter text; ``side`` is the side of the longer one,
    0 left and 1 right.

    A text probes with parts of one length, the greatest power of two that fits. They are longer than half of
    it, so that the first and the last of them cover all of it: whatever beginning or end many texts share,
    some part holds what tells this one apart, and the rarest part is the only one it is joined on. The other
    side shows its parts of the lengths that are asked for, as hashes of fixed size.
    """
    both = left.select(*scope, F.lit(0).alias("side"), "key").unionByName(right.select(*scope, F.lit(1).alias("side"), "key"))
    texts = cut_lineage(both.where(F.col("key") != "").distinct().withColumn("size", F.expr("shiftleft(1, length(bin(length(key))) - 1)")))
    at = [*scope, "side"]
    other = (1 - F.col("side")).alias("side")
    wanted = texts.groupBy(*scope, other).agg(F.collect_set("size").alias("sizes"))  # powers of two: a handful
    shown = texts.drop("size").join(wanted, at).select(*at, "key", F.explode("sizes").alias("size")).where(F.length("key") >= F.col("size")).select(
        *at, F.col("key").alias("long"), F.explode(_parts(F.col("size"))).alias("part"))
    frequency = shown.groupBy(*at, "part").agg(F.count(F.lit(1)).alias("n"))
    own = texts.select(*scope, other, F.col("key").alias("short"), F.explode(_parts(F.col("size"))).alias("part"))
    probe = own.join(frequency, [*at, "part"], "left").groupBy(*at, "short").agg(F.min_by("part", F.struct(F.coalesce("n", F.lit(0)), "part")).alias("part"))
    return probe.join(shown, [*at, "part"]).select(*at, "short", "long")


def containing_pairs(left: DataFrame, right: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Pairs (left_key, right_key) of distinct texts where one contains the other: both directions in one join."""
    met = containment_candidates(left, right, scope).where(F.col("long").contains(F.col("short")))
    on_left = F.col("side") == 0
    return met.select(*scope, F.when(on_left, F.col("long")).otherwise(F.col("short")).alias("left_key"),
                      F.when(on_left, F.col("short")).otherwise(F.col("long")).alias("right_key")).distinct()
