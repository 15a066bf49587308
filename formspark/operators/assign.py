"""Greedy one-to-one matching in row order.

Takers (matrix rows, or widgets) choose one after the other from a pool; what one takes is gone for those
after it. Who may take what is known from texts alone: a taker has a key for each stage, a key reaches
classes of the pool (an equal label, labels that contain it, similar labels), and a class is a list of
units in order. So the frontier of settled takers moves by blocks: a block of takers meets the classes it
reaches, of each as many free units as takers of the block reach it and two more, which is all that the
order can ever touch. What it takes leaves the pool, and the next block follows.

Takers that share no class, directly or through others, never meet: forms of more than a block are split
into connected parts, and the blocks of all parts and forms go side by side. A form within one block is
one step. No task ever holds more than a block of takers and what they reach. The pool is numbered once;
a block reads on from there, past as many places as have been taken.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from math import floor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formspark.functions import text as T
from formspark.kernels import SLICE, connected, ordered_scan, spread
from formspark.operators.fuzzy import containing_pairs, similar_pairs
from formspark.session import cut_lineage

BLOCK = 1 << 14
#: Confidence from which a match takes its unit out of the pool.
TAKES = 75


@dataclass(frozen=True)
class Stage:
    """How a taker chooses among the free units that its key of this stage reaches.

    ``unique``: the only one; several end the search as ``ambiguous``. ``first``: the first in order.
    ``best``: the first of the highest score, which is also the confidence, in hundredths.
    """

    source: str
    rule: str = "first"
    confidence: int = 100
    ambiguous: str = ""
    ambiguous_confidence: int = 50


_COLUMNS = ["ord", "pool_ord", "unit", "confidence", "source", "n_candidates"]


def _settle(records: pd.DataFrame, stages: Sequence[Stage]) -> list[tuple]:
    """Choices of one block, in order."""
    reach: dict[tuple[int, str], list[tuple[float, str]]] = defaultdict(list)
    free: dict[str, int] = {}
    units: dict[str, list[tuple[int, str, int]]] = defaultdict(list)       # class: (order, unit, rows)
    classes: dict[str, list[tuple[str, int]]] = defaultdict(list)          # unit: (class, rows)
    takers = []
    for kind, number, a, b, score, rows, keys in records.itertuples(index=False):
        if kind == 0:
            takers.append((number, keys))
        elif kind == 1:
            reach[int(number), a].append((-score, b))
        elif kind == 2:
            free[b] = rows
        else:
            units[b].append((number, a, rows))
            classes[a].append((b, rows))
    for found in units.values():
        found.sort()
    for found in reach.values():
        found.sort()
    gone: set[str] = set()
    at: dict[str, int] = defaultdict(int)

    def first(names: Sequence[str]) -> tuple[int, str]:
        """first free unit of some classes, as (order, unit)"""
        best = None
        for name in names:
            listed = units[name]
            while at[name] < len(listed) and listed[at[name]][1] in gone:
                at[name] += 1
            if at[name] < len(listed) and (best is None or listed[at[name]][:2] < best):
                best = listed[at[name]][:2]
        assert best is not None, "a class with free units lists some"
        return best

    out = []
    for taker, keys in sorted(takers, key=lambda t: t[0]):
        for k, stage in enumerate(stages):
            there = [(score, name) for score, name in reach.get((k, keys[k]), ()) if free.get(name, 0) > 0] if keys[k] else []
            if not there:
                continue
            total = sum(free[name] for _, name in there)
            if stage.rule == "unique" and total > 1:
                out.append((taker, None, None, stage.ambiguous_confidence, stage.ambiguous, total))
                break
            names = [name for score, name in there if stage.rule != "best" or score == there[0][0]]
            order, unit = first(names)
            confidence = floor(-there[0][0] * 100 + 0.5) if stage.rule == "best" else stage.confidence
            out.append((taker, order, unit, confidence, stage.source, 1))
            if confidence >= TAKES:
                gone.add(unit)
                for name, rows in classes[unit]:
                    free[name] -= rows
            break
    return out


def greedy(takers: DataFrame, reach: DataFrame, pool: DataFrame, stages: Sequence[Stage], scope: Sequence[str] = ("form_id",), block: int = BLOCK) -> DataFrame:
    """(scope, ord, pool_ord, unit, confidence, source, n_candidates) of every taker that finds something.

    takers: scope, ord (unique in a scope), keys (a text for each stage; empty or NULL leaves it out);
    reach: scope, stage, key, class, score; pool: scope, class, unit, ord. Rows of one unit are taken
    together; the first of them that is in the class gives ``pool_ord``.
    """
    scope = list(scope)
    reach = cut_lineage(reach.select(*scope, "stage", "key", "class", "score").distinct())
    pool = cut_lineage(pool.groupBy(*scope, "class", "unit").agg(F.min("ord").alias("pool_ord"), F.count(F.lit(1)).alias("rows")))
    reach = cut_lineage(reach.join(pool.select(*scope, "class").distinct(), [*scope, "class"], "left_semi"))
    live = reach.select(*scope, "stage", "key").distinct()
    probes = takers.select(*scope, "ord", "keys", F.posexplode("keys").alias("stage", "key"))
    able = probes.join(live, [*scope, "stage", "key"], "left_semi").groupBy(*scope, "ord", "keys").agg(F.collect_set("stage").alias("_live"))
    # a key that reaches nothing is none, so that takers that differ in such keys alone have one profile
    able = able.select(*scope, "ord", F.transform("keys", lambda key, k: F.when(F.array_contains("_live", k), key)).alias("keys"))
    able = cut_lineage(able.withColumn("profile", F.xxhash64(*scope, "keys")))
    # places among all of a class: a block reads on from them, whatever has been taken before it
    pool = pool.join(reach.select(*scope, "class").distinct(), [*scope, "class"], "left_semi")
    pool = cut_lineage(ordered_scan(pool, [*scope, "class"], [F.col("pool_ord"), F.col("unit")], F.floor(F.col("pool_ord") / SLICE), number="place", whole={"total": F.col("rows")}))

    large = able.groupBy(*scope).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select(*scope)
    if large.limit(1).count():
        parts = _parts(able.join(large, scope, "left_semi"), reach.join(large, scope, "left_semi"), pool.join(large, scope, "left_semi"), scope)
        able = able.join(parts, "profile", "left").withColumn("part", F.coalesce("part", F.lit(0)))
        # ids may lie far apart: ranges of about as many takers each
        numbered = ordered_scan(able.drop("profile"), [*scope, "part"], [F.col("ord")], None, number="n")
        numbered = cut_lineage(numbered.withColumn("block", F.floor((F.col("n") - 1) / block)).drop("n"))
    else:
        numbered = able.drop("profile").withColumns({"part": F.lit(0).cast("long"), "block": F.lit(0).cast("long")})
    last = numbered.agg(F.max("block")).first()[0]

    results = gone = None
    for step in range(0 if last is None else last + 1):
        found, entries = _step(numbered.where(F.col("block") == step), reach, pool, gone, stages, scope)
        results = found if results is None else results.unionByName(found)
        if step < last:
            took = found.where(F.col("unit").isNotNull() & (F.col("confidence") >= TAKES)).select(*scope, "unit").distinct()
            took = cut_lineage(entries.join(took, [*scope, "unit"], "left_semi"))
            gone = took if gone is None else gone.unionByName(took)
    if results is None:
        types = {**dict(takers.select(*scope, "ord").dtypes), "pool_ord": "bigint", "unit": "string", "confidence": "int", "source": "string", "n_candidates": "bigint"}
        return takers.select(*[F.lit(None).cast(t).alias(c) for c, t in types.items()]).where(F.lit(False))
    return results


def _parts(takers: DataFrame, reach: DataFrame, pool: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(profile, part): profiles that share a class, directly or through others, are of one part.

    Profiles are linked to their keys, keys to their classes, and classes to others that hold a unit of theirs:
    distinct links, that do not grow with the copies of a text."""
    def node(kind: str, *cols: str) -> Column:
        return F.xxhash64(*scope, F.lit(kind), *cols)

    keys = takers.select(*scope, "keys", "profile").distinct().select(*scope, "profile", F.posexplode("keys").alias("stage", "key")).where(F.col("key").isNotNull())
    edges = keys.select(F.col("profile").alias("u"), node("key", "stage", "key").alias("v"))
    edges = edges.unionByName(reach.select(node("key", "stage", "key").alias("u"), node("class", "class").alias("v")))
    shared = pool.join(pool.groupBy(*scope, "unit").agg(F.min("class").alias("least"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), [*scope, "unit"])
    edges = edges.unionByName(shared.where(F.col("class") != F.col("least")).select(node("class", "class").alias("u"), node("class", "least").alias("v")))
    return connected(edges.distinct()).join(keys.select("profile").distinct(), F.col("node") == F.col("profile")).select("profile", F.col("label").alias("part"))


def _step(rows: DataFrame, reach: DataFrame, pool: DataFrame, gone: DataFrame | None, stages: Sequence[Stage], scope: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The choices of one block of every part of every form, and the pool's entries of all units that it could take.

    ``gone`` are the entries of units that earlier blocks took. A class of which so many are gone has its next free units
    among as many places more, so that no block numbers a pool again."""
    probes = rows.select(*scope, "part", "ord", F.posexplode("keys").alias("stage", "key"))
    keys = probes.groupBy(*scope, "part", "stage", "key").agg(F.count(F.lit(1)).alias("n"))
    met = cut_lineage(keys.join(reach, [*scope, "stage", "key"]))
    needs = met.groupBy(*scope, "part", "class").agg((F.sum("n") + 2).alias("need"))
    if gone is None:
        needs = needs.withColumns({"_units": F.lit(0).cast("long"), "_rows": F.lit(0).cast("long")})
    else:
        taken = gone.groupBy(*scope, "class").agg(F.count(F.lit(1)).alias("_units"), F.sum("rows").alias("_rows"))
        needs = needs.join(taken, [*scope, "class"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("_units", "_rows")})
    needs = cut_lineage(needs)
    near = pool.join(needs, [*scope, "class"]).where(F.col("place") <= F.col("need") + F.col("_units"))
    if gone is not None:
        near = cut_lineage(near.join(gone.select(*scope, "unit").distinct(), [*scope, "unit"], "left_anti"))
        near = ordered_scan(near, [*scope, "part", "class"], [F.col("place")], F.floor(F.col("place") / SLICE), number="_free").where(F.col("_free") <= F.col("need"))
    entries = cut_lineage(pool.join(near.select(*scope, "part", "unit").distinct(), [*scope, "unit"]))
    listed = entries.join(needs, [*scope, "part", "class"], "left_semi")
    first = pool.where(F.col("place") == 1).select(*scope, "class", "total")
    totals = needs.join(first, [*scope, "class"]).withColumn("rows", F.col("total") - F.col("_rows"))

    def record(df: DataFrame, kind: int, number: Column, a: Column, b: Column, score: Column, n: Column, own: Column) -> DataFrame:
        return df.select(*scope, "part", F.lit(kind).alias("kind"), number.cast("long").alias("number"), a.cast("string").alias("a"), b.cast("string").alias("b"),
                         score.cast("double").alias("score"), n.cast("long").alias("rows"), own.cast("array<string>").alias("keys"))

    none = F.lit(None)
    both = record(rows, 0, F.col("ord"), none, none, F.lit(0), F.lit(0), F.col("keys"))
    both = both.unionByName(record(met, 1, F.col("stage"), F.col("key"), F.col("class"), F.col("score"), F.lit(0), none))
    both = both.unionByName(record(totals, 2, F.lit(0), none, F.col("class"), F.lit(0), F.col("rows"), none))
    both = both.unionByName(record(listed, 3, F.col("pool_ord"), F.col("unit"), F.col("class"), F.lit(0), F.col("rows"), none))
    names = list(scope)

    def settle(key: tuple, records: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_settle(records[["kind", "number", "a", "b", "score", "rows", "keys"]], stages), columns=_COLUMNS)
        out["pool_ord"] = out["pool_ord"].astype("Int64")
        for at, name in enumerate(names):
            out.insert(at, name, key[at])
        return out

    types = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in names], "ord bigint, pool_ord bigint, unit string, confidence int, source string, n_candidates bigint"])
    found = cut_lineage(both.groupBy(*names, "part").applyInPandas(settle, schema))
    return found, entries.select(*scope, "class", "unit", "rows")


# ---- rows and widgets -------------------------------------------------------------------------

CROSS_STAGES = [Stage("exact-pdf-name"), Stage("pdf-label", "unique", 90, "ambiguous-label"), Stage("form-label", "unique", 75, "ambiguous-form-label"), Stage("fuzzy", "best")]
FUZZY_FROM = 0.65


def _similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).otherwise((longest - F.levenshtein(a, b)) / longest)


def cross_match(rows: DataFrame, widgets: DataFrame, scope: Sequence[str] = ("form_id",), block: int = BLOCK) -> DataFrame:
    """The widget of every row, chosen in row order: the widget of that name (100); the only one of the row's
    PDF label (90), several are ambiguous (50); the only one whose label contains the form label or is
    contained in it (75), several are ambiguous (50); the most similar label from 0.65 on. A match of 75
    or more takes the widget, by its name; rows are returned once each, without a match as well.

    rows: scope, ord, pdf_field_name, pdf_label, field_label; widgets: scope, ord, name, label.
    Adds widget_ord, widget_name, confidence, source, n_candidates.
    """
    scope = list(scope)
    label = T.norm_compact("label")
    target, pdf, form = T.trim(T.text_or_empty("pdf_field_name")), T.norm_compact("pdf_label"), T.norm_compact("field_label")
    search = F.when(form != "", form).otherwise(pdf)
    takers = cut_lineage(rows.select(*scope, "ord", F.array(target, pdf, form, search).alias("keys")))
    named = cut_lineage(widgets.where(F.col("name").isNotNull()).select(*scope, F.col("name").alias("unit"), "ord", label.alias("label")))
    labelled = named.where(F.col("label") != "")
    pool = named.select(*scope, F.concat(F.lit("n:"), "unit").alias("class"), "unit", "ord").unionByName(
        labelled.select(*scope, F.concat(F.lit("l:"), "label").alias("class"), "unit", "ord"))

    def of(stage: int) -> DataFrame:
        return takers.select(*scope, F.get("keys", F.lit(stage)).alias("key")).where(F.col("key") != "").distinct()

    texts = labelled.select(*scope, F.col("label").alias("key")).distinct()
    inside = containing_pairs(of(2), texts, scope).select(*scope, F.col("left_key").alias("key"), F.col("right_key").alias("there"), F.lit(0.0).alias("score"))
    alike = similar_pairs(of(3), texts, scope, FUZZY_FROM - 1e-9).select(*scope, F.col("left_key").alias("key"), F.col("right_key").alias("there"))
    alike = alike.withColumn("score", _similarity(F.col("key"), F.col("there"))).where(F.col("score") >= FUZZY_FROM)

    def reached(df: DataFrame, stage: int, prefix: str, there: str, score: Column) -> DataFrame:
        return df.select(*scope, F.lit(stage).alias("stage"), "key", F.concat(F.lit(prefix), there).alias("class"), score.alias("score"))

    reach = reached(of(0), 0, "n:", "key", F.lit(0.0)).unionByName(reached(of(1), 1, "l:", "key", F.lit(0.0))).unionByName(
        reached(inside, 2, "l:", "there", F.lit(0.0))).unionByName(reached(alike, 3, "l:", "there", F.col("score")))
    found = greedy(takers, reach, pool, CROSS_STAGES, scope, block)
    found = found.select(*scope, "ord", F.col("pool_ord").alias("widget_ord"), F.col("unit").alias("widget_name"), "confidence", "source", "n_candidates")
    return rows.join(found, [*scope, "ord"], "left")


def cross_match_multi(rows: DataFrame, widgets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``cross_match`` of every row against each PDF of its form by itself, then the match of highest
    confidence, the first PDF's on ties.

    rows: as for ``cross_match``; widgets: form_id, pdf, pdf_ord, ord, name, label. Adds pdf as well.
    """
    pdfs = widgets.groupBy("form_id", "pdf").agg(F.min("pdf_ord").alias("pdf_ord"))
    each = cross_match(rows.join(pdfs, "form_id"), widgets.drop("pdf_ord"), ["form_id", "pdf"], block)
    cols = ["widget_ord", "widget_name", "confidence", "source", "n_candidates", "pdf"]
    best = each.where(F.col("source").isNotNull()).groupBy("form_id", "ord").agg(
        F.min_by(F.struct(*cols), F.struct(-F.col("confidence"), F.col("pdf_ord"), F.col("pdf"))).alias("best"))
    return rows.join(best.select("form_id", "ord", "best.*"), ["form_id", "ord"], "left")


#: Words of a section's name, and the words of a path that belong to it; the first that is met decides.
SECTION_WORDS = [(["solicitante", "asegurado"], ["asegurado", "solicitante"]), (["beneficiario"], ["beneficiario"]), (["tomador", "firma"], ["tomador", "firma"]),
                 (["poliza"], ["poliza"]), (["vigencia"], ["vigencia"]), (["notificacion"], ["notificacion"])]
SECTION_STAGES = [Stage("label-in-section"), Stage("label"), Stage("pdf-name"), Stage("contains")]
LEAST_CONTAINED = 4


def _any(c: Column, words: Sequence[str]) -> Column:
    out = c.contains(words[0])
    for w in words[1:]:
        out = out | c.contains(w)
    return out


def match_in_section(widgets: DataFrame, rows: DataFrame, scope: Sequence[str] = ("form_id",), block: int = BLOCK) -> DataFrame:
    """The matrix row of every widget, chosen in the widgets' order, each row once: the first row of its label
    whose path belongs to the widget's section, of its label, of its name as PDF label, and the first whose
    label contains it or is contained in it (labels of four letters or more).

    widgets: scope, ord, name, label, section; rows: scope, ord, field_label, pdf_label, json_name.
    Adds row_ord and source.
    """
    scope = list(scope)
    label, name, section, path = (T.norm_compact(c) for c in ("label", "name", "section", "json_name"))
    kind = F.coalesce(*[F.when(_any(section, words), F.lit(str(k))) for k, (words, _) in enumerate(SECTION_WORDS)])
    kinds = F.filter(F.array(*[F.when(_any(path, words), F.lit(str(k))) for k, (_, words) in enumerate(SECTION_WORDS)]), lambda k: k.isNotNull())
    here = F.when(kind.isNotNull() & (label != ""), F.concat_ws(":", kind, label))
    takers = cut_lineage(spread(widgets.select(*scope, "ord", "name", "label", "section")).select(*scope, "ord", F.array(here, label, name, F.when(F.length(label) >= LEAST_CONTAINED, label)).alias("keys")))
    base = cut_lineage(spread(rows.select(*scope, "ord", "field_label", "pdf_label", "json_name")).select(*scope, F.col("ord").cast("string").alias("unit"), "ord", T.norm_compact("field_label").alias("label"), T.norm_compact("pdf_label").alias("pdf"), kinds.alias("kinds")))

    def pooled(df: DataFrame, prefix: str, there: Column) -> DataFrame:
        return df.select(*scope, F.concat(F.lit(prefix), there).alias("class"), "unit", "ord")

    with_label = base.where(F.col("label") != "")
    placed = with_label.select("*", F.explode("kinds").alias("kind"))
    pool = pooled(placed, "s:", F.concat_ws(":", "kind", "label")).unionByName(pooled(with_label, "l:", F.col("label"))).unionByName(
        pooled(base.where(F.col("pdf") != ""), "p:", F.col("pdf")))

    def of(stage: int) -> DataFrame:
        return takers.select(*scope, F.get("keys", F.lit(stage)).alias("key")).where(F.col("key") != "").distinct()

    def equal(stage: int, prefix: str) -> DataFrame:
        return of(stage).select(*scope, F.lit(stage).alias("stage"), "key", F.concat(F.lit(prefix), "key").alias("class"), F.lit(0.0).alias("score"))

    inside = containing_pairs(of(3), with_label.select(*scope, F.col("label").alias("key")).distinct(), scope)
    inside = inside.select(*scope, F.lit(3).alias("stage"), F.col("left_key").alias("key"), F.concat(F.lit("l:"), "right_key").alias("class"), F.lit(0.0).alias("score"))
    reach = equal(0, "s:").unionByName(equal(1, "l:")).unionByName(equal(2, "p:")).unionByName(inside)
    found = greedy(takers, reach, pool, SECTION_STAGES, scope, block).select(*scope, "ord", F.col("pool_ord").alias("row_ord"), "source")
    return widgets.join(found, [*scope, "ord"], "left")
