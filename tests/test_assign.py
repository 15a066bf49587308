"""Greedy matching in row order against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from formspark.kernels import connected
from formspark.operators import assign


def _edit(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        here = [i]
        for j, y in enumerate(b, 1):
            here.append(min(last[j] + 1, here[-1] + 1, last[j - 1] + (x != y)))
        last = here
    return last[-1]


def _loop(rows, widgets):
    """the row-order loop over one form"""
    gone, out = set(), {}
    for ord_, target, pdf, form in rows:
        live = [w for w in widgets if w[1] not in gone]
        hit = next((w for w in live if target and w[1] == target), None)
        found = None
        if hit:
            found = (hit[0], hit[1], 100, "exact-pdf-name", 1)
        elif pdf and (same := [w for w in live if w[2] == pdf]):
            found = (same[0][0], same[0][1], 90, "pdf-label", 1) if len(same) == 1 else (None, None, 50, "ambiguous-label", len(same))
        elif form and (inside := [w for w in live if w[2] and (form in w[2] or w[2] in form)]):
            found = (inside[0][0], inside[0][1], 75, "form-label", 1) if len(inside) == 1 else (None, None, 50, "ambiguous-form-label", len(inside))
        elif form or pdf:
            text = form or pdf
            near = [((max(len(text), len(w[2])) - _edit(text, w[2])) / max(len(text), len(w[2])), w) for w in live if w[2]]
            near = sorted((n for n in near if n[0] >= 0.65), key=lambda n: -n[0])
            if near:
                found = (near[0][1][0], near[0][1][1], int(near[0][0] * 100 + 0.5), "fuzzy", 1)
        if found:
            out[ord_] = found
            if found[1] is not None and found[2] >= 75:
                gone.add(found[1])
    return out


def _tables(spark, seed, n, labels):
    rng = random.Random(seed)
    rows, widgets = [], []
    for k in range(n):
        rows.append(("f", k, rng.choice(["", "", None, f"w{rng.randrange(n)}"]), rng.choice([None, "", *labels]), rng.choice(["", *labels])))
        widgets.append(("f", k, f"w{rng.choice([k, k, rng.randrange(n)])}", rng.choice(["", *labels])))
    return (spark.createDataFrame(rows, "form_id string, ord bigint, pdf_field_name string, pdf_label string, field_label string"),
            spark.createDataFrame(widgets, "form_id string, ord bigint, name string, label string"),
            [(r[1], r[2] or "", r[3] or "", r[4]) for r in rows], [w[1:] for w in widgets])


LABELS = ["nombre", "nombre completo", "nombres", "apellido", "apelido", "fecha de pago", "fecha de pagos", "valor", "vlaor", "x", "ciudad de pago"]


@pytest.mark.parametrize(("seed", "n", "block"), [(1, 40, 1 << 14), (2, 40, 9)])
def test_cross_match_equals_the_loop(spark, seed, n, block):
    rows, widgets, plain_rows, plain_widgets = _tables(spark, seed, n, LABELS)
    got = {r["ord"]: (r["widget_ord"], r["widget_name"], r["confidence"], r["source"], r["n_candidates"])
           for r in assign.cross_match(rows, widgets, block=block).collect() if r["source"]}
    assert got == _loop(plain_rows, plain_widgets)
    taken = [g[1] for g in got.values() if g[1] is not None and g[2] >= 75]
    assert len(taken) == len(set(taken))


def test_a_hot_label_goes_by_blocks(spark):
    """5,000 rows and widgets of one label, and as many that name their widget: blocks, never the whole form"""
    n = 5000
    rows = spark.range(2 * n).select(F.lit("f").alias("form_id"), F.col("id").alias("ord"), F.when(F.col("id") % 2 == 1, F.concat(F.lit("w"), F.floor(F.col("id") / 2).cast("int"))).alias("pdf_field_name"),
                                     F.lit("valor").alias("pdf_label"), F.lit("").alias("field_label"))
    widgets = spark.range(n).select(F.lit("f").alias("form_id"), F.col("id").alias("ord"), F.concat(F.lit("w"), "id").alias("name"), F.lit("valor").alias("label"))
    out = assign.cross_match(rows, widgets, block=4000)
    counts = {(r["source"], r["confidence"]): r["count"] for r in out.groupBy("source", "confidence").count().collect()}
    # row 2k sees the n - k widgets that are left; the last one left is unique
    assert counts == {("exact-pdf-name", 100): n - 1, ("ambiguous-label", 50): n - 1, ("pdf-label", 90): 1, (None, None): 1}


def test_nothing_to_match(spark):
    rows, widgets, *_ = _tables(spark, 1, 3, ["a b c"])
    assert assign.cross_match(rows.limit(0), widgets).count() == 0
    assert {r["source"] for r in assign.cross_match(rows, widgets.limit(0)).collect()} == {None}


def test_best_pdf(spark):
    rows = spark.createDataFrame([("f", 0, "", "valor", ""), ("f", 1, "b", "", ""), ("g", 0, "b", "", "")], "form_id string, ord bigint, pdf_field_name string, pdf_label string, field_label string")
    widgets = spark.createDataFrame([("f", "p", 1, 0, "a", "valor"), ("f", "q", 0, 0, "c", "valor"), ("f", "q", 0, 1, "b", None)], "form_id string, pdf string, pdf_ord int, ord bigint, name string, label string")
    got = {(r["form_id"], r["ord"]): (r["pdf"], r["widget_name"], r["confidence"]) for r in assign.cross_match_multi(rows, widgets).collect()}
    assert got == {("f", 0): ("q", "c", 90), ("f", 1): ("q", "b", 100), ("g", 0): (None, None, None)}


def test_match_in_section(spark):
    widgets = spark.createDataFrame([("f", 0, "w0", "Nombre", "DATOS DEL TOMADOR"), ("f", 1, "w1", "Nombre", ""), ("f", 2, "w2", "", None), ("f", 3, "w3", "Fecha de", "x"), ("f", 4, "w4", "abc", None)],
                                    "form_id string, ord bigint, name string, label string, section string")
    rows = spark.createDataFrame([("f", 0, "nombre", "", "datosAsegurado.n"), ("f", 1, "nombre", "", "datosTomador.n"), ("f", 2, "otro", "W2", ""), ("f", 3, "fecha de pago", "", ""), ("f", 4, "abc d", "", "")],
                                 "form_id string, ord bigint, field_label string, pdf_label string, json_name string")
    got = {r["ord"]: (r["row_ord"], r["source"]) for r in assign.match_in_section(widgets, rows).collect()}
    assert got == {0: (1, "label-in-section"), 1: (0, "label"), 2: (2, "pdf-name"), 3: (3, "contains"), 4: (None, None)}


def test_connected(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 3), (200, 200)]
    got = {r["node"]: r["label"] for r in connected(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 200: 200}


def test_copies_are_linked_once(spark, monkeypatch):
    """takers that differ in keys that reach nothing, and copies of a label, add no links between parts"""
    seen = []
    monkeypatch.setattr(assign, "connected", lambda edges, real=assign.connected: seen.append(edges.count()) or real(edges))
    widgets = spark.range(200).select(F.lit("f").alias("form_id"), F.col("id").alias("ord"), F.concat(F.lit("w"), "id").alias("name"), F.lit("Nombre").alias("label"), F.lit("").alias("section"))
    rows = spark.range(150).select(F.lit("f").alias("form_id"), F.col("id").alias("ord"), F.lit("Nombre").alias("field_label"), F.lit("nada").alias("pdf_label"), F.lit("").alias("json_name"))
    got = {r["ord"]: r["row_ord"] for r in assign.match_in_section(widgets, rows, block=40).collect()}
    assert got == {k: k if k < 150 else None for k in range(200)}
    assert seen and seen[0] < 10


def test_blocks_read_on_past_what_is_taken(spark):
    """units that earlier blocks took through another class are passed over, and counted out"""
    rng = random.Random(3)
    widgets = spark.createDataFrame([("f", k, f"w{rng.randint(0, 60)}", rng.choice(["Nombre", "Nombre de pila", "Edad", "pila"]), rng.choice(["Firma del tomador", ""])) for k in range(150)], "form_id string, ord bigint, name string, label string, section string")
    rows = spark.createDataFrame([("f", k, rng.choice(["Nombre", "Nombre de pila", "Edad"]), f"w{rng.randint(0, 60)}", rng.choice(["a.tomador", "b"])) for k in range(120)], "form_id string, ord bigint, field_label string, pdf_label string, json_name string")
    want = sorted(assign.match_in_section(widgets, rows).select("ord", "row_ord", "source").collect())
    assert sorted(assign.match_in_section(widgets, rows, block=16).select("ord", "row_ord", "source").collect(), key=str) == sorted(want, key=str)
