"""Small cases of the operators with exact expected rows."""

import json
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from formspark import constants as K
from formspark.operators import assemble as A
from formspark.operators import groups as G
from formspark.operators import joins as J
from formspark.operators import json_paths as P
from formspark.operators import layout as L
from formspark.operators.rules import Model, run_rules
from formspark.plans.tables import FORM_FIELDS, spark_table
from formspark.sources import sheets

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# ---- forms, runs ------------------------------------------------------------------------

def test_group_by_form(spark):
    f = spark.createDataFrame([("x", "", 0), ("x", "1009052", 1), ("x", "1009052", 2), ("x", "D0306", 3), ("y", "", 4)], "file string, form_code string, ord int")
    got = G.group_by_form(f, ["file"]).groupBy("file", "form_id").count()
    assert rows(got, "file", "form_id", "count") == [("x", "1009052", 3), ("x", "D0306", 2), ("y", "_all", 1)]


def test_collapse_runs_fills_blanks_and_stops_at_other_types(spark):
    data = [(1, "Sexo", "Combo", "M - Masculino", ""), (2, "", "", "F - Femenino", "a.sexo"), (3, "Sexo", "Texto", "x", ""), (4, "Edad", "Texto", "", "a.edad"),
            (5, "País", "Lista", "", ""), (6, "País", "Lista", "CR", "")]
    r = spark.createDataFrame([("f", *d, "", "", "") for d in data], "form_id string, ord int, field_label string, data_type string, value string, json_name string, rule string, obs string, product_scope string")
    runs = G.collapse_runs(r, size=2)
    assert rows(runs, "ord", "run", "option_code") == [(1, 1, "M"), (2, 1, "F"), (3, 2, None), (4, 3, None), (5, 4, None), (6, 4, "CR")]
    heads = G.run_heads(runs)
    assert rows(heads, "run", "n_options", "json_name")[0] == (1, 2, "a.sexo")


def test_name_groups(spark):
    names = ["depNombre[0]", "depNombre[1]", "fumaSi", "fuma_No", "soloSi", "enfAsma_Si", "otro"]
    items = spark.createDataFrame([("f", i, 0, n) for i, n in enumerate(names)], "form_id string, ord int, page int, source_name string")
    got = {r.group_key: (r.kind, r.members, r.section) for r in G.canonical_groups(items).collect()}
    assert got["repeater:depNombre"] == ("repeater", 2, "Dependientes")
    assert got["radio:fuma"] == ("radio", 2, "General")
    assert got["simple:soloSi"][0] == "simple"
    assert got["lookup:enf"] == ("lookup", 1, "Cuestionario de Salud")


# ---- layout -----------------------------------------------------------------------------

TEXT = "form_id string, ord int, page int, str string, x double, y double, width double, height double"
WIDGET = "form_id string, ord int, page int, name string, type string, label string, x double, y double, width double, height double"


def test_section_and_subheading(spark):
    t = spark.createDataFrame([("f", 1, 0, "DATOS DEL SOLICITANTE", 50.0, 700.0, 200.0, 10.0), ("f", 2, 0, "Sexo:", 50.0, 600.0, 30.0, 10.0)], TEXT)
    w = spark.createDataFrame([("f", 1, 0, "a", "checkbox", "M", 60.0, 580.0, 10.0, 10.0), ("f", 2, 0, "b", "checkbox", "F", 90.0, 580.0, 10.0, 10.0),
                               ("f", 3, 0, "c", "text", "T", 60.0, 400.0, 10.0, 14.0)], WIDGET)
    h, s = L.detect_sections(t, w)
    got = L.assign_section(w, h, s)
    assert rows(got, "ord", "section_prefix", "sub_prefix", "group_name") == [(1, "asegurado_", "sexo_", "sexo"), (2, "asegurado_", "sexo_", "sexo"), (3, "asegurado_", "", None)]


def test_no_heading_warns(spark):
    t = spark.createDataFrame([], TEXT)
    w = spark.createDataFrame([("f", 1, 0, "a", "text", "M", 60.0, 580.0, 10.0, 10.0)], WIDGET)
    h, s = L.detect_sections(t, w)
    assert rows(L.assign_section(w, h, s), "section_prefix", "warning") == [("", "no_section_match")]


def test_date_triplets(spark):
    w = spark.createDataFrame([("f", i, 0, f"d{i}", "text", lab, x, y, 20.0, 10.0) for i, (lab, x, y) in enumerate(
        [("Día", 100.0, 500.0), ("Mes", 140.0, 500.0), ("Año", 180.0, 501.0), ("Día", 100.0, 300.0), ("Mes:", 140.0, 300.0), ("Día", 400.0, 100.0)])], WIDGET)
    t = spark.createDataFrame([("f", 1, 0, "DATOS DEL ASEGURADO", 50.0, 700.0, 200.0, 10.0), ("f", 2, 0, "Fecha de Nacimiento:", 50.0, 520.0, 80.0, 10.0)], TEXT)
    h, _ = L.detect_sections(t, w)
    got = L.date_groups(w, h, t)
    assert rows(got, "ord", "part", "date_prefix") == [(0, "dia", "fecha_nacimiento_"), (1, "mes", "fecha_nacimiento_"), (2, "ano", "fecha_nacimiento_"),
                                                       (3, "dia", "fecha_nacimiento_"), (4, "mes", "fecha_nacimiento_")]


def test_collisions(spark):
    r = spark.createDataFrame([("f", i, n, t) for i, (n, t) in enumerate([("a", "checkbox"), ("a", "text"), ("b", "text"), ("b", "text"), ("b", "text")])],
                              "form_id string, ord int, proposed string, type string")
    assert rows(L.resolve_collisions(r, size=2), "ord", "final_name") == [(0, "a"), (1, "a_texto"), (2, "b"), (3, "b_2"), (4, "b_3")]


def test_dedupe_skips_names_in_use(spark):
    r = spark.createDataFrame([("f", i, n, p) for i, (n, p) in enumerate([("a", 0), ("a__p1_2", 0), ("a", 0), ("a", 0), ("a", 1)])], "form_id string, ord int, name string, page int")
    assert rows(L.dedupe_across_docs(r), "ord", "final_name") == [(0, "a"), (1, "a__p1_2"), (2, "a__p1"), (3, "a__p1_3"), (4, "a__p2")]


def test_visual_order(spark):
    w = spark.createDataFrame([("f", 1, 0, 10.0, 500.0), ("f", 2, 0, 5.0, 503.0), ("f", 3, 0, 1.0, 400.0), ("f", 4, 1, 1.0, 700.0)], "form_id string, ord int, page int, x double, y double")
    assert rows(L.visual_order(w), "ord", "visual_row", "visual_ord") == [(1, 1, 2), (2, 1, 1), (3, 2, 3), (4, 3, 4)]


def test_merge_adjacent(spark):
    t = spark.createDataFrame([("f", 1, 0, "Primer", 10.0, 500.0, 30.0, 8.0), ("f", 2, 0, "nombre", 45.0, 501.0, 30.0, 9.0), ("f", 3, 0, "lejos", 200.0, 500.0, 20.0, 8.0)], TEXT)
    assert rows(L.merge_adjacent(t), "str", "width", "height") == [("Primer nombre", 65.0, 9.0), ("lejos", 20.0, 8.0)]


def test_detect_labels(spark):
    t = spark.createDataFrame([("f", 1, 0, "Nombre:", 10.0, 500.0, 40.0, 8.0), ("f", 2, 0, "Arriba", 100.0, 530.0, 40.0, 8.0)], TEXT)
    w = spark.createDataFrame([("f", 1, 0, "a", "text", "", 60.0, 500.0, 30.0, 10.0), ("f", 2, 0, "b", "text", "", 100.0, 500.0, 30.0, 10.0)], WIDGET).drop("label")
    # the second widget's left text is hidden behind the first widget
    assert rows(L.detect_labels(w, t), "ord", "label") == [(1, "Nombre"), (2, "Arriba")]


# ---- JSON ----------------------------------------------------------------------------------

def docs(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "doc_id int, body string")


def test_flatten_paths(spark):
    d = docs(spark, '{"Cliente":{"PrimerNombre":"","Telefonos":{"Telefono":[{"Numero":""}]}}}')
    paths = {r.path for r in P.flatten_paths(d, ["doc_id"], "body").collect()}
    assert {"Cliente.PrimerNombre", "Cliente.Telefonos.Telefono[].Numero", "Cliente.Telefonos.Telefono[]"} <= paths
    keys = spark.createDataFrame([("a", "Cliente.PrimerNombre"), ("b", "Cliente.NoExiste"), ("c", "numero"), ("d", "cliente.telefonos.telefono.numero")], "field_id string, key string")
    unknown = P.unknown_paths(keys, P.flatten_paths(d, ["doc_id"], "body").select("path"))
    assert rows(unknown, "field_id") == [("b",)]


def test_compare_counts_add_up(spark):
    a = P.flatten_shape(docs(spark, '{"a":{"b":1},"l":[{"x":1}],"s":2}').withColumn("f", F.lit("f")), ["f", "doc_id"], "body", per=["f"])
    b = P.flatten_shape(docs(spark, '{"a":3,"z":{"l":[{"x":1}]}}').withColumn("f", F.lit("f")), ["f", "doc_id"], "body", per=["f"])
    diff = P.suggest_path(P.compare_shape(a, b, ["f"]), b, ["f"])
    counts = P.compare_counts(diff, ["f"]).first()
    assert counts.ok + counts.falta + counts.forma == a.count()
    got = {r.path: (r.status, r.suggestion) for r in diff.collect()}
    assert got["a"] == ("forma", None) and got["l[].x"] == ("falta", "z.l[].x") and got["z"] == ("sobra", None)


def test_prefix_conflicts(spark):
    w = spark.createDataFrame([("f", p) for p in ("a", "a.b", "ab.c", "r", "r[0].x", "q", "q.z", "q[1]")], "form_id string, path string")
    rep = spark.createDataFrame([("f", "r"), ("f", "q")], "form_id string, path string")
    assert rows(P.path_prefix_conflict(w, rep), "path", "type", "child") == [("a", "contenedor", "a.b"), ("q", "array-y-objeto", "q.z")]


def test_json_with_rest_is_no_json(spark):
    d = docs(spark, '{"a":1}', '{"a":1,}', '{"a":1}}', "nada", '{"a":1} {"b":2}')
    got = d.select("doc_id", P.read_json_lenient("body").isNotNull().alias("ok")).collect()
    assert [r.ok for r in sorted(got)] == [True, True, False, False, False]


# ---- joins ---------------------------------------------------------------------------------

def test_mapping_last_pair_wins(spark):
    w = spark.createDataFrame([("f", 1, "a"), ("f", 2, "z")], "form_id string, ord int, name string")
    p = spark.createDataFrame([("f", 1, "a", "x"), ("f", 2, "a", "y"), ("f", 3, "q", "r")], "form_id string, ord int, actual string, proposed string")
    done, lost = J.mapping_join(w, p)
    assert rows(done, "name", "new_name", "confidence") == [("a", "y", 100), ("z", "z", 0)]
    assert rows(lost, "actual") == [("q",)]


def test_cascade_prefers_stronger_lookups(spark):
    r = spark.createDataFrame([("f", 1, "primer_nombre", "Otro", "Nombre", "a.x"), ("f", 2, "", "Primer nombre", "", "a.primerApellido")],
                              "form_id string, ord int, pdf_field_name string, pdf_label string, field_label string, json_name string")
    f = spark.createDataFrame([("f", 1, "primer_nombre_2", "zzz"), ("f", 2, "primer_apellido", "zzz"), ("f", 3, "q", "Primer nombre_Row_2")],
                              "form_id string, ord int, source_name string, label string")
    got = J.cascade_match(f, r)
    assert rows(got, "ord", "row_ord", "confidence", "source") == [(1, 1, 95, "pdf-field-name-base"), (2, 2, 70, "json-leaf"), (3, 2, 90, "pdf-label")]


def test_cascade_tries_all_nine_lookups(spark, monkeypatch):
    r = spark.createDataFrame([("f", 1, "", "Apellido", "", ""), ("f", 2, "", "", "Materno", "")],
                              "form_id string, ord int, pdf_field_name string, pdf_label string, field_label string, json_name string")
    f = spark.createDataFrame([("f", 1, "primer_apellido", "zzz"), ("f", 2, "segundo_materno_3", "zzz"), ("f", 3, "apellido", "zzz")], "form_id string, ord int, source_name string, label string")
    assert [(c, name) for name, c, _ in J.CASCADE[-2:]] == [(65, "last-segment-pdf"), (60, "last-segment-form")]
    # below the gate they are no matches
    assert rows(J.cascade_match(f, r), "ord", "row_ord", "source") == [(1, None, None), (2, None, None), (3, 1, "snake-to-pdf")]
    monkeypatch.setattr(J, "CASCADE_GATE", 60)
    assert rows(J.cascade_match(f, r), "ord", "row_ord", "confidence", "source") == [(1, 1, 65, "last-segment-pdf"), (2, 2, 60, "last-segment-form"), (3, 1, 75, "snake-to-pdf")]


def test_word_match(spark):
    r = spark.createDataFrame([("f", 1, "", "fecha de la poliza madre", "", "")], "form_id string, ord int, pdf_field_name string, pdf_label string, field_label string, json_name string")
    f = spark.createDataFrame([("f", 1, "poliza_fecha", ""), ("f", 2, "poliza_hija", "")], "form_id string, ord int, source_name string, label string")
    assert rows(J.word_match(f, r), "ord", "row_ord") == [(1, 1)]


# ---- rules -----------------------------------------------------------------------------------

def field_rows(spark, *changes):
    base = spark_table(spark, SF, FORM_FIELDS).limit(0)
    empty = {c: None for c in base.columns}
    data = [{**empty, "form_id": "f", "ord": i, "type": "signature", "id": f"field_{i}", "hidden": False, "hidden_effective": False, **c} for i, c in enumerate(changes)]
    schema = StructType([StructField(f.name, f.dataType) for f in base.schema])
    return Model(spark.createDataFrame([tuple(d[c] for c in base.columns) for d in data], schema))


def found(model, rule):
    return run_rules(model, [rule]).where(F.col("rule") == rule).count()


def cut(start, end):
    return json.dumps({"parts": [{"kind": "field", "fieldId": "field_0", "transforms": [{"kind": "substring", "start": start, "end": end}]}]})


def test_r04_r09(spark):
    assert found(field_rows(spark, {"salida_json": "a.b", "json_output_path": "c.d"}), "R04") == 1
    assert found(field_rows(spark, {"native_type": "Checkbox", "checked_pdf_value": "SI"}), "R09") == 1
    assert found(field_rows(spark, {"native_type": "Checkbox", "checked_pdf_value": "X"}), "R09") == 0


@pytest.mark.parametrize("source,start,end,n", [
    ({}, 0, 2, 0), ({}, 8, 10, 1), ({"pdf_date_format": "YYYY-MM-DD"}, 8, 10, 0), ({"pdf_date_format": "YYYY-MM-DD"}, 0, 2, 1), ({"type": "text"}, 8, 10, 0),
])
def test_r19(spark, source, start, end, n):
    m = field_rows(spark, {"type": "date", "id": "field_0", **source}, {"type": "text", "id": "field_x_dia", "concat": cut(start, end)})
    assert found(m, "R19") == n


def test_broken_rule_is_visible_and_others_go_on(spark):
    m = field_rows(spark, {"prefill_mode": "api"})
    broken = Model(m.fields.drop("salida_json"))
    got = {r.rule for r in run_rules(broken, ["R04", "R14"]).collect()}
    assert got == {"R00", "R14"}


# ---- documents -----------------------------------------------------------------------------------

def test_document_lines_are_json(spark):
    from formspark.plans.assemble_queries import family
    lines = family.queries["form_documents"](spark, SF).collect()
    forms = {}
    for r in sorted(lines, key=lambda r: (r.form_id, *[r[k] for k in A.LINE_KEY])):
        forms.setdefault(r.form_id, []).append(r.text)
    assert forms
    for texts in forms.values():
        doc = json.loads("".join(texts))
        assert doc["sections"][0]["id"] == "section_encabezado" and len(doc["sections"][0]["fields"]) == 10


def test_written_documents_keep_their_lines(spark, tmp_path):
    from formspark.sources.files import write_documents
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(['{"a":[', "1", ",2", "]}"])], "form_id string, line_no int, text string")
    write_documents(lines, str(tmp_path / "out"), ["line_no"], parts=2)
    parts = sorted((tmp_path / "out" / "form_id=f").glob("*.txt"))
    assert json.loads("".join(p.read_text() for p in parts)) == {"a": [1, 2]}


def test_field_positions_round_half_up(spark):
    w = spark.createDataFrame([("f", "a", 0, 1.5, 2.5, 3.4, 0.5), ("f", "b", None, None, None, None, None)], "form_id string, name string, page int, x double, y double, width double, height double")
    assert rows(A.field_positions(w), "source_name", "page", "x_int", "y_int", "height_int") == [("a", 1, 2, 3, 1), ("b", 1, 0, 0, 0)]


# ---- sample documents ------------------------------------------------------------------------------

def put(node, steps, value):
    """reference meaning of a sample path, on plain Python values"""
    for i, s in enumerate(steps):
        key = s["key"] if s["kind"] == "k" else s["at"]
        while isinstance(node, list) and len(node) <= key:
            node.append(None)
        if i == len(steps) - 1:
            node[key] = value
            return
        fresh = {} if steps[i + 1]["kind"] == "k" else []
        if (node.get(key) if isinstance(node, dict) else node[key]) is None:
            node[key] = fresh
        node = node[key]


def test_sample_tree_lines_are_the_document(spark):
    paths = {"a.b[2].c": "1", "a.b[0].c": "2", "a.b[2].d[]": "3", "a.z": None, "q[1][0]": "4", "q[1][3]": "5", 'w"x.y': 'v"w', "a.b[0].a": "6"}
    df = spark.createDataFrame([("f", p, v) for p, v in paths.items()], "form_id string, path string, value string")
    lines = sorted(P.sample_tree_lines(df).collect(), key=lambda r: (r.part, [tuple(s) for s in r.steps]))
    want = {}
    for p, v in paths.items():
        put(want, [s.asDict() for s in df.where(F.col("path") == p).select(P._steps(F.col("path")).alias("s")).first().s], v)
    assert json.loads("".join(r.text for r in lines)) == want


def test_registered_sample_tree(spark):
    from formspark.plans.json_queries import family
    forms = {}
    for r in family.queries["sample_tree"](spark, SF).collect():
        forms.setdefault(r.form_id, []).append((r.part, [(s["kind"], s["key"], s["at"]) for s in json.loads(r.steps)], r.text))
    for lines in forms.values():
        want = {}
        for part, steps, text in lines:
            if part == 0:
                put(want, [dict(zip(("kind", "key", "at"), s)) for s in steps], text.rsplit('"', 2)[-2])
        assert json.loads("".join(t for _, _, t in sorted(lines))) == want


# ---- depth, isolation, sinks -----------------------------------------------------------------------

def test_documents_of_any_depth(spark):
    deep = '{"a":[' * 7 + '{"b":"x","c":[],"d":{}}' + "]}" * 7
    nodes = P.json_nodes(docs(spark, deep, '{"k":1}', "oops [[[[[[[[[[[[[[[[[[[[", None, '"[[[["', '{"t":"[[[[\\\\"}'), ["doc_id"], "body").collect()
    first = [r for r in nodes if r.doc_id == 0]
    assert len(first) == 17 and [(r.path.split(".")[-1], r.kind, r.value) for r in sorted(first, key=lambda r: r.ord)[-3:]] == [("b", "leaf", "x"), ("c", "array", None), ("d", "object", None)]
    assert [(r.doc_id, r.path, r.value) for r in nodes if r.doc_id > 0] == [(1, "k", "1"), (5, "t", "[[[[\\")]


def test_sections_of_any_level(spark):
    body = {"id": "s0", "fields": [{"id": "f0"}]}
    for k in range(1, 13):
        body = {"id": f"s{k}", "fields": [{"id": f"f{k}"}], "subsections": [body]}
    got = P.flatten_formdef(docs(spark, json.dumps({"sections": [body]}), None, "{}"), ["doc_id"], "body").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.ord)] == [f"f{k}" for k in range(12, -1, -1)]
    assert max(len(r.section_path) for r in got) == 13


def test_rows_a_rule_cannot_read(spark):
    from formspark.operators.rules.registry import hit
    m = field_rows(spark, {"default_value": "7", "prefill_mode": "api"}, {"default_value": "seven"}, {"default_value": None})
    over = (lambda: hit(F.col("default_value").cast("int") > 3), lambda: F.col("default_value").isNull() | F.col("default_value").try_cast("int").isNotNull())
    got = [(r.rule, r.subject) for r in run_rules(m, ["R14"], {"X01": over}).collect()]
    assert sorted(got, key=str) == [("R00", "X01: unreadable row"), ("R14", None), ("X01", None)]


def test_lines_end_at_the_reach_of_their_head(spark):
    t = spark.createDataFrame([("f", 1, 0, "a", 10.0, 100.0, 10.0, 8.0), ("f", 2, 0, "b", 21.0, 97.5, 10.0, 8.0), ("f", 3, 0, "c", 32.0, 95.0, 10.0, 8.0)], TEXT)
    assert rows(L.merge_adjacent(t), "str") == [("a b",), ("c",)]


def test_top_files_show_their_share(spark):
    from formspark.operators.scoring import top_files
    files = spark.createDataFrame([("p", "a", 60.0, 60), ("p", "b", 1.0, 1), ("p", "c", 0.0, 0)], "project string, file string, points double, share int")
    assert rows(top_files(files), "file", "place", "bar") == [("a", 1, 60), ("b", 2, 3)]


def test_files_are_listed_and_written_by_form(spark, tmp_path):
    from formspark.sources import files as S
    items = spark.createDataFrame([("f", "Moneda", "1", "Colón"), ("g", "Moneda", "2", "Dólar")], "form_id string, catalog string, code string, label string")
    S.write_partitioned(items, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("form_id=*")) == ["form_id=f", "form_id=g"]
    assert S.list_files(spark, str(tmp_path / "out")).where("path like '%.parquet'").count() == 2
    assert S.catalog_view(items).columns == ["Catálogo", "Código", "Label"]
    names = spark.createDataFrame([("f", "a", "a"), ("f", "b", "c")], "form_id string, name string, new_name string")
    assert rows(S.rename_view(names), "old_name", "state") == [("a", "sin cambio"), ("b", "renombrado")]


def test_every_rule_survives_rows_it_cannot_read(spark):
    """bad JSON, other shapes and missing ids give R00 for the row and the rule; other rows are judged"""
    from formspark.operators.rules import registry
    from formspark.plans import rule_queries

    m = rule_queries.stored_model(spark, "/root/testdata/sf0.001")
    good = m.fields.limit(40)
    for column in sorted({c for columns in registry.READS.values() for c in columns}):
        values = [None] if column == "id" else ["[1", "7", '{"conditions":7,"parts":{"a":1}}', '"x"']
        for value in values if column == "concat" else values[-2:]:
            broken = good.withColumn(column, F.lit(value).cast("string"))
            rows = run_rules(Model(broken, m.widgets), sorted(registry.READS)).where("rule = 'R00'")
            got = {r["subject"] for r in rows.select("subject").distinct().collect()}
            told = {f"{rule}: unreadable {column}" for rule, columns in registry.READS.items() if column in columns}
            # a text is no condition at all, which is not a fault
            assert got >= (set() if column.startswith("condition_") and value == '"x"' else told), (column, value)


def test_rules_about_keys_share_their_passes(spark):
    """all rules about keys together scan the fields three times at most, whatever rules there are"""
    from formspark.plans import rule_queries

    m = rule_queries.model(spark, "/root/testdata/sf0.001")
    plan = run_rules(m)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("LogicalRDD [") <= 9


def test_free_numbers_between_many_taken_ones(spark):
    """every odd number of a base is a field's own name: the k-th free one is 2k, without a list of the taken ones"""
    from formspark.operators import layout

    own = spark.range(3000).select(F.lit("f").alias("form_id"), (10 + F.col("id")).alias("ord"), F.lit(0).alias("page"),
                                   F.when(F.col("id") == 0, F.lit("a__p1")).otherwise(F.concat(F.lit("a__p1_"), 2 * F.col("id") + 1)).alias("name"))
    twins = spark.range(1001).select(F.lit("f").alias("form_id"), (10000 + F.col("id")).alias("ord"), F.lit(0).alias("page"), F.lit("a").alias("name"))
    out = layout.dedupe_across_docs(own.unionByName(twins), size=64).where("name = 'a'").orderBy("ord").collect()
    assert [r["final_name"] for r in out] == ["a", *(f"a__p1_{2 * k}" for k in range(1, 1001))]


def test_a_word_in_all_names_adds_no_pairs(spark):
    """best PDF by shared words: same as all pairs, and linear in files that all share a word"""
    import random

    from formspark.functions import text as T
    from formspark.operators import scoring

    rng = random.Random(3)
    words = ["vida", "hogar", "autos", "salud", "viaje", "banca", "todos", "todos"]
    excels = [("p", f"{' '.join(rng.choices(words, k=rng.randint(1, 4)))} {k if k % 3 else ''}.xlsx") for k in range(40)]
    pdfs = [("p", f"{' '.join(rng.choices(words, k=rng.randint(1, 4)))} {k}x.pdf", k) for k in range(30)]
    e, p = spark.createDataFrame(excels, "project string, file string"), spark.createDataFrame(pdfs, "project string, file string, file_ord int")
    got = {r["excel"]: (r["pdf"], r["affinity"]) for r in scoring.name_affinity_best(e, p).collect()}
    named = {r["file"]: r["w"] for r in e.select("file").union(p.select("file")).select("file", T.name_words("file").alias("w")).collect()}
    want = {}
    for _, x in excels:
        scores = [(sum(w in named[f] for w in named[x]), -k, f) for _, f, k in pdfs]
        if max(scores)[0]:
            want[x] = (max(scores)[2], max(scores)[0] * sum(y == x for _, y in excels))
    assert got == want
    many = spark.range(300)
    e = many.select(F.lit("p").alias("project"), F.concat(F.lit("todos tema"), "id", F.lit(".xlsx")).alias("file"))
    p = many.select(F.lit("p").alias("project"), F.concat(F.lit("todos tema"), "id", F.lit(".pdf")).alias("file"), F.col("id").alias("file_ord"))
    assert scoring.affinity_candidates(e, p)[1].count() <= 600


def planned_broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


class TestNothingPassesTheDriver:
    """Rows that are exploded from a small file are many: no side of these joins is broadcast by the file's size."""

    FIELDS = [("f", 1, "edad_1", "Edad"), ("f", 2, "nombre", "zz")]
    ROWS = [("f", 7, "edad", "Edad:", "edad", "d.edad", ""), ("f", 8, "x", "otro nombre", "otro", "d.otro", "")]

    def tables(self, spark, tmp_path):
        spark.createDataFrame(self.FIELDS, "form_id string, ord bigint, source_name string, label string").write.parquet(f"{tmp_path}/f")
        spark.createDataFrame(self.ROWS, "form_id string, ord bigint, pdf_field_name string, pdf_label string, field_label string, json_name string, catalog_direct string").write.parquet(f"{tmp_path}/r")
        return spark.read.parquet(f"{tmp_path}/f"), spark.read.parquet(f"{tmp_path}/r")

    def test_cascade_match(self, spark, tmp_path):
        from formspark.operators import joins
        out = joins.cascade_match(*self.tables(spark, tmp_path))
        assert planned_broadcasts(out) == 0
        assert {(r["ord"], r["row_ord"], r["confidence"]) for r in out.collect()} == {(1, 7, 95), (2, None, None)}

    def test_match_fields(self, spark, tmp_path):
        from formspark.operators import joins
        out = joins.match_fields(*self.tables(spark, tmp_path))
        assert planned_broadcasts(out) == 0
        assert {(r["ord"], r["row_ord"], r["confidence"]) for r in out.collect()} == {(1, 7, 95), (2, 8, 55)}

    def test_similar_pairs(self, spark, tmp_path):
        from formspark.operators import fuzzy
        spark.createDataFrame([("telefono",), ("zz",)], "key string").write.parquet(f"{tmp_path}/left")
        spark.createDataFrame([("telefonos",), ("otro",)], "key string").write.parquet(f"{tmp_path}/right")
        pairs = fuzzy.similar_pairs(spark.read.parquet(f"{tmp_path}/left"), spark.read.parquet(f"{tmp_path}/right"), [], 0.7)
        assert planned_broadcasts(pairs) == 0
        assert [(r["left_key"], r["right_key"]) for r in pairs.collect()] == [("telefono", "telefonos")]


def test_labels_over_the_edges_of_tiles(spark):
    """a widget is looked at in few tiles, and meets texts and other widgets on either side of their edges"""
    from formspark.operators import layout
    grid = [("f", 1, 100 * i + j, 37.0 * i, 23.0 * j, 25.0, 10.0) for i in range(30) for j in range(30)]
    schema = "form_id string, page int, ord int, x double, y double, width double, height double"
    w = spark.createDataFrame(grid, schema)
    x, top = F.col("x"), F.col("y") + F.col("height")
    assert layout._tiles(w, (x - 200, x + 30), (F.col("y") - 14, top + 80)).count() <= 2.2 * len(grid)
    widgets = spark.createDataFrame([("f", 1, 1, 1005.0, 165.0, 25.0, 10.0), ("f", 1, 2, 500.0, 150.0, 25.0, 10.0), ("f", 1, 3, 5.0, 400.0, 25.0, 10.0), ("f", 1, 4, -30.0, 400.0, 25.0, 10.0)], schema)
    texts = spark.createDataFrame([("f", 1, 1, "izquierda", 900.0, 158.0, 60.0), ("f", 1, 2, "arriba", 480.0, 230.0, 30.0), ("f", 1, 3, "oculto", -90.0, 400.0, 30.0)],
                                  "form_id string, page int, ord int, str string, x double, y double, width double")
    found = {r["ord"]: r["label"] for r in layout.detect_labels(widgets, texts).collect()}
    assert found == {1: "izquierda", 2: "arriba", 3: None, 4: "oculto"}


def test_equal_names_are_counted_in_the_scan_that_numbers_them(spark):
    """one exchange of the rows: no count is joined to them; rows without a name are left out as before"""
    from formspark.operators import layout
    rows = spark.createDataFrame([("f", 1, "a", "text"), ("f", 2, "a", "box"), ("f", 70000, "b", "box"), ("f", 140000, "b", "box"), ("f", 5, "c", "box"), ("f", 6, None, "box"), (None, 7, "a", "box")],
                                 "form_id string, ord int, proposed string, type string")
    out = layout.resolve_collisions(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") + plan.count("ShuffledHashJoin") <= 1
    assert {r["ord"]: r["final_name"] for r in out.collect()} == {1: "a_texto", 2: "a", 70000: "b", 140000: "b_2", 5: "c"}
    placed = rows.select("form_id", "ord", F.col("proposed").alias("new_name"), F.lit(1).alias("page"), (F.col("ord") * -1.0).alias("y"))
    got = {r["ord"]: (r["final_name"], r["warning"]) for r in layout.suffix_by_row(placed).collect()}
    assert got == {1: ("a_1", "collision-resolved"), 2: ("a_1", "collision-resolved"), 70000: ("b_1", "collision-resolved"), 140000: ("b_2", "collision-resolved"), 5: ("c", None)}


# ---- work that is spread, and not done twice ---------------------------------------------------

def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _sheet(spark, rows):
    return spark.createDataFrame([("f", "a.xlsx", sheet, at, row, col, value) for sheet, at, row, col, value in rows],
                                 "form_id string, file string, sheet string, sheet_ord int, row_idx int, col_idx int, value string")


def test_definitions_of_one_file_are_read_by_many_tasks(spark):
    body = '{"sections":[{"id":"s","title":"T","fields":[{"id":"a","type":"text"},{"id":"b"}]}]}'
    defs = spark.range(20).select("id", F.lit(body).alias("body")).coalesce(1)
    fields = P.flatten_formdef(defs, ["id"], "body")
    assert fields.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert fields.count() == 40


def test_header_cells_are_compared_after_they_are_moved(spark):
    cells = _sheet(spark, [("S", 0, 1, 0, "Nombre del campo en formulario"), ("S", 0, 1, 1, "Tipo de dato"), ("S", 0, 1, 2, "Regla de negocio"), ("S", 0, 1, 3, "Obligatorio"),
                           ("S", 0, 0, 0, "Matriz"), ("T", 1, 0, 0, "nada")])
    found = sheets.detect_header(cells)
    above, below = _plan(found).split("RepartitionByExpression", 1)
    assert "contains" in above.lower() and "contains" not in below.lower()
    assert {(r.sheet, r.header_row, r.role) for r in found.collect()} == {("S", 1, r) for r in ("field_label", "data_type", "rule", "required")}
    lost = sheets.detect_header(cells, fallback=["step", "section"]).where("sheet = 'T'").collect()
    assert sorted((r.role, r.header_row, r.col_idx) for r in lost) == [("section", 0, 1), ("step", 0, 0)]
    assert sheets.detect_header(cells.where("sheet = 'T'"), min_roles=0, must_have=None).count() == 0


def test_layout_tells_sheets_before_it_aggregates_their_names(spark):
    cells = _sheet(spark, [("Campos", 0, 0, 0, "x"), ("Campos", 0, 1, 0, "x"), ("Opciones", 1, 0, 0, "y"), (None, 2, 0, 0, "y")])
    found = sheets.detect_layout(cells)
    assert re.search(r"Aggregate \[form_id#\d+, file#\d+, sheet#\d+, sheet_ord#\d+\]", _plan(found))
    assert [r.layout for r in found.collect()] == ["canonical"]


def test_mapping_warnings_read_two_columns(spark):
    at = {c: K.MAPPING_COLUMNS.index(c) for c in ("acro_actual", "options_raw", "format")}
    cells = _sheet(spark, [("M", 0, row, at[c], value) for row, c, value in [
        (1, "acro_actual", "a"), (1, "options_raw", "{oops"), (1, "format", "X"), (2, "acro_actual", "b"), (2, "options_raw", "[]"), (3, "options_raw", "{oops"), (4, "acro_actual", " "), (4, "options_raw", "{"), (5, "acro_actual", "c")]])
    found, warnings = sheets.read_mapping22(cells)
    assert rows(warnings, "row", "field", "type") == [(2, "a", "invalid_options_json")]
    assert rows(found, "row_idx", "acro_actual", "format") == [(1, "a", "x"), (2, "b", ""), (5, "c", "")]
    assert re.search(r"col_idx#\d+ IN \(|col_idx#\d+ = \d+ OR|col_idx#\d+ = \d+\) OR", _plan(warnings))


def test_texts_without_a_word_of_a_heading_are_left_out_first(spark, monkeypatch):
    tried = []
    match = L._heading
    monkeypatch.setattr(L, "_heading", lambda c: tried.append(1) or F.when(c.contains("texto"), F.raise_error(F.lit("a plain text was tried"))).otherwise(match(c)))
    strs = ["Texto 1", "", None, "Texto 2 ", "PÓLIZA", "Beneficiario 3", "En calidad de.", "tipo de identificación", "Sexo", "Marque 5:", "x sexo", "sexo y edad", "no"]
    t = spark.createDataFrame([("f", i, 1, 0.0, 10.0 * i, s) for i, s in enumerate(strs)], "form_id string, ord int, page int, x double, y double, str string")
    w = spark.createDataFrame([("f", i, 1, 10.0 * i, 70.0, 5.0, "checkbox") for i in range(2)], "form_id string, ord int, page int, x double, y double, height double, type string")
    headings, subs = L.detect_sections(t, w)
    assert tried and rows(headings, "ord", "prefix", "number") == [(4, "poliza_", None), (5, "beneficiario_", 3)]
    assert rows(subs, "ord", "prefix", "group_name", "source") == [
        (6, "calidad_", "calidad", "whitelist"), (7, "tipo_id_", "tipo_identificacion", "whitelist"), (8, "sexo_", "sexo", "whitelist"), (9, "", "marque_5", "fallback"),
        (10, "sexo_", "sexo", "whitelist"), (11, "sexo_", "sexo", "whitelist")]


def test_near_points_are_listed_in_few_cells(spark):
    """a position is listed where its reach goes, not in nine cells, and is found across the edge of a cell"""
    grid = spark.sql("SELECT CAST(a.id - 32 AS INT) AS px, CAST(b.id - 32 AS INT) AS py FROM range(64) a, range(64) b")
    assert grid.select(F.avg(F.size(J._cells_in_reach("px", "py", 8)))).first()[0] < 2.5
    widgets = spark.createDataFrame([("f", k, 1, x, y) for k, (x, y) in enumerate([(31.0, 31.0), (-1.0, 0.0), (40.0, 31.0), (23.0, 40.0), (None, 1.0)])], "form_id string, ord int, page int, x double, y double")
    known = spark.createDataFrame([("f", 0, 1, 32.0, 32.0, "a"), ("f", 1, 1, -9.0, 8.0, "b"), ("f", 2, 1, 33.0, 31.0, "c")], "form_id string, ord int, page int, x double, y double, source_name string")
    assert {r["ord"]: r["source_name"] for r in J.near_point_join(widgets, known).collect()} == {0: "a", 1: "b", 2: "a", 3: None, 4: None}


def test_merged_pieces_forget_how_heights_were_folded(spark):
    """the shuffles that fold heights into lines are dropped before the pieces are moved"""
    t = spark.createDataFrame([("f", 1, 1, 0.0, 10.0, 5.0, 8.0, "a"), ("f", 2, 1, 6.0, 11.0, 5.0, 8.0, "b"), ("f", 3, 1, 6.0, 30.0, 5.0, 8.0, "c")],
                              "form_id string, ord int, page int, x double, y double, width double, height double, str string")
    merged = L.merge_adjacent(t)
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "_chain" not in plan and "_tops" not in plan
    assert sorted(r["str"] for r in merged.collect()) == ["a b", "c"]
