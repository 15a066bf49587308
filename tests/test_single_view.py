"""The single view against rows told by hand."""

from formspark.operators import single_view as SV

ROW = ("form_id string, sheet string, ord int, step string, section string, label string, pdf_name string, ficha_type string, type string, value string, rule string, required string, "
       "visualization string, notes string, forms string, route string, routes string, source_name string")


def ficha(spark, *rows):
    names = [c.split()[0] for c in ROW.split(", ")]
    return spark.createDataFrame([tuple({"form_id": "f", "sheet": "a", **r}.get(n) for n in names) for r in rows], ROW)


def test_rows_of_a_route_are_one_numbered_field(spark):
    rows = ficha(spark, {"ord": 1, "route": "p.x", "label": "Fuma", "value": "Sí", "rule": "abre", "source_name": "x1"}, {"ord": 2, "route": "p.x", "label": "otro", "value": "No", "rule": "abre", "source_name": "x2"},
                 {"ord": 3, "value": "solo"}, {"ord": 4, "route": "", "rule": "NO APLICA formulario"}, {"ord": 5, "route": "p.x", "value": "No", "rule": "cierra", "source_name": "x1"},
                 {"ord": 6, "sheet": "b", "route": "p.x", "required": "web"})
    fields = SV.ficha_fields(rows)
    view = SV.single_view(fields, size=2)
    assert view.columns == ["form_id", *SV.VIEW_COLUMNS]
    got = [(r["#"], r["Hoja"], r["Label (ficha)"], r["Opciones"], r["Regla"], r["sourceName"], r["Destino"]) for r in view.orderBy("#").collect()]
    assert got == [(1, "a", "Fuma", "Sí | No | No", "abre | cierra", "x1 | x2", "normal"), (2, "a", "", "solo", "", "", "label"),
                   (3, "a", "", "", "NO APLICA formulario", "", "excluido"), (4, "b", "", "", "", "", "soloWeb")]
    sheets = spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "c"), ("g", "a")], "form_id string, sheet string")
    typos = spark.createDataFrame([("f", "nmobre", "nombre")] * 2, "form_id string, name string, suggestion string")
    lines = {}
    for r in SV.view_summary(fields, sheets, typos).collect():
        lines.setdefault(r.form_id, []).append((r.line, r.metric, r.value))
    assert [v for _, _, v in sorted(lines["f"])] == ["3", "2", "4", "4", "0", "0", "0", "0", "1", "2", "1", "ejemplo: nombre"]
    assert [v for _, _, v in sorted(lines["g"])] == ["1"] + ["0"] * 10


def test_a_ficha_without_rows(spark):
    fields = SV.ficha_fields(spark.createDataFrame([], ROW))
    assert SV.single_view(fields).count() == 0
