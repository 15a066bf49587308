"""Sheets, rule counts, reuse, scores and documents over parts, documents and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from formspark import constants as K
from formspark.operators import scoring as S
from formspark.plans.join_queries import slug
from formspark.plans.registry import Family
from formspark.plans.tables import _CELL_COLUMNS as CELL_HEADS
from formspark.plans.tables import CELLS, duck, read, spark_table, stored
from formspark.sources import files as FS
from formspark.sources import json_lines as JL
from formspark.sources import sheets as SH

family = Family()
C = duck(CELLS)
KEY = ["form_id", "file", "sheet"]


def cells(spark, sf):
    return stored(spark_table(spark, sf, CELLS))


# ---- reading sheets --------------------------------------------------------------------

@family.query(f"""
WITH s AS (SELECT form_id, file, sheet, sheet_ord, max(row_idx) - min(row_idx) + 1 AS n, regexp_matches(sheet, '(?i)formulario') AS f FROM {C} GROUP BY ALL)
SELECT form_id, file, arg_min(sheet, (NOT f, CASE WHEN f THEN 0 ELSE -n END, sheet_ord)) AS sheet FROM s GROUP BY ALL""")
def pick_matrix_sheet(spark, sf):
    return SH.pick_matrix_sheet(cells(spark, sf))


_HEADROLES = "['field_label', 'data_type', 'rule', 'required', 'value', 'visualization', 'obs', 'product_scope', 'json_name', 'pdf_field_name']"


@family.query(f"SELECT DISTINCT form_id, file, sheet, 1 AS header_row, {_HEADROLES}[col_idx + 1] AS role, col_idx FROM {C} WHERE row_idx = 1")
def detect_header(spark, sf):
    return SH.detect_header(cells(spark, sf))


@family.query(f"""SELECT DISTINCT form_id, file, sheet, 0 AS header_row, r AS role, i::INT - 1 AS col_idx FROM (SELECT form_id, file, sheet, unnest(['step', 'section', 'pdf_label', 'field_label', 'data_type', 'value', 'rule', 'required', 'product_scope', 'visualization', 'obs', 'json_name', 'pdf_field_name']) AS r,
  unnest(generate_series(1, 13)) AS i FROM {C})""")
def detect_header_fallback(spark, sf):
    return SH.detect_header(cells(spark, sf).withColumn("value", F.when(F.col("row_idx") == 1, F.concat(F.lit("x"), "col_idx")).otherwise(F.col("value"))), fallback=K.MATRIX_FALLBACK)


@family.query(f"SELECT DISTINCT form_id, file, sheet, 1 AS header_row FROM {C}")
def header_by_density(spark, sf):
    return SH.header_by_density(cells(spark, sf))


# a sheet per customer: a heading of 3 to 10 names at row 0 to 11 with turned columns, a full one three rows below, and a line of data
_NAMED = " ".join(f"WHEN {i} THEN '{head}'" for i, (head, _) in enumerate(CELL_HEADS) if i)
_FIRST = CELL_HEADS[0][0]
_OWN = "concat('n', c_nationkey) AS form_id, 'f.xlsx' AS file, concat('h', c_custkey) AS sheet"
_MOVED = f"""SELECT {_OWN}, CAST(c_custkey % 12 AS INT) AS row_idx, CAST((c + c_custkey) % 10 AS INT) AS col_idx, CASE c WHEN 0 THEN CASE WHEN c_custkey % 5 = 0 THEN 'Nada' ELSE '{_FIRST}' END {_NAMED} END AS value FROM @customer, @each(0, 9) r(c) WHERE c < 3 + c_custkey % 8
UNION ALL SELECT {_OWN}, CAST(c_custkey % 12 + 3 AS INT), CAST(c AS INT), CASE c WHEN 0 THEN '{_FIRST}' {_NAMED} END FROM @customer, @each(0, 9) r(c)
UNION ALL SELECT {_OWN}, 40, 0, c_name FROM @customer"""


@family.query(f"""WITH s AS (SELECT {_OWN}, c_custkey AS k, c_custkey % 12 AS a, c_custkey % 12 + 3 AS b, 3 + c_custkey % 8 AS m FROM customer),
w AS (SELECT *, CASE WHEN a < 10 AND m >= 4 AND k % 5 <> 0 THEN 'a' WHEN b < 10 THEN 'b' ELSE 'none' END AS w FROM s)
SELECT form_id, file, sheet, CASE w WHEN 'a' THEN a ELSE b END::INT AS header_row, {_HEADROLES}[c + 1] AS role, CASE w WHEN 'a' THEN (c + k) % 10 ELSE c END::INT AS col_idx FROM w, generate_series(0, 9) r(c) WHERE w = 'b' OR (w = 'a' AND c < m)
UNION ALL SELECT form_id, file, sheet, 0, unnest({K.MATRIX_FALLBACK}), unnest(range(0, {len(K.MATRIX_FALLBACK)}))::INT FROM w WHERE w = 'none'""")
def detect_header_moved(spark, sf):
    """headings at different rows, in other columns, too short ones, ones too far down"""
    return SH.detect_header(spark_table(spark, sf, _MOVED), fallback=K.MATRIX_FALLBACK)


@family.query(f"""SELECT {_OWN}, CASE WHEN a < 8 AND (m = 10 OR b >= 8) THEN a WHEN b < 8 THEN b ELSE 0 END::INT AS header_row FROM (SELECT *, c_custkey % 12 AS a, c_custkey % 12 + 3 AS b, 3 + c_custkey % 8 AS m FROM customer)""")
def header_by_density_moved(spark, sf):
    return SH.header_by_density(spark_table(spark, sf, _MOVED))


_ROW0 = f"(SELECT form_id, file, sheet, sheet_ord, row_idx - 1 AS row_idx, col_idx, value FROM {C} WHERE row_idx > 0)"


def _row0(spark, sf):
    return cells(spark, sf).where("row_idx > 0").withColumn("row_idx", F.col("row_idx") - 1)


@family.query(f"""SELECT form_id, file, sheet, r AS role, c AS col_idx, how FROM (SELECT DISTINCT form_id, file, sheet FROM {C}), (VALUES ('label', 0, 'column'), ('data_type', 1, 'column'), ('required', 3, 'column'), ('value', 4, 'column'), ('visualization', 5, 'column'), ('obs', 6, 'column'),
  ('product_scope', 7, 'column'), ('json_name', 8, 'column'), ('pdf_field_name', 9, 'column'), ('source', 9, 'pattern'), ('name', 9, 'last'), ('form', 7, 'last')) t(r, c, how)""")
def header_by_pattern(spark, sf):
    top = _row0(spark, sf)
    parts = [(K.FLEX_HEADERS, "column"), ([("source", rx) for rx in K.SOURCE_HEADERS], "pattern"), ([("name", "(?i)nombre del campo"), ("form", "(?i)formulario")], "last")]
    out = [SH.header_by_pattern(top, p, how).withColumn("how", F.lit(how)) for p, how in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _pivot_sql(source: str, first: int) -> str:
    col = "trim(coalesce(max(value) FILTER (col_idx = {0}), ''))"
    return f"""SELECT form_id, file, sheet, row_idx, {col.format(0)} AS field_label, {col.format(1)} AS data_type, {col.format(4)} AS value, {col.format(9)} AS pdf_field_name FROM {source} WHERE row_idx > {first} GROUP BY ALL"""


@family.query(_pivot_sql(C, 1))
def pivot_rows(spark, sf):
    c = cells(spark, sf)
    return SH.pivot_rows(c, SH.detect_header(c), ["field_label", "data_type", "value", "pdf_field_name"], ["field_label", "value"])


@family.query(_pivot_sql(_ROW0, 0))
def read_custom_matrix(spark, sf):
    return SH.read_custom_matrix(_row0(spark, sf), {"field_label": 0, "data_type": 1, "value": 4, "pdf_field_name": 9}, ["field_label"])


# Ficha sheets: 14 columns by position, a node per supplier nation.
FICHA = """SELECT concat('S', s_suppkey) AS form_id, 'ficha.xlsx' AS file, CASE s_nationkey % 6 WHEN 0 THEN 'Estructura  base JSON' WHEN 1 THEN 'JSON generado' ELSE concat('nodo', s_nationkey) END AS sheet, s_nationkey AS sheet_ord, r AS row_idx, c AS col_idx,
  CASE WHEN r = 0 THEN concat('H', c) WHEN r = 3 AND s_nationkey % 7 = 2 AND c = 0 THEN 'No aplica para este  formulario' WHEN c = 0 THEN CASE WHEN r % 3 = 0 THEN '' WHEN r % 5 = 0 THEN 'Json' ELSE concat('Nodo ', r) END WHEN c = 1 THEN concat('Paso ', r)
    WHEN c = 2 THEN CASE WHEN s_nationkey % 6 = 0 THEN concat('Sec ', r) ELSE 'pdf' END WHEN c = 3 THEN CASE WHEN r % 4 = 0 THEN ' ' ELSE concat(' Label  ', r) END WHEN c = 4 THEN CASE WHEN r % 2 = 0 THEN 'Radio/Combo' ELSE 'Numérico' END WHEN c = 6 THEN CASE WHEN r = 7 THEN 'No aplica formulario' ELSE 'x' END
    WHEN c = 7 THEN CASE WHEN r % 5 = 1 THEN 'Web' ELSE 'Si' END WHEN c = 9 THEN CASE r % 3 WHEN 0 THEN 'No aplica' WHEN 1 THEN 'Disabled' ELSE 'Dato prellenado' END WHEN c = 12 THEN CASE WHEN r % 4 < 2 THEN '' ELSE concat('a.b', r, ', c.d') END WHEN c = 13 THEN CASE WHEN r % 8 = 0 THEN '' ELSE concat('s', r) END ELSE '' END AS value
FROM (SELECT s_suppkey, s_nationkey, CAST(rr AS INT) AS r, CAST(cc AS INT) AS c FROM @supplier, @each(0, 11) t1(rr), @each(0, 13) t2(cc)) x"""
FC = duck(FICHA)


def ficha(spark, sf):
    return spark_table(spark, sf, FICHA)


@family.query(f"""SELECT form_id, file, sheet, CASE sheet WHEN 'Estructura  base JSON' THEN 'indice' WHEN 'JSON generado' THEN 'ejemplo' ELSE 'nodo' END AS role, sheet LIKE 'nodo%' AND b AS empty FROM (SELECT form_id, file, sheet, bool_or(regexp_replace(upper(value), '\\s+', ' ', 'g') = 'NO APLICA PARA ESTE FORMULARIO') AS b FROM {FC} GROUP BY form_id, file, sheet)""")
def sheet_roles(spark, sf):
    return SH.sheet_roles(ficha(spark, sf))


_g = "max(value) FILTER (col_idx = {0})"


@family.query(f"""
WITH e AS (SELECT form_id FROM {FC} GROUP BY 1 HAVING bool_or(value = 'No aplica para este  formulario')),
p AS (SELECT form_id, sheet, row_idx, {_g.format(0)} AS step, trim(regexp_replace({_g.format(3)}, '\\s+', ' ', 'g')) AS label, {_g.format(4)} AS data_type, {_g.format(6)} AS rule, {_g.format(7)} AS req, {_g.format(9)} AS vis, {_g.format(12)} AS route, {_g.format(13)} AS sn
  FROM {FC} WHERE row_idx > 0 AND sheet LIKE 'nodo%' AND form_id NOT IN (SELECT form_id FROM e) GROUP BY ALL)
SELECT form_id, sheet, row_idx, label, CASE data_type WHEN 'Numérico' THEN 'number' ELSE 'radio' END AS type, split_part(route, ',', 1) AS route, CASE WHEN route = '' THEN 0 ELSE 2 END AS n_routes, sn AS source_name,
  CASE WHEN row_idx = 7 THEN 'excluido' WHEN route = '' THEN 'label' WHEN step = 'Json' THEN 'soloJSON' WHEN req = 'Web' THEN 'soloWeb' WHEN vis = 'No aplica' THEN 'oculto' WHEN vis = 'Disabled' THEN 'readOnly' ELSE 'normal' END AS dest FROM p WHERE label <> '' OR route <> '' OR sn <> ''""")
def ficha_rows(spark, sf):
    r = SH.read_positional(ficha(spark, sf))
    return r.select("form_id", "sheet", "row_idx", "label", "type", "route", F.size("routes").alias("n_routes"), "source_name", "dest")


@family.query(f"""
WITH p AS (SELECT form_id, row_idx, {_g.format(0)} AS node, {_g.format(1)} AS step, {_g.format(2)} AS section FROM {FC} WHERE row_idx > 0 AND sheet LIKE 'Estructura%' GROUP BY ALL)
SELECT form_id, row_idx AS ord, coalesce(last_value(nullif(node, '') IGNORE NULLS) OVER (PARTITION BY form_id ORDER BY row_idx), '') AS node, step, section, node = '' AS is_instance FROM p""")
def ficha_index(spark, sf):
    c = ficha(spark, sf).where("sheet LIKE 'Estructura%'")
    return SH.read_ficha_index(c).select("form_id", "ord", "node", "step", "section", "is_instance")


# Mapping sheets: 22 columns, one row per order, one sheet per status and priority.
MAP22 = """SELECT o_orderpriority AS form_id, concat(o_orderstatus, '.xlsx') AS file, 'Mapeo' AS sheet, 0 AS sheet_ord, CAST(o_orderkey + 1 AS INT) AS row_idx, CAST(n AS INT) AS col_idx,
  CASE n WHEN 0 THEN CAST(o_orderkey AS STRING) WHEN 2 THEN CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE concat('W', o_orderkey) END WHEN 3 THEN CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN concat('W', o_orderkey) ELSE concat('p', o_custkey) END
    WHEN 8 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE CAST(o_custkey % 7 AS STRING) END WHEN 11 THEN CASE o_orderkey % 3 WHEN 0 THEN 'Sí' WHEN 1 THEN '' ELSE '?' END WHEN 13 THEN CAST(o_custkey % 4 AS STRING) WHEN 15 THEN ' FECHA'
    WHEN 18 THEN CASE o_orderkey % 6 WHEN 0 THEN concat('[{"value":"', o_custkey, '","label":"L"},{"value":"2"}]') WHEN 1 THEN '[{"value":' ELSE '' END ELSE concat('c', n) END AS value
FROM @orders, @each(0, 21) t(n)"""
_MAPD = MAP22.replace("AS STRING)", "AS VARCHAR)")
M22 = duck(_MAPD)


@family.query(f"""
WITH p AS (SELECT form_id, file, row_idx, {_g.format(2)} AS a, {_g.format(3)} AS b, {_g.format(8)} AS page, {_g.format(11)} AS pre, {_g.format(13)} AS m, {_g.format(18)} AS o FROM {M22} WHERE row_idx > 0 GROUP BY ALL)
SELECT form_id, file, row_idx, a AS acro_actual, b AS acro_proposed, try_cast(page AS INT) AS page, CASE pre WHEN 'Sí' THEN true WHEN '' THEN false END AS prefilled, nullif(m::INT, 0) AS max_length, 'fecha' AS format,
  CASE WHEN o LIKE '%}}]' THEN 2 END AS n_options, CASE WHEN o LIKE '%:' THEN 'invalid_options_json' END AS warning FROM p WHERE trim(a) <> ''""")
def mapping_rows(spark, sf):
    rows, warnings = SH.read_mapping22(spark_table(spark, sf, MAP22))
    w = warnings.select(*KEY, (F.col("row") - 1).alias("row_idx"), F.col("type").alias("warning"))
    valid = F.when((F.col("options_raw") != "") & F.col("warning").isNull(), F.size("options"))
    return rows.join(w, [*KEY, "row_idx"], "left").select("form_id", "file", "row_idx", "acro_actual", "acro_proposed", "page", "prefilled", "max_length", "format",
                                                          valid.alias("n_options"), "warning")


_HEADS = "SELECT s_suppkey, CAST(n AS INT) AS col_idx, CASE WHEN (s_suppkey + n) % 5 = 0 THEN concat('otro ', s_suppkey) ELSE upper(concat('col', n)) END AS value FROM @supplier, @each(0, 14 + s_nationkey % 10) t(n)"


@family.query(f"""
WITH h AS (SELECT * FROM {duck(_HEADS)}), n AS (SELECT s_suppkey, max(col_idx) + 1 AS n FROM h GROUP BY 1)
SELECT s_suppkey AS form_id, 'missing_columns' AS type, NULL AS "column", NULL AS expected, n::VARCHAR AS actual FROM n WHERE n < 20
UNION ALL SELECT n.s_suppkey, 'header_mismatch', i + 1, 'Col' || i, coalesce(value, '') FROM n JOIN generate_series(0, 21) t(i) ON true LEFT JOIN h ON h.s_suppkey = n.s_suppkey AND col_idx = i WHERE n >= 20 AND lower(coalesce(value, '')) <> 'col' || i""")
def validate_headers(spark, sf):
    h = spark_table(spark, sf, _HEADS).select(F.col("s_suppkey").alias("form_id"), F.lit("f").alias("file"), F.lit("s").alias("sheet"), F.lit(0).alias("row_idx"), "col_idx", "value")
    return SH.validate_headers(h, [f"Col{i}" for i in range(22)]).select("form_id", "type", "column", "expected", "actual")


_PAIRS = """SELECT o_orderpriority AS form_id, 'f' AS file, 's' AS sheet, 0 AS row_idx, 3 AS col_idx, 'ACROFORM  Actual' AS value FROM @orders GROUP BY 1 UNION ALL SELECT o_orderpriority, 'f', 's', 0, 5, 'AcroForm propuesto' FROM @orders GROUP BY 1
UNION ALL SELECT o_orderpriority, 'f', 's', CAST(o_orderkey + 1 AS INT), 3, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE concat('a', o_custkey) END FROM @orders UNION ALL SELECT o_orderpriority, 'f', 's', CAST(o_orderkey + 1 AS INT), 5, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN concat('a', o_custkey) ELSE 'nuevo' END FROM @orders"""


@family.query("""SELECT o_orderpriority AS form_id, (o_orderkey + 1)::INT AS row_idx, 'a' || o_custkey AS actual, CASE WHEN o_orderkey % 3 = 2 THEN 'nuevo' ELSE 'a' || o_custkey END AS proposed FROM orders WHERE o_orderkey % 7 <> 0""")
def rename_pairs(spark, sf):
    return SH.read_rename_pairs(spark_table(spark, sf, _PAIRS)).select("form_id", "row_idx", "actual", "proposed")


@family.query(f"""SELECT form_id, file, CASE WHEN a AND b AND file LIKE '%small%' THEN 'canonical' WHEN file LIKE '%large%' AND c THEN 'new' ELSE 'mapping22' END AS layout FROM (SELECT form_id, file, bool_or(sheet = 'Campos') AS a, bool_or(sheet = 'Catálogo X') AS b, bool_or(sheet = 'Portada') AS c FROM {C} GROUP BY form_id, file)""")
def sheet_layouts(spark, sf):
    c = cells(spark, sf)
    small = F.col("file").contains("small")
    sheet = F.when((F.col("sheet") == "Catálogo X") & small, "Opciones").when((F.col("sheet") == "Portada") & F.col("file").contains("large"), "Campos del formulario").when(
        (F.col("sheet") == "Opciones"), "x").otherwise(F.col("sheet"))
    return SH.detect_layout(c.withColumn("sheet", sheet))


_CATC = """SELECT 'g' AS form_id, 'catalogos.xlsx' AS file, n_name AS sheet, n_nationkey AS sheet_ord, 0 AS row_idx, CAST(c AS INT) AS col_idx, CASE c WHEN 0 THEN CASE n_nationkey % 3 WHEN 0 THEN 'Código' WHEN 1 THEN 'Nombre' ELSE 'Alfa' END WHEN 1 THEN CASE n_nationkey % 3 WHEN 0 THEN 'Descripción' WHEN 1 THEN 'Clave' ELSE 'Beta' END ELSE 'Otro' END AS value FROM @nation, @each(0, 2) r(c)
UNION ALL SELECT 'g', 'catalogos.xlsx', n_name, n_nationkey, CAST(c_custkey + 1 AS INT), 0, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('A', c_custkey) END FROM @customer JOIN @nation ON n_nationkey = c_nationkey UNION ALL SELECT 'g', 'catalogos.xlsx', n_name, n_nationkey, CAST(c_custkey + 1 AS INT), 1, CASE WHEN c_custkey % 8 = 0 THEN ' ' ELSE concat(' B', c_custkey) END FROM @customer JOIN @nation ON n_nationkey = c_nationkey"""


@family.query(f"""
WITH p AS (SELECT sheet, sheet_ord, row_idx AS ord, trim({_g.format(0)}) AS a, trim({_g.format(1)}) AS b FROM {duck(_CATC)} WHERE row_idx > 0 GROUP BY ALL)
SELECT sheet AS catalog, {slug('sheet')} AS catalog_key, ord, CASE WHEN sheet_ord % 3 = 1 THEN b ELSE a END AS code, CASE WHEN sheet_ord % 3 = 1 THEN a ELSE b END AS label FROM p WHERE a <> '' OR b <> ''""")
def read_catalogs(spark, sf):
    return SH.read_catalogs(spark_table(spark, sf, _CATC)).select("catalog", "catalog_key", "ord", "code", "label")


@family.query(f"""
WITH c AS (SELECT *, CASE WHEN row_idx = 0 THEN CASE col_idx WHEN 0 THEN 'codigo' WHEN 1 THEN CASE WHEN sheet_ord % 2 = 0 THEN 'Nombre' ELSE 'Descripcion' END ELSE value END ELSE value END AS v FROM {duck(_CATC)}),
p AS (SELECT sheet, row_idx AS ord, trim(max(v) FILTER (col_idx = 0)) AS code, trim(max(v) FILTER (col_idx = 1)) AS label FROM c WHERE row_idx > 0 GROUP BY ALL)
SELECT sheet AS catalog, ord, code, label FROM p WHERE label <> ''""")
def read_catalogs_strict(spark, sf):
    head = F.col("row_idx") == 0
    v = F.when(head & (F.col("col_idx") == 0), "codigo").when(head & (F.col("col_idx") == 1), F.when(F.col("sheet_ord") % 2 == 0, "Nombre").otherwise("Descripcion")).otherwise(F.col("value"))
    return SH.read_catalogs(spark_table(spark, sf, _CATC).withColumn("value", v), strict=True).select("catalog", "ord", "code", "label")


@family.query("""SELECT conv_id::VARCHAR AS form_id, string_agg(role || len(text), chr(10) ORDER BY turn) AS body, false AS valid FROM conversations GROUP BY 1
UNION ALL SELECT 'doc' || c_custkey, '{' || chr(10) || '"a":' || c_custkey || '}', true FROM customer""")
def lines_as_json(spark, sf):
    c = read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("form_id"), F.col("turn").cast("int").alias("row_idx"), F.lit(0).alias("col_idx"),
                                                F.concat("role", F.length("text")).alias("value"))
    k = read(spark, sf, "customer").select(F.concat(F.lit("doc"), "c_custkey").alias("form_id"), F.explode(F.array(
        F.struct(F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("{").alias("value")), F.struct(F.lit(1).alias("row_idx"), F.lit(0).alias("col_idx"), F.lit('"a":').alias("value")),
        F.struct(F.lit(1).alias("row_idx"), F.lit(3).alias("col_idx"), F.concat("c_custkey", F.lit("}")).alias("value")))).alias("x")).select("form_id", "x.*")
    both = c.unionByName(k).withColumns({"file": F.lit("f"), "sheet": F.lit("s")})
    return SH.read_lines_as_json(both).select("form_id", "body", "valid")


# a sheet per nation with a line per customer, one that breaks off per supplier, and plain text per conversation
_SHEETJSON = """SELECT concat('n', n_nationkey) AS form_id, 0 AS row_idx, concat('{"pais":"', n_name, '","clientes":[null') AS line FROM @nation
UNION ALL SELECT concat('n', c_nationkey), CAST(c_custkey + 1 AS INT), concat(', {"id": ', c_custkey, ', "activo":true,"alias":["x:', c_custkey, '",[ ]]}') FROM @customer
UNION ALL SELECT concat('n', n_nationkey), 2000000000, ']}' FROM @nation
UNION ALL SELECT concat('s', s_suppkey), 0, '{"a":[1' FROM @supplier
UNION ALL SELECT concat('c', conv_id), CAST(turn AS INT), concat(coalesce(role, ''), ' x') FROM @conversations"""


def _sheet_json(spark, sf):
    return JL.read_json_lines(spark_table(spark, sf, _SHEETJSON).withColumns({"file": F.lit("f"), "sheet": F.lit("s")}))


@family.query(f"""SELECT concat('n', n_nationkey) AS form_id, 0 AS row_idx, unnest(['pais', 'clientes', 'clientes[]']) AS path, unnest(['leaf', 'array', 'leaf']) AS kind, unnest([n_name, NULL, NULL]) AS value FROM nation
UNION ALL SELECT concat('n', c_nationkey), CAST(c_custkey + 1 AS INT), unnest(['clientes[]', 'clientes[].id', 'clientes[].activo', 'clientes[].alias', 'clientes[].alias[]', 'clientes[].alias[]']),
  unnest(['object', 'leaf', 'leaf', 'array', 'leaf', 'array']), unnest([NULL, CAST(c_custkey AS VARCHAR), 'true', NULL, concat('x:', c_custkey), NULL]) FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)""")
def json_sheet_nodes(spark, sf):
    """JSON sheets read by lines: the nodes of those that hold a document"""
    return _sheet_json(spark, sf)[1].select("form_id", "row_idx", "path", "kind", "value")


@family.query(f"""SELECT form_id, left(form_id, 1) = 'n' AS valid, CASE WHEN left(form_id, 1) = 'c' THEN min(row_idx) END AS fault_row FROM {duck(_SHEETJSON)} GROUP BY 1""")
def json_sheet_faults(spark, sf):
    """JSON sheets read by lines: whether they hold a document, and the first row out of place"""
    return _sheet_json(spark, sf)[0].select("form_id", "valid", "fault_row")


@family.query(f"""SELECT 'Campos' AS sheet, form_id, file, c.row_idx, h.value AS header, trim(c.value) AS value FROM {_ROW0} c JOIN (SELECT DISTINCT col_idx, value FROM {_ROW0} WHERE row_idx = 0) h USING (col_idx) WHERE c.row_idx > 0 AND sheet = 'Campos' AND trim(c.value) <> ''""")
def canonical_rows(spark, sf):
    fields, _ = SH.read_canonical(_row0(spark, sf))
    return fields.select("sheet", "form_id", "file", "row_idx", "header", "value")


_FILES = """SELECT page_id AS form_id, CASE page_id % 6 WHEN 0 THEN concat('__MACOSX/', page_id, '.pdf') WHEN 1 THEN concat('a/._b', page_id) WHEN 2 THEN concat('dir/Matriz ', page_id, '.XLSX') WHEN 3 THEN concat('x/y/', page_id, '.pdf') WHEN 4 THEN concat('def_v', page_id, '.json') ELSE concat('raro', page_id) END AS path,
  CASE page_id % 4 WHEN 0 THEN length(html) WHEN 1 THEN length(html) * 700 WHEN 2 THEN 900 END AS length FROM @pages"""


@family.query(f"""
SELECT form_id, path, list_last(string_split(path, '/')) AS name, regexp_extract(lower(path), '\\.([a-z0-9]+)$', 1) AS ext, length AS size, CASE WHEN length IS NULL THEN '' WHEN length < 1024 THEN length || ' B' WHEN length < 1048576 THEN printf('%.1f', floor(length / 1024 * 10 + 0.5) / 10) || ' KB' ELSE printf('%.1f', floor(length / 1024 / 1024 * 10 + 0.5) / 10) || ' MB' END AS size_label,
  CASE regexp_extract(lower(path), '\\.([a-z0-9]+)$', 1) WHEN 'pdf' THEN 'pdf' WHEN 'xlsx' THEN 'excel' WHEN 'json' THEN 'json' ELSE 'otro' END AS kind,
  CASE WHEN form_id % 2 = 0 THEN 'D0309' ELSE NULL END AS known, 'Base' AS code FROM {duck(_FILES)} WHERE form_id % 6 > 1""")
def file_inventory(spark, sf):
    inv = FS.file_inventory(spark_table(spark, sf, _FILES))
    name = F.when(F.col("form_id") % 2 == 0, F.concat(F.lit("x_d0309_"), "form_id")).otherwise(F.lit("nada.pdf"))
    code = F.when(F.col("form_id") % 2 == 0, FS.form_code_of_json(F.lit("Base_v3.PDF"), "path")).otherwise(FS.form_code_of_pdf(F.lit("Base.pdf")))
    return inv.withColumn("known", FS.known_form_code(name)).withColumn("code", code)


# ---- rule counts -------------------------------------------------------------------------

_RULES = f"""WITH x AS (SELECT *, trim(value) AS v FROM {C} WHERE trim(value) <> ''), d AS (SELECT * FROM x WHERE row_idx > 1 AND sheet <> 'Portada'),
j AS (SELECT *, strip_accents(lower(v)) IN ('no', 'n/a', '-', 'na', 'no aplica', 'ninguna') AS junk, regexp_matches(v, '(?i)(^|[^a-z0-9_])si\\s|cuando|depende|seg[uú]n|>=') AS cond FROM d WHERE col_idx IN (2, 3, 4, 5, 6)),
k AS (SELECT *, CASE WHEN junk THEN '' WHEN col_idx = 3 THEN CASE WHEN v IN ('Sí', 'X') THEN 'b' ELSE '' END WHEN col_idx IN (2, 5, 6) AND cond THEN 'c' WHEN col_idx = 4 AND v = 'Ver catálogo' THEN 'r' ELSE 'b' END AS w FROM j),
s AS (SELECT form_id, file, sheet, count(DISTINCT row_idx) AS rows, count(DISTINCT CASE WHEN col_idx IN (0, 8, 9) THEN row_idx END) AS field_rows FROM d GROUP BY ALL),
r AS (SELECT form_id, file, sheet, count(*) FILTER (w IN ('b', 'r')) AS b, count(*) FILTER (w = 'c') AS c, count(*) FILTER (w = 'r') AS q FROM k GROUP BY ALL),
z AS (SELECT form_id, file, sheet, 10 AS columns, 6 AS rule_columns, rows, field_rows, CASE WHEN sheet = 'Catálogo X' THEN 0 ELSE coalesce(b, 0) END AS business_rules, CASE WHEN sheet = 'Catálogo X' THEN 0 ELSE coalesce(c, 0) END AS conditional_rules, coalesce(q, 0) AS catalog_refs,
  sheet = 'Catálogo X' AS is_catalog, CASE WHEN sheet = 'Catálogo X' THEN rows ELSE 0 END AS catalog_items, false AS ignored FROM s LEFT JOIN r USING (form_id, file, sheet)
  UNION ALL SELECT form_id, file, sheet, 0, 0, count(DISTINCT row_idx), 0, 0, 0, 0, false, 0, true FROM x WHERE sheet = 'Portada' GROUP BY ALL)"""


@family.query(f"{_RULES} SELECT * FROM z".replace("6 AS rule_columns", "5 AS rule_columns"))
def sheet_rules(spark, sf):
    return SH.sheet_rules(cells(spark, sf))[0]


@family.query(f"""{_RULES} SELECT form_id, file, count(*) AS sheet_count, count(*) FILTER (ignored) AS ignored_sheets, sum(business_rules)::BIGINT AS business_rules, sum(conditional_rules)::BIGINT AS conditional_rules, sum(field_rows)::BIGINT AS field_rows,
  sum(catalog_items)::BIGINT AS catalog_items, sum(catalog_refs)::BIGINT AS catalog_refs, count(*) FILTER (is_catalog) AS catalogs FROM z GROUP BY ALL""")
def file_rules(spark, sf):
    return SH.file_rules(SH.sheet_rules(cells(spark, sf))[0])


@family.query(f"""SELECT form_id, file, sheet, row_idx, string_agg(strip_accents(lower(trim(value))), '|' ORDER BY col_idx) AS field_key FROM {C} WHERE row_idx > 1 AND sheet <> 'Portada' AND col_idx IN (0, 8, 9) AND trim(value) <> '' GROUP BY ALL""")
def field_keys(spark, sf):
    return SH.sheet_rules(cells(spark, sf))[1]


# ---- reuse: a project is a language, a file a source, its names the words of its documents ------

_WORDS = "(SELECT lang AS project, source AS file, substr(source, 4)::INT AS file_ord, unnest(string_split_regex(lower(text), '\\s+')) AS name FROM documents)"
_PER = f"""(WITH w AS (SELECT DISTINCT project, file, file_ord, name FROM {_WORDS}), s AS (SELECT project, file, count(*) AS n FROM w GROUP BY ALL), f AS (SELECT project, name, min((-n, file_ord)) AS first FROM w JOIN s USING (project, file) GROUP BY ALL)
SELECT project, file, (-n, file_ord) AS rank, n AS total, count(*) FILTER (first < (-n, file_ord)) AS shared FROM w JOIN s USING (project, file) JOIN f USING (project, name) GROUP BY project, file, n, file_ord)"""


def _names(spark, sf):
    d = read(spark, sf, "documents")
    words = d.select(F.col("lang").alias("project"), F.col("source").alias("file"), F.substr("source", F.lit(4)).cast("int").alias("file_ord"),
                     F.explode(F.split(F.lower("text"), r"\s+")).alias("name")).distinct()
    sizes = words.groupBy("project", "file").agg(F.count(F.lit(1)).alias("size"))
    return words.join(sizes, ["project", "file"])


@family.query(f"SELECT project, file, total, shared, total - shared AS own FROM {_PER}")
def word_reuse(spark, sf):
    return S.reuse(_names(spark, sf)).drop("rank")


@family.query(f"""SELECT p.project, file, against, shared, total - shared AS own, floor(shared * 100 / total + 0.5)::INT AS percent FROM {_PER} p JOIN (SELECT project, arg_min(file, rank) AS against, min(rank) AS top FROM {_PER} GROUP BY 1) t ON p.project = t.project WHERE rank > top""")
def reuse_pairs(spark, sf):
    return S.reuse_pairs(S.reuse(_names(spark, sf)))


@family.query(f"""SELECT project, sum(total)::BIGINT AS pdf_total, sum(shared)::BIGINT AS pdf_shared, (sum(total) - sum(shared))::BIGINT AS pdf_own, coalesce(any_value(e), 0) AS excel_total, 0 AS excel_shared, coalesce(any_value(e), 0) AS excel_own,
  floor(sum(shared) * 100 / (sum(total) + coalesce(any_value(e), 0)) + 0.5)::INT AS percent FROM {_PER} LEFT JOIN (SELECT lang AS project, count(*) AS e FROM documents GROUP BY 1) USING (project) GROUP BY project""")
def reuse_totals(spark, sf):
    d = read(spark, sf, "documents")
    excel = S.reuse(d.select(F.col("lang").alias("project"), F.col("source").alias("file"), F.lit(0).alias("file_ord"), F.lit(0).alias("size"), F.col("doc_id").alias("name")))
    return S.reuse_totals(S.reuse(_names(spark, sf)), excel)


# ---- scores: a project is a customer segment; PDFs are customers, spreadsheets nations -----------

PDFS = "SELECT c_mktsegment AS project, concat('Solicitud ', CASE WHEN c_custkey % 3 = 0 THEN concat('nation', c_nationkey, ' vida ') ELSE '' END, c_custkey, '.pdf') AS file, c_custkey AS file_ord, c_custkey % 50 AS field_count, c_custkey % 4 AS pages, c_custkey % 3 AS repeater_groups, c_custkey % 20 AS unique_configs FROM @customer"
EXCELS = "SELECT c_mktsegment AS project, concat('Ficha nation', c_nationkey, CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE '_x' END, '.xlsx') AS file, c_nationkey AS file_ord, sum(c_custkey % 7) AS business_rules, sum(c_custkey % 3) AS conditional_rules, count(*) AS catalogs, 1 AS catalog_refs, sum(c_custkey % 11) AS catalog_items FROM @customer GROUP BY c_mktsegment, c_nationkey"
DEFS = "SELECT c_mktsegment AS project, concat('def', c_custkey, '.json') AS file, c_custkey % 2 = 0 AS is_definition, c_custkey * 30 AS fields, c_custkey % 5 AS repeaters, 1 AS lookups, c_custkey % 90 AS conditionals, c_custkey % 70 AS rules FROM @customer"
P, X, D = duck(PDFS), duck(EXCELS), duck(DEFS)


def _totals(spark, sf):
    t = S.project_totals(spark_table(spark, sf, PDFS), spark_table(spark, sf, EXCELS), spark_table(spark, sf, DEFS))
    return t.withColumn("repeated_fields", F.lit(500)).withColumn("repeated_rules", F.lit(100))


_TOT = f"""(SELECT project, pdfs, greatest(pdf_fields, f) AS pdf_fields, pages, greatest(p.repeaters, r) AS repeaters, unique_configs, excels, greatest(business_rules, b) AS business_rules, greatest(conditional_rules, c) AS conditional_rules, catalogs, catalog_items, pdfs - 1 AS extra_forms, 500 AS repeated_fields, 100 AS repeated_rules
FROM (SELECT project, count(*) AS pdfs, sum(field_count)::BIGINT AS pdf_fields, sum(pages)::BIGINT AS pages, sum(repeater_groups)::BIGINT AS repeaters, sum(unique_configs)::BIGINT AS unique_configs FROM {P} GROUP BY 1) p
JOIN (SELECT project, count(*) AS excels, sum(business_rules)::BIGINT AS business_rules, sum(conditional_rules)::BIGINT AS conditional_rules, sum(catalogs + catalog_refs)::BIGINT AS catalogs, sum(catalog_items)::BIGINT AS catalog_items FROM {X} GROUP BY 1) e USING (project)
JOIN (SELECT project, max(repeaters + lookups) AS r, max(conditionals) AS c, max(rules) AS b, max(fields) AS f FROM {D} GROUP BY 1) d USING (project))"""


@family.query(f"SELECT * FROM {_TOT}")
def project_totals(spark, sf):
    return _totals(spark, sf)


_LINES = f"""(SELECT project, line, label, n::DOUBLE AS count, floor(n * w * 10 + 0.5) / 10 AS points FROM (SELECT project, unnest(generate_series(1, 10)) AS line, unnest(['Campos del PDF (nuevos)', 'Campos repetidos', 'Páginas', 'Reglas de negocio (nuevas)', 'Reglas repetidas', 'Visibilidad condicional', 'Bloques repetidos', 'Catálogos', 'Ítems de catálogo', 'Formularios extra']) AS label,
  unnest([pdf_fields - 500, 500, pages, business_rules - 100, 100, conditional_rules, repeaters, catalogs, catalog_items, extra_forms]) AS n, unnest([1::DOUBLE, 0.15::DOUBLE, 2, 2.5::DOUBLE, 2.5::DOUBLE * 0.15::DOUBLE, 6, 10, 5, 0.2::DOUBLE, 40]) AS w FROM {_TOT}))"""


@family.query(f"SELECT project, line::INT AS line, label, count, points FROM {_LINES}")
def score_breakdown(spark, sf):
    return S.breakdown(_totals(spark, sf))


_SCORE = f"(SELECT project, floor(sum(points) * 10 + 0.5) / 10 AS points FROM {_LINES} GROUP BY 1)"


@family.query(f"""SELECT project, floor((500 * (1 - 0.15::DOUBLE) + 100 * 2.5::DOUBLE * (1 - 0.15::DOUBLE)) * 10 + 0.5) / 10 AS saved_points, points, CASE WHEN points <= 900 THEN 'baja' WHEN points <= 1800 THEN 'media' ELSE 'alta' END AS level, CASE WHEN points <= 900 THEN 1 WHEN points <= 1800 THEN 2 ELSE 3 END AS weeks,
  floor(points * 0.035 * 0.8 + 0.5)::BIGINT AS hours_min, floor(points * 0.035 * 1.3 + 0.5)::BIGINT AS hours_max FROM {_SCORE}""")
def project_scores(spark, sf):
    return S.score(_totals(spark, sf))


@family.query("""
WITH c AS (SELECT o_orderkey, o_totalprice / 100 AS p, o_orderstatus AS s FROM orders)
SELECT o_orderkey, CASE s WHEN 'F' THEN greatest(10, floor(p * 1.3::DOUBLE / 10 + 0.5) * 10) WHEN 'O' THEN CASE WHEN 900 >= greatest(10, floor(p * 0.8::DOUBLE / 10 + 0.5) * 10) THEN greatest(10, floor(greatest(10, floor(p * 0.8::DOUBLE / 10 + 0.5) * 10) * 0.35::DOUBLE / 10 + 0.5) * 10) ELSE 900 END ELSE greatest(10, floor(p * 0.55::DOUBLE / 10 + 0.5) * 10) END::DOUBLE AS baja,
  CASE s WHEN 'F' THEN CASE WHEN 1800 <= greatest(10, floor(p * 1.3::DOUBLE / 10 + 0.5) * 10) THEN greatest(10, floor(greatest(10, floor(p * 1.3::DOUBLE / 10 + 0.5) * 10) * 3 / 10 + 0.5) * 10) ELSE 1800 END WHEN 'O' THEN greatest(10, floor(p * 0.8::DOUBLE / 10 + 0.5) * 10) ELSE greatest(10, floor(p * 1.45::DOUBLE / 10 + 0.5) * 10) END::DOUBLE AS media FROM c""")
def calibrated_cuts(spark, sf):
    target = F.when(F.col("o_orderstatus") == "F", "Fácil").when(F.col("o_orderstatus") == "O", "ALTA").otherwise("Media")
    cut = S.calibrate(F.col("o_totalprice") / 100, target, F.lit(900.0), F.lit(1800.0))
    return read(spark, sf, "orders").select("o_orderkey", cut.baja.alias("baja"), cut.media.alias("media"))


_FILESC = f"""(SELECT project, file, 'pdf' AS kind, CASE WHEN file = arg_max(file, (field_count, -file_ord)) OVER (PARTITION BY project) THEN 'Formulario principal' ELSE 'Variante / anexo' END AS role, (field_count + pages * 2 + repeater_groups * 10)::DOUBLE AS points FROM {P}
UNION ALL SELECT project, file, 'excel', CASE WHEN business_rules = 0 AND conditional_rules = 0 THEN 'Catálogos / datos' ELSE 'Ficha de reglas' END, floor((business_rules * 2.5::DOUBLE + conditional_rules * 6 + (catalogs + catalog_refs) * 5 + catalog_items * 0.2::DOUBLE) * 10 + 0.5) / 10 FROM {X}
UNION ALL SELECT project, file, 'json', CASE WHEN is_definition THEN 'Definición ya construida' ELSE 'Datos / ejemplo' END, 0 FROM {D})"""


def _files(spark, sf):
    return S.classify_files(spark_table(spark, sf, PDFS), spark_table(spark, sf, EXCELS), spark_table(spark, sf, DEFS), S.score(_totals(spark, sf)))


@family.query(f"""SELECT f.project, file, kind, role, f.points, CASE WHEN kind = 'json' THEN 'info' WHEN f.points <= 900 THEN 'baja' WHEN f.points <= 1800 THEN 'media' ELSE 'alta' END AS level, CASE WHEN kind = 'json' THEN 0 ELSE floor(f.points * 100 / s.points + 0.5) END::INT AS share FROM {_FILESC} f JOIN {_SCORE} s ON f.project = s.project""")
def classified_files(spark, sf):
    return _files(spark, sf)


@family.query(f"""
WITH t AS (SELECT f.*, CASE WHEN kind = 'json' THEN 0 ELSE floor(f.points * 100 / s.points + 0.5) END::INT AS share, row_number() OVER (PARTITION BY f.project ORDER BY f.points DESC, file) AS place FROM {_FILESC} f JOIN {_SCORE} s ON f.project = s.project WHERE f.points > 0)
SELECT project, file, kind, points, place, least(100, greatest(3, share)) AS bar FROM t WHERE place <= 5""")
def top_files(spark, sf):
    return S.top_files(_files(spark, sf)).select("project", "file", "kind", "points", "place", "bar")


@family.query(f"""
WITH x AS (SELECT *, CASE WHEN file LIKE '%\\_x.%' ESCAPE '\\' THEN regexp_extract(file, 'nation\\d+') ELSE regexp_extract(file, 'nation\\d+') END AS w FROM {X}), p AS (SELECT *, regexp_extract(file, 'nation\\d+') AS w FROM {P}),
b AS (SELECT x.project, x.file AS excel, arg_min(p.file, p.file_ord) AS pdf FROM x JOIN p ON x.project = p.project AND x.w = p.w AND p.w <> '' GROUP BY ALL),
o AS (SELECT x.project, pdf AS file, sum(business_rules) AS b, sum(conditional_rules) AS c, sum(catalogs + catalog_refs) AS k, count(*) AS n FROM x JOIN b ON x.project = b.project AND x.file = b.excel GROUP BY ALL),
s AS (SELECT project, sum(business_rules) AS b, sum(conditional_rules) AS c, sum(catalogs + catalog_refs) AS k, count(*) AS n FROM x WHERE (project, file) NOT IN (SELECT (project, excel) FROM b) GROUP BY ALL),
a AS (SELECT project, sum(field_count) AS n FROM p GROUP BY 1),
r AS (SELECT p.project, p.file, field_count AS fields, pages, repeater_groups, floor(coalesce(o.b, 0) + coalesce(s.b, 0) * (field_count / a.n) + 0.5)::BIGINT AS business_rules, floor(coalesce(o.c, 0) + coalesce(s.c, 0) * (field_count / a.n) + 0.5)::BIGINT AS conditional_rules,
  floor(coalesce(o.k, 0) + coalesce(s.k, 0) * (field_count / a.n) + 0.5)::BIGINT AS catalogs, coalesce(o.n, 0) + coalesce(s.n, 0) AS sources FROM p JOIN a USING (project) LEFT JOIN o ON p.project = o.project AND p.file = o.file LEFT JOIN s ON s.project = p.project),
q AS (SELECT *, floor((fields + pages * 2 + repeater_groups * 10 + business_rules * 2.5::DOUBLE + conditional_rules * 6 + catalogs * 5) * 10 + 0.5) / 10 AS points FROM r)
SELECT project, file, fields, pages, business_rules, conditional_rules, catalogs, sources, points, CASE WHEN points <= 900 THEN 'baja' WHEN points <= 1800 THEN 'media' ELSE 'alta' END AS level, CASE WHEN points <= 900 THEN 1 WHEN points <= 1800 THEN 2 ELSE 3 END AS weeks FROM q""")
def delivery_documents(spark, sf):
    return S.documents(spark_table(spark, sf, PDFS), spark_table(spark, sf, EXCELS))


