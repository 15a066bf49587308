"""Adapters: the given tables seen as corpus tables.

Each adapter is plain SQL that means the same in Spark and in DuckDB, so the operator
under test reads the same rows on both sides. All of them are projections of whole
tables (plus ``GROUP BY`` where the source key repeats).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from formspark.session import cut_lineage


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """An adapter's rows as a table of their own, as the corpus tables would be: operators that
    read a table several times then do not run the adapter several times."""
    return cut_lineage(df)


# ``@each(low, high) t(c)``: a row for each whole number from low to high, beside every row so far
_EACH = re.compile(r"@each\(((?:[^()]|\([^()]*\))*)\)\s+(\w+)\((\w+)\)")


def spark_table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run an adapter on Spark; ``@part`` etc. name the given tables."""
    sql = _EACH.sub(r"LATERAL explode(sequence(\1)) AS \2(\3)", sql)
    names = set(re.findall(r"@(\w+)", sql))
    text = re.sub(r"@(\w+)", r"{\1}", sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(text, **{n: read(spark, sf_dir, n) for n in names})


def duck(sql: str) -> str:
    """The same adapter as a DuckDB subquery."""
    return "(" + re.sub(r"@(\w+)", r"\1", _EACH.sub(r"generate_series(\1) \2(\3)", sql)) + ")"


# Field matrix: one row per part. Form = brand; the texts are derived from the columns.
MATRIX = """
SELECT p_brand AS form_id, p_partkey AS ord, p_name, p_size,
  CASE p_type WHEN 'STANDARD' THEN 'Texto' WHEN 'ECONOMY' THEN 'Numérico' WHEN 'PROMO' THEN 'Radio/Combo'
    WHEN 'LARGE' THEN 'Fecha' WHEN 'MEDIUM' THEN 'CheckBox' ELSE 'Alfanumérico' END AS data_type,
  CASE p_size % 10
    WHEN 0 THEN concat(p_size, ' caracteres, ', p_name)
    WHEN 1 THEN 'Formato dd/mm/aaaa'
    WHEN 2 THEN 'Sólo números'
    WHEN 3 THEN concat('Máximo: ', p_size, ' alfanuméricos')
    WHEN 4 THEN concat('Si se selecciona ', split_part(p_name, ' ', 1), ' se debe habilitar el campo ', split_part(p_name, ' ', 2), ' ', p_size)
    WHEN 5 THEN concat('Si el campo ', p_name, ' es ', p_size)
    WHEN 6 THEN concat('Depende de ', p_name)
    WHEN 7 THEN concat('Numérico y ', p_size, ' dígitos, hasta ', p_size + 1)
    WHEN 8 THEN concat('Correo electrónico; formato dd-mm-yyyy')
    ELSE '' END AS rule,
  CASE p_partkey % 7 WHEN 0 THEN 'Si' WHEN 1 THEN 'NO' WHEN 2 THEN ' sí ' WHEN 3 THEN 'TRUE' WHEN 4 THEN 'x'
    WHEN 5 THEN 'Obligatorio' ELSE '' END AS required,
  CASE p_partkey % 6 WHEN 0 THEN 'Disabled' WHEN 1 THEN 'Disabled, no visible' WHEN 2 THEN 'No aplica'
    WHEN 3 THEN 'Editable' WHEN 4 THEN 'Solo lectura' ELSE 'Dato Prellenado' END AS visualization,
  CASE p_partkey % 5 WHEN 0 THEN 'TODOS' WHEN 1 THEN 'Vida Colectiva; Vida Universal' WHEN 2 THEN 'Protección Crediticia'
    WHEN 3 THEN '' ELSE 'vida_universal, proteccion_crediticia' END AS product_scope,
  concat('datosFormulario.personas', CASE WHEN p_partkey % 3 = 0 THEN '[0]' WHEN p_partkey % 3 = 1 THEN '' ELSE '[]' END,
    '.', lower(p_type), upper(substring(p_name, 1, 1)), substring(replace(p_name, ' ', 'De'), 2)) AS json_name,
  concat(replace(p_name, ' ', '_'), CASE WHEN p_partkey % 4 = 0 THEN concat('_', p_size) WHEN p_partkey % 4 = 1 THEN concat('Row', p_size)
    WHEN p_partkey % 4 = 2 THEN concat('[', p_size, ']') ELSE '_Row_2_3' END) AS pdf_field_name
FROM @part
"""


# Text lines: every line of every document.
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        "SELECT doc_id, source, lang, pos + 1 AS line_no, line FROM "
        "(SELECT doc_id, source, lang, posexplode(split(text, '\n')) AS (pos, line) FROM {documents})",
        documents=read(spark, sf_dir, "documents"))


LINES = """(SELECT doc_id, source, lang, unnest(generate_series(1, len(string_split(text, chr(10)))))::INT AS line_no,
  unnest(string_split(text, chr(10))) AS line FROM documents)"""


# JSON documents: one nested payload per order, of three shapes. Family = order priority.
PAYLOADS = """
SELECT o_orderkey AS doc_id, o_orderpriority AS family, o_orderstatus AS status, concat(
  '{"order":{"id":', o_orderkey, ',"customer":{"id":', o_custkey, ',"tags":["', lower(o_orderstatus), '","', o_custkey % 7, '"]}',
  CASE WHEN o_orderstatus = 'F' THEN concat(',"total":', o_custkey % 100, ',"dates":[{"kind":"made","day":"', o_custkey % 28, '"},{"kind":"paid"}]')
       WHEN o_orderstatus = 'O' THEN concat(',"total":{"amount":', o_custkey % 50, '},"billing":{"dates":[{"kind":"due","day":"1"}]}')
       ELSE ',"dates":[],"note":null' END,
  '},"meta":{"priority":"', o_orderpriority, '","k', o_custkey % 5, '":[[', o_custkey % 3, ',2],[]]}}') AS body
FROM @orders
"""

# Form fields: one per order. Form = customer; ids and paths repeat inside a form.
FORM_FIELDS = """
SELECT concat('F', o_custkey) AS form_id, o_orderkey AS ord, k5 AS field_order, CAST(substring(o_orderpriority, 1, 1) AS INT) AS section_ord,
  concat('s', substring(o_orderpriority, 1, 1)) AS section_id,
  CASE substring(o_orderpriority, 1, 1) WHEN '3' THEN 'Declaraciones' WHEN '5' THEN NULL ELSE o_orderpriority END AS section_title,
  CASE WHEN k11 = 10 AND k5 = 0 THEN 'field_' ELSE concat(CASE WHEN k11 = 10 THEN 'f_' ELSE 'field_' END, base) END AS id,
  CASE k5 WHEN 0 THEN 'Informacion de la poliza' WHEN 1 THEN 'Género' WHEN 2 THEN 'Numeros' WHEN 3 THEN NULL ELSE o_orderpriority END AS label,
  CASE k7 WHEN 0 THEN 'date' WHEN 1 THEN 'select' WHEN 4 THEN 'radio' WHEN 5 THEN 'checkbox' WHEN 6 THEN CASE WHEN k11 = 0 THEN 'signature' WHEN k11 < 4 THEN 'repeater' ELSE 'header' END ELSE 'text' END AS type,
  CASE k3 WHEN 0 THEN base WHEN 1 THEN concat(upper(substring(base, 1, 1)), substring(base, 2), '.') ELSE CASE WHEN k5 = 0 THEN concat('otro', k11) WHEN k5 = 1 THEN NULL ELSE replace(base, '_', ' ') END END AS source_name,
  CASE k5 WHEN 0 THEN 'Checkbox' WHEN 1 THEN 'RadioGroup' ELSE 'Tx' END AS native_type,
  k3 = 0 AS hidden, k3 = 0 OR k5 = 4 AS hidden_effective, CASE WHEN k11 = 7 THEN 'field_rep' END AS in_repeater,
  CASE WHEN k5 = 2 THEN NULL ELSE concat('personas[', k5 % 3, '].', leaf) END AS salida_json,
  CASE WHEN k5 = 3 THEN NULL WHEN k5 = 4 THEN concat('personas[', k5 % 3, '].x.', leaf) WHEN k11 = 9 THEN '' ELSE concat('personas[', k5 % 3, '].', leaf) END AS json_output_path,
  CASE WHEN k11 = 5 THEN concat('copia.', leaf) ELSE '' END AS secondary_path,
  k11 = 3 AS exclude, CASE WHEN k5 = 1 THEN concat('cliente.', leaf, '==', k3) WHEN k11 = 6 THEN concat('cliente.', leaf) END AS prefill_key,
  CASE WHEN k11 = 4 THEN 'api' ELSE 'optional' END AS prefill_mode, CASE k7 WHEN 5 THEN 'v' WHEN 4 THEN '' END AS default_value,
  CASE WHEN k11 % 4 = 0 THEN 'A' WHEN k11 % 4 = 1 THEN concat('B', k5) END AS json_value, CASE k3 WHEN 0 THEN 'X' WHEN 1 THEN 'SI' END AS checked_pdf_value,
  CASE WHEN k11 = 1 THEN concat('{"logic":"and","conditions":[{"fieldId":"field_x_', k5, '","operator":"equals","value":"', CASE WHEN k3 = 0 THEN 'Si' ELSE 'No' END, '"}]}')
    WHEN k11 = 2 THEN concat('{"logic":"or","conditions":[{"fieldId":"field_NEVER_EXISTS","operator":"equals","value":"ASG"},{"fieldId":"benef_nombre","operator":"is","value":"', CASE k3 WHEN 0 THEN 'DME' WHEN 1 THEN 'JRD' ELSE 'zz' END, '"}]}')
    WHEN k11 = 5 THEN 'oops' END AS condition_visibility,
  CASE WHEN k11 = 8 THEN '{"logic":"and","conditions":[{"fieldId":"field_benef_nombre","operator":"equals","value":"Si"}]}' END AS condition_required,
  CASE WHEN k11 = 9 THEN concat('field_benef_', k5) WHEN k11 = 0 THEN 'field_titular_x' END AS parent_id, CASE WHEN k11 = 9 AND k3 = 0 THEN 'field_titular_y' END AS grandparent_id,
  k3 = 1 AS read_only,
  CASE WHEN k7 IN (2, 3) AND k3 < 2 THEN concat('{"sourceFieldIds":["field_titular_fecha"],"parts":[{"kind":"field","fieldId":"field_titular_fecha","condition":{"fieldId":"field_',
    CASE WHEN k5 = 0 THEN 'titular_fecha' ELSE concat('x_', k5) END, '","op":"equals","values":"Si"},"transforms":[{"kind":"substring","start":', k3 * 3, ',"end":', k3 * 3 + 2, '}]}]}') END AS concat,
  CASE WHEN k7 = 4 THEN '["field_x_1","field_benef_nombre"]' END AS radio_fields, CASE WHEN k7 = 4 THEN 'genero y Genero' END AS radio_label,
  CASE WHEN k7 = 6 AND k11 IN (1, 2) THEN concat('p[{i', k11 - 1, '}].{sub}') END AS slot_pattern, k7 = 6 AND k11 IN (1, 2, 3) AS has_repeater,
  CASE WHEN k5 = 0 THEN 'YYYY-MM-DD' END AS pdf_date_format, CASE WHEN k5 = 1 THEN 'MM/DD/AAAA' END AS date_format,
  CASE WHEN k7 = 1 THEN '[{"label":"Si","jsonValue":"1"},{"label":"No","jsonValue":"No"},{"label":"","jsonValue":"2"}]' END AS options
FROM (SELECT *, CASE k7 WHEN 0 THEN 'titular_fecha' WHEN 1 THEN 'benef_nombre' WHEN 2 THEN 'titular_fecha_dia' WHEN 3 THEN 'benef_fecha_ano' WHEN 4 THEN 'género_1' ELSE concat('x_', k11) END AS base,
    CASE k11 WHEN 0 THEN 'descripcionX' WHEN 1 THEN 'edad' WHEN 2 THEN 'nombreCompleto' WHEN 3 THEN 'codigo' ELSE concat('dato', k7) END AS leaf
  FROM (SELECT *, o_orderkey % 3 AS k3, o_orderkey % 5 AS k5, o_orderkey % 7 AS k7, o_orderkey % 11 AS k11 FROM @orders) o1) o2
"""

# Widgets of the same forms: names, geometry and labels.
FORM_WIDGETS = """
SELECT concat('F', o_custkey) AS form_id, o_orderkey AS ord, CASE o_orderkey % 4 WHEN 0 THEN 'titular_fecha' WHEN 1 THEN concat('otro', o_orderkey % 11) WHEN 2 THEN concat('x ', o_orderkey % 9) ELSE concat('w', o_orderkey % 6) END AS name,
  CASE WHEN o_custkey % 3 = 0 OR o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS label FROM @orders
"""

# Matrix rows and form fields of the same forms (form = brand), with names that differ.
ROWS = """
SELECT p_brand AS form_id, p_partkey AS ord, CASE WHEN p_size % 10 = 0 THEN 'No aplica' WHEN p_size % 10 = 1 THEN '' ELSE concat(replace(p_name, ' ', '_'), '_', p_size % 4) END AS pdf_field_name,
  concat(upper(substring(p_name, 1, 1)), substring(p_name, 2), CASE p_size % 3 WHEN 0 THEN ':' WHEN 1 THEN ' (ó)' ELSE '' END) AS pdf_label,
  concat(split_part(p_name, ' ', 2), ' de ', split_part(p_name, ' ', 1), CASE WHEN p_size % 2 = 0 THEN concat(' ', p_size) ELSE '' END) AS field_label,
  concat('datos.', split_part(p_name, ' ', 2), '.', split_part(p_name, ' ', 1), 'Del', p_size % 5) AS json_name,
  CASE WHEN p_size % 7 = 0 THEN concat('Lista: ', lower(p_type), ' ', p_size % 5, '|', p_name, '|x') ELSE '' END AS catalog_direct,
  concat('W', p_partkey % 50) AS acro_actual, concat('P', p_partkey % 40) AS acro_proposed, CASE WHEN p_size % 5 = 0 THEN '' ELSE concat('S', p_partkey % 45) END AS source_name
FROM @part
"""
FIELDS = """
SELECT p_brand AS form_id, p_partkey AS ord, concat('field_', p_partkey % 60) AS id,
  CASE p_partkey % 6 WHEN 0 THEN concat(replace(p_name, ' ', '_'), '_', p_size % 4) WHEN 1 THEN concat(replace(p_name, ' ', '_'), '_9_', p_size)
    WHEN 2 THEN concat(split_part(p_name, ' ', 2), '_de_', split_part(p_name, ' ', 1), '_', p_size) WHEN 3 THEN concat(lower(p_type), '_', p_size % 5)
    WHEN 4 THEN concat(split_part(p_name, ' ', 1), 'x_', split_part(p_name, ' ', 2), 'y') ELSE '' END AS source_name,
  CASE p_size % 4 WHEN 0 THEN concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1), '_Row_2') WHEN 1 THEN concat('zz ', p_type, ' ', p_size)
    WHEN 2 THEN concat(replace(split_part(p_name, ' ', 2), 'e', 'o'), ' de ', split_part(p_name, ' ', 1)) ELSE p_name END AS label,
  concat('S', p_partkey % 55) AS key_name
FROM @part
"""
# Widgets on a page grid, and known positions next to some of them. Form = customer segment of the order.
WIDGETS = """
SELECT concat('F', l_suppkey) AS form_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag) AS INT) AS ord,
  concat('w', l_partkey) AS name, l_linenumber AS page, l_quantity * 12 + l_discount * 100 AS x, l_extendedprice / 100 + l_tax * 10 AS y, 20 + l_linenumber AS width, 8.0 + l_tax * 100 AS height,
  l_returnflag AS flag FROM @lineitem
"""

# Sheet cells: the parts as rows of spreadsheets. Form = brand, file = type, four sheets each.
_CELL_COLUMNS = [
    ("Nombre del campo en formulario", "p_name"),
    ("Tipo de dato", "CASE WHEN p_size % 2 = 0 THEN 'Texto' ELSE ' Combo ' END"),
    ("Regla de negocio", "CASE p_size % 5 WHEN 0 THEN 'Si aplica' WHEN 1 THEN 'No aplica' WHEN 2 THEN concat('Máximo ', p_size) WHEN 3 THEN 'según caso' ELSE '' END"),
    ("Obligatorio", "CASE p_partkey % 4 WHEN 0 THEN 'Sí' WHEN 1 THEN 'no' WHEN 2 THEN 'X' ELSE 'quizás' END"),
    ("Valor", "CASE p_partkey % 5 WHEN 0 THEN 'Ver catálogo' WHEN 1 THEN '-' ELSE p_brand END"),
    ("Visualización en formularios", "CASE p_size % 7 WHEN 0 THEN 'Visible si edad >= 18' WHEN 1 THEN '' ELSE 'Disabled' END"),
    ("Observaciones", "CASE p_partkey % 6 WHEN 0 THEN 'Cuando sea menor' WHEN 1 THEN ' ' ELSE '' END"),
    ("Formulario a visualizar", "p_type"),
    ("Nombre del campo en Json", "concat('a.', p_name)"),
    ("Nombre del campo en PDF", "CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('w', p_partkey) END"),
]
_SHEET = """CASE p_size % 4 WHEN 0 THEN 'Campos' WHEN 1 THEN 'Catálogo X' WHEN 2 THEN 'Portada' ELSE 'Formulario Digital Vida' END"""
_ROWS = f"""SELECT p.*, concat('matriz_', lower(p_type), '.xlsx') AS file, {_SHEET} AS sheet, p_size % 4 AS sheet_ord,
  CAST(p_partkey + 2 AS INT) AS row_idx FROM @part p"""
_SHEETS = f"(SELECT DISTINCT p_brand, file, sheet, sheet_ord FROM ({_ROWS}) s0)"
_COLUMN = "@each(0, 9) k(c)"
CELLS = (
    f"SELECT p_brand AS form_id, file, sheet, sheet_ord, 0 AS row_idx, 0 AS col_idx, concat('Matriz ', p_brand) AS value FROM {_SHEETS} t0"
    + f" UNION ALL SELECT p_brand, file, sheet, sheet_ord, 1, CAST(c AS INT), CASE c " + " ".join(f"WHEN {i} THEN '{head}'" for i, (head, _) in enumerate(_CELL_COLUMNS))
    + f" END FROM {_SHEETS} t1, {_COLUMN}"
    + f" UNION ALL SELECT p_brand, file, sheet, sheet_ord, row_idx, CAST(c AS INT), CASE c " + " ".join(f"WHEN {i} THEN {expr}" for i, (_, expr) in enumerate(_CELL_COLUMNS))
    + f" END FROM ({_ROWS}) t2, {_COLUMN}"
)
