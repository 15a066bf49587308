"""Grouping and statistics over rows made of parts, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from formspark.operators import groups as G
from formspark.operators import single_view as SV
from formspark.plans.join_queries import nw, slug
from formspark.plans.registry import Family
from formspark.plans.tables import FORM_FIELDS, MATRIX, duck, read, spark_table

family = Family()

_CODED = "SELECT p_type AS file, p_partkey AS ord, CASE WHEN p_type = 'SMALL' OR p_size % 5 = 0 THEN '' WHEN p_size % 5 = 1 THEN 'Todos' ELSE p_brand END AS form_code FROM @part"


@family.query(f"""
WITH f AS (SELECT *, lower(form_code) IN ('', 'todos', 'all') AS is_shared FROM {duck(_CODED)}), c AS (SELECT DISTINCT file, form_code AS form_id FROM f WHERE NOT is_shared)
SELECT file, ord, form_code AS form_id, is_shared FROM f WHERE NOT is_shared UNION ALL SELECT f.file, ord, coalesce(form_id, '_all'), true FROM f LEFT JOIN c USING (file) WHERE is_shared""")
def group_by_form(spark, sf):
    return G.group_by_form(spark_table(spark, sf, _CODED), ["file"]).select("file", "ord", "form_id", "is_shared")


@family.query(f"""SELECT *, row_number() OVER (PARTITION BY file ORDER BY first_ord) AS pos FROM (SELECT file, form_code, min(ord) AS first_ord FROM {duck(_CODED)} WHERE form_code <> '' GROUP BY file, form_code)""")
def unique_codes(spark, sf):
    return G.unique_codes(spark_table(spark, sf, _CODED), ["file"], "form_code")


_CHOICE = """SELECT p_brand AS form_id, p_partkey AS ord, CASE WHEN p_size % 5 = 0 THEN '' ELSE concat('L', CAST(floor(p_partkey / 150) AS BIGINT)) END AS field_label,
  CASE p_type WHEN 'STANDARD' THEN 'Radio/Combo' WHEN 'ECONOMY' THEN 'Combo' WHEN 'PROMO' THEN 'Lista' WHEN 'LARGE' THEN '' WHEN 'MEDIUM' THEN 'Texto' ELSE 'Select' END AS data_type,
  CASE WHEN p_size % 7 = 0 THEN '' WHEN p_size % 2 = 0 THEN concat('A', p_size, ' - ', p_name) ELSE p_name END AS value,
  CASE WHEN p_size % 3 = 0 THEN concat('j', p_partkey) ELSE '' END AS json_name, CASE WHEN p_size % 4 = 0 THEN concat('r', p_partkey) ELSE '' END AS rule, '' AS obs, CASE WHEN p_size % 6 = 0 THEN 'Todos' ELSE '' END AS product_scope FROM @part"""

_RUNS = f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY form_id ORDER BY ord) AS i, regexp_matches(lower(data_type), 'combo|radio|select|lista') AS choice FROM {duck(_CHOICE)}),
w AS (SELECT form_id, i, CASE WHEN choice AND field_label <> '' THEN field_label END AS head, 1 AS run, true AS is_head FROM r WHERE i = 1
 UNION ALL SELECT form_id, i, CASE WHEN absorbed THEN head WHEN choice AND field_label <> '' THEN field_label END, run + CASE WHEN absorbed THEN 0 ELSE 1 END, NOT absorbed
 FROM (SELECT r.*, w.head, w.run, w.head IS NOT NULL AND r.value <> '' AND (r.choice OR r.data_type = '') AND (r.field_label = '' OR r.field_label = w.head) AS absorbed FROM w JOIN r ON r.form_id = w.form_id AND r.i = w.i + 1)),
x AS (SELECT r.*, w.run, w.is_head, w.head IS NOT NULL AND r.value <> '' AS has FROM r JOIN w USING (form_id, i))"""


@family.query(f"""{_RUNS} SELECT form_id, ord, run, is_head, CASE WHEN has THEN CASE WHEN regexp_matches(value, '^A\\d+ - ') THEN regexp_extract(value, '^(A\\d+)', 1) ELSE value END END AS option_code,
  CASE WHEN has THEN regexp_replace(value, '^A\\d+ - ', '') END AS option_label FROM x""")
def collapse_runs(spark, sf):
    return G.collapse_runs(spark_table(spark, sf, _CHOICE)).select("form_id", "ord", "run", "is_head", "option_code", "option_label")


@family.query(f"""{_RUNS} SELECT form_id, run, min(ord) AS ord, arg_min(field_label, ord) AS field_label, arg_min(data_type, ord) AS data_type, count(*) FILTER (has) AS n_options,
  coalesce(arg_min(json_name, ord) FILTER (json_name <> ''), '') AS json_name, coalesce(arg_min(rule, ord) FILTER (rule <> ''), '') AS rule, '' AS obs, coalesce(arg_min(product_scope, ord) FILTER (product_scope <> ''), '') AS product_scope FROM x GROUP BY form_id, run""")
def run_heads(spark, sf):
    return G.run_heads(G.collapse_runs(spark_table(spark, sf, _CHOICE)))


_LOGIC = "SELECT p_brand AS form_id, p_partkey AS ord, concat(CASE WHEN p_size % 2 = 0 THEN 'Á ' ELSE 'a  ' END, CAST(floor(p_partkey / 150) AS BIGINT)) AS label, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS value, CASE WHEN p_size % 5 = 0 THEN 'x.y' ELSE '' END AS path FROM @part"


@family.query(f"""
WITH l AS (SELECT *, {nw('label')} = lag({nw('label')}) OVER (PARTITION BY form_id ORDER BY ord) AND value <> '' AND path = '' AS same FROM {duck(_LOGIC)})
SELECT form_id, ord, sum(CASE WHEN coalesce(same, false) THEN 0 ELSE 1 END) OVER (PARTITION BY form_id ORDER BY ord)::BIGINT AS run, NOT coalesce(same, false) AS is_head FROM l""")
def collapse_logical(spark, sf):
    return G.collapse_logical(spark_table(spark, sf, _LOGIC)).select("form_id", "ord", "run", "is_head")


@family.query("""
WITH c AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations)
SELECT conv_id, turn, role, sum(s::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM c""")
def speaker_runs(spark, sf):
    c = read(spark, sf, "conversations")
    out = G.islands(c, ["conv_id"], [F.col("turn")], F.floor(F.col("turn") / G.SLICE), {"_prev": F.col("role")}, F.col("_prev") != F.col("role"), ["role"], name="run")
    return out.select("conv_id", "turn", "role", "run")


_ROUTES = "SELECT o_orderpriority AS form_id, o_orderstatus AS sheet, o_orderkey AS ord, CASE WHEN o_custkey % 9 = 0 THEN '' ELSE concat('p.r', o_custkey % 40) END AS route, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('v', o_custkey) END AS value, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('rule', o_custkey % 6) END AS rule, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('s', o_custkey % 8) END AS source_name, concat('L', o_orderkey) AS label, CASE WHEN o_orderkey % 2 = 0 THEN 'normal' ELSE 'oculto' END AS dest FROM @orders"


@family.query(f"""SELECT form_id, sheet, route, min(ord) AS ord, count(*) AS n_rows, count(*) FILTER (value <> '') AS n_options, arg_min(label, ord) AS label, arg_min(dest, ord) AS dest,
  count(DISTINCT nullif(source_name, '')) AS n_sources, count(DISTINCT nullif(rule, '')) AS n_rules FROM {duck(_ROUTES)} GROUP BY form_id, sheet, route, CASE WHEN route = '' THEN ord END""")
def collapse_by_route(spark, sf):
    return G.collapse_by_route(spark_table(spark, sf, _ROUTES))


# rows of a ficha with all of their texts
_FICHA = """SELECT o_orderpriority AS form_id, o_orderstatus AS sheet, o_orderkey AS ord, CASE WHEN o_orderkey % 31 = 0 THEN 'json' ELSE concat('Paso ', o_custkey % 4) END AS step, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE concat('S', o_custkey % 7) END AS section,
  concat('L', o_orderkey) AS label, concat('pdf', o_custkey) AS pdf_name, 'Combo' AS ficha_type, 'select' AS type, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('v', o_custkey) END AS value,
  CASE WHEN o_orderkey % 17 = 0 THEN 'No aplica  formulario' WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('rule', o_custkey % 6) END AS rule, CASE WHEN o_orderkey % 13 = 0 THEN 'Web' ELSE 'Si' END AS required,
  CASE o_orderkey % 5 WHEN 0 THEN 'Disabled' WHEN 1 THEN 'No aplica' WHEN 2 THEN 'Dato Prellenado' ELSE NULL END AS visualization, '' AS notes, 'D1' AS forms,
  CASE WHEN o_custkey % 9 = 0 THEN '' ELSE concat('p.r', o_custkey % 400) END AS route, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE concat('p.r', o_custkey % 400, ', q') END AS routes, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE concat('s', o_custkey % 8) END AS source_name FROM @orders"""
_FICHA_FIELDS = f"""(WITH f AS (SELECT form_id, sheet, route, min(ord) AS ord, count(*) AS n_rows, coalesce(string_agg(nullif(value, ''), ' | ' ORDER BY ord), '') AS options, list(rule ORDER BY ord) FILTER (rule <> '') AS rl, list(source_name ORDER BY ord) FILTER (source_name <> '') AS sl
  FROM {duck(_FICHA)} GROUP BY form_id, sheet, route, CASE WHEN route = '' THEN ord END)
SELECT f.*, coalesce(list_aggregate(list_transform(list_filter(rl, lambda x, i: list_position(rl, x) = i), lambda x: x), 'string_agg', ' | '), '') AS rules, coalesce(list_aggregate(list_filter(sl, lambda x, i: list_position(sl, x) = i), 'string_agg', ' | '), '') AS source_names,
  r.step, r.section, r.label, r.pdf_name, r.required, r.visualization, r.routes, r.step = 'json' AS j, r.required = 'Web' AS w, coalesce(r.visualization = 'No aplica', false) AS h, coalesce(r.visualization = 'Disabled', false) AS ro, coalesce(r.visualization = 'Dato Prellenado', false) AS pf, r.rule LIKE 'No aplica%' AS e, f.route = '' AS lb
  FROM f JOIN {duck(_FICHA)} r USING (form_id, ord))"""


def _ficha_fields(spark, sf):
    return SV.ficha_fields(spark_table(spark, sf, _FICHA))


@family.query(f"""SELECT form_id, row_number() OVER (PARTITION BY form_id ORDER BY ord) AS "#", sheet AS "Hoja", step AS "Paso", coalesce(section, '') AS "Sección", label AS "Label (ficha)", pdf_name AS "Nombre en PDF", 'Combo' AS "Tipo (ficha)", 'select' AS "Tipo (form-def)",
  options AS "Opciones", rules AS "Regla", required AS "Obligatorio", coalesce(visualization, '') AS "Visualización", '' AS "Observaciones", 'D1' AS "Formulario", coalesce(routes, '') AS "Ruta JSON", source_names AS "sourceName",
  CASE WHEN e THEN 'excluido' WHEN lb THEN 'label' WHEN j THEN 'soloJSON' WHEN w THEN 'soloWeb' WHEN h THEN 'oculto' WHEN ro THEN 'readOnly' ELSE 'normal' END AS "Destino", 'sin-cruzar' AS "Estado", '' AS "Motivo" FROM {_FICHA_FIELDS}""")
def single_view(spark, sf):
    """all 19 columns of a ficha's view"""
    return SV.single_view(_ficha_fields(spark, sf))


@family.query(f"""WITH s AS (SELECT DISTINCT o_orderpriority AS form_id, o_orderstatus AS sheet FROM orders UNION ALL SELECT DISTINCT o_orderpriority, 'vacía' FROM orders),
c AS (SELECT form_id, count(DISTINCT sheet) AS k, coalesce(sum(n_rows) FILTER (route <> ''), 0) AS fr, count(*) AS n, count(*) FILTER (j) AS j, count(*) FILTER (h) AS h, count(*) FILTER (ro) AS ro, count(*) FILTER (pf) AS pf, count(*) FILTER (e) AS e, count(*) FILTER (lb) AS lb, count(*) FILTER (source_names <> '') AS sn FROM {_FICHA_FIELDS} GROUP BY 1)
SELECT form_id, unnest(range(0, 11))::INTEGER AS line, unnest(['hojas', 'hojasConCampos', 'filasConRuta', 'campos', 'soloJSON', 'ocultos', 'readOnly', 'prefill', 'excluidos', 'labels', 'conSourceName']) AS metric,
  unnest(list_transform([sh::BIGINT, k, fr::BIGINT, n, j, h, ro, pf, e, lb, sn], lambda x: CAST(x AS VARCHAR))) AS value FROM c JOIN (SELECT form_id, count(*) AS sh FROM s GROUP BY 1) USING (form_id)
UNION ALL SELECT DISTINCT o_orderpriority, 11, concat('typo', o_custkey % 5), concat('ejemplo: tipo', o_custkey % 5) FROM orders""")
def single_view_summary(spark, sf):
    """counts of a ficha and its typos, as lines"""
    o = read(spark, sf, "orders").withColumnsRenamed({"o_orderpriority": "form_id", "o_orderstatus": "sheet"})
    sheets = o.select("form_id", "sheet").unionByName(o.select("form_id", F.lit("vacía").alias("sheet")))
    k = F.col("o_custkey") % 5
    return SV.view_summary(_ficha_fields(spark, sf), sheets, o.select("form_id", F.concat(F.lit("typo"), k).alias("name"), F.concat(F.lit("tipo"), k).alias("suggestion")))


@family.query(f"""
WITH o AS (SELECT form_id, ord, field_label, CASE WHEN regexp_matches(value, '^A\\d+ - ') THEN regexp_extract(value, '^(A\\d+)', 1) ELSE value END AS code, regexp_replace(value, '^A\\d+ - ', '') AS label FROM {duck(_CHOICE)} WHERE value <> '' AND field_label <> '')
SELECT form_id, field_label, min(ord) AS ord, arg_min(code, ord) AS code, arg_min(label, ord) AS label FROM o GROUP BY form_id, field_label, lower(code || '|' || label)""")
def combo_options(spark, sf):
    return G.combo_options(spark_table(spark, sf, _CHOICE))


# Widget names with prefixes, option marks and indexes.
NAMES = """SELECT o_orderpriority AS form_id, o_orderkey AS ord, o_custkey % 9 AS page, concat(CASE o_custkey % 5 WHEN 0 THEN 'enfCancer' WHEN 1 THEN 'depNombre' WHEN 2 THEN 'titularDato' WHEN 3 THEN 'benefDep' ELSE 'otro' END, o_custkey % 70,
  CASE o_orderkey % 6 WHEN 0 THEN '_Si' WHEN 1 THEN 'No' WHEN 2 THEN concat('[', o_orderkey % 4, ']') WHEN 3 THEN '_NoAplica' WHEN 4 THEN concat('[', o_orderkey % 3, ']') ELSE '' END) AS source_name FROM @orders"""
_N = f"""(WITH n AS (SELECT *, starts_with(source_name, 'enf') AS lk, regexp_matches(source_name, '\\[\\d+\\]$') AS ix, regexp_replace(source_name, '_?(NoAplica|Si|No)$', '') AS base FROM {duck(NAMES)}),
b AS (SELECT form_id, base, count(*) AS c FROM n WHERE NOT lk AND NOT ix AND base <> source_name GROUP BY ALL)
SELECT n.form_id, n.ord, n.page, source_name, CASE WHEN lk THEN 'lookup' WHEN ix THEN 'repeater' WHEN n.base <> source_name AND c >= 2 THEN 'radio' ELSE 'simple' END AS kind,
  CASE WHEN lk THEN 'enfermedades' WHEN ix THEN regexp_replace(source_name, '\\[\\d+\\]$', '') WHEN n.base <> source_name AND c >= 2 THEN n.base ELSE source_name END AS group_name FROM n LEFT JOIN b ON n.form_id = b.form_id AND n.base = b.base)"""


@family.query(f"SELECT form_id, ord, kind, group_name, kind || ':' || CASE kind WHEN 'lookup' THEN 'enf' ELSE group_name END AS group_key FROM {_N}")
def name_groups(spark, sf):
    return G.name_groups(spark_table(spark, sf, NAMES)).select("form_id", "ord", "kind", "group_name", "group_key")


@family.query(f"""
WITH n AS (SELECT *, regexp_matches(source_name, '\\[\\d+\\]$') AS ix, regexp_replace(source_name, '(NoAplica|Si|No)$', '') AS base FROM {duck(NAMES)}), b AS (SELECT form_id, base, count(*) AS c FROM n WHERE NOT ix AND base <> source_name GROUP BY ALL)
SELECT n.form_id, n.ord, CASE WHEN ix THEN 'repeater' WHEN n.base <> source_name AND c >= 2 THEN 'radio' ELSE 'simple' END AS kind FROM n LEFT JOIN b ON n.form_id = b.form_id AND n.base = b.base""")
def name_groups_plain(spark, sf):
    return G.name_groups(spark_table(spark, sf, NAMES), lookups=False).select("form_id", "ord", "kind")


@family.query(f"""SELECT form_id, kind || ':' || CASE kind WHEN 'lookup' THEN 'enf' ELSE group_name END AS group_key, kind, group_name, count(*) AS members, min(ord) AS ord, arg_min(page, ord) AS page,
  CASE WHEN kind = 'lookup' THEN 'Cuestionario de Salud' WHEN group_name LIKE 'dep%' THEN 'Dependientes' WHEN group_name LIKE 'titular%' THEN 'Datos del Titular' WHEN group_name LIKE 'benef%' THEN 'Beneficiarios' ELSE 'General' END AS section,
  CASE WHEN group_name LIKE 'benefDep%' THEN 'benefDep' WHEN group_name LIKE 'dep%' THEN 'dep' ELSE '' END AS entity FROM {_N} GROUP BY ALL""")
def canonical_groups(spark, sf):
    return G.canonical_groups(spark_table(spark, sf, NAMES))


@family.query(f"""SELECT form_id, ord, group_name, kind, source_name, CASE WHEN kind IN ('radio', 'lookup') THEN regexp_extract(source_name, '(NoAplica|Si|No)$', 1) ELSE '' END AS option,
  CASE WHEN kind = 'repeater' THEN regexp_extract(source_name, '\\[(\\d+)\\]$', 1)::INT END AS item,
  CASE WHEN kind = 'lookup' THEN replace(regexp_replace(source_name, '_?(NoAplica|Si|No)$', ''), 'enf', '') ELSE '' END AS needle,
  CASE WHEN kind = 'radio' THEN regexp_extract(source_name, '(NoAplica|Si|No)$', 1) WHEN kind = 'lookup' AND regexp_matches(source_name, '(NoAplica|Si|No)$') THEN 'X' ELSE '' END AS pdf_value FROM {_N} WHERE kind <> 'simple'""")
def option_details(spark, sf):
    return G.option_details(G.name_groups(spark_table(spark, sf, NAMES)))


@family.query(f"""
WITH m AS (SELECT *, CASE WHEN group_name LIKE 'benefDep%' THEN 'benefDep' WHEN group_name LIKE 'dep%' THEN 'dep' END AS entity, regexp_extract(source_name, '\\[(\\d+)\\]$', 1)::INT AS i FROM {_N} WHERE kind = 'repeater')
SELECT form_id, entity, count(DISTINCT group_name) AS subfields, max(i) AS max_index, 0 AS extra, true AS ok, entity || '{{sub}}[{{i0}}]' AS pattern FROM m WHERE entity IS NOT NULL GROUP BY ALL""")
def entity_repeaters(spark, sf):
    g = G.name_groups(spark_table(spark, sf, NAMES)).where("kind = 'repeater'")
    return G.entity_repeaters(g.withColumn("entity", G.C.entity_of(F.col("group_name"))))


# Members whose names do not follow the slots of their entity, and items that are missing.
_SLOTS = """SELECT p_brand AS form_id, CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'benefDep' ELSE 'dep' END AS entity, concat(CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'benefDep' ELSE 'dep' END, 'Campo', p_partkey % 4) AS group_name,
  concat(CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'benefDep' ELSE 'dep' END, 'Campo', CASE WHEN p_size % 11 = 0 THEN 9 ELSE p_partkey % 4 END, CASE WHEN p_size % 7 = 0 THEN '' ELSE concat('[', p_size % 6 * 2, ']') END) AS source_name FROM @part WHERE p_size % 3 > 0 OR p_partkey % 2 = 0"""


@family.query(f"""
WITH m AS (SELECT *, nullif(regexp_extract(source_name, '\\[(\\d+)\\]$', 1), '')::INT AS i FROM {duck(_SLOTS)} WHERE entity <> ''), b AS (SELECT *, coalesce(group_name || '[' || i || ']' = source_name, false) AS good FROM m)
SELECT form_id, entity, count(DISTINCT group_name) AS subfields, coalesce(max(i), -1) AS max_index, count(*) FILTER (NOT good) AS extra, bool_and(good) AS ok, entity || '{{sub}}[{{i0}}]' AS pattern FROM b GROUP BY form_id, entity""")
def entity_slots(spark, sf):
    return G.entity_repeaters(spark_table(spark, sf, _SLOTS))


_RADIO = "SELECT o_orderpriority AS form_id, o_orderkey AS ord, concat('f', o_orderkey) AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'text' ELSE 'radio' END AS type, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('a', o_custkey % 500, '/b/', o_orderkey) WHEN 2 THEN concat('/x', o_custkey) ELSE concat('y', o_orderkey) END AS source_name, concat(' Label ', o_custkey % 800) AS label FROM @orders"


@family.query(f"""
WITH r AS (SELECT *, CASE WHEN source_name = '' THEN '' WHEN instr(source_name, '/') > 1 THEN regexp_replace(source_name, '/[^/]*$', '') ELSE lower(trim(label)) END AS radio_group FROM {duck(_RADIO)} WHERE type = 'radio'),
g AS (SELECT *, count(*) OVER (PARTITION BY form_id, radio_group) AS members, row_number() OVER (PARTITION BY form_id, radio_group ORDER BY ord) AS member_no FROM r WHERE radio_group <> '')
SELECT form_id, radio_group, ord, id, members, member_no FROM g WHERE members > 1""")
def radio_groups(spark, sf):
    return G.radio_groups(spark_table(spark, sf, _RADIO))


_MGROUP = "SELECT p_brand AS form_id, p_partkey AS ord, CASE WHEN p_size % 4 = 0 THEN '' ELSE concat(' g', p_size % 8) END AS group_name, CASE WHEN p_partkey % 50 = 0 THEN ' Btn' ELSE 'Tx' END AS native_type, CASE WHEN p_partkey % 77 = 0 THEN 'RADIO x' ELSE 'texto' END AS data_type FROM @part"


@family.query(f"SELECT form_id, trim(group_name) AS group_name, count(*) AS members FROM {duck(_MGROUP)} WHERE group_name <> '' GROUP BY ALL HAVING bool_or(trim(native_type) = 'Btn' OR lower(data_type) LIKE '%radio%')")
def matrix_radio_groups(spark, sf):
    return G.matrix_radio_groups(spark_table(spark, sf, _MGROUP))


_LABELS = "SELECT o_orderpriority AS form_id, o_orderkey AS ord, o_orderkey % 5 AS page, CASE WHEN o_orderkey % 2 = 0 THEN concat('Base', o_custkey % 60, CASE WHEN o_orderkey % 4 = 0 THEN 'Row' ELSE 'row ' END, o_orderkey % 12) ELSE concat('w', o_custkey) END AS name, CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'X' WHEN 2 THEN 'DATOS DE LA PERSONA ASEGURADA' WHEN 3 THEN NULL ELSE concat('Label ', o_custkey % 3000) END AS label FROM @orders"


@family.query(f"SELECT form_id, name, arg_max(ord, (len(coalesce(label, '')), -ord)) AS ord, arg_max(struct_pack(l := label), (len(coalesce(label, '')), -ord)).l AS label, arg_max(page, (len(coalesce(label, '')), -ord)) AS page FROM {duck(_LABELS)} GROUP BY ALL")
def collapse_widgets(spark, sf):
    return G.collapse_widgets(spark_table(spark, sf, _LABELS), ["page"])


@family.query(f"""
WITH w AS (SELECT *, CASE WHEN regexp_matches(name, '(?i)^.+?Row\\s*\\d+$') THEN lower(regexp_extract(name, '(?i)^(.+?)Row\\s*(\\d+)$', 1)) END AS b, try_cast(regexp_extract(name, '(?i)Row\\s*(\\d+)$', 1) AS INT) AS n,
  len(trim(coalesce(label, ''))) <= 1 OR regexp_matches(trim(label), '^[A-ZÁÉÍÓÚÑÜ\\s]{{15,}}$') AS bad FROM {duck(_LABELS)}),
d AS (SELECT form_id, b, arg_min(label, (n, ord)) FILTER (NOT bad) AS donor FROM w WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
SELECT w.form_id, w.ord, name, CASE WHEN bad AND donor IS NOT NULL THEN donor ELSE label END AS label FROM w LEFT JOIN d ON w.form_id = d.form_id AND w.b = d.b""")
def propagate_row_labels(spark, sf):
    return G.propagate_row_labels(spark_table(spark, sf, _LABELS)).select("form_id", "ord", "name", "label")


_SECT = "SELECT p_brand AS form_id, p_partkey AS ord, p_size % 4 AS page, CASE WHEN p_size % 6 = 0 THEN '' ELSE concat('Paso ', p_size % 3) END AS step, CASE WHEN p_size % 5 = 0 THEN '' ELSE concat('Sección ', p_type, ' ', p_size % 2) END AS section, p_size % 9 <> 0 AS matched FROM @part"


def _sections_sql(key: str, sec_id: str, title: str, last: str = "false") -> str:
    return f"""WITH f AS (SELECT *, {key} AS k, {sec_id} AS i, {title} AS t, {last} AS z FROM {duck(_SECT)}),
g AS (SELECT form_id, k, z, min(ord) AS o, arg_min(i, ord) AS section_id, arg_min(t, ord) AS section_title FROM f GROUP BY ALL), h AS (SELECT *, row_number() OVER (PARTITION BY form_id ORDER BY z, o) AS section_order FROM g)
SELECT f.form_id, ord, section_id, section_title, section_order FROM f JOIN h ON f.form_id = h.form_id AND f.k = h.k"""


def _s40(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 'x' ELSE substr({slug(x)}, 1, 40) END"


_ST, _SE = "CASE WHEN step = '' THEN 'General' ELSE step END", "CASE WHEN section <> '' THEN section WHEN step <> '' THEN step ELSE 'Datos' END"
_MS = "CASE WHEN step <> '' THEN step WHEN section <> '' THEN section ELSE 'General' END"
_ME = f"CASE WHEN section <> '' THEN section ELSE {_MS} END"


@family.query(_sections_sql(f"{_s40(_ST)} || '__' || {_s40(_SE)}", f"'sec_' || {_s40(_ST)} || '_' || {_s40(_SE)}", _SE))
def sections_logical(spark, sf):
    return G.section_group(spark_table(spark, sf, _SECT), "logical").select("form_id", "ord", "section_id", "section_title", "section_order")


@family.query(_sections_sql("page", "'sec_page_' || (page + 1)", "'Página ' || (page + 1)"))
def sections_by_page(spark, sf):
    return G.section_group(spark_table(spark, sf, _SECT), "pdf_page").select("form_id", "ord", "section_id", "section_title", "section_order")


@family.query(_sections_sql(f"CASE WHEN matched THEN {_s40(_MS)} || '__' || {_s40(_ME)} ELSE '~' END", f"CASE WHEN matched THEN 'section_' || {_s40(_MS)} || '_' || {_s40(_ME)} ELSE 'section_sin_clasificar' END",
                            f"CASE WHEN matched THEN {_ME} ELSE 'Sin clasificar' END", "NOT matched"))
def sections_matched(spark, sf):
    return G.section_group(spark_table(spark, sf, _SECT), "matched").select("form_id", "ord", "section_id", "section_title", "section_order")


def _title(x: str) -> str:
    return f"array_to_string([upper(w[1:1]) || lower(w[2:]) FOR w IN string_split({x}, ' ')], ' ')"


@family.query(f"""
WITH f AS (SELECT *, CASE WHEN NOT matched THEN 'Sistema' WHEN step <> '' THEN step WHEN section <> '' THEN section ELSE 'Sin Sección' END AS s FROM {duck(_SECT)}),
g AS (SELECT *, CASE WHEN NOT matched THEN 'Datos del Sistema (oculto)' WHEN section <> '' THEN section ELSE s END AS p FROM f),
p AS (SELECT form_id, matched, s, p, min(ord) AS o, count(*) AS fields FROM g GROUP BY ALL), q AS (SELECT form_id, matched, s, min(o) AS o FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY form_id ORDER BY NOT matched, o) AS section_order FROM q)
SELECT p.form_id, 'section_' || {slug('p.s')} AS section_id, CASE WHEN p.matched THEN {_title('p.s')} ELSE p.s END AS section_title, section_order,
  CASE WHEN p.matched THEN 'subsection_' || {slug('p.s')} || '_' || {slug('p.p')} ELSE 'subsection_sistema_oculto' END AS part_id, CASE WHEN p.matched THEN {_title('p.p')} ELSE p.p END AS part_title,
  row_number() OVER (PARTITION BY p.form_id, p.matched, p.s ORDER BY p.o) AS part_order, NOT p.matched AS hidden, fields FROM p JOIN r ON p.form_id = r.form_id AND p.matched = r.matched AND p.s = r.s""")
def sections_two_level(spark, sf):
    return G.section_two_level(spark_table(spark, sf, _SECT))


_NUMB = "SELECT p_brand AS form_id, concat('bloque ', p_type, CASE WHEN p_size % 3 = 0 THEN '' ELSE concat(' ', p_size % 4) END) AS name, min(p_partkey) AS first_ord FROM @part GROUP BY 1, 2"


@family.query(f"""
WITH n AS (SELECT *, regexp_replace(name, '\\s+\\d+$', '') AS base, nullif(regexp_extract(name, '\\s+(\\d+)$', 1), '') AS num FROM {duck(_NUMB)}), c AS (SELECT form_id, base, count(*) AS a, count(num) AS b FROM n GROUP BY ALL)
SELECT n.form_id, name, base, num, CASE WHEN a > 1 AND b > 0 THEN {_title('base')} || 's' END AS parent_title FROM n JOIN c USING (form_id, base)""")
def numbered_sections(spark, sf):
    return G.numbered_parent(spark_table(spark, sf, _NUMB)).select("form_id", "name", "base", "num", "parent_title")


@family.query(f"""SELECT form_id, 'total' AS metric, '' AS value, count(*) AS n FROM {duck(FORM_FIELDS)} GROUP BY 1 UNION ALL SELECT form_id, 'type', type, count(*) FROM {duck(FORM_FIELDS)} GROUP BY ALL
UNION ALL SELECT form_id, 'section_title', coalesce(section_title, ''), count(*) FROM {duck(FORM_FIELDS)} GROUP BY ALL UNION ALL SELECT form_id, 'hidden', '', count(*) FROM {duck(FORM_FIELDS)} WHERE hidden GROUP BY 1""")
def field_statistics(spark, sf):
    return G.stats(spark_table(spark, sf, FORM_FIELDS), ["type", "section_title"], ["hidden"])


_ISS = f"SELECT form_id, ord, CASE WHEN ord % 9 = 0 THEN 'Vida Colectiva: a / Vida universal: b' WHEN ord % 9 = 1 THEN 'vida  universal' ELSE 'x/y' END AS pdf_label, CASE WHEN ord % 4 = 0 THEN ' ' ELSE 'n' END AS pdf_field_name, json_name, required, product_scope FROM ({MATRIX}) m"


@family.query(f"""
SELECT form_id, ord, 'ambiguous_pdf_name' AS issue, NULL AS suggested FROM {duck(_ISS)} WHERE ord % 9 = 0
UNION ALL SELECT form_id, ord, 'missing_pdf_field', regexp_replace(lower(regexp_replace(list_last(string_split(json_name, '.')), '([A-Z])', '_\\1', 'g')), '^_', '') FROM {duck(_ISS)} WHERE ord % 4 = 0
UNION ALL SELECT form_id, ord, 'obligatorio_case', 'No' FROM {duck(_ISS)} WHERE required = 'NO'
UNION ALL SELECT form_id, ord, 'derive_formulario', CASE WHEN product_scope = 'TODOS' THEN 'TODOS' WHEN product_scope LIKE '%Colectiva%' THEN 'VC' WHEN product_scope LIKE '%universal%' THEN 'VU' ELSE 'PC' END FROM {duck(_ISS)} WHERE product_scope <> ''""")
def matrix_issues(spark, sf):
    return G.matrix_issues(spark_table(spark, sf, _ISS))


@family.query(f"""
WITH n AS (SELECT *, source_name AS name, regexp_replace(source_name, '\\[\\d+\\]$', '') AS r FROM {duck(NAMES)})
SELECT form_id, count(*) AS fields, max(page) + 1 AS pages, count(DISTINCT CASE WHEN r <> name THEN r END) AS repeater_groups, count(DISTINCT r) AS unique_configs FROM n GROUP BY 1""")
def widget_statistics(spark, sf):
    return G.widget_stats(spark_table(spark, sf, NAMES).withColumnRenamed("source_name", "name"))


@family.query(f"""
WITH s AS (SELECT DISTINCT form_id, section_id, CASE WHEN section_id = 's2' THEN 'x' END AS c FROM {duck(FORM_FIELDS)})
SELECT f.form_id, s.sections, fields, repeaters, autofill, 0 AS lookups, cond + s.c AS conditionals FROM (SELECT form_id, count(*) AS fields, count(*) FILTER (type = 'repeater') AS repeaters, count(concat) AS autofill,
  count(*) FILTER (coalesce(condition_visibility, condition_required, '') <> '') AS cond FROM {duck(FORM_FIELDS)} GROUP BY 1) f JOIN (SELECT form_id, count(*) AS sections, count(c) AS c FROM s GROUP BY 1) s USING (form_id)""")
def definition_statistics(spark, sf):
    f = spark_table(spark, sf, FORM_FIELDS)
    s = f.select("form_id", "section_id").distinct().withColumn("condition_visibility", F.when(F.col("section_id") == "s2", "x"))
    return G.formdef_stats(f, s)
