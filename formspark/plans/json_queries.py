"""JSON payloads made of the orders: shapes, contract comparison, conflicts, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from formspark.operators import json_paths as J
from formspark.plans.registry import Family
from formspark.plans.tables import MATRIX, PAYLOADS, duck, read, spark_table

family = Family()

NODES = f"""(SELECT d.doc_id, d.family, d.status, k.id AS node, k.fullkey, regexp_replace(substr(k.fullkey, 3), '\\[\\d+\\]', '[]', 'g') AS path,
  CASE k.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'leaf' END AS kind, json_extract_string(k.atom, '$') AS value
  FROM {duck(PAYLOADS)} d, json_tree(d.body) k WHERE k.fullkey <> '$')"""


def payloads(spark, sf):
    return spark_table(spark, sf, PAYLOADS)


@family.query(f"""
SELECT DISTINCT doc_id, CASE kind WHEN 'array' THEN path || '[]' ELSE path END AS path FROM {NODES}
WHERE NOT regexp_matches(fullkey, '\\[[1-9]') AND (kind <> 'leaf' OR value IS NOT NULL)""")
def payload_paths(spark, sf):
    return J.flatten_paths(payloads(spark, sf), ["doc_id"], "body")


SHAPE = f"(SELECT family, status, path, coalesce(min(CASE WHEN kind <> 'leaf' THEN kind END), 'leaf') AS kind, count(*) AS n FROM {NODES} GROUP BY ALL)"


def shape(spark, sf, status: list[str] | None = None, per=("family",)):
    docs = payloads(spark, sf)
    if status:
        docs = docs.where(F.col("status").isin(*status))
    return J.flatten_shape(docs, ["family", "status", "doc_id"], "body", per=list(per))


@family.query(f"SELECT * FROM {SHAPE}")
def payload_shape(spark, sf):
    return shape(spark, sf, per=("family", "status")).drop("first_seen")


@family.query(f"""SELECT family, path, sample_no, value FROM (SELECT *, row_number() OVER (PARTITION BY family, path ORDER BY doc_id, node) AS sample_no
  FROM {NODES} WHERE kind = 'leaf') WHERE sample_no <= 3""")
def payload_samples(spark, sf):
    return J.path_samples(payloads(spark, sf), ["family", "doc_id"], "body", per=["family"])


@family.query(f"""SELECT 'leaf' AS what, family, path AS name FROM (SELECT DISTINCT family, path FROM {NODES} WHERE kind = 'leaf')
UNION ALL SELECT DISTINCT 'key', family, regexp_replace(list_last(string_split(path, '.')), '(\\[\\])+$', '') FROM {NODES} WHERE NOT ends_with(path, '[]')""")
def payload_leaves_and_keys(spark, sf):
    nodes = J.json_nodes(payloads(spark, sf), ["family"], "body")
    leaves = J.flatten_leaves(nodes, ["family"]).select(F.lit("leaf").alias("what"), "family", F.col("path").alias("name"))
    return leaves.unionByName(J.sample_keys(nodes, ["family"]).select(F.lit("key").alias("what"), "family", F.col("key").alias("name")))


def _side(status: str) -> str:
    return f"(SELECT family, path, coalesce(min(CASE WHEN kind <> 'leaf' THEN kind END), 'leaf') AS kind FROM {NODES} WHERE status {status} GROUP BY ALL)"


_CONTRACT, _GENERATED = _side("= 'F'"), _side("<> 'F'")
_DIFF = f"""(SELECT family, path, CASE WHEN g.kind IS NULL THEN 'falta' WHEN c.kind IS NULL THEN 'sobra' WHEN c.kind <> g.kind THEN 'forma' ELSE 'ok' END AS status,
  coalesce(c.kind, g.kind) AS kind, c.kind AS expected, g.kind AS found FROM {_CONTRACT} c FULL JOIN {_GENERATED} g USING (family, path))"""


def _diff(spark, sf):
    contract, generated = shape(spark, sf, ["F"]), shape(spark, sf, ["O", "P"])
    return J.compare_shape(contract, generated, ["family"]), generated


@family.query(f"""
WITH gen AS (SELECT family, path AS suggestion, n, array_to_string(string_split(path, '.')[len(string_split(path, '.')) - n + 1:], '.') AS suffix FROM {_GENERATED}, generate_series(2, len(string_split(path, '.'))) t(n)),
miss AS (SELECT family, path, n, array_to_string(string_split(path, '.')[len(string_split(path, '.')) - n + 1:], '.') AS suffix FROM {_DIFF}, generate_series(2, len(string_split(path, '.'))) t(n) WHERE status = 'falta'),
best AS (SELECT miss.family, path, suggestion, miss.n AS segments, row_number() OVER (PARTITION BY miss.family, path ORDER BY miss.n DESC, suggestion) AS k
  FROM miss JOIN gen ON miss.family = gen.family AND miss.suffix = gen.suffix)
SELECT d.family, d.path, status, kind, expected, found, suggestion, segments, row_number() OVER (PARTITION BY d.family ORDER BY CASE status WHEN 'forma' THEN 0 WHEN 'falta' THEN 1 WHEN 'sobra' THEN 2 ELSE 3 END, d.path) AS place FROM {_DIFF} d LEFT JOIN best ON best.k = 1 AND d.family = best.family AND d.path = best.path""")
def contract_compare(spark, sf):
    diff, generated = _diff(spark, sf)
    return J.order_diff(J.suggest_path(diff, generated, ["family"]), ["family"])


@family.query(f"""SELECT *, CAST(floor(ok * 100 / (ok + falta + forma) + 0.5) AS INT) AS coverage FROM (SELECT family, count(*) FILTER (status = 'ok') AS ok,
  count(*) FILTER (status = 'falta') AS falta, count(*) FILTER (status = 'sobra') AS sobra, count(*) FILTER (status = 'forma') AS forma FROM {_DIFF} GROUP BY 1)""")
def contract_counts(spark, sf):
    return J.compare_counts(_diff(spark, sf)[0], ["family"])


_LEAVES = f"(SELECT DISTINCT family, path FROM {NODES} WHERE kind = 'leaf' AND status = 'F')"
_WRITTEN = f"(SELECT DISTINCT family, path FROM {NODES} WHERE kind = 'leaf' AND status <> 'F')"


def _leaves(spark, sf, statuses):
    docs = payloads(spark, sf).where(F.col("status").isin(*statuses))
    return J.flatten_leaves(J.json_nodes(docs, ["family"], "body"), ["family"])


@family.query(f"SELECT * FROM {_LEAVES} WHERE (family, path) NOT IN (SELECT (family, path) FROM {_WRITTEN})")
def contract_missing(spark, sf):
    return J.coverage(_leaves(spark, sf, ["F"]), _leaves(spark, sf, ["O", "P"]), ["family"])[0]


@family.query(f"SELECT family, count(*) AS total, count(w.path) AS covered, count(*) - count(w.path) AS missing FROM {_LEAVES} l LEFT JOIN {_WRITTEN} w USING (family, path) GROUP BY 1")
def contract_coverage(spark, sf):
    return J.coverage(_leaves(spark, sf, ["F"]), _leaves(spark, sf, ["O", "P"]), ["family"])[1]


# Paths a form writes: whole person blocks next to fields inside them. Form = brand.
WRITTEN = f"""SELECT form_id, ord, CASE p_size % 7 WHEN 0 THEN 'datosFormulario.personas' WHEN 1 THEN 'datosFormulario.personas[0]'
  WHEN 2 THEN concat(json_name, '.', p_size) ELSE json_name END AS path FROM ({MATRIX}) m"""


@family.query(f"""
WITH w AS (SELECT DISTINCT form_id, path FROM {duck(WRITTEN)}),
r AS (SELECT DISTINCT form_id, path, true AS rep FROM w WHERE path = 'datosFormulario.personas' AND form_id > 'Brand#15')
SELECT a.form_id, a.path, CASE WHEN rep THEN 'array-y-objeto' ELSE 'contenedor' END AS type, min(b.path) AS child
FROM w a LEFT JOIN r ON a.form_id = r.form_id AND a.path = r.path JOIN w b ON a.form_id = b.form_id AND
  (starts_with(b.path, a.path || '.') OR (starts_with(b.path, a.path || '[') AND rep IS NULL)) GROUP BY ALL""")
def path_conflicts(spark, sf):
    paths = spark_table(spark, sf, WRITTEN)
    repeaters = paths.where("path = 'datosFormulario.personas' AND form_id > 'Brand#15'")
    return J.path_prefix_conflict(paths, repeaters)


@family.query(f"""
WITH p AS (SELECT form_id, list_filter(string_split(path, '.'), lambda s: s <> '') AS p FROM {duck(WRITTEN)})
SELECT form_id, array_to_string(p[1:d], '.') AS path, p[d] AS name, d::INT AS depth, bool_or(d = len(p)) AS leaf FROM p, generate_series(1, len(p)) t(d) GROUP BY ALL""")
def route_tree(spark, sf):
    return J.route_tree(spark_table(spark, sf, WRITTEN), ["form_id"])


# Keys a form is prefilled from, some of them unknown to the payloads.
KEYS = """SELECT c_custkey AS field_id, CASE c_custkey % 6 WHEN 0 THEN 'order.customer.id' WHEN 1 THEN 'ORDER.Customer.Tags' WHEN 2 THEN concat('order.', c_mktsegment)
  WHEN 3 THEN 'Amount' WHEN 4 THEN concat('meta.k', c_nationkey) ELSE 'order.billing.dates[].day' END AS key FROM @customer"""


@family.query(f"""
WITH known AS (SELECT DISTINCT CASE kind WHEN 'array' THEN path || '[]' ELSE path END AS path FROM {NODES} WHERE NOT regexp_matches(fullkey, '\\[[1-9]') AND (kind <> 'leaf' OR value IS NOT NULL)),
forms AS (SELECT lower(replace(path, '[]', '')) AS f FROM known), leaves AS (SELECT lower(replace(list_last(string_split(path, '.')), '[]', '')) AS f FROM known)
SELECT field_id, key FROM {duck(KEYS)} WHERE lower(replace(key, '[]', '')) NOT IN (SELECT f FROM forms) AND lower(key) NOT IN (SELECT f FROM leaves WHERE f <> '')""")
def unknown_prefill_keys(spark, sf):
    known = J.flatten_paths(payloads(spark, sf), ["doc_id"], "body").select("path").distinct()
    return J.unknown_paths(spark_table(spark, sf, KEYS), known)


@family.query(f"""
WITH known AS (SELECT DISTINCT path FROM {NODES}), walk AS (SELECT path FROM known UNION SELECT regexp_replace(path, '(\\[\\])+$', '') FROM known)
SELECT form_id, ord, path, regexp_replace(path, '\\[\\d*\\]', '[]', 'g') IN (SELECT path FROM walk) AS "exists"
FROM (SELECT 'f' || field_id % 3 AS form_id, field_id AS ord, CASE WHEN field_id % 2 = 0 THEN replace(key, '[]', '[3]') ELSE key END AS path FROM {duck(KEYS)})""")
def paths_exist(spark, sf):
    wanted = spark_table(spark, sf, KEYS).select(
        F.concat(F.lit("f"), F.col("field_id") % 3).alias("form_id"), F.col("field_id").alias("ord"),
        F.when(F.col("field_id") % 2 == 0, F.replace("key", F.lit("[]"), F.lit("[3]"))).otherwise(F.col("key")).alias("path"))
    known = J.json_nodes(payloads(spark, sf), [], "body").select("path").distinct()
    return J.path_exists(wanted, known, [])


@family.query("""
SELECT s_suppkey AS form_id, sub, i::INT AS i, 'dep' || sub || '_' || i || '[' || (i + 1) || ']' || (i + 1) AS name
FROM supplier, unnest(['Nombre', 'Edad' || s_nationkey]) u(sub), generate_series(0, s_nationkey % 5) t(i)""")
def repeater_slots(spark, sf):
    reps = read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("form_id"), F.lit("dep{sub}_{i0}[{i1}]{i}").alias("pattern"),
        F.array(F.lit("Nombre"), F.concat(F.lit("Edad"), "s_nationkey")).alias("subfields"), (F.col("s_nationkey") % 5 + 1).alias("max_items"))
    return J.expand_slots(reps)


@family.query("""
SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE props ->> '$.k' END AS k FROM events""")
def lenient_json(spark, sf):
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(
        F.col("event_id") % 3 == 1, F.replace("props", F.lit("}"), F.lit(', \n}'))).otherwise(F.concat("props", F.lit("}")))
    return read(spark, sf, "events").select("event_id", F.try_variant_get(J.read_json_lenient(text), "$.k", "string").alias("k"))


# Form definitions: one per customer, with a hidden part, a repeater and the three roots.
FORMDEFS = """SELECT c_custkey AS form_id, concat(CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '{"jsonDefinition":' ELSE '{"data":{"jsonDefinition":' END,
  '{"sections":[{"id":"s1","title":"', c_mktsegment, '","hidden":', CASE WHEN c_nationkey % 4 = 0 THEN 'true' ELSE 'false' END, ',"fields":[{"id":"field_a","label":"', c_name,
  '","type":"text","hidden":true,"salidaJSON":"x.a","sourceMeta":{"sourceName":"a', c_nationkey, '"}},{"id":"field_r","type":"repeater","repeaterConfig":{"fields":[{"id":"n","label":"N","type":"text"},{"id":"m","type":"number"}]}}],',
  '"subsections":[{"id":"s2","fields":[{"id":"field_b","type":"date","jsonOutputPath":"x.b"}],"subsections":[{"id":"s3","title":"T","conditionalVisibility":"',
  CASE WHEN c_nationkey % 2 = 0 THEN 'field_NEVER_EXISTS' ELSE 'x' END, '","fields":[{"id":"field_c","type":"text"}]}]}]},{"id":"s4","title":"Fin","fields":[{"id":"field_d","type":"signature"}]}]}',
  CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '}' ELSE '}}' END) AS body FROM @customer"""


@family.query("""
WITH c AS (SELECT c_custkey AS form_id, c_mktsegment AS t, c_name, c_nationkey % 4 = 0 AS h, c_nationkey % 2 = 0 AS never, c_nationkey FROM customer)
SELECT form_id, t AS section_path, 's1' AS section_id, NULL AS in_repeater, true AS hidden_effective, 'field_a' AS id, c_name AS label, 'text' AS type, 'x.a' AS salida, NULL AS output, 'a' || c_nationkey AS source_name, 1 AS pos FROM c
UNION ALL SELECT form_id, t, 's1', NULL, h, 'field_r', NULL, 'repeater', NULL, NULL, NULL, 2 FROM c
UNION ALL SELECT form_id, t || ' / field_r', 's1', 'field_r', h, 'n', 'N', 'text', NULL, NULL, NULL, 3 FROM c
UNION ALL SELECT form_id, t || ' / field_r', 's1', 'field_r', h, 'm', NULL, 'number', NULL, NULL, NULL, 4 FROM c
UNION ALL SELECT form_id, t || ' / s2', 's2', NULL, h, 'field_b', NULL, 'date', NULL, 'x.b', NULL, 5 FROM c
UNION ALL SELECT form_id, t || ' / s2 / T', 's3', NULL, h OR never, 'field_c', NULL, 'text', NULL, NULL, NULL, 6 FROM c
UNION ALL SELECT form_id, 'Fin', 's4', NULL, false, 'field_d', NULL, 'signature', NULL, NULL, NULL, 7 FROM c""")
def formdef_fields(spark, sf):
    fields = J.flatten_formdef(spark_table(spark, sf, FORMDEFS), ["form_id"], "body")
    by_form = F.row_number().over(J.Window.partitionBy("form_id").orderBy("ord"))
    return fields.select("form_id", F.array_join("section_path", " / ").alias("section_path"), "section_id", "in_repeater", "hidden_effective",
                         "id", "label", "type", F.col("salidaJSON").alias("salida"), F.col("jsonOutputPath").alias("output"), "source_name",
                         by_form.alias("pos"))


# Documents nested up to 40 levels deep, and definitions of up to 13 levels of sections.
DEEP = """SELECT o_orderkey AS doc_id, concat(repeat('{"a":[', CAST(o_orderkey % 20 AS INT)), '{"b":"', o_orderpriority, '","c":[]}', repeat(']}', CAST(o_orderkey % 20 AS INT))) AS body FROM @orders"""
DEEPDEFS = """SELECT c_custkey AS form_id, concat('{"sections":[', repeat('{"id":"s","fields":[{"id":"f","type":"text"}],"subsections":[', CAST(c_custkey % 13 AS INT)),
  '{"id":"last","title":"', c_mktsegment, '","fields":[{"id":"deep","type":"date","label":"', c_name, '"}]}', repeat(']}', CAST(c_custkey % 13 AS INT)), ']}') AS body FROM @customer"""


@family.query(f"""SELECT d.doc_id, regexp_replace(substr(k.fullkey, 3), '\\[\\d+\\]', '[]', 'g') AS path, CASE k.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'leaf' END AS kind,
  CASE WHEN k.type NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(k.atom, '$') END AS value FROM {duck(DEEP)} d, json_tree(d.body) k WHERE k.fullkey <> '$'""")
def deep_nodes(spark, sf):
    return J.json_nodes(spark_table(spark, sf, DEEP), ["doc_id"], "body").drop("ord")


@family.query("""
WITH c AS (SELECT c_custkey AS form_id, (c_custkey % 13)::INT AS n, c_mktsegment, c_name FROM customer)
SELECT form_id, repeat('s / ', d::INT - 1) || 's' AS section_path, 's' AS section_id, 'f' AS id, NULL AS label, 'text' AS type FROM c, generate_series(1, n) t(d)
UNION ALL SELECT form_id, repeat('s / ', n) || c_mktsegment, 'last', 'deep', c_name, 'date' FROM c""")
def deep_formdef_fields(spark, sf):
    fields = J.flatten_formdef(spark_table(spark, sf, DEEPDEFS), ["form_id"], "body")
    return fields.select("form_id", F.array_join("section_path", " / ").alias("section_path"), "section_id", "id", "label", "type")


# Sample values at the paths a form writes. Form = brand.
SAMPLES = f"""SELECT form_id, concat('a', p_size % 3, '.b[', p_size % 4, '].', CASE WHEN p_size % 2 = 0 THEN 'x' ELSE 'y[]' END, '.', lower(substring(data_type, 1, 1)), '[', ord % 3, '][', p_size % 2, ']') AS path, concat('<', ord, '>') AS value FROM ({MATRIX}) m"""


_ENDS = "array_to_string(list_reverse(list_transform({0}, lambda s: CASE s.kind WHEN 'k' THEN '}}' ELSE ']' END)), '')"
_LABEL = """CASE {0}.kind WHEN 'k' THEN '"' || {0}.key || '":' ELSE repeat('null,', greatest({1}, 0)::INT) END"""
_STEP = "struct_pack(kind := '{}', key := {}, at := {})"


def _list(*steps: tuple[str, str, str]) -> str:
    return "[" + ", ".join(_STEP.format(*s) for s in steps) + "]"


_TREE = f"""WITH m AS (SELECT form_id, concat('<', ord, '>') AS value, list_concat(list_concat({_list(("k", "'a' || p_size % 3", "0"), ("k", "'b'", "0"), ("i", "''", "(p_size % 4)::INT"))},
    CASE WHEN p_size % 2 = 0 THEN {_list(("k", "'x'", "0"))} ELSE {_list(("k", "'y'", "0"), ("i", "''", "0"))} END),
    {_list(("k", "lower(substring(data_type, 1, 1))", "0"), ("i", "''", "(ord % 3)::INT"), ("i", "''", "(p_size % 2)::INT"))}) AS steps FROM {duck(MATRIX)}),
r AS (SELECT form_id, steps, min(value) AS value FROM m GROUP BY ALL), p AS (SELECT *, lag(steps) OVER (PARTITION BY form_id ORDER BY steps) AS prev FROM r),
q AS (SELECT *, CASE WHEN prev IS NULL THEN 0 ELSE len(list_filter(generate_series(1, least(len(steps), len(prev))), lambda i: steps[:i] = prev[:i])) END AS same FROM p),
t AS (SELECT *, steps[same + 1] AS first, CASE WHEN prev IS NULL THEN steps[same + 1].at ELSE steps[same + 1].at - prev[same + 1].at - 1 END AS holes FROM q),
x AS (SELECT form_id, 0 AS part, steps, CASE WHEN prev IS NULL THEN '{{' ELSE {_ENDS.format("prev[same + 2:]")} || ',' END || {_LABEL.format("first", "holes")}
    || array_to_string(list_transform(steps[same + 2:], lambda d: CASE d.kind WHEN 'k' THEN '{{' ELSE '[' END || {_LABEL.format("d", "d.at")}), '') || '"' || value || '"' AS text FROM t
  UNION ALL SELECT form_id, 1, steps, {_ENDS.format("steps")} FROM (SELECT form_id, max(steps) AS steps FROM r GROUP BY 1))
SELECT form_id, part, '[' || array_to_string(list_transform(steps, lambda d: '{{"kind":"' || d.kind || '","key":"' || d.key || '","at":' || d.at || '}}'), ',') || ']' AS steps, text FROM x"""


@family.query(_TREE)
def sample_tree(spark, sf):
    """the sample document of each form, line by line; the tests read the lines as JSON as well"""
    return J.sample_tree_lines(spark_table(spark, sf, SAMPLES)).select(
        "form_id", "part", F.to_json("steps").alias("steps"), "text")
