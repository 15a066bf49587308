"""Matching operators over rows and fields made of the parts (form = brand)."""

from __future__ import annotations

from pyspark.sql import functions as F

from formspark.operators import fuzzy
from formspark.operators import joins as J
from formspark.plans.registry import Family
from formspark.plans.tables import FIELDS, MATRIX, ROWS, WIDGETS, duck, read, spark_table, stored

family = Family()


def nw(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(coalesce({c}, ''))), '[^a-z0-9]+', ' ', 'g'))"


def fold(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(coalesce({c}, ''))), '\\s+', ' ', 'g'))"


def slug(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(coalesce({c}, ''))), '[^a-z0-9]+', '_', 'g'), '_')"


R, FI, M = duck(ROWS), duck(FIELDS), duck(MATRIX)


def rows(spark, sf):
    return stored(spark_table(spark, sf, ROWS))


def fields(spark, sf):
    return stored(spark_table(spark, sf, FIELDS))


# ---- catalogs -----------------------------------------------------------------------------

# Catalog sheets: one per nation and region, plus the ones the labels hint at.
CATALOGS = """SELECT CASE n_nationkey % 5 WHEN 0 THEN 'Moneda' WHEN 1 THEN 'Estado Civil' WHEN 2 THEN 'Tipo Identificación' WHEN 3 THEN concat('Nation ', n_nationkey) ELSE r_name END AS catalog,
  n_nationkey AS cat_ord, n_nationkey AS code, n_name AS label FROM @nation n JOIN @region r ON n_regionkey = r_regionkey"""
CHOICES = """SELECT c_mktsegment AS form_id, c_custkey AS ord, CASE c_custkey % 4 WHEN 0 THEN 'select' WHEN 1 THEN 'radio' WHEN 2 THEN 'select' ELSE 'text' END AS type,
  CASE c_nationkey % 6 WHEN 0 THEN concat('Nation ', c_nationkey) WHEN 1 THEN 'Tipo de identificación' WHEN 2 THEN concat('Moneda del ', c_name) WHEN 3 THEN 'Estado civil' WHEN 4 THEN 'asia' ELSE c_name END AS label,
  CASE WHEN c_nationkey % 4 = 0 THEN 'Estado   civil!' ELSE concat('NATION-', c_nationkey) END AS pdf_label, concat('nation', c_nationkey) AS json_name, c_custkey % 3 AS n_options,
  CASE c_custkey % 5 WHEN 0 THEN 'sexo' WHEN 1 THEN 'moneda' WHEN 2 THEN 'tipo_identificacion' WHEN 3 THEN 'parentesco' ELSE '' END AS group_name,
  CASE c_custkey % 5 WHEN 0 THEN 'Ver catálogo' ELSE 'libre' END AS rule, CASE c_custkey % 7 WHEN 0 THEN 'Moneda: (ver hoja)' WHEN 1 THEN 'X: a|b' WHEN 2 THEN 'sin lista' ELSE '' END AS catalog_direct,
  concat('etiqueta ', c_custkey % 9) AS field_label FROM @customer"""
CAT, CH = duck(CATALOGS), duck(CHOICES)
_HINT = "CASE WHEN lower({0}) LIKE '%moneda%' THEN 'moneda' WHEN regexp_matches(lower({0}), 'estado{1}civil') THEN 'estado_civil' WHEN regexp_matches(lower({0}), 'tipo{2}identificaci[oó]n') THEN 'tipo_identificacion' END"


@family.query(f"""
WITH k AS (SELECT {slug('catalog')} AS k, max(catalog) AS c FROM {CAT} GROUP BY 1), f AS (SELECT *, type IN ('select', 'radio') AS ok FROM {CH})
SELECT form_id, ord, CASE WHEN ok THEN coalesce(a.c, b.c, d.c, e.c, h.c) END AS catalog_name, ok AND coalesce(a.c, b.c, d.c, e.c, h.c) IS NOT NULL AND n_options <= 1 AS use_catalog
FROM f LEFT JOIN k a ON a.k = {slug('label')} LEFT JOIN k b ON b.k = {slug('pdf_label')} LEFT JOIN k d ON d.k = {slug("regexp_replace(label, '(?i)^tipo\\s+de\\s+', 'tipo ')")}
LEFT JOIN k e ON e.k = {slug('json_name')} LEFT JOIN k h ON h.k = {_HINT.format('label', chr(92) + 's*', chr(92) + 's+')}""")
def join_catalog(spark, sf):
    return J.join_catalog(spark_table(spark, sf, CHOICES), spark_table(spark, sf, CATALOGS)).select("form_id", "ord", "catalog_name", "use_catalog")


@family.query(f"""
WITH c AS (SELECT DISTINCT lower(trim(catalog)) AS key, cat_ord FROM {CAT}),
s AS (SELECT w, arg_min(key, (CASE WHEN key = w THEN 0 ELSE 1 END, cat_ord)) AS sheet FROM c, unnest(['tipo identificación', 'parentesco', 'estado civil', 'nacionalidad', 'moneda', 'tipo persona']) t(w) WHERE contains(key, w) OR contains(w, key) GROUP BY 1),
f AS (SELECT *, CASE group_name WHEN 'moneda' THEN 'moneda' WHEN 'tipo_identificacion' THEN 'tipo identificación' WHEN 'parentesco' THEN 'parentesco' END AS g,
  CASE WHEN regexp_matches(label, '(?i)tipo\\s+(de\\s+)?identificaci') THEN 'tipo identificación' WHEN label ILIKE '%estado civil%' THEN 'estado civil' WHEN label ILIKE '%moneda%' THEN 'moneda' END AS l FROM {CH})
SELECT form_id, ord, group_name = 'sexo' AS synthetic, CASE WHEN group_name = 'sexo' THEN 'Sexo (sintético)' ELSE coalesce(a.sheet, b.sheet) END AS sheet FROM f LEFT JOIN s a ON a.w = g LEFT JOIN s b ON b.w = l""")
def find_catalog(spark, sf):
    return J.find_catalog(spark_table(spark, sf, CHOICES), spark_table(spark, sf, CATALOGS)).select("form_id", "ord", "synthetic", "sheet")


@family.query(f"""
WITH k AS (SELECT {slug('catalog')} AS k, min(catalog) AS c FROM {CAT} GROUP BY 1), combo AS (SELECT DISTINCT form_id, field_label FROM {CH} WHERE n_options = 2),
f AS (SELECT c.*, combo.field_label IS NOT NULL AS has_combo, rule = 'Ver catálogo' AS by_rule, type IN ('select', 'radio') AS ok FROM {CH} c LEFT JOIN combo USING (form_id, field_label))
SELECT form_id, ord, CASE WHEN NOT ok THEN NULL WHEN has_combo THEN 'combo' WHEN catalog_direct LIKE 'Moneda: (%' THEN 'direct_catalog' WHEN catalog_direct LIKE '%:%' THEN 'direct' WHEN rc IS NOT NULL THEN 'rule_catalog' WHEN kc IS NOT NULL THEN 'known_catalog' END AS origin,
  CASE WHEN NOT ok OR has_combo THEN NULL WHEN catalog_direct LIKE 'Moneda: (%' THEN 'Moneda' WHEN catalog_direct LIKE '%:%' THEN NULL ELSE coalesce(rc, kc) END AS catalog_name
FROM (SELECT f.*, CASE WHEN by_rule THEN coalesce(a.c, a2.c, b.c, b2.c) END AS rc, h.c AS kc FROM f LEFT JOIN k a ON a.k = {slug('pdf_label')} LEFT JOIN k a2 ON a2.k = {slug("regexp_replace(pdf_label, '(?i)^tipo de ', 'tipo ')")} LEFT JOIN k b ON b.k = {slug('label')}
  LEFT JOIN k b2 ON b2.k = {slug("regexp_replace(label, '(?i)^tipo de ', 'tipo ')")} LEFT JOIN k h ON h.k = {_HINT.format('field_label', chr(92) + 's*', chr(92) + 's*')})""")
def resolve_options(spark, sf):
    c = spark_table(spark, sf, CHOICES)
    combo = c.where("n_options = 2").select("form_id", F.col("field_label").alias("label"))
    return J.resolve_options(c, combo, spark_table(spark, sf, CATALOGS)).select("form_id", "ord", "origin", "catalog_name")


@family.query("""
WITH c AS (SELECT o_orderpriority AS form_id, 'L' || o_custkey AS label, CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE ' ' || o_orderstatus || o_custkey % 2 END AS value, o_orderkey AS ord FROM orders),
n AS (SELECT form_id, label FROM c WHERE trim(value) <> '' GROUP BY ALL HAVING count(*) > 1)
SELECT form_id, label, trim(value) AS value, min(ord) AS ord FROM c JOIN n USING (form_id, label) WHERE trim(value) <> '' GROUP BY ALL""")
def inline_options(spark, sf):
    o = read(spark, sf, "orders")
    value = F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.concat(F.lit(" "), "o_orderstatus", F.col("o_custkey") % 2))
    return J.inline_options(o.select(F.col("o_orderpriority").alias("form_id"), F.concat(F.lit("L"), "o_custkey").alias("label"), value.alias("value"),
                                     F.col("o_orderkey").alias("ord")))


# ---- conditions ------------------------------------------------------------------------------

_COND = f"SELECT form_id, ord, CASE p_size % 4 WHEN 0 THEN 'equals' WHEN 1 THEN 'depends' WHEN 2 THEN 'trigger' END AS kind, concat(' ', upper(p_name), CASE WHEN p_size % 5 = 0 THEN ' no' ELSE '' END) AS label, CASE WHEN p_size % 4 = 0 THEN concat('v', p_size) END AS value, CASE WHEN p_size % 2 = 1 THEN 'unparsed_rule' END AS leftover FROM ({MATRIX}) m"
_TARGET = f"SELECT form_id, ord, concat('field_', ord) AS id, CASE WHEN p_size % 3 = 0 THEN p_name ELSE concat('l', p_size) END AS label, CASE WHEN p_size % 3 = 1 THEN p_name ELSE concat('l', p_size) END AS pdf_label, CASE WHEN p_size % 3 = 2 THEN replace(p_name, ' ', '_') ELSE '' END AS source_name FROM ({MATRIX}) m"


@family.query(f"""
WITH t AS (SELECT form_id, k, max_by(id, ord) AS id FROM (SELECT form_id, ord, id, {fold('label')} AS k FROM {duck(_TARGET)} UNION ALL SELECT form_id, ord, id, {fold('pdf_label')} FROM {duck(_TARGET)} WHERE pdf_label <> label) GROUP BY ALL)
SELECT c.form_id, ord, kind, id AS depends_on, CASE WHEN kind IN ('equals', 'depends') AND id IS NULL AND kind = 'equals' THEN 'unknown_reference' WHEN kind IS NULL OR (kind = 'depends' AND id IS NULL) THEN leftover END AS warning,
  CASE WHEN id IS NOT NULL THEN CASE WHEN coalesce(value, '') = '' THEN 'not_empty' ELSE 'equals' END END AS operator
FROM {duck(_COND)} c LEFT JOIN t ON c.form_id = t.form_id AND kind IN ('equals', 'depends') AND k = {fold('c.label')}""")
def condition_targets(spark, sf):
    return J.resolve_condition_target(spark_table(spark, sf, _COND), spark_table(spark, sf, _TARGET)).select(
        "form_id", "ord", "kind", "depends_on", "warning", "operator")


_TRG = f"SELECT form_id, ord, concat('field_', ord) AS id, concat(upper(p_name), CASE WHEN p_size % 5 = 0 THEN ' no' ELSE '' END) AS target, concat('v', p_size) AS value FROM ({MATRIX}) m WHERE p_size % 4 = 2"


@family.query(f"""
WITH t AS (SELECT form_id, k, max_by(id, ord) AS id FROM (SELECT form_id, ord, id, {fold('label')} AS k FROM {duck(_TARGET)} UNION ALL SELECT form_id, ord, id, lower(replace(source_name, '_', ' ')) FROM {duck(_TARGET)} WHERE source_name <> '') GROUP BY ALL),
f AS (SELECT g.*, t.id AS target_id FROM {duck(_TRG)} g LEFT JOIN t ON g.form_id = t.form_id AND k = {fold('target')})
SELECT form_id, target_id AS id, max_by(id, ord) AS depends_on, max_by(value, ord) AS value, 'moved' AS what FROM f WHERE target_id IS NOT NULL GROUP BY ALL
UNION ALL SELECT form_id, id, target, NULL, 'lost' FROM f WHERE target_id IS NULL""")
def trigger_targets(spark, sf):
    moved, lost = J.move_trigger(spark_table(spark, sf, _TRG), spark_table(spark, sf, _TARGET))
    return moved.select("form_id", "id", "depends_on", "value", F.lit("moved").alias("what")).unionByName(
        lost.select("form_id", "id", F.col("target").alias("depends_on"), F.lit(None).cast("string").alias("value"), F.lit("lost").alias("what")))


# ---- rows and widgets ----------------------------------------------------------------------

_WID = "SELECT p_brand AS form_id, p_partkey AS ord, CASE p_partkey % 3 WHEN 0 THEN concat(replace(p_name, ' ', '_'), '_', p_size % 4) WHEN 1 THEN concat(upper(p_name), '[', p_size, '].', p_size % 4) ELSE concat('-', p_name, CASE WHEN p_size % 2 = 0 THEN '-o-' ELSE '' END) END AS name, p_size % 3 AS page, p_partkey % 100 AS x FROM @part"
_kslug = "trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '\\[\\d+\\]', '', 'g'), '[^a-z0-9]+', '_', 'g'), '_')"


@family.query(f"""
WITH e AS (SELECT form_id, name AS k, max_by(name, ord) AS v, max_by(page, ord) AS page FROM {duck(_WID)} GROUP BY ALL),
n AS (SELECT form_id, {_kslug.format('name')} AS k, max_by(name, ord) AS v, max_by(page, ord) AS page FROM {duck(_WID)} GROUP BY ALL)
SELECT r.form_id, r.ord, coalesce(e.v, a.v, b.v) AS name, CASE WHEN e.v IS NOT NULL THEN e.page WHEN a.v IS NOT NULL THEN a.page ELSE b.page END AS page, CASE WHEN coalesce(e.v, a.v, b.v) IS NULL AND pdf_field_name <> '' THEN 'pdf_field_not_found' END AS warning
FROM {R} r LEFT JOIN e ON r.form_id = e.form_id AND e.k = pdf_field_name AND pdf_field_name <> '' LEFT JOIN n a ON r.form_id = a.form_id AND a.k = {_kslug.format('pdf_field_name')} AND a.k <> '' LEFT JOIN n b ON r.form_id = b.form_id AND b.k = {_kslug.format('pdf_label')}""")
def join_coords(spark, sf):
    return J.join_coords(rows(spark, sf), spark_table(spark, sf, _WID), ["name", "page"]).select("form_id", "ord", "name", "page", "warning")


@family.query(f"""
WITH e AS (SELECT form_id, pdf_field_name AS k, max(ord) AS v FROM {R} GROUP BY ALL),
n AS (SELECT form_id, k, max(ord) AS v FROM (SELECT form_id, ord, unnest([{_kslug.format('pdf_field_name')}, {_kslug.format('pdf_label')}, {_kslug.format('field_label')}]) AS k FROM {R}) WHERE k <> '' GROUP BY ALL)
SELECT f.form_id, f.ord, coalesce(e.v, n.v) AS row_ord, CASE WHEN f.source_name = '' THEN 'no_source_name' WHEN coalesce(e.v, n.v) IS NULL THEN 'no_excel_match' END AS warning
FROM {FI} f LEFT JOIN e ON f.form_id = e.form_id AND e.k = f.source_name AND e.k <> '' LEFT JOIN n ON f.form_id = n.form_id AND n.k = {_kslug.format('f.source_name')}""")
def enrich_by_source(spark, sf):
    r = rows(spark, sf).withColumnRenamed("field_label", "label").drop("source_name")
    return J.enrich_by_source(fields(spark, sf), r, []).select("form_id", "ord", "row_ord", "warning")


@family.query(f"""SELECT form_id, ord, pdf_field_name FROM {R} WHERE pdf_field_name <> '' AND (form_id, {_kslug.format('pdf_field_name')}) NOT IN (SELECT (form_id, {_kslug.format('source_name')}) FROM {FI} WHERE source_name <> '')""")
def unused_rows(spark, sf):
    return J.unused_rows(rows(spark, sf), fields(spark, sf)).select("form_id", "ord", "pdf_field_name")


_base = "regexp_replace(regexp_replace({0}, '_(\\d+)$', ''), '(?i)_Row_(\\d+)$', '')"
_clean = "trim(replace(regexp_replace(regexp_replace(regexp_replace(label, '(?i)_Row_\\d+$', ''), '_\\d+$', ''), ':_?$', ''), '_', ' '))"
_leaf = nw("regexp_replace(list_last(string_split(trim(split_part(json_name, ',', 1)), '.')), '([A-Z])', ' \\1', 'g')")


def _index(name: str, key: str) -> str:
    return f"{name} AS (SELECT form_id, {key} AS k, min(ord) AS o FROM {R} WHERE {key} <> '' GROUP BY ALL)"


_CASCADE = f"""WITH {_index('pn', nw('pdf_field_name'))}, {_index('pl', nw('pdf_label'))}, {_index('fl', nw('field_label'))}, {_index('jl', _leaf)},
v AS (SELECT *, CASE WHEN s1 <> s0 THEN s1 END AS w1, CASE WHEN s2 <> s1 THEN s2 END AS w2, CASE WHEN s3 <> s2 THEN s3 END AS w3 FROM (SELECT *, regexp_replace(s2, '_\\d+$', '') AS s3 FROM (SELECT *, regexp_replace(s1, '_\\d+$', '') AS s2 FROM (SELECT *, source_name AS s0, regexp_replace(source_name, '_\\d+$', '') AS s1 FROM {FI})))),
t AS (SELECT form_id, ord, i, {nw('s')} AS full_, {nw(_base.format('s'))} AS base, {nw(_clean)} AS lab FROM (SELECT *, unnest([0, 1, 2, 3]) AS i, unnest([s0, w1, w2, w3]) AS s FROM v) WHERE s IS NOT NULL),
a AS (SELECT t.form_id, ord, i * 10 + step AS rank, conf, src, o FROM (SELECT *, unnest([1, 2, 3, 4, 5, 6, 7]) AS step, unnest([100, 95, 90, 85, 80, 75, 70]) AS conf,
  unnest(['pdf-field-name', 'pdf-field-name-base', 'pdf-label', 'form-label', 'snake-to-form', 'snake-to-pdf', 'json-leaf']) AS src, unnest(['pn', 'pn', 'pl', 'fl', 'fl', 'pl', 'jl']) AS idx, unnest([full_, base, lab, lab, base, base, base]) AS k FROM t) t
  JOIN (SELECT 'pn' AS idx, * FROM pn UNION ALL SELECT 'pl', * FROM pl UNION ALL SELECT 'fl', * FROM fl UNION ALL SELECT 'jl', * FROM jl) x ON t.form_id = x.form_id AND t.idx = x.idx AND t.k = x.k WHERE len(t.k) >= 2),
best AS (SELECT form_id, ord, arg_min(o, rank) AS row_ord, arg_min(conf, rank) AS confidence, arg_min(src, rank) AS source FROM a GROUP BY ALL)"""


@family.query(f"""{_CASCADE} SELECT f.form_id, f.ord, row_ord, confidence, source, nullif(regexp_extract(source_name, '_(\\d+)$', 1), '')::INT AS row_index FROM {FI} f LEFT JOIN best USING (form_id, ord)""")
def cascade_match(spark, sf):
    return J.cascade_match(fields(spark, sf), rows(spark, sf)).select("form_id", "ord", "row_ord", "confidence", "source", "row_index")


_REST = f"""{_CASCADE},
left1 AS (SELECT * FROM v WHERE (form_id, ord) NOT IN (SELECT (form_id, ord) FROM best)),
cat AS (SELECT form_id, {nw('x')} AS k, min(ord) AS o FROM (SELECT form_id, ord, unnest(string_split(regexp_replace(catalog_direct, '^[^:]*:', ''), '|')) AS x FROM {R} WHERE catalog_direct LIKE '%:%') GROUP BY ALL),
m2 AS (SELECT l.form_id, ord, o AS row_ord, 75 AS confidence, 'catalog-value-match' AS source FROM left1 l JOIN cat ON l.form_id = cat.form_id AND cat.k = {nw('source_name')} WHERE len(cat.k) >= 2),
left2 AS (SELECT * FROM left1 WHERE (form_id, ord) NOT IN (SELECT (form_id, ord) FROM m2)),
tx AS (SELECT form_id, ord, r, k FROM (SELECT form_id, ord, unnest([0, 1]) AS r, unnest([{nw(_clean)}, {nw("coalesce(w3, w2, w1, s0)")}]) AS k FROM left2) WHERE len(k) >= 3),
ix AS (SELECT 0 AS kind, * FROM pl UNION ALL SELECT 1, * FROM fl UNION ALL SELECT 2, * FROM jl),
fz AS (SELECT tx.form_id, ord, o, 1 - levenshtein(tx.k, ix.k) / greatest(len(tx.k), len(ix.k)) AS s, r, kind FROM tx JOIN ix ON tx.form_id = ix.form_id AND len(ix.k) >= 3),
m3 AS (SELECT form_id, ord, arg_min(o, (-s, r, kind, o)) AS row_ord, floor(max(s) * 65 + 0.5)::INT AS confidence, 'fuzzy' AS source FROM fz WHERE s > 0.72 GROUP BY ALL),
wd AS (SELECT tx.form_id, ord, arg_min(o, (1 - r, kind, o)) AS row_ord, 55 AS confidence, 'word-match' AS source FROM tx JOIN ix ON tx.form_id = ix.form_id AND kind < 2 AND len(ix.k) >= 3 AND list_has_all(string_split(ix.k, ' '), string_split(tx.k, ' '))
  WHERE (tx.form_id, ord) NOT IN (SELECT (form_id, ord) FROM m3) GROUP BY ALL)"""


@family.query(f"""{_REST} SELECT f.form_id, f.ord, row_ord, confidence, source FROM {FI} f LEFT JOIN (SELECT form_id, ord, row_ord, confidence, source FROM best UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3 UNION ALL SELECT * FROM wd) x USING (form_id, ord)""")
def match_fields(spark, sf):
    return J.match_fields(fields(spark, sf), rows(spark, sf)).select("form_id", "ord", "row_ord", "confidence", "source")


_loose = "translate(regexp_replace(lower({0}), '[\\s._\\-]+', '', 'g'), 'áéíóúñ', 'aeioun')"
_LNAME = "SELECT p_brand AS form_id, p_partkey AS ord, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(replace(p_name, ' ', '_')) WHEN 2 THEN concat(replace(p_name, 'l', ''), p_size % 3) ELSE concat(p_type, p_size) END AS name FROM @part"
_RNAME = "SELECT p_brand AS form_id, p_partkey AS ord, CASE WHEN p_size % 2 = 0 THEN p_name ELSE concat(split_part(p_name, ' ', 2), '.', split_part(p_name, ' ', 1)) END AS name FROM @part"


@family.query(f"""
WITH l AS (SELECT *, {_loose.format('name')} AS k FROM {duck(_LNAME)}), r AS (SELECT form_id, name, {_loose.format('name')} AS k, min(ord) AS o FROM {duck(_RNAME)} GROUP BY ALL), rk AS (SELECT form_id, k, min(o) AS o FROM r GROUP BY ALL),
z AS (SELECT d.form_id, d.k, rk.o, 1 - levenshtein(d.k, rk.k) / greatest(len(d.k), len(rk.k)) AS s FROM (SELECT DISTINCT form_id, k FROM l) d JOIN rk ON d.form_id = rk.form_id),
b AS (SELECT form_id, k, arg_min(o, (-s, o)) AS o, max(s) AS s FROM z WHERE s >= 0.7 GROUP BY ALL)
SELECT l.form_id, l.ord, coalesce(r.o, rk.o, b.o) AS row_ord, CASE WHEN r.o IS NOT NULL THEN 'exact' WHEN rk.o IS NOT NULL THEN 'normalized' WHEN b.o IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS match_type,
  round(CASE WHEN r.o IS NOT NULL THEN 1.0 WHEN rk.o IS NOT NULL THEN 0.95 ELSE coalesce(b.s, 0) END, 6) AS match_score
FROM l LEFT JOIN r ON l.form_id = r.form_id AND l.name = r.name LEFT JOIN rk ON l.form_id = rk.form_id AND l.k = rk.k LEFT JOIN b ON l.form_id = b.form_id AND l.k = b.k""")
def fuzzy_names(spark, sf):
    out = J.fuzzy_join(spark_table(spark, sf, _LNAME), spark_table(spark, sf, _RNAME), 0.7)
    return out.select("form_id", "ord", "row_ord", "match_type", F.round("match_score", 6).alias("match_score"))


@family.query("""
WITH d AS (SELECT DISTINCT n_name AS k FROM nation UNION SELECT DISTINCT r_name FROM region UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT c_name FROM customer)
SELECT a.k AS left_key, b.k AS right_key, round(1 - levenshtein(a.k, b.k) / greatest(len(a.k), len(b.k)), 6) AS score FROM (SELECT DISTINCT s_name AS k FROM supplier UNION SELECT DISTINCT p_name || 's' FROM part) a, d b
WHERE 1 - levenshtein(a.k, b.k) / greatest(len(a.k), len(b.k)) >= 0.65""")
def similar_names(spark, sf):
    def key(table, col):
        return read(spark, sf, table).select(F.col(col).alias("key"))
    left = key("supplier", "s_name").unionAll(read(spark, sf, "part").select(F.concat("p_name", F.lit("s"))))
    right = key("nation", "n_name").unionAll(key("region", "r_name")).unionAll(key("part", "p_name")).unionAll(key("customer", "c_name"))
    return fuzzy.similar_pairs(left, right, [], 0.65).withColumn("score", F.round("score", 6))


@family.query("""
WITH n AS (SELECT DISTINCT replace(upper(substr(p_name, 1, 1)) || substr(p_name, 2), ' ', CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'X' WHEN 2 THEN 'abc' ELSE ' ' END) AS name FROM part),
k AS (SELECT DISTINCT replace(p_name, ' ', CASE p_size % 2 WHEN 0 THEN '' ELSE 'é' END) AS key FROM part)
SELECT name, min(key) AS suggestion FROM n JOIN k ON (len(key) > 4 AND abs(len(key) - len(name)) <= 2 AND levenshtein(lower(key), lower(name)) <= 2) OR upper(strip_accents(key)) = upper(strip_accents(name))
WHERE name NOT IN (SELECT key FROM k) GROUP BY 1""")
def typo_keys(spark, sf):
    p = read(spark, sf, "part")
    k = F.col("p_size") % 4
    mark = F.when(k == 0, "").when(k == 1, "X").when(k == 2, "abc").otherwise(" ")
    name = F.replace(F.concat(F.upper(F.substring("p_name", 1, 1)), F.substr("p_name", F.lit(2))), F.lit(" "), mark)
    key = F.replace("p_name", F.lit(" "), F.when(F.col("p_size") % 2 == 0, "").otherwise("é"))
    return fuzzy.typo_keys(p.select(name.alias("name")), p.select(key.alias("key")))


W = duck(WIDGETS)


@family.query(f"""
WITH w AS (SELECT *, floor(x + 0.5)::INT AS fx, floor(y + 0.5)::INT AS fy FROM {W}), p AS (SELECT form_id, page, fx AS px, fy AS py, min(ord) AS o, arg_min(name, ord) AS s FROM w WHERE flag = 'R' GROUP BY ALL)
SELECT w.form_id, ord, name, sn AS source_name FROM w LEFT JOIN (SELECT w.form_id, ord, arg_min(s, o) AS sn FROM w JOIN p ON w.form_id = p.form_id AND w.page = p.page AND abs(px - fx) <= 8 AND abs(py - fy) <= 8 WHERE flag <> 'R' GROUP BY ALL) b USING (form_id, ord) WHERE flag <> 'R'""")
def near_points(spark, sf):
    w = stored(spark_table(spark, sf, WIDGETS).select("form_id", "ord", "name", "page", "x", "y", "flag"))
    known = w.where("flag = 'R'").select("form_id", "ord", "page", "x", "y", F.col("name").alias("source_name"))
    return J.near_point_join(w.where("flag <> 'R'"), known).select("form_id", "ord", "name", "source_name")


_NAMED = "SELECT p_brand AS form_id, p_partkey AS ord, CASE p_partkey % 4 WHEN 0 THEN concat(replace(p_name, ' ', '_'), '_', p_size % 4, '.1.2') WHEN 1 THEN concat('NombreRow', p_size) WHEN 2 THEN '_unnamed_3' ELSE concat('w', p_size) END AS name, CASE p_size % 5 WHEN 0 THEN concat(upper(p_name), ':') WHEN 1 THEN concat(p_name, 'z') WHEN 2 THEN '' WHEN 3 THEN concat(split_part(p_name, ' ', 2), ' de ', split_part(p_name, ' ', 1)) ELSE concat('Otro ', p_type) END AS label, p_size % 4 AS page, p_partkey % 97 * 5 AS x, p_size * 7 AS y FROM @part"


def named(spark, sf):
    return spark_table(spark, sf, _NAMED)


@family.query(f"""
WITH r AS (SELECT *, {nw('pdf_label')} AS a, {nw('field_label')} AS b, lower(pdf_field_name) IN ('', 'no aplica') AS ph FROM {R}),
bl AS (SELECT form_id, k, max(ord) AS o FROM (SELECT form_id, ord, unnest([a, b]) AS k FROM r) GROUP BY ALL), bn AS (SELECT form_id, {nw('pdf_field_name')} AS k, max(ord) AS o FROM r WHERE NOT ph GROUP BY ALL),
w AS (SELECT *, {nw('label')} AS lk, CASE WHEN starts_with(name, '_unnamed_') THEN '' ELSE {nw("regexp_replace(name, '\\.\\d+(\\.\\d+)*$', '')")} END AS nk, coalesce(nullif(regexp_extract(name, '(?i)Row\\s*(\\d+)', 1), ''), nullif(regexp_extract(name, '\\.(\\d+)\\.\\d+$', 1), '')) AS rn FROM {duck(_NAMED)}),
z AS (SELECT d.form_id, lk, o, 1 - levenshtein(lk, bl.k) / greatest(len(lk), len(bl.k)) AS s, bl.k FROM (SELECT DISTINCT form_id, lk FROM w WHERE lk <> '') d JOIN bl ON d.form_id = bl.form_id),
zb AS (SELECT form_id, lk, arg_min(o, (-s, o, k)) AS o FROM z WHERE s > 0.75 GROUP BY ALL),
j AS (SELECT w.*, l.o AS o1, CASE WHEN l.o IS NULL THEN zb.o END AS o2, coalesce(n.o, n2.o) AS o3 FROM w LEFT JOIN bl l ON w.form_id = l.form_id AND l.k = lk AND lk <> '' LEFT JOIN zb ON w.form_id = zb.form_id AND w.lk = zb.lk
  LEFT JOIN bn n ON w.form_id = n.form_id AND n.k = nk AND nk <> '' LEFT JOIN bl n2 ON w.form_id = n2.form_id AND n2.k = nk AND nk <> ''),
x AS (SELECT j.*, r.ph, r.pdf_field_name, r.json_name, CASE WHEN o1 IS NOT NULL THEN 1 WHEN o2 IS NOT NULL THEN 2 WHEN o3 IS NOT NULL THEN 3 END AS how FROM j LEFT JOIN r ON r.form_id = j.form_id AND r.ord = coalesce(o1, o2, o3))
SELECT form_id, ord, CASE WHEN how IS NOT NULL THEN CASE WHEN NOT ph THEN lower(pdf_field_name) ELSE regexp_replace(lower(regexp_replace(list_last(string_split(json_name, '.')), '([a-z])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9_]', '_', 'g') || CASE WHEN rn IS NOT NULL THEN '_' || rn ELSE '' END END
  WHEN lk <> '' AND replace(lk, ' ', '_') <> name THEN replace(lk, ' ', '_') ELSE name END AS new_name,
  CASE WHEN how = 1 THEN 'excel-exact' WHEN how = 2 THEN 'excel-fuzzy' WHEN how = 3 THEN 'excel-field-name' WHEN lk <> '' AND replace(lk, ' ', '_') <> name THEN 'derived' ELSE 'unchanged' END AS source,
  CASE how WHEN 1 THEN 95 WHEN 2 THEN 75 WHEN 3 THEN 90 ELSE CASE WHEN lk <> '' AND replace(lk, ' ', '_') <> name THEN 50 ELSE 0 END END AS confidence FROM x""")
def resolve_names(spark, sf):
    return J.resolve_name(named(spark, sf), rows(spark, sf)).select("form_id", "ord", "new_name", "source", "confidence")


# Positions that a reference knows, near some of the widgets.
_KNOWN_AT = f"SELECT form_id, ord, page, x + 3 AS x, y - 2 AS y, concat('pos_', ord % 30) AS source_name FROM ({_NAMED}) n WHERE ord % 3 = 0"
_BY_PLACE = family.sql["resolve_names"]
for _old, _new in (("\n  WHEN lk <> ''", "\n  WHEN pos IS NOT NULL THEN pos WHEN lk <> ''"), ("'excel-field-name' WHEN lk", "'excel-field-name' WHEN pos IS NOT NULL THEN 'reference-json' WHEN lk"),
                   ("ELSE CASE WHEN lk", "ELSE CASE WHEN pos IS NOT NULL THEN 85 WHEN lk"), ("AS confidence FROM x", "AS confidence FROM x LEFT JOIN pp USING (form_id, ord)"),
                   ("\nSELECT form_id, ord, CASE WHEN how", f""",
pp AS (SELECT n.form_id, n.ord, arg_min(k.source_name, k.ord) AS pos FROM {duck(_NAMED)} n JOIN {duck(_KNOWN_AT)} k ON n.form_id = k.form_id AND n.page = k.page
  AND abs(floor(n.x + 0.5) - floor(k.x + 0.5)) <= 8 AND abs(floor(n.y + 0.5) - floor(k.y + 0.5)) <= 8 GROUP BY ALL)
SELECT form_id, ord, CASE WHEN how""")):
    assert _old in _BY_PLACE
    _BY_PLACE = _BY_PLACE.replace(_old, _new)


@family.query(_BY_PLACE)
def resolve_names_by_position(spark, sf):
    """with what a reference knows about positions"""
    found = J.resolve_name(named(spark, sf), rows(spark, sf), spark_table(spark, sf, _KNOWN_AT))
    return found.select("form_id", "ord", "new_name", "source", "confidence")


_PAIRS = "SELECT form_id, ord, acro_actual AS actual, acro_proposed AS proposed FROM (" + ROWS + ") r"
_WNAMES = "SELECT p_brand AS form_id, p_partkey AS ord, concat('W', p_partkey % 53) AS name FROM @part"


@family.query(f"""
WITH p AS (SELECT form_id, actual, max_by(proposed, ord) AS proposed FROM {duck(_PAIRS)} GROUP BY ALL), w AS (SELECT * FROM {duck(_WNAMES)})
SELECT w.form_id, name, coalesce(proposed, name) AS new_name, CASE WHEN proposed IS NULL THEN 'unchanged' ELSE 'excel-exact' END AS source, CASE WHEN proposed IS NULL THEN 0 ELSE 100 END AS confidence FROM w LEFT JOIN p ON w.form_id = p.form_id AND actual = name
UNION ALL SELECT form_id, actual, proposed, 'mapping_not_found', 0 FROM p WHERE (form_id, actual) NOT IN (SELECT (form_id, name) FROM w)""")
def mapping_renames(spark, sf):
    done, lost = J.mapping_join(spark_table(spark, sf, _WNAMES), spark_table(spark, sf, _PAIRS))
    cols = ["form_id", "name", "new_name", "source", "confidence"]
    return done.select(*cols).unionByName(lost.select("form_id", F.col("actual").alias("name"), F.col("proposed").alias("new_name"),
                                                      F.lit("mapping_not_found").alias("source"), F.lit(0).alias("confidence")))


@family.query(f"""SELECT r.form_id, r.ord, r.new_name FROM (SELECT form_id, ord, 'W' || (ord % 90) AS new_name FROM {R}) r WHERE (form_id, new_name) NOT IN (SELECT (form_id, name) FROM {duck(_WNAMES)})""")
def renames_not_found(spark, sf):
    r = rows(spark, sf).select("form_id", "ord", F.concat(F.lit("W"), F.col("ord") % 90).alias("new_name"))
    return J.verify_renames(r, spark_table(spark, sf, _WNAMES)).select("form_id", "ord", "new_name")


_WLOOSE = "SELECT p_brand AS form_id, p_partkey AS ord, CASE WHEN p_size % 3 = 0 THEN concat('w-', p_partkey % 53) ELSE concat('W', p_partkey % 53) END AS name FROM @part"


@family.query(f"""
WITH w AS (SELECT *, regexp_replace(lower(name), '[\\s._\\-]+', '', 'g') AS k FROM {duck(_WLOOSE)}), e AS (SELECT DISTINCT form_id, name FROM w), n AS (SELECT form_id, k, min_by(name, ord) AS v FROM w GROUP BY ALL),
m AS (SELECT r.form_id, r.ord, coalesce(e.name, n.v) AS widget FROM {R} r LEFT JOIN e ON r.form_id = e.form_id AND e.name = acro_actual LEFT JOIN n ON r.form_id = n.form_id AND n.k = lower(acro_actual))
SELECT form_id, ord, widget, 'row' AS what FROM m UNION ALL SELECT form_id, ord, name, 'orphan' FROM w WHERE (form_id, name) NOT IN (SELECT (form_id, widget) FROM m WHERE widget IS NOT NULL)""")
def cross_reference(spark, sf):
    out, lost = J.cross_reference(rows(spark, sf), spark_table(spark, sf, _WLOOSE))
    return out.select("form_id", "ord", "widget", F.lit("row").alias("what")).unionByName(
        lost.select("form_id", "ord", F.col("name").alias("widget"), F.lit("orphan").alias("what")))


_CF = "SELECT p_brand AS form_id, p_partkey AS ord, concat('field_W', p_partkey % 57) AS id, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN concat('P', p_partkey % 44) ELSE concat('S', p_partkey % 55) END AS source_name FROM @part"


@family.query(f"""
WITH s AS (SELECT form_id, source_name AS k, max(ord) AS o FROM {R} WHERE source_name <> '' GROUP BY ALL), a AS (SELECT form_id, acro_actual AS k, max(ord) AS o FROM {R} GROUP BY ALL), p AS (SELECT form_id, acro_proposed AS k, min(ord) AS o FROM {R} GROUP BY ALL),
f AS (SELECT *, CASE WHEN source_name <> '' THEN source_name ELSE replace(id, 'field_', '') END AS k FROM {duck(_CF)}),
m AS (SELECT f.form_id, f.ord, coalesce(s.o, a.o, p.o) AS row_ord FROM f LEFT JOIN s ON f.form_id = s.form_id AND f.k = s.k LEFT JOIN a ON f.form_id = a.form_id AND f.k = a.k LEFT JOIN p ON f.form_id = p.form_id AND f.k = p.k),
u AS (SELECT DISTINCT r.form_id, unnest([r.source_name, acro_actual, acro_proposed]) AS n FROM {R} r WHERE (form_id, ord) IN (SELECT (form_id, row_ord) FROM m WHERE row_ord IS NOT NULL))
SELECT form_id, ord, row_ord, 'field' AS what FROM m UNION ALL SELECT form_id, ord, NULL, 'row' FROM {R} r WHERE (form_id, source_name) NOT IN (SELECT (form_id, n) FROM u) AND (form_id, acro_actual) NOT IN (SELECT (form_id, n) FROM u)""")
def combine_fields(spark, sf):
    matched, unused = J.combine(spark_table(spark, sf, _CF), rows(spark, sf))
    return matched.select("form_id", "ord", "row_ord", F.lit("field").alias("what")).unionByName(
        unused.select("form_id", "ord", F.lit(None).cast("long").alias("row_ord"), F.lit("row").alias("what")))


_OV = f"""SELECT form_id, ord, concat('field_', ord) AS id, CASE WHEN ord % 3 = 0 THEN '' ELSE p_name END AS m_label, concat('old ', p_size) AS label, lower(data_type) AS m_data_type, CASE ord % 4 WHEN 0 THEN 'Btn' ELSE 'zz' END AS m_native, CASE WHEN ord % 5 = 0 THEN 'g' ELSE '' END AS m_group,
  CASE WHEN ord % 7 = 0 THEN '[1]' ELSE '' END AS m_options, CASE ord % 3 WHEN 0 THEN true WHEN 1 THEN false END AS m_required, CASE ord % 4 WHEN 0 THEN true WHEN 1 THEN false END AS m_prefilled,
  CASE WHEN ord % 6 = 0 THEN '' ELSE concat('datosGenerales.personas.Consentimiento', p_size) END AS m_path, CASE WHEN ord % 2 = 0 THEN concat('a', p_size, ' | b,c|') ELSE concat('a, b', p_size) END AS m_secondary, p_size % 3 AS m_max_length, '' AS m_pattern,
  CASE ord % 4 WHEN 0 THEN 'Monto' WHEN 1 THEN 'Entero' WHEN 2 THEN '10%' ELSE 'x' END AS m_format, ord % 2 = 0 AS hidden, ord % 5 = 0 AS read_only, CASE WHEN ord % 12 = 0 THEN '' ELSE 'viejo' END AS output, CASE WHEN ord % 8 = 0 THEN '' ELSE 's' END AS source_name FROM ({MATRIX}) m"""


@family.query(f"""SELECT form_id, ord, id, source_name, CASE WHEN m_label = '' THEN label ELSE m_label END AS label, t AS type, coalesce(m_required, false) AS required, hidden, source_name = '' AND read_only AS read_only, CASE WHEN m_prefilled THEN 'required' WHEN NOT m_prefilled THEN 'none' END AS prefill_mode,
  CASE WHEN m_path <> '' THEN 'datosFormulario.personas.consentimiento' || p ELSE output END AS output, CASE WHEN m_path <> '' THEN 'datosFormulario.personas.consentimiento' || p END AS prefill_key, CASE WHEN m_path <> '' THEN false WHEN output = '' THEN true END AS exclude,
  CASE WHEN ord % 2 = 0 THEN 'a' || p || ' | b,c' ELSE 'a | b' || p END AS mapped_paths, CASE WHEN m_max_length > 0 THEN m_max_length END AS max_length, NULL AS pattern, CASE ord % 4 WHEN 0 THEN '#.##0,00' WHEN 1 THEN '#.##0' WHEN 2 THEN '00.00' END AS number_format,
  CASE WHEN t = 'date' OR (t = 'select' AND m_options <> '') THEN 'half' ELSE 'full' END AS width
FROM (SELECT *, regexp_extract(label, '\\d+') AS p, CASE m_data_type WHEN 'texto' THEN 'text' WHEN 'numérico' THEN 'number' WHEN 'radio/combo' THEN 'radio' WHEN 'fecha' THEN 'date' WHEN 'checkbox' THEN 'checkbox' WHEN 'alfanumérico' THEN 'text' END AS t FROM {duck(_OV)})""")
def overlay_fields(spark, sf):
    return J.overlay_fields(spark_table(spark, sf, _OV))


_GROUPS = "SELECT c_mktsegment AS form_id, c_custkey AS ord, concat('g', c_custkey) AS key, concat('root', c_custkey % 40) AS root FROM @customer"
_MEMBERS = "SELECT c_mktsegment AS form_id, concat('g', o_custkey) AS key, o_orderkey AS ord, concat('s', o_orderkey % 4000) AS source_name FROM @orders JOIN @customer ON o_custkey = c_custkey"
_FICHA = "SELECT c_mktsegment AS form_id, c_custkey AS ord, c_custkey AS row_num, CASE WHEN c_custkey % 4 = 0 THEN concat('root', c_custkey % 90) ELSE concat('s', c_custkey) END AS source_name, concat('Root', c_nationkey) AS acro_actual, concat('S ', c_custkey * 2) AS label FROM @customer"


@family.query(f"""
WITH f AS (SELECT form_id, source_name, min_by(row_num, ord) AS row_num FROM {duck(_FICHA)} GROUP BY ALL), t AS (SELECT form_id, key, -1 AS rank, root AS s FROM {duck(_GROUPS)} UNION ALL SELECT form_id, key, ord, source_name FROM {duck(_MEMBERS)})
SELECT g.form_id, g.key, row_num FROM {duck(_GROUPS)} g LEFT JOIN (SELECT t.form_id, key, min_by(row_num, rank) AS row_num FROM t JOIN f ON t.form_id = f.form_id AND s = source_name GROUP BY ALL) b USING (form_id, key)""")
def merge_business(spark, sf):
    return J.merge_business(spark_table(spark, sf, _GROUPS), spark_table(spark, sf, _MEMBERS), spark_table(spark, sf, _FICHA), ["row_num"]).select("form_id", "key", "row_num")


@family.query(f"""
WITH e AS (SELECT form_id, n, min_by(row_num, ord) AS r FROM (SELECT form_id, ord, row_num, {nw('x')} AS n FROM (SELECT *, unnest([source_name, acro_actual, label]) AS x FROM {duck(_FICHA)})) GROUP BY ALL),
t AS (SELECT form_id, key, -1 AS rank, {nw('root')} AS n FROM {duck(_GROUPS)} UNION ALL SELECT form_id, key, ord, {nw('source_name')} FROM {duck(_MEMBERS)}), x AS (SELECT t.form_id, key, min_by(r, rank) AS r FROM t JOIN e USING (form_id, n) GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY form_id ORDER BY ord) AS i FROM {duck(_GROUPS)}), p AS (SELECT form_id, row_num, row_number() OVER (PARTITION BY form_id ORDER BY ord) AS i, count(*) OVER (PARTITION BY form_id) AS n FROM {duck(_FICHA)}),
l AS (SELECT form_id, max(n) AS n FROM p GROUP BY 1)
SELECT g.form_id, g.key, coalesce(x.r, p.row_num) AS row_num, CASE WHEN x.r IS NOT NULL THEN 'exact' ELSE 'position' END AS kind FROM g LEFT JOIN x USING (form_id, key) LEFT JOIN l ON l.form_id = g.form_id LEFT JOIN p ON p.form_id = g.form_id AND p.i = least(g.i, l.n)""")
def align_groups(spark, sf):
    return J.align_groups(spark_table(spark, sf, _GROUPS), spark_table(spark, sf, _MEMBERS), spark_table(spark, sf, _FICHA)).select(
        "form_id", "key", "row_num", "kind")


_MATCH = f"SELECT form_id, ord, CASE WHEN ord % 5 = 0 THEN NULL ELSE concat('W', ord % 61) END AS widget, CASE WHEN ord % 5 = 0 THEN NULL ELSE p_size + 55 END AS confidence FROM ({MATRIX}) m"


@family.query(f"""
WITH m AS (SELECT *, coalesce(widget IS NOT NULL AND confidence >= 75, false) AS good FROM {duck(_MATCH)})
SELECT form_id, ord, 'row' AS what, NULL AS name FROM m WHERE NOT good UNION ALL SELECT form_id, ord, 'widget', name FROM {duck(_WNAMES)} WHERE (form_id, name) NOT IN (SELECT (form_id, widget) FROM m WHERE good)""")
def orphans(spark, sf):
    lost_rows, lost_widgets = J.orphans(spark_table(spark, sf, _MATCH), spark_table(spark, sf, _WNAMES))
    return lost_rows.select("form_id", "ord", F.lit("row").alias("what"), F.lit(None).cast("string").alias("name")).unionByName(
        lost_widgets.select("form_id", "ord", F.lit("widget").alias("what"), "name"))


@family.query(f"""SELECT form_id, count(*) AS rows, count(*) FILTER (confidence >= 85) AS high, count(*) FILTER (confidence >= 70 AND confidence < 85) AS medium, count(*) FILTER (confidence < 70) AS low, count(*) FILTER (confidence IS NULL) AS "none" FROM {duck(_MATCH)} GROUP BY 1""")
def match_statistics(spark, sf):
    return J.match_stats(spark_table(spark, sf, _MATCH))


_ENTRY = "SELECT o_orderpriority AS form_id, o_orderkey AS ord, concat('n', o_custkey) AS old_name, concat('m', o_custkey % 3) AS new_name, CAST(o_custkey % 10 AS DOUBLE) AS x, CAST(1 AS DOUBLE) AS y, CAST(2 AS DOUBLE) AS width, CAST(3 AS DOUBLE) AS height FROM @orders"
_LINES = "SELECT o_orderpriority AS form_id, o_orderkey AS line_no, CASE o_orderkey % 5 WHEN 0 THEN concat('n', o_custkey, chr(9), 'm1', chr(9), '5', chr(9), '1.0', chr(9), '2', chr(9), '3') WHEN 1 THEN concat(' n', o_custkey, '   m', o_orderkey % 3) WHEN 2 THEN '  ' WHEN 3 THEN concat('n', o_custkey, chr(9), 'm2', chr(9), 'x', chr(9), '1', chr(9), '2', chr(9), '3') ELSE concat('zz', o_custkey) END AS line FROM @orders"


@family.query(f"""
WITH l AS (SELECT form_id, line_no, line_no % 5 AS k, line FROM {duck(_LINES)} WHERE line_no % 5 <> 2), e AS (SELECT form_id, line_no, k, CASE WHEN k = 1 THEN regexp_extract(line, 'n\\d+') WHEN k = 4 THEN line ELSE split_part(line, chr(9), 1) END AS old_name,
  CASE k WHEN 0 THEN 'm1' WHEN 1 THEN regexp_extract(line, 'm\\d+') WHEN 3 THEN 'm2' ELSE '' END AS nn FROM l), b AS (SELECT form_id, old_name, max_by(nn, line_no) AS nn, max_by(k, line_no) AS k FROM e GROUP BY ALL)
SELECT n.form_id, n.ord, n.old_name, coalesce(nn, new_name) AS new_name, CASE WHEN k = 0 THEN 5.0 ELSE x END AS x, CASE WHEN nn IS NOT NULL AND nn <> new_name THEN 1 ELSE 0 END + CASE WHEN k = 0 AND x <> 5 THEN 1 ELSE 0 END AS changes FROM {duck(_ENTRY)} n LEFT JOIN b USING (form_id, old_name)""")
def bulk_edits(spark, sf):
    return J.bulk_edit(spark_table(spark, sf, _ENTRY), spark_table(spark, sf, _LINES)).select("form_id", "ord", "old_name", "new_name", "x", "changes")


@family.query("""
WITH r AS (SELECT o_orderpriority AS form_id, o_orderkey AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS i FROM orders WHERE o_orderstatus = 'F'),
w AS (SELECT o_orderpriority AS form_id, o_orderkey AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS i FROM orders WHERE o_orderstatus <> 'F')
SELECT form_id, i, r.v AS row_key, w.v AS widget_key, r.v IS NOT NULL AND w.v IS NOT NULL AS matched FROM r FULL JOIN w USING (form_id, i)""")
def positional_pairs(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("form_id"), F.col("o_orderkey").alias("ord"), "o_orderstatus")
    left = o.where("o_orderstatus = 'F'").withColumn("row_key", F.col("ord"))
    right = o.where("o_orderstatus <> 'F'").withColumn("widget_key", F.col("ord"))
    return J.positional_join(left, right, ["row_key"], ["widget_key"])


@family.query(f"""
WITH k AS (SELECT DISTINCT form_id, source_name AS n FROM {duck(_CF)} WHERE source_name <> '')
SELECT form_id, ord, CASE WHEN s THEN source_name WHEN p THEN acro_proposed WHEN a THEN acro_actual WHEN source_name <> '' THEN source_name ELSE acro_proposed END AS item, s OR p OR a AS known
FROM (SELECT *, (form_id, source_name) IN (SELECT (form_id, n) FROM k) AS s, (form_id, acro_proposed) IN (SELECT (form_id, n) FROM k) AS p, (form_id, acro_actual) IN (SELECT (form_id, n) FROM k) AS a FROM {R})""")
def known_names(spark, sf):
    return J.pick_known_name(rows(spark, sf), spark_table(spark, sf, _CF)).select("form_id", "ord", "item", "known")
