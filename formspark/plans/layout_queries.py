"""Reading order, lines, labels, sections, dates and names from positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from formspark.operators import layout as L
from formspark.plans.registry import Family
from formspark.plans.tables import WIDGETS, duck, read, spark_table, stored

family = Family()
W = duck(WIDGETS)


def widgets(spark, sf):
    return stored(spark_table(spark, sf, WIDGETS))


@family.query(f"""
WITH l AS (SELECT *, page IS DISTINCT FROM lag(page) OVER o OR lag(y) OVER o - y > 5 AS s FROM {W} WINDOW o AS (PARTITION BY form_id ORDER BY page, y DESC, x, ord)),
r AS (SELECT *, sum(s::INT) OVER (PARTITION BY form_id ORDER BY page, y DESC, x, ord) AS visual_row FROM l)
SELECT form_id, ord, visual_row::BIGINT AS visual_row, row_number() OVER (PARTITION BY form_id ORDER BY visual_row, x, ord) AS visual_ord FROM r""")
def visual_order(spark, sf):
    return L.visual_order(widgets(spark, sf)).select("form_id", "ord", "visual_row", "visual_ord")


# Text pieces: the words of every document laid out on lines and pages.
TEXTS = """SELECT concat('F', l_suppkey) AS form_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS INT) AS ord, l_linenumber AS page, CAST(l_orderkey % 60 * 10 AS DOUBLE) AS x, CAST(l_partkey % 80 * 8 + CAST(l_quantity AS INT) % 3 * 2.5 AS DOUBLE) AS y,
  CASE l_partkey % 3 WHEN 0 THEN 8.0 WHEN 1 THEN 11.0 ELSE 20.0 END AS width, 6.0 + l_orderkey % 4 AS height,
  CASE l_orderkey % 23 WHEN 0 THEN 'DATOS DE LA POLIZA' WHEN 1 THEN concat('Beneficiario ', l_partkey % 5) WHEN 2 THEN 'Sexo:' WHEN 3 THEN 'Fecha de Nacimiento' WHEN 4 THEN 'VIGENCIA DEL SEGURO' WHEN 5 THEN 'desde:' WHEN 6 THEN 'Hasta' WHEN 7 THEN concat('Marque ', l_partkey % 9, ':')
    WHEN 8 THEN 'Día' WHEN 9 THEN 'En calidad de' WHEN 10 THEN 'LUGAR Y FECHA DE SOLICITUD' WHEN 11 THEN 'x' ELSE concat('Texto ', l_partkey) END AS str FROM @lineitem"""
T = duck(TEXTS)


def texts(spark, sf):
    return stored(spark_table(spark, sf, TEXTS))


# a line's top, then the highest piece out of its reach, and so on down the page
MERGED = f"""
WITH RECURSIVE h AS (SELECT DISTINCT form_id, page, y FROM {T}),
top AS (SELECT form_id, page, max(y) AS line FROM h GROUP BY ALL UNION ALL SELECT h.form_id, h.page, max(h.y) FROM top JOIN h ON h.form_id = top.form_id AND h.page = top.page AND h.y < top.line - 3 GROUP BY h.form_id, h.page),
r AS (SELECT t.*, k.line FROM {T} t ASOF JOIN top k ON t.form_id = k.form_id AND t.page = k.page AND t.y <= k.line),
g AS (SELECT *, x - lag(x + width) OVER p AS gap FROM r WINDOW p AS (PARTITION BY form_id, page, line ORDER BY x, ord)), q AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 12 OR gap < -2 THEN 1 ELSE 0 END) OVER (PARTITION BY form_id, page, line ORDER BY x, ord) AS piece FROM g)
SELECT form_id, page, string_agg(str, ' ' ORDER BY x, ord) AS str, arg_min(y, (x, ord)) AS y, min(x) AS x, arg_max(x + width, (x, ord)) - min(x) AS width, max(height) AS height, count(*) AS pieces, arg_min(ord, (x, ord)) AS ord FROM q GROUP BY form_id, page, line, piece"""


@family.query(MERGED)
def merge_adjacent(spark, sf):
    return L.merge_adjacent(texts(spark, sf))


# Widgets on the same pages as the texts.
FIELDS = """SELECT concat('F', l_suppkey) AS form_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS INT) AS ord, l_linenumber AS page, CAST(l_orderkey % 50 * 12 AS DOUBLE) AS x, CAST(l_partkey % 90 * 7 AS DOUBLE) AS y, 20.0 + l_linenumber AS width, 8.0 + l_partkey % 5 AS height,
  CASE l_orderkey % 3 WHEN 0 THEN 'checkbox' ELSE 'text' END AS type, CASE l_orderkey % 5 WHEN 0 THEN 'Día' WHEN 1 THEN 'mes:' WHEN 2 THEN 'AÑO' ELSE concat('Dato ', l_partkey % 30) END AS label, concat('w', l_partkey, CASE WHEN l_partkey % 6 = 0 THEN concat('Row', l_linenumber) ELSE '' END) AS name
  FROM @lineitem"""
FD = duck(FIELDS)


def page_fields(spark, sf):
    return stored(spark_table(spark, sf, FIELDS))


@family.query(f"""
WITH t AS (SELECT * FROM ({MERGED}) WHERE NOT (len(trim(str)) >= 10 AND len(regexp_replace(trim(str), '[^A-Za-z\\s]', '', 'g')) >= 10 AND regexp_replace(trim(str), '[^A-Za-z\\s]', '', 'g') = upper(regexp_replace(trim(str), '[^A-Za-z\\s]', '', 'g')))),
f AS (SELECT * FROM {FD}),
c AS (SELECT f.form_id, f.page, f.ord AS fo, t.ord AS t_o, t.str, f.x AS fx, f.y AS fy, f.width AS fw, f.height AS fh, t.x AS tx, t.y AS ty, t.width AS tw,
  CASE WHEN f.x - t.x - t.width > 0 AND f.x - t.x - t.width < 200 AND abs(t.y - f.y) < 4 + f.height * 0.5 THEN 'left' WHEN t.y - f.y - f.height > -2 AND t.y - f.y - f.height < 80 AND (abs(t.x - f.x) < 30 OR least(t.x + t.width, f.x + f.width) - greatest(t.x, f.x) > 0) THEN 'above' END AS side
  FROM f JOIN t ON f.form_id = t.form_id AND f.page = t.page WHERE side IS NOT NULL),
d AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.form_id = c.form_id AND o.page = c.page AND o.ord <> c.fo AND CASE WHEN c.side = 'left' THEN abs(o.y - c.fy) <= c.fh + 4 AND o.x >= c.tx + c.tw AND o.x + o.width <= c.fx ELSE o.y > c.fy + c.fh AND o.y + o.height < c.ty AND abs(o.x - c.fx) < 30 END)),
s AS (SELECT *, 100::DOUBLE - CASE side WHEN 'left' THEN (fx - tx - tw) * 0.4::DOUBLE ELSE greatest(0, ty - fy - fh) * 0.6::DOUBLE END + CASE side WHEN 'left' THEN 10 ELSE 0 END + CASE WHEN ends_with(trim(str), ':') THEN 15 ELSE 0 END - CASE WHEN len(trim(str)) <= 2 THEN 20 ELSE 0 END + CASE WHEN len(trim(str)) BETWEEN 3 AND 40 THEN 5 ELSE 0 END AS score FROM d)
SELECT f.form_id, f.ord, b.label FROM f LEFT JOIN (SELECT form_id, fo AS ord, regexp_replace(arg_min(trim(str), (-score, t_o)), ':$', '') AS label FROM s GROUP BY ALL) b USING (form_id, ord)""")
def detect_labels(spark, sf):
    return L.detect_labels(page_fields(spark, sf).drop("label"), stored(L.merge_adjacent(texts(spark, sf)))).select("form_id", "ord", "label")


_N = "strip_accents(lower(trim(str)))"
_HEAD = f"""(SELECT form_id, ord, page, x, y, str, CASE WHEN {_N} LIKE '%lugar y fecha de solicitud%' THEN 'solicitud_' WHEN {_N} LIKE '%poliza%' THEN 'poliza_' WHEN {_N} LIKE '%beneficiario%' THEN 'beneficiario_' WHEN {_N} LIKE '%vigencia%' THEN 'vigencia_' END AS prefix,
  CASE WHEN {_N} LIKE '%beneficiario%' THEN nullif(regexp_extract(str, '(\\d+)', 1), '')::INT END AS number FROM {T} WHERE regexp_matches({_N}, 'lugar y fecha de solicitud|poliza|beneficiario|vigencia'))"""
_BOX = f"(SELECT * FROM {FD} WHERE type = 'checkbox')"
_SUB = f"""(SELECT form_id, ord, page, x, y, str, CASE str WHEN 'Sexo:' THEN 'sexo_' ELSE 'calidad_' END AS prefix, CASE str WHEN 'Sexo:' THEN 'sexo' ELSE 'calidad' END AS group_name, 'whitelist' AS source FROM {T} WHERE str IN ('Sexo:', 'En calidad de')
  UNION ALL SELECT t.form_id, t.ord, t.page, t.x, t.y, str, '', replace(replace(lower(str), ':', ''), ' ', '_'), 'fallback' FROM {T} t JOIN (SELECT t.form_id, t.ord, max(n) AS n FROM {T} t JOIN (SELECT a.form_id, a.page, a.ord, a.y + a.height AS top, count(*) AS n FROM {_BOX} a JOIN {_BOX} b ON a.form_id = b.form_id AND a.page = b.page AND abs(a.y - b.y) <= 6 GROUP BY ALL) x
    ON t.form_id = x.form_id AND t.page = x.page AND top <= t.y - 4 AND t.y - top <= 30 GROUP BY ALL) z ON t.form_id = z.form_id AND t.ord = z.ord WHERE n BETWEEN 2 AND 8 AND ends_with(str, ':') AND str <> 'Sexo:' AND str <> 'desde:'
  UNION ALL SELECT t.form_id, t.ord, t.page, t.x, t.y, str, '', 'desde', 'fallback' FROM {T} t JOIN (SELECT t.form_id, t.ord, max(n) AS n FROM {T} t JOIN (SELECT a.form_id, a.page, a.ord, a.y + a.height AS top, count(*) AS n FROM {_BOX} a JOIN {_BOX} b ON a.form_id = b.form_id AND a.page = b.page AND abs(a.y - b.y) <= 6 GROUP BY ALL) x
    ON t.form_id = x.form_id AND t.page = x.page AND top <= t.y - 4 AND t.y - top <= 30 GROUP BY ALL) z ON t.form_id = z.form_id AND t.ord = z.ord WHERE n BETWEEN 2 AND 8 AND str = 'desde:')"""


@family.query(f"SELECT form_id, ord, prefix, number, NULL AS group_name, 'heading' AS source FROM {_HEAD} UNION ALL SELECT form_id, ord, prefix, NULL, group_name, source FROM {_SUB}")
def detect_sections(spark, sf):
    h, s = L.detect_sections(texts(spark, sf), page_fields(spark, sf))
    none = F.lit(None)
    return h.select("form_id", "ord", "prefix", "number", none.cast("string").alias("group_name"), F.lit("heading").alias("source")).unionByName(
        s.select("form_id", "ord", "prefix", none.cast("int").alias("number"), "group_name", "source"))


def _nearest(name: str, marks: str, points: str = FD) -> str:
    return f"""{name} AS (SELECT f.form_id, f.ord, arg_min(struct_pack(str := m.str, prefix := m.prefix, g := m.g, src := m.src, y := m.y, num := m.num), (m.y, m.ord)) AS v FROM {points} f JOIN {marks} m ON f.form_id = m.form_id AND f.page = m.page AND m.y > f.y + f.height GROUP BY ALL)"""


_HM = f"(SELECT *, NULL AS g, NULL AS src, number AS num FROM {_HEAD})"
_SM = f"(SELECT *, group_name AS g, source AS src, NULL AS num FROM {_SUB})"
_ASSIGN = f"""WITH {_nearest('h', _HM)}, {_nearest('s', _SM)},
a AS (SELECT f.*, h.v AS h, CASE WHEN s.v IS NOT NULL AND (h.v IS NULL OR s.v.y <= h.v.y) AND s.v.y - f.y - f.height <= CASE WHEN s.v.src = 'whitelist' THEN 25 ELSE 60 END THEN s.v END AS s FROM {FD} f LEFT JOIN h USING (form_id, ord) LEFT JOIN s USING (form_id, ord))"""


@family.query(f"{_ASSIGN} SELECT form_id, ord, h.str AS heading, coalesce(h.prefix, '') AS section_prefix, h.num AS block_no, s.str AS subheading, coalesce(s.prefix, '') AS sub_prefix, s.g AS group_name, CASE WHEN h IS NULL THEN 'no_section_match' END AS warning FROM a")
def assign_section(spark, sf):
    w = page_fields(spark, sf)
    h, s = L.detect_sections(texts(spark, sf), w)
    return L.assign_section(w, h, s).select("form_id", "ord", "heading", "section_prefix", "block_no", "subheading", "sub_prefix", "group_name", "warning")


_DATES = f"""WITH p AS (SELECT *, replace(strip_accents(lower(label)), ':', '') AS part FROM {FD} WHERE type = 'text' AND label IN ('Día', 'mes:', 'AÑO')),
l AS (SELECT *, sum(s) OVER (PARTITION BY form_id, page ORDER BY y DESC, x, ord) AS line FROM (SELECT *, CASE WHEN lag(y) OVER o - y <= 5 THEN 0 ELSE 1 END AS s FROM p WINDOW o AS (PARTITION BY form_id, page ORDER BY y DESC, x, ord))),
r AS (SELECT * EXCLUDE (s2), sum(s2) OVER (PARTITION BY form_id, page ORDER BY line, x, ord) AS run FROM (SELECT *, CASE WHEN x - lag(x + width) OVER o <= 80 THEN 0 ELSE 1 END AS s2 FROM l WINDOW o AS (PARTITION BY form_id, page, line ORDER BY x, ord))),
hd AS (SELECT form_id, page, run, arg_min(struct_pack(o := ord, y := y, h := height), (x, ord)) AS f FROM r GROUP BY ALL HAVING count(*) > 1),
hp AS (SELECT form_id, page, run, f.o AS ord, f.y AS y, f.h AS height FROM hd),
{_nearest('h', _HM, 'hp')}, {_nearest('t', f"(SELECT *, NULL AS prefix, NULL AS g, NULL AS src, NULL AS num FROM {T} WHERE str <> 'Día')", 'hp')},
c AS (SELECT hp.*, h.v.str AS hs, strip_accents(lower(h.v.str)) AS hn, CASE WHEN t.v.y < h.v.y THEN t.v.str END AS m FROM hp LEFT JOIN h USING (form_id, ord) LEFT JOIN t USING (form_id, ord)),
d AS (SELECT *, CASE WHEN hs IS NULL OR hn LIKE '%fecha de solicitud%' OR m IS NULL THEN 'fecha_' WHEN lower(m) LIKE '%nacimiento%' THEN 'fecha_nacimiento_' WHEN lower(m) LIKE '%desde%' THEN 'fecha_desde_' WHEN lower(m) LIKE '%hasta%' THEN 'fecha_hasta_' ELSE 'fecha_' || replace(replace(lower(m), ':', ''), ' ', '_') || '_' END AS date_prefix FROM c)"""


DATE_GROUPS = f"""{_DATES} SELECT r.form_id, r.ord, part, date_prefix, CASE date_prefix WHEN 'fecha_nacimiento_' THEN 'fecha_nacimiento' WHEN 'fecha_desde_' THEN 'vigencia_desde' WHEN 'fecha_hasta_' THEN 'vigencia_hasta' ELSE CASE WHEN hn LIKE '%solicitud%' THEN 'fecha_solicitud' ELSE 'fecha' END END AS date_group, hs AS date_heading
FROM r JOIN d ON r.form_id = d.form_id AND r.page = d.page AND r.run = d.run"""


@family.query(DATE_GROUPS)
def date_groups(spark, sf):
    w, t = page_fields(spark, sf), texts(spark, sf)
    h, _ = L.detect_sections(t, w)
    return L.date_groups(w, h, t).select("form_id", "ord", "part", "date_prefix", "date_group", "date_heading")


@family.query(f"""
WITH hm AS (SELECT *, NULL AS prefix, NULL AS g, NULL AS src, NULL AS num FROM {T} WHERE str IN ('DATOS DE LA POLIZA', 'VIGENCIA DEL SEGURO', 'LUGAR Y FECHA DE SOLICITUD')), {_nearest('h', 'hm')},
s AS (SELECT f.form_id, f.ord, arg_min(replace(lower(str), ':', ''), (f.x - t.x - t.width, t.ord)) AS sub FROM {FD} f JOIN {T} t ON f.form_id = t.form_id AND f.page = t.page AND t.str IN ('desde:', 'Hasta') AND abs(t.y - f.y) <= 30 AND t.x + t.width <= f.x AND f.x - t.x - t.width <= 300 GROUP BY ALL)
SELECT f.form_id, f.ord, nullif(concat_ws('_', CASE WHEN h.v.y - f.y - f.height <= 200 THEN CASE WHEN h.v.str LIKE 'VIG%' THEN 'vigencia' WHEN h.v.str LIKE 'LUGAR%' THEN 'fecha' END END, sub), '') AS context_prefix FROM {FD} f LEFT JOIN h USING (form_id, ord) LEFT JOIN s USING (form_id, ord)""")
def context_prefixes(spark, sf):
    return L.context_prefix(page_fields(spark, sf), texts(spark, sf)).select("form_id", "ord", "context_prefix")


@family.query(f"""{_ASSIGN}, dn AS (SELECT 1),
x AS (SELECT a.*, CASE WHEN regexp_matches(name, 'Row\\d+$') THEN regexp_extract(name, 'Row(\\d+)$', 1) END AS rn, replace(replace(regexp_replace(strip_accents(lower(label)), '[^a-z0-9\\s_]', '', 'g'), ' ', '_'), '__', '_') AS slug FROM a)
SELECT form_id, ord, trim(CASE WHEN rn IS NOT NULL AND (h.prefix = 'beneficiario_') THEN 'beneficiario_' || coalesce(nullif(h.num, 0)::VARCHAR, rn) || '_' WHEN rn IS NOT NULL THEN 'fila_' || rn || '_' ELSE coalesce(h.prefix, '') END || coalesce(s.prefix, '') || slug, '_') AS proposed,
  CASE WHEN coalesce(s.prefix, '') <> '' THEN s.g END AS group_proposed, label AS public_label FROM x""")
def propose_names(spark, sf):
    w = page_fields(spark, sf)
    h, s = L.detect_sections(texts(spark, sf), w)
    none = F.lit(None).cast("string")
    f = L.assign_section(w, h, s).withColumns({"date_part": none, "date_prefix": none, "date_group": none})
    return L.propose_name(f).select("form_id", "ord", "proposed", "group_proposed", "public_label")


_PROP = "SELECT p_brand AS form_id, p_partkey AS ord, p_name AS proposed, CASE WHEN p_size % 9 = 0 THEN 'text' ELSE 'checkbox' END AS type FROM @part"


@family.query(f"""
WITH c AS (SELECT *, count(*) OVER n AS n, count(*) FILTER (type = 'text') OVER n AS t, row_number() OVER (PARTITION BY form_id, proposed ORDER BY ord) AS k FROM {duck(_PROP)} WINDOW n AS (PARTITION BY form_id, proposed))
SELECT form_id, ord, CASE WHEN n > 1 AND t = 1 THEN CASE WHEN type = 'text' THEN proposed || '_texto' ELSE proposed END WHEN k = 1 THEN proposed ELSE proposed || '_' || k END AS final_name FROM c""")
def resolve_collisions(spark, sf):
    return L.resolve_collisions(spark_table(spark, sf, _PROP)).select("form_id", "ord", "final_name")


@family.query(f"""
WITH n AS (SELECT *, 'n' || ord % 40 AS new_name FROM {W}), l AS (SELECT *, page IS DISTINCT FROM lag(page) OVER o OR abs(lag(y) OVER o - y) > 15 AS s, count(*) OVER (PARTITION BY form_id, new_name) AS c FROM n WINDOW o AS (PARTITION BY form_id, new_name ORDER BY page, y DESC, ord)),
r AS (SELECT *, sum(s::INT) OVER (PARTITION BY form_id, new_name ORDER BY page, y DESC, ord) AS row_no FROM l)
SELECT form_id, ord, CASE WHEN c > 1 THEN new_name || '_' || row_no ELSE new_name END AS final_name, CASE WHEN c > 1 THEN 'collision-resolved' END AS warning FROM r""")
def suffix_by_row(spark, sf):
    rows = widgets(spark, sf).withColumn("new_name", F.concat(F.lit("n"), F.col("ord") % 40))
    return L.suffix_by_row(rows).select("form_id", "ord", "final_name", "warning")


_SUF = "SELECT p_brand AS form_id, p_partkey AS ord, concat('a.', p_partkey % 900) AS old_name, CASE WHEN p_size % 3 = 0 THEN concat('a.', p_partkey % 900) ELSE replace(p_name, ' ', '_') END AS new_name FROM @part"


@family.query(f"""
WITH f AS (SELECT form_id, old_name, min(ord) AS ord, arg_min(CASE WHEN new_name = old_name THEN replace(new_name, '.', '_') ELSE new_name END, ord) AS nn FROM {duck(_SUF)} GROUP BY ALL)
SELECT form_id, ord, old_name, CASE WHEN count(*) OVER (PARTITION BY form_id, nn) > 1 THEN nn || '_' || row_number() OVER (PARTITION BY form_id, nn ORDER BY ord) ELSE nn END AS final_name FROM f""")
def suffix_all(spark, sf):
    return L.suffix_all(spark_table(spark, sf, _SUF)).select("form_id", "ord", "old_name", "final_name")


_DUP = "SELECT p_brand AS form_id, p_partkey AS ord, p_size % 3 AS page, split_part(p_name, ' ', 2) AS name FROM @part"


@family.query(f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY form_id, name ORDER BY ord) AS k FROM {duck(_DUP)}), d AS (SELECT *, CASE WHEN k > 1 THEN row_number() OVER (PARTITION BY form_id, name, page, k > 1 ORDER BY ord) END AS j FROM c)
SELECT form_id, ord, CASE WHEN k = 1 THEN name WHEN j = 1 THEN name || '__p' || (page + 1) ELSE name || '__p' || (page + 1) || '_' || j END AS final_name FROM d""")
def dedupe_across_docs(spark, sf):
    return L.dedupe_across_docs(spark_table(spark, sf, _DUP)).select("form_id", "ord", "final_name")


# Some fields are named like the names that are made for others.
_TAKEN = "SELECT p_brand AS form_id, p_partkey AS ord, p_size % 3 AS page, CASE WHEN p_size % 4 = 0 THEN concat(split_part(p_name, ' ', 2), '__p', p_size % 3 + 1, CASE WHEN p_size % 8 = 0 THEN '' ELSE concat('_', 2 + p_size % 9) END) ELSE split_part(p_name, ' ', 2) END AS name FROM @part"


@family.query(f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY form_id, name ORDER BY ord) AS k FROM {duck(_TAKEN)}), f AS (SELECT DISTINCT form_id, name FROM c),
t AS (SELECT form_id, regexp_extract(name, '^(.*__p\\d+)(?:_(\\d+))?$', 1) AS base, list(DISTINCT coalesce(nullif(regexp_extract(name, '^(.*__p\\d+)(?:_(\\d+))?$', 2), '')::INT, 1)) AS taken FROM f GROUP BY ALL),
d AS (SELECT *, name || '__p' || (page + 1) AS base, row_number() OVER (PARTITION BY form_id, name, page ORDER BY ord) AS j FROM c WHERE k > 1),
n AS (SELECT d.*, list_filter(range(1, j + coalesce(len(taken), 0) + 1), lambda x: taken IS NULL OR NOT list_contains(taken, x))[j] AS free FROM d LEFT JOIN t USING (form_id, base))
SELECT form_id, ord, name AS final_name FROM c WHERE k = 1 UNION ALL SELECT form_id, ord, CASE WHEN free = 1 THEN base ELSE base || '_' || free END FROM n""")
def dedupe_taken_names(spark, sf):
    return L.dedupe_across_docs(spark_table(spark, sf, _TAKEN)).select("form_id", "ord", "final_name")


@family.query(f"""SELECT form_id, ord, name, k - 1 AS dup_index, c AS dup_count, CASE WHEN c > 1 THEN name || '#' || (k - 1) ELSE name END AS dup_key FROM (SELECT *, row_number() OVER (PARTITION BY form_id, name ORDER BY ord) AS k, count(*) OVER (PARTITION BY form_id, name) AS c FROM {duck(_PROP.replace("p_name AS proposed", "p_name AS name"))})""")
def duplicate_index(spark, sf):
    return L.dup_index(spark_table(spark, sf, _PROP.replace("p_name AS proposed", "p_name AS name"))).select("form_id", "ord", "name", "dup_index", "dup_count", "dup_key")


_CTX = "SELECT p_brand AS form_id, p_partkey AS ord, p_name AS public_label, CASE WHEN p_size % 4 = 0 THEN 'fecha_nacimiento' WHEN p_size % 4 = 1 THEN 'otra' END AS date_group, CASE WHEN p_size % 3 = 0 THEN 'sexo' WHEN p_size % 3 = 1 THEN 'zz' END AS group_name, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS section_name FROM @part"


@family.query(f"""
SELECT form_id, ord, CASE WHEN count(*) OVER (PARTITION BY form_id, public_label) > 1 AND ctx IS NOT NULL THEN public_label || ' (' || ctx || ')' ELSE public_label END AS context_label
FROM (SELECT *, CASE WHEN date_group = 'fecha_nacimiento' THEN 'Nacimiento' WHEN group_name = 'sexo' THEN 'Sexo' WHEN section_name <> '' THEN section_name ELSE group_name END AS ctx FROM {duck(_CTX)})""")
def context_labels(spark, sf):
    return L.context_labels(spark_table(spark, sf, _CTX)).select("form_id", "ord", "context_label")


_PDFROWS = "SELECT p_brand AS form_id, p_partkey AS ord, CASE CAST(floor(p_partkey / 200) AS BIGINT) % 4 WHEN 0 THEN 'Datos del Tomador' WHEN 1 THEN '' WHEN 2 THEN 'FIRMA' ELSE 'Póliza' END AS section FROM @part WHERE p_size % 3 > 0"
_EXTRA = "SELECT p_brand AS form_id, p_partkey AS ord, CASE p_size % 4 WHEN 0 THEN 'tomador' WHEN 1 THEN 'firma y sello' WHEN 2 THEN 'otra' ELSE 'poliza' END AS section FROM @part WHERE p_size % 3 = 0"


@family.query(f"""
WITH n AS (SELECT *, sum(s) OVER (PARTITION BY form_id ORDER BY ord) AS run FROM (SELECT *, CASE WHEN lag(section) OVER (PARTITION BY form_id ORDER BY ord) = section THEN 0 ELSE 1 END AS s FROM {duck(_PDFROWS)})),
h AS (SELECT DISTINCT form_id, run, strip_accents(lower(section)) AS k FROM n WHERE section <> ''),
e AS (SELECT x.form_id, x.ord, x.section, min(run) AS run FROM {duck(_EXTRA)} x LEFT JOIN h ON h.form_id = x.form_id AND (contains(k, x.section) OR contains(x.section, k)) GROUP BY ALL)
SELECT form_id, origin, ord, section, row_number() OVER (PARTITION BY form_id ORDER BY run, z, ord) AS number FROM (SELECT form_id, 'pdf' AS origin, ord, section, run, 0 AS z FROM n UNION ALL SELECT form_id, 'matrix', ord, section, coalesce(run, 1125899906842624), 1 FROM e)""")
def interleave_prefilled(spark, sf):
    return L.interleave_prefilled(spark_table(spark, sf, _PDFROWS), spark_table(spark, sf, _EXTRA))


@family.query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS field_order FROM events""")
def reading_order(spark, sf):
    return L.reading_order(read(spark, sf, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_id", "field_order")


@family.query("""
WITH e AS (SELECT *, CASE WHEN event_type = 'signup' THEN event_id END AS h FROM events)
SELECT event_id, user_id, (SELECT max(event_id) FROM events b WHERE b.user_id = e.user_id AND b.event_type = 'signup' AND b.ts < e.ts) AS heading FROM e WHERE event_type <> 'signup'""")
def events_after_signup(spark, sf):
    """the as-of kernel on time: the last sign-up before each other event"""
    e = read(spark, sf, "events")
    points = e.where("event_type <> 'signup'").select("event_id", "user_id", "ts")
    marks = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup"))
    from formspark.kernels import carry_above
    return carry_above(points, marks, ["user_id"], "ts", F.to_date("ts"), {"heading": F.col("signup")}).select("event_id", "user_id", "heading")
