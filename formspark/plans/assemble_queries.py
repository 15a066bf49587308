"""Built form definitions: fields, sections and documents as lines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from formspark import constants as K
from formspark.functions import classify as C
from formspark.operators import assemble as A
from formspark.operators import groups as G
from formspark.plans.group_queries import _N, NAMES
from formspark.plans.layout_queries import _ASSIGN as ASSIGN
from formspark.plans.layout_queries import DATE_GROUPS, page_fields, texts
from formspark.plans.registry import Family
from formspark.plans.tables import CELLS, WIDGETS, duck, read, spark_table, stored
from formspark.session import remove_folder, shared_folder
from formspark.sources import sheets as SH
from formspark.sources.files import write_documents
from formspark.sources.json_lines import read_document_lines, read_json_lines

family = Family()

# Mapping rows: one per order. Form = customer segment and status.
MAPPING = """SELECT concat(c_mktsegment, '-', o_orderstatus) AS form_id, o_orderkey AS ord, o_orderkey AS row_num, CASE o_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN concat('Beneficiario ', o_custkey % 4) WHEN 2 THEN 'Datos del Tomador' ELSE concat('Sección ', o_custkey % 9, ' (b)') END AS section_pdf,
  CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat('beneficiario_', o_custkey % 9, '_numero') WHEN 2 THEN concat('x_', o_custkey, '_dia') ELSE concat('dato_', o_orderkey) END AS source_name, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('p_', o_orderkey) END AS acro_proposed, concat('W', o_orderkey) AS acro_actual,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('Nº ', o_custkey) END AS label, CASE o_custkey % 5 WHEN 0 THEN 'FECHA' WHEN 1 THEN 'numérico' ELSE '' END AS format, CASE o_orderkey % 3 WHEN 0 THEN 'Btn' ELSE 'Tx' END AS native_type, CASE WHEN o_orderkey % 4 = 1 THEN concat('g', o_custkey % 90) ELSE '' END AS group_name,
  CASE WHEN o_orderkey % 8 = 0 THEN 'Moneda' ELSE '' END AS catalog_name, '' AS options_raw, CASE WHEN o_custkey % 4 = 0 THEN 'fecha' ELSE 'otro' END AS data_type, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN concat('encabezado.x', o_custkey) ELSE 'datosGenerales.personas.a' END AS path_main,
  CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS required, o_custkey % 30 AS max_length, CASE WHEN o_custkey % 10 = 0 THEN '^x$' ELSE '' END AS pattern FROM @orders JOIN @customer ON o_custkey = c_custkey"""
M = duck(MAPPING)
_SEC = f"(SELECT form_id, CASE WHEN section_pdf = '' THEN 'Sin Sección' ELSE section_pdf END AS title, min(ord) AS o FROM {M} GROUP BY ALL)"
_TSLUG = "replace(regexp_replace(strip_accents(lower(title)), '[^a-z0-9\\s]', '', 'g'), ' ', '_')"
_ORDERED = f"""(SELECT form_id, 1 AS section_order, 'section_encabezado' AS section_id, 'Encabezado (oculto)' AS title, '{{"logic":"and","conditions":[{{"fieldId":"field_NEVER_EXISTS","operator":"not_empty"}}]}}' AS condition FROM {_SEC} GROUP BY 1
UNION ALL SELECT form_id, row_number() OVER (PARTITION BY form_id ORDER BY o) + 1, 'section_' || {_TSLUG}, title,
  CASE WHEN title IN ('Beneficiario 2', 'Beneficiario 3') THEN '{{"logic":"and","conditions":[{{"fieldId":"field_beneficiario_' || (right(title, 1)::INT - 1) || '_nombre","operator":"not_empty"}}]}}' END FROM {_SEC})"""


def mapping(spark, sf):
    return stored(spark_table(spark, sf, MAPPING))


@family.query(f"SELECT * FROM {_ORDERED}")
def enriched_sections(spark, sf):
    return A.enriched_sections(mapping(spark, sf))


_FIELDS = f"""(SELECT form_id, title, k AS field_order, 'field_encabezado_' || n AS id, t AS type, l AS label, true AS required, true AS read_only, 'encabezado.' || n AS prefill_key, 'mandatory' AS prefill_mode, NULL AS help_text, NULL AS default_value, NULL AS max_length, NULL AS pattern
 FROM (SELECT DISTINCT form_id, 'Encabezado (oculto)' AS title FROM {M}), (SELECT unnest(generate_series(1, 10)) AS k, unnest(['codigoTipoFormulario', 'descripcionTipoFormulario', 'codigoTipoTramite', 'descripcionTipoTramite', 'identificadorTransaccionInterno', 'correoElectronico', 'codigoProducto', 'descripcionProducto', 'nombreCompletoCliente', 'identificadorArchivo']) AS n,
  unnest(['Tipo de Formulario', 'Descripción Tipo Formulario', 'Tipo de Trámite', 'Descripción Tipo Trámite', 'Identificador de Transacción', 'Correo Electrónico', 'Código de Producto', 'Descripción del Producto', 'Nombre Completo del Cliente', 'Identificador de Archivo']) AS l, unnest(['select', 'text', 'select', 'text', 'text', 'text', 'text', 'text', 'text', 'text']) AS t)
 UNION ALL SELECT form_id, title, row_number() OVER (PARTITION BY form_id, title ORDER BY ord), 'field_' || sn, t, CASE WHEN label <> '' THEN label ELSE sn END, coalesce(required, false), starts_with(sn, 'beneficiario_'), nullif(path_main, ''),
  CASE WHEN path_main LIKE 'encabezado.%' THEN 'mandatory' ELSE 'optional' END, CASE WHEN starts_with(sn, 'beneficiario_') AND n > 0 THEN 'Número consecutivo del beneficiario.' END, n, CASE WHEN t IN ('date', 'number', 'text') THEN nullif(max_length, 0) END, nullif(pattern, '')
 FROM (SELECT *, CASE WHEN starts_with(sn, 'beneficiario_') THEN regexp_extract(sn, '\\d+')::INT END AS n, CASE WHEN format = 'FECHA' THEN 'date' WHEN format = 'numérico' THEN 'number' WHEN source_name LIKE '%\\_dia' ESCAPE '\\' THEN 'select' WHEN native_type = 'Btn' AND group_name <> '' THEN 'radio' WHEN native_type = 'Btn' THEN 'checkbox' WHEN catalog_name <> '' THEN 'select' ELSE 'text' END AS t
  FROM (SELECT *, CASE WHEN source_name <> '' THEN source_name ELSE acro_proposed END AS sn, CASE WHEN section_pdf = '' THEN 'Sin Sección' ELSE section_pdf END AS title FROM {M})))"""


@family.query(f"SELECT * FROM {_FIELDS}")
def enriched_fields(spark, sf):
    return A.enriched_fields(mapping(spark, sf))


@family.query(f"""SELECT form_id, count(*) AS fields, count(*) FILTER (required) AS required, count(prefill_key) AS with_prefill, count(help_text) AS with_help, count(*) FILTER (prefill_mode = 'mandatory') AS mandatory, count(*) FILTER (prefill_mode = 'optional') AS optional FROM {_FIELDS} GROUP BY 1""")
def enriched_statistics(spark, sf):
    return A.enriched_stats(A.enriched_fields(mapping(spark, sf)))


def _q(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'null' ELSE '\"' || replace({x}, '\"', '\\\"') || '\"' END"


_DOC = f"""(SELECT form_id, 0 AS s, 0 AS p, 0 AS f, 0 AS i, '{{"sections":[' AS text FROM {_SEC} GROUP BY 1
UNION ALL SELECT form_id, section_order, 0, 0, 0, CASE WHEN section_order > 1 THEN ',' ELSE '' END || '{{"id":"' || section_id || '","title":"' || title || '","conditionalVisibility":' || {_q('condition')} || ',"order":' || section_order || ',"fields":[' FROM {_ORDERED}
UNION ALL SELECT form_id, section_order, 2, 0, 0, ']}}' FROM {_ORDERED}
UNION ALL SELECT f.form_id, section_order, 1, field_order, 0, CASE WHEN field_order > 1 THEN ',' ELSE '' END || '{{"id":"' || id || '","type":"' || type || '","label":"' || label || '","required":' || required || ',"prefillKey":' || {_q('prefill_key')} || ',"options":[' FROM {_FIELDS} f JOIN {_ORDERED} s ON f.form_id = s.form_id AND f.title = s.title
UNION ALL SELECT f.form_id, section_order, 1, field_order, 1073741824, ']}}' FROM {_FIELDS} f JOIN {_ORDERED} s ON f.form_id = s.form_id AND f.title = s.title
UNION ALL SELECT f.form_id, section_order, 1, field_order, k, CASE WHEN k > 1 THEN ',' ELSE '' END || '{{"value":"' || k || '","label":"' || k || '"}}' FROM {_FIELDS} f JOIN {_ORDERED} s ON f.form_id = s.form_id AND f.title = s.title, generate_series(1, 31) t(k) WHERE id LIKE '%\\_dia' ESCAPE '\\'
UNION ALL SELECT form_id, 1152921504606846976, 3, 0, 0, '],"validationRules":[],"prefillMappings":[],"version":1}}' FROM {_SEC} GROUP BY 1)"""


@family.query(f"SELECT form_id, s AS section_order, p AS part, f AS field_order, i AS item, text FROM {_DOC}")
def form_documents(spark, sf):
    m = mapping(spark, sf)
    sections = stored(A.enriched_sections(m))
    placed = stored(A.enriched_fields(m).join(sections.select("form_id", "title", "section_order"), ["form_id", "title"]))
    sec = sections.select("form_id", "section_order", F.struct(F.col("section_id").alias("id"), "title", F.col("condition").alias("conditionalVisibility"), F.col("section_order").alias("order")).alias("body"))
    fld = placed.select("form_id", "section_order", "field_order", F.struct("id", "type", "label", "required", F.col("prefill_key").alias("prefillKey")).alias("body"))
    opt = placed.select("form_id", "section_order", "field_order", F.posexplode(A.C.date_part_options(F.col("id"))).alias("pos", "o")).select(
        "form_id", "section_order", "field_order", (F.col("pos") + 1).alias("option_no"), F.struct("o.value", "o.label").alias("body"))
    return A.document_lines(m.select("form_id").distinct(), sec, fld, opt, ',"validationRules":[],"prefillMappings":[],"version":1')


def _nodes(rows: str, base: str, leaves: dict[str, str], array: str) -> str:
    """SQL: an object at ``base`` for each row, its leaves and its last member, a list"""
    paths = [base, *[f"{base}.{k}" for k in leaves], *([f"{base}.{array}"] if array else [])]
    kinds = ["object", *["leaf"] * len(leaves), *(["array"] if array else [])]
    values = ["NULL", *[f"CAST({v} AS VARCHAR)" for v in leaves.values()], *(["NULL"] if array else [])]
    return f"SELECT form_id, unnest({paths}) AS path, unnest({kinds}) AS kind, unnest([{', '.join(values)}]) AS value FROM {rows}"


@family.query(f"""SELECT form_id, unnest(['sections', 'validationRules', 'prefillMappings', 'version']) AS path, unnest(['array', 'array', 'array', 'leaf']) AS kind, unnest([NULL, NULL, NULL, '1']) AS value FROM (SELECT DISTINCT form_id FROM {_SEC})
UNION ALL {_nodes(_ORDERED, 'sections[]', {"id": "section_id", "title": "title", "conditionalVisibility": "condition", "order": "section_order"}, 'fields')}
UNION ALL {_nodes(_FIELDS, 'sections[].fields[]', {"id": "id", "type": "type", "label": "label", "required": "required", "prefillKey": "prefill_key"}, 'options')}
UNION ALL {_nodes(f"(SELECT form_id, k FROM {_FIELDS}, generate_series(1, 31) t(k) WHERE id LIKE '%@_dia' ESCAPE '@')", 'sections[].fields[].options[]', {"value": "k", "label": "k"}, '')}""")
def written_documents(spark, sf):
    """Form documents written as lines and read back by lines: their nodes"""
    path = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    write_documents(form_documents(spark, sf), path, A.LINE_KEY)
    _, nodes = read_json_lines(read_document_lines(spark, path))
    remove_folder(spark, path)  # what the nodes are made of is checkpointed
    return nodes.select("form_id", "path", "kind", "value")


_WID = "SELECT concat(c_mktsegment, '-', o_orderstatus) AS form_id, o_orderkey AS ord, CASE o_orderkey % 4 WHEN 0 THEN concat('w.', o_orderkey) WHEN 1 THEN concat('otro', o_orderkey) ELSE concat('W', o_orderkey) END AS name, CASE WHEN o_orderkey % 8 = 1 THEN 'Button' ELSE 'Text' END AS type FROM @orders JOIN @customer ON o_custkey = c_custkey"


@family.query(f"""
SELECT form_id, false AS orphan, 'field_' || sn AS id, CASE WHEN group_name <> '' THEN 'radio' WHEN data_type = 'fecha' THEN 'date' WHEN native_type = 'Tx' THEN 'text' ELSE 'checkbox' END AS type, CASE WHEN label <> '' THEN label ELSE sn END AS label, coalesce(required, false) AS required, false AS hidden,
  CASE WHEN ord % 4 = 0 THEN 'w.' || ord WHEN ord % 4 > 1 THEN 'W' || ord END AS source_name, nullif(replace(path_main, 'datosGenerales.personas', 'datosFormulario.personas'), '') AS output, nullif(group_name, '') AS radio_group,
  CASE WHEN group_name <> '' THEN row_number() OVER (PARTITION BY form_id, group_name ORDER BY ord) ELSE ord END AS field_order FROM (SELECT *, CASE WHEN source_name <> '' THEN source_name WHEN acro_proposed <> '' THEN acro_proposed ELSE acro_actual END AS sn FROM {M})
UNION ALL SELECT form_id, true, 'field_' || name, CASE type WHEN 'Button' THEN 'checkbox' ELSE 'text' END, name, false, true, name, NULL, NULL, 0 FROM {duck(_WID)} WHERE ord % 4 = 1""")
def matrix_fields(spark, sf):
    return A.matrix_fields(mapping(spark, sf), spark_table(spark, sf, _WID))


@family.query(f"""SELECT form_id, ord, CASE WHEN ord % 35 = 0 THEN CASE WHEN label <> '' THEN 'no_' || substr(label, 4) ELSE 'campo' END || '_r' || row_num ELSE acro_proposed END AS acro_proposed FROM {M}""".replace("'no_' ||", "'n_' ||"))
def synthetic_sources(spark, sf):
    return A.synthetic_source(mapping(spark, sf).withColumn("acro_actual", F.lit(""))).select("form_id", "ord", "acro_proposed")


_LINKS = "SELECT concat(c_mktsegment, '-', o_orderstatus) AS form_id, o_orderkey AS ord, concat('s', o_orderkey) AS source_name, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey - o_custkey % 3 END AS row_num FROM @orders JOIN @customer ON o_custkey = c_custkey"


@family.query(f"""
WITH l AS (SELECT * FROM {duck(_LINKS)} WHERE row_num IS NOT NULL), f AS (SELECT form_id, row_num, arg_min(source_name, ord) AS source_name, min(ord) AS o FROM l GROUP BY ALL), k AS (SELECT form_id, CASE WHEN ord % 3 > 0 THEN 's' ELSE 'h' END || ord AS source_name FROM {M})
SELECT m.form_id, f.source_name, m.row_num, CASE WHEN k.source_name IS NULL THEN 'new' ELSE 'linked' END AS state FROM {M} m JOIN f ON m.form_id = f.form_id AND m.row_num = f.row_num LEFT JOIN k ON k.form_id = f.form_id AND k.source_name = f.source_name
UNION ALL SELECT form_id, source_name, NULL, 'hidden' FROM k WHERE (form_id, source_name) NOT IN (SELECT (form_id, source_name) FROM f)
UNION ALL SELECT l.form_id, l.source_name, l.row_num, 'extra' FROM l JOIN f ON l.form_id = f.form_id AND l.row_num = f.row_num WHERE l.ord > f.o""")
def linked_fields(spark, sf):
    m = mapping(spark, sf)
    have = m.select("form_id", "ord", F.concat(F.when(F.col("ord") % 3 > 0, "s").otherwise("h"), "ord").alias("source_name"))
    out, extra = A.apply_links(m.select("form_id", "row_num"), spark_table(spark, sf, _LINKS), have)
    return out.unionByName(extra.withColumn("state", F.lit("extra")))


@family.query(f"""SELECT form_id, name AS source_name, page + 1 AS page, ord % 9 > 0 AS has_coordinates, CASE WHEN ord % 9 > 0 THEN x ELSE 0 END AS x_px, CASE WHEN ord % 9 > 0 THEN floor(x + 0.5) ELSE 0 END::BIGINT AS x_int, CASE WHEN ord % 9 > 0 THEN floor(y + 0.5) ELSE 0 END::BIGINT AS y_int, CASE WHEN ord % 9 > 0 THEN floor(height + 0.5) ELSE 0 END::BIGINT AS height_int FROM {duck(WIDGETS)}""")
def field_positions(spark, sf):
    w = spark_table(spark, sf, WIDGETS)
    gone = F.col("ord") % 9 == 0
    w = w.withColumns({c: F.when(~gone, F.col(c)) for c in ("x", "y", "width", "height")})
    return A.field_positions(w).select("form_id", "source_name", "page", "has_coordinates", "x_px", "x_int", "y_int", "height_int")


_WEB = """SELECT o_orderpriority AS form_id, 1 + o_orderkey % 3 AS section_order, concat('c', o_orderkey) AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Correo' WHEN 1 THEN 'Teléfono' ELSE concat('L', o_custkey) END AS label, CASE o_custkey % 3 WHEN 0 THEN 'checkbox' WHEN 1 THEN 'date' ELSE 'number' END AS type,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('a.b', o_custkey, ' y c') END AS json_name, o_orderkey % 2 = 0 AS required, CASE WHEN o_orderkey % 5 = 0 THEN concat('c', o_custkey) END AS depends_on, CASE WHEN o_orderkey % 10 = 0 THEN 'Si' END AS equals, o_orderkey AS ord FROM @orders"""


@family.query(f"""
WITH w AS (SELECT *, row_number() OVER (PARTITION BY form_id, section_order ORDER BY ord) AS n FROM {duck(_WEB)})
SELECT form_id, section_order, n AS field_order, '{{"id":"field_' || id || '","label":"' || label || '","type":"' || CASE label WHEN 'Correo' THEN 'email' WHEN 'Teléfono' THEN 'phone' ELSE CASE type WHEN 'checkbox' THEN 'radio' WHEN 'date' THEN 'text' ELSE 'number' END END || '","required":' || required || ',"readOnly":false,"width":"full","validationPattern":null,"conditionalVisibility":' ||
  CASE WHEN depends_on IS NULL THEN 'null' ELSE '"{{\\"logic\\":\\"and\\",\\"conditions\\":[{{\\"fieldId\\":\\"field_' || depends_on || '\\",\\"operator\\":\\"' || CASE WHEN equals IS NULL THEN 'not_empty\\"' ELSE 'equals\\",\\"value\\":\\"Si\\"' END || '}}]}}"' END ||
  ',"defaultValue":null,"sourceMeta":null,"prefillMode":"' || CASE WHEN required THEN 'required' ELSE 'optional' END || '","prefillKey":' || CASE WHEN json_name = '' THEN 'null' ELSE '"' || split_part(json_name, ' ', 1) || '"' END || '}}' AS body FROM w""")
def web_fields(spark, sf):
    f = spark_table(spark, sf, _WEB)
    f = A.ordered_scan(f, ["form_id", "section_order"], [F.col("ord")], F.floor(F.col("ord") / A.SLICE), number="field_order")
    none = {c: F.lit(None).cast(t) for c, t in (("pattern", "string"), ("value", "string"), ("n_options", "int"), ("source_name", "string"), ("page", "int"), ("x", "double"),
                                                ("y", "double"), ("width", "double"), ("height", "double"), ("read_only", "boolean"))}
    return A.web_field(f.withColumns(none)).withColumn("body", F.to_json("body", A._KEEP_NULLS))


@family.query(f"SELECT form_id, section_order, section_order AS id, CASE WHEN section_order % 2 = 0 THEN 'Page ' || section_order ELSE 'T' END AS title FROM (SELECT DISTINCT o_orderpriority AS form_id, 1 + o_orderkey % 3 AS section_order FROM orders)")
def web_sections(spark, sf):
    s = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("form_id"), (1 + F.col("o_orderkey") % 3).alias("section_order")).distinct()
    s = s.withColumn("section_title", F.when(F.col("section_order") % 2 == 0, "página 7").otherwise("T")).withColumn("section_id", F.col("section_order"))
    return A.web_section(s).select("form_id", "section_order", "body.id", "body.title")


# Name groups of widgets, with labels and paths.
_GM = f"(SELECT *, kind || ':' || CASE kind WHEN 'lookup' THEN 'enf' ELSE group_name END AS group_key FROM {_N})"


@family.query(f"""
WITH m AS (SELECT *, CASE WHEN group_name LIKE 'dep%' THEN 'dep' WHEN group_name LIKE 'benef%' THEN 'benef' END AS e, regexp_extract(source_name, '\\[(\\d+)\\]$', 1) AS i, regexp_extract(source_name, '(NoAplica|Si|No)$', 1) AS mark FROM {_GM})
SELECT form_id, ord, 'field_' || source_name AS id, CASE kind WHEN 'radio' THEN 'radio' WHEN 'lookup' THEN 'checkbox' ELSE 'text' END AS type, CASE kind WHEN 'lookup' THEN replace(regexp_replace(source_name, '_?(NoAplica|Si|No)$', ''), 'enf', '') ELSE group_name END AS label, source_name,
  CASE WHEN kind = 'radio' THEN group_name END AS radio_group, NULL AS slot_pattern, NULL AS json_pattern, NULL AS max_items,
  CASE WHEN kind = 'lookup' THEN '{{"type":"repeaterLookup","repeaterId":"field_enfermedades","needle":"' || replace(regexp_replace(source_name, '_?(NoAplica|Si|No)$', ''), 'enf', '') || '","ifFound":"' || CASE mark WHEN 'Si' THEN 'X' ELSE '' END || '","ifNotFound":"' || CASE mark WHEN 'Si' THEN '' ELSE 'X' END || '"}}' END AS lookup FROM m WHERE kind <> 'repeater'
UNION ALL SELECT form_id, min(ord), 'field_' || coalesce(e, group_name), 'repeater', CASE e WHEN 'dep' THEN 'Dependientes' WHEN 'benef' THEN 'Beneficiarios' ELSE coalesce(e, group_name) END, NULL, NULL, CASE WHEN e IS NULL THEN group_name || '[{{i0}}]' ELSE e || '{{sub}}[{{i0}}]' END,
  CASE e WHEN 'dep' THEN 'datosFormulario.personas[{{i0}}].{{sub}}' WHEN 'benef' THEN 'datosFormulario.beneficiarios[{{i0}}].{{sub}}' ELSE 'datosFormulario.' || group_name || '[{{i0}}]' END, CASE e WHEN 'dep' THEN 5 WHEN 'benef' THEN 4 ELSE max(i::INT) + 1 END, NULL
  FROM (SELECT * REPLACE (CASE WHEN e IS NULL THEN group_name END AS group_name) FROM m WHERE kind = 'repeater') GROUP BY form_id, e, group_name
UNION ALL SELECT form_id, min(ord), 'field_enfermedades', 'repeater', 'enfermedades', NULL, NULL, NULL, 'datosFormulario.enfermedades', count(*), NULL FROM m WHERE kind = 'lookup' GROUP BY form_id""")
def group_fields(spark, sf):
    g = G.name_groups(stored(spark_table(spark, sf, NAMES)))
    groups = G.canonical_groups(stored(spark_table(spark, sf, NAMES))).select("form_id", "group_key", "kind", "group_name", "entity", F.lit("").alias("label"), F.lit("").alias("path"), "section", "ord")
    return A.group_fields(groups, g.select("form_id", "group_key", "ord", "source_name")).drop("section")


@family.query(f"""WITH b AS (SELECT form_id, CASE WHEN ord % 3 = 0 THEN source_name ELSE 'otro_' || source_name END AS source_name FROM {duck(NAMES)})
SELECT form_id, 'field_' || source_name AS id, source_name, false AS hidden FROM b UNION ALL SELECT DISTINCT form_id, 'field_' || source_name, source_name, true FROM {duck(NAMES)} WHERE (form_id, source_name) NOT IN (SELECT (form_id, source_name) FROM b)""")
def unused_kept_hidden(spark, sf):
    n = spark_table(spark, sf, NAMES)
    own = F.when(F.col("ord") % 3 == 0, F.col("source_name")).otherwise(F.concat(F.lit("otro_"), "source_name"))
    built = n.select("form_id", F.concat(F.lit("field_"), own).alias("id"), own.alias("source_name"))
    return A.with_unused(built, n)


_TITLE = "CASE prefix " + " ".join(f"WHEN '{h[1]}' THEN '{h[2]}'" for h in K.HEADINGS) + " END"
_GROUP = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.GROUP_LABELS.items()) + " END"


@family.query(f"""
WITH dd AS ({DATE_GROUPS}), aa AS ({ASSIGN} SELECT form_id, ord, page, name, type, label, h.str AS heading, h.prefix AS prefix, h.num AS num, coalesce(s.prefix, '') AS sub, s.g AS g FROM a),
x AS (SELECT aa.*, part, date_prefix, date_group, {_TITLE} AS title, CASE WHEN regexp_matches(name, 'Row\\d+$') THEN regexp_extract(name, 'Row(\\d+)$', 1) END AS rn,
  replace(replace(regexp_replace(strip_accents(lower(label)), '[^a-z0-9\\s_]', '', 'g'), ' ', '_'), '__', '_') AS slug FROM aa LEFT JOIN dd USING (form_id, ord)),
n AS (SELECT *, trim(regexp_replace(CASE WHEN rn IS NOT NULL AND prefix = 'beneficiario_' THEN 'beneficiario_' || coalesce(nullif(num, 0)::VARCHAR, rn) || '_' WHEN rn IS NOT NULL THEN 'fila_' || rn || '_' ELSE coalesce(prefix, '') END
  || CASE WHEN part IS NOT NULL THEN date_prefix || part ELSE sub || slug END, '_+', '_', 'g'), '_') AS proposed, CASE WHEN part IS NOT NULL THEN date_group WHEN sub <> '' THEN g END AS group_name FROM x),
k AS (SELECT * FROM n WHERE NOT (len(proposed) >= 35 AND regexp_matches(proposed, '{K.NOISE_CONNECTORS}|{"|".join(K.NOISE_PHRASES)}'))),
c AS (SELECT *, count(*) OVER w AS cn, count(*) FILTER (type = 'text') OVER w AS ct, row_number() OVER (PARTITION BY form_id, proposed ORDER BY ord) AS kk, count(*) OVER (PARTITION BY form_id, label) AS ln,
  coalesce({_GROUP.format('date_group')}, {_GROUP.format('group_name')}, nullif(title, ''), nullif(group_name, '')) AS ctx FROM k WINDOW w AS (PARTITION BY form_id, proposed))
SELECT form_id, ord, coalesce(heading, '') AS section_pdf, name AS acro_actual, CASE WHEN cn > 1 AND ct = 1 THEN CASE WHEN type = 'text' THEN proposed || '_texto' ELSE proposed END WHEN kk = 1 THEN proposed ELSE proposed || '_' || kk END AS acro_proposed,
  CASE WHEN ln > 1 AND ctx IS NOT NULL THEN label || ' (' || ctx || ')' ELSE label END AS label, CASE type WHEN 'text' THEN 'Tx' ELSE 'Btn' END AS native_type, group_name, page + 1 AS page FROM c""")
def page_mapping_rows(spark, sf):
    """layout alone: sections, date groups, names free of collisions, labels"""
    return A.mapping_rows(page_fields(spark, sf), texts(spark, sf))


# From cells to documents: a document is a workbook of a form, its sections are the sheets.
_SHEETROWS = f"""(SELECT form_id || '/' || file AS form_id, sheet, row_idx, trim(coalesce(max(value) FILTER (col_idx = 0), '')) AS label, trim(coalesce(max(value) FILTER (col_idx = 1), '')) AS data_type,
  trim(coalesce(max(value) FILTER (col_idx = 3), '')) AS required, trim(coalesce(max(value) FILTER (col_idx = 4), '')) AS value, trim(coalesce(max(value) FILTER (col_idx = 8), '')) AS json_name FROM {duck(CELLS)} WHERE row_idx > 1 GROUP BY ALL)"""


@family.query(f"""
WITH f AS (SELECT *, dense_rank() OVER (PARTITION BY form_id ORDER BY sheet) AS s, row_number() OVER (PARTITION BY form_id, sheet ORDER BY row_idx) AS n FROM {_SHEETROWS})
SELECT form_id, 0 AS section_order, 0 AS part, 0 AS field_order, '{{"sections":[' AS text FROM f GROUP BY 1
UNION ALL SELECT form_id, s, 0, 0, CASE WHEN s = 1 THEN '' ELSE ',' END || '{{"id":"s' || s || '","title":"' || sheet || '","description":null,"order":' || s || ',"fields":[' FROM f GROUP BY form_id, s, sheet
UNION ALL SELECT form_id, s, 1, n, CASE WHEN n = 1 THEN '' ELSE ',' END || '{{"id":"field_r' || row_idx || '","label":"' || label || '","type":"' || CASE data_type WHEN 'Combo' THEN 'select' ELSE 'text' END || '","required":' || (required = 'Sí') ||
  ',"readOnly":false,"width":"full","validationPattern":null,"conditionalVisibility":null,"defaultValue":"' || value || '","sourceMeta":null,"prefillMode":"' || CASE WHEN required = 'Sí' THEN 'required' ELSE 'optional' END || '","prefillKey":"' || json_name || '"}}' FROM f
UNION ALL SELECT form_id, s, 2, 0, ']}}' FROM f GROUP BY form_id, s
UNION ALL SELECT form_id, {A.LAST_SECTION}, 3, 0, ']}}' FROM f GROUP BY 1""")
def definition_lines(spark, sf):
    """from sheet cells to definitions: header, rows, types, rules, sections, lines"""
    cells = stored(spark_table(spark, sf, CELLS))
    roles = ["field_label", "data_type", "rule", "required", "value", "json_name"]
    rows = SH.pivot_rows(cells, SH.detect_header(cells), roles, ["field_label", "value"]).withColumn("form_id", F.concat_ws("/", "form_id", "file"))
    # a workbook has a handful of sheets
    sheets = rows.groupBy("form_id").agg(F.array_sort(F.collect_set("sheet")).alias("all")).select("form_id", F.posexplode("all").alias("at", "sheet"))
    sheets = sheets.select("form_id", "sheet", (F.col("at") + 1).alias("section_order"))
    placed = rows.join(sheets, ["form_id", "sheet"])
    numbered = A.ordered_scan(placed, ["form_id", "section_order"], [F.col("row_idx")], F.floor(F.col("row_idx") / A.SLICE), number="field_order")
    none = {c: F.lit(None).cast(t) for c, t in (("n_options", "int"), ("depends_on", "string"), ("equals", "string"), ("source_name", "string"), ("page", "int"), ("x", "double"),
                                                ("y", "double"), ("width", "double"), ("height", "double"), ("read_only", "boolean"))}
    fields = numbered.select("form_id", "section_order", "field_order", F.concat(F.lit("r"), "row_idx").alias("id"), F.col("field_label").alias("label"), C.map_type("data_type").alias("type"),
                             C.yes_no("required").alias("required"), C.parse_validation("rule", "data_type").pattern.alias("pattern"), "value", "json_name").withColumns(none)
    sections = sheets.select("form_id", "section_order", F.concat(F.lit("s"), "section_order").alias("section_id"), F.col("sheet").alias("section_title"))
    lines = A.document_lines(sheets.select("form_id").distinct(), A.web_section(sections), A.web_field(fields))
    return lines.select("form_id", "section_order", "part", "field_order", "text")
