"""Types, rules, flags, paths and conditions over the part matrix and the document lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from formspark.functions import classify as C
from formspark.functions import paths as P
from formspark.plans.registry import Family
from formspark.plans.tables import LINES, MATRIX, duck, lines, read, spark_table

family = Family()

_TYPE = """CASE WHEN regexp_matches(t, 'titulo|heading') THEN 'heading' WHEN regexp_matches(t, 'info') THEN 'readonly'
  WHEN regexp_matches(t, 'radio') THEN 'radio' WHEN regexp_matches(t, 'combo|select|lista') THEN 'select' WHEN regexp_matches(t, 'fecha|date') THEN 'date'
  WHEN regexp_matches(t, 'numeric|numero|number') THEN 'number' WHEN regexp_matches(t, 'check') THEN 'checkbox' ELSE 'text' END"""


@family.query(f"""
SELECT ord, {_TYPE} AS type,
  CASE WHEN t IN ('texto', 'alfanumerico') THEN 'text' WHEN t = 'numerico' THEN 'number' WHEN t = 'fecha' THEN 'date'
    WHEN t = 'radio/combo' THEN 'radio' WHEN t = 'checkbox' THEN 'checkbox' END AS exact_type,
  CASE WHEN lower(data_type) = data_type THEN NULL ELSE
    CASE WHEN native = 'Tx' THEN 'text' WHEN native = 'Btn' THEN 'checkbox' WHEN grp <> '' THEN 'radio' ELSE 'text' END END AS mapped_type,
  CASE WHEN regexp_matches(lower(json_name), 'email|correo') THEN 'email' WHEN regexp_matches(lower(json_name), 'telefono|celular|phone') THEN 'phone'
    WHEN {_TYPE} IN ('radio', 'checkbox') THEN 'radio' WHEN {_TYPE} IN ('select', 'number') THEN {_TYPE} ELSE 'text' END AS web_type,
  CASE WHEN regexp_matches(lower(data_type), 'check') THEN 'Ch' WHEN regexp_matches(lower(data_type), 'text') THEN 'Tx' WHEN regexp_matches(lower(data_type), 'radio') THEN 'Btn'
    ELSE substr(lower(data_type), 1, 3) END AS native_type,
  CASE WHEN regexp_matches(lower(data_type), 'text|alfa|numer|fecha') THEN 'Tx' WHEN regexp_matches(lower(data_type), 'combo|select|lista') THEN 'Ch'
    WHEN regexp_matches(lower(data_type), 'radio|check') THEN 'Btn' ELSE 'Tx' END AS acro_type,
  CASE WHEN t = 'fecha' THEN 'fecha' WHEN t = 'numerico' THEN 'numérico' WHEN t IN ('alfanumerico', 'texto') THEN 'alfanumérico' WHEN regexp_matches(t, 'combo|radio|checkbox') THEN '' ELSE 'alfanumérico' END AS format,
  CASE WHEN regexp_matches(lower(data_type), 'numer') THEN 'numérico' WHEN regexp_matches(lower(data_type), 'alfa') THEN 'alfanumérico' WHEN lower(data_type) LIKE '%fecha%' THEN 'fecha'
    WHEN lower(data_type) LIKE '%texto%' THEN 'texto' ELSE lower(data_type) END AS row_format,
  CASE WHEN lower(data_type) = 'numérico' THEN '#.##0' END AS number_format
FROM (SELECT *, strip_accents(lower(trim(data_type))) AS t, CASE ord % 3 WHEN 0 THEN 'Tx' WHEN 1 THEN 'Btn' ELSE 'Zz' END AS native,
  CASE WHEN ord % 2 = 0 THEN 'g' ELSE '' END AS grp FROM {duck(MATRIX)})""")
def field_types(spark, sf):
    m = spark_table(spark, sf, MATRIX)
    native = F.when(F.col("ord") % 3 == 0, "Tx").when(F.col("ord") % 3 == 1, "Btn").otherwise("Zz")
    group = F.when(F.col("ord") % 2 == 0, "g").otherwise("")
    type_ = C.map_type("data_type")
    return m.select(
        "ord", type_.alias("type"), C.map_type_exact("data_type").alias("exact_type"),
        C.mapping_type(F.col("data_type"), native, group, F.lit(False)).alias("mapped_type"),
        C.form_type(type_, F.lit(""), F.col("json_name")).alias("web_type"), C.native_type("data_type").alias("native_type"),
        C.native_from_data_type("data_type").alias("acro_type"), C.map_format("data_type").alias("format"),
        C.data_type_format("data_type").alias("row_format"), C.number_format("data_type").alias("number_format"))


_LEN = "coalesce(nullif(regexp_extract(r, '(\\d+)\\s*caract', 1), ''), nullif(regexp_extract(r, 'max(?:imo)?\\s*[:=]?\\s*(\\d+)', 1), '')"


@family.query(f"""
SELECT ord, {_LEN})::INT AS max_length,
  CASE WHEN regexp_matches(r, 'formato\\s+dd/?mm/?(aaaa|yyyy)|dd/mm/aaaa') THEN '^\\d{{2}}/\\d{{2}}/\\d{{4}}$' WHEN regexp_matches(r, 'formato\\s+dd-mm-(aaaa|yyyy)') THEN '^\\d{{2}}-\\d{{2}}-\\d{{4}}$'
    WHEN regexp_matches(r, 'solo\\s*numeros') THEN '^\\d+$' WHEN regexp_matches(r, 'email|correo') THEN '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$'
    WHEN r LIKE '%alfanum%' THEN '^[A-Za-z0-9 ]+$' END AS pattern,
  CASE WHEN NOT skip THEN {_LEN}, nullif(regexp_extract(r, 'hasta\\s+(\\d+)', 1), ''))::INT END AS max_length_ext,
  CASE WHEN skip THEN NULL WHEN regexp_matches(r, 'formato\\s+dd/?mm/?(aaaa|yyyy)|dd/mm/aaaa') THEN '^\\d{{2}}/\\d{{2}}/\\d{{4}}$' WHEN regexp_matches(r, 'formato\\s+dd-mm-(aaaa|yyyy)') THEN '^\\d{{2}}-\\d{{2}}-\\d{{4}}$'
    WHEN regexp_matches(r, 'numerico\\s+y\\s+\\d+\\s*digitos') THEN '^\\d{{' || regexp_extract(r, 'numerico\\s+y\\s+(\\d+)', 1) || '}}$'
    WHEN regexp_matches(r, 'solo\\s*numeros') THEN '^\\d+$' WHEN regexp_matches(r, 'email|correo') THEN '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$'
    WHEN r LIKE '%alfanum%' THEN '^[A-Za-z0-9 ]+$' END AS pattern_ext,
  coalesce(nullif(regexp_extract(rule, '(?i)(\\d+)\\s*car[aá]cteres', 1), ''), nullif(regexp_extract(rule, '(?i)(\\d+)\\s*d[ií]gitos', 1), ''), '') AS length_text
FROM (SELECT *, trim(regexp_replace(strip_accents(lower(rule)), '\\s+', ' ', 'g')) AS r, {_TYPE} IN ('select', 'radio', 'checkbox', 'heading', 'readonly') AS skip
  FROM (SELECT *, strip_accents(lower(data_type)) AS t FROM {duck(MATRIX)}))""")
def rule_validation(spark, sf):
    m = spark_table(spark, sf, MATRIX)
    base, ext = C.parse_validation("rule", "data_type"), C.parse_validation_ext("rule", C.map_type("data_type"))
    return m.select("ord", base.max_length.alias("max_length"), base.pattern.alias("pattern"),
                    ext.max_length.alias("max_length_ext"), ext.pattern.alias("pattern_ext"), C.length_text("rule").alias("length_text"))


@family.query(f"""
SELECT ord, r IN ('si', 'sí', 'yes', 'true', 'obligatorio') AS required, CASE WHEN r IN ('si', 'sí') THEN 'Si' WHEN r = 'no' THEN 'No' ELSE required END AS spelling,
  CASE WHEN r IN ('si', 'sí') THEN 'Sí' WHEN r = 'no' THEN 'No' ELSE '' END AS accented,
  CASE WHEN r IN ('si', 'sí', 'yes', 's', 'x') THEN true WHEN r IN ('no', 'n', '') THEN false END AS mapping,
  CASE WHEN r IN ('si', 'sí', 'yes', 's') THEN true WHEN r IN ('no', 'n') THEN false END AS enriched,
  r IN ('si', 'sí', 'yes', 'true', '1') AS plain,
  CASE WHEN product_scope = '' THEN 'all' WHEN product_scope = 'TODOS' THEN 'all' ELSE array_to_string([trim(x) FOR x IN regexp_split_to_array(lower(product_scope), '[,;]')], '|') END AS scopes,
  product_scope IN ('', 'TODOS') OR regexp_matches(lower(product_scope), 'colectiva') AS applies_1009052,
  product_scope IN ('', 'TODOS') OR regexp_matches(lower(product_scope), 'crediticia') AS applies_d0309,
  CASE WHEN product_scope IN ('', 'TODOS') THEN product_scope WHEN lower(product_scope) LIKE '%colectiva%' THEN 'VC' WHEN lower(product_scope) LIKE '%universal%' THEN 'VU' WHEN lower(product_scope) LIKE '%crediticia%' THEN 'PC' END AS product,
  regexp_matches(lower(visualization), 'lectura') AS matrix_read_only, regexp_matches(lower(visualization), 'no visible') AS matrix_hidden,
  CASE WHEN visualization LIKE 'Disabled%' THEN true WHEN visualization = 'Editable' THEN false ELSE ord % 2 = 0 END AS read_only,
  visualization IN ('Disabled, no visible', 'No aplica') OR ord % 5 = 0 AS hidden
FROM (SELECT *, lower(trim(required)) AS r FROM {duck(MATRIX)})""")
def yes_no_and_products(spark, sf):
    m = spark_table(spark, sf, MATRIX)
    v = C.visibility_flags("visualization", F.col("ord") % 2 == 0, F.col("ord") % 5 == 0)
    mf = C.matrix_flags("visualization")
    return m.select(
        "ord", C.yes_no("required").alias("required"),
        *[C.yes_no("required", k).alias(k) for k in ("spelling", "accented", "mapping", "enriched", "plain")],
        F.array_join(C.scope_split("product_scope"), "|").alias("scopes"),
        C.applies_to_form("product_scope", F.lit("1009052")).alias("applies_1009052"),
        C.applies_to_form("product_scope", F.lit("D0309")).alias("applies_d0309"), C.map_product("product_scope").alias("product"),
        mf.read_only.alias("matrix_read_only"), mf.hidden.alias("matrix_hidden"), v.read_only.alias("read_only"), v.hidden.alias("hidden"))


@family.query("""
SELECT c_custkey, CASE WHEN hit THEN regexp_extract(v, '^([A-Z0-9]{1,6})', 1) ELSE v END AS code,
  CASE WHEN hit THEN trim(regexp_extract(v, '^[A-Z0-9]{1,6}\\s*[-|,]\\s*(.+)$', 1)) ELSE v END AS label, n_parts, first_forms, first_name, last_name
FROM (SELECT *, regexp_matches(v, '^[A-Z0-9]{1,6}\\s*[-|,]\\s*.+$') AS hit,
    CASE WHEN c_custkey % 3 = 0 THEN 3 WHEN c_custkey % 3 = 1 THEN 1 ELSE 2 END AS n_parts,
    CASE WHEN c_custkey % 3 = 0 THEN 'VC|VU' ELSE '' END AS first_forms,
    CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_name ELSE c_mktsegment END AS first_name,
    CASE WHEN c_custkey % 3 = 0 THEN 'otro' ELSE c_name END AS last_name
  FROM (SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment || ' - ' || c_name ELSE c_nationkey || ',' || c_name END AS v FROM customer))""")
def options_and_ambiguous_names(spark, sf):
    c = read(spark, sf, "customer")
    v = F.when(F.col("c_nationkey") % 2 == 0, F.concat("c_mktsegment", F.lit(" - "), "c_name")).otherwise(
        F.concat("c_nationkey", F.lit(","), "c_name"))
    k = F.col("c_custkey") % 3
    text = (F.when(k == 0, F.concat(F.lit("Vida Colectiva y vida universal: "), "c_name", F.lit(" / x / Protección Crediticia: otro")))
            .when(k == 1, F.col("c_name")).otherwise(F.concat("c_mktsegment", F.lit("/ Forma: "), "c_name")))
    opt, parts = C.option_split(v), C.split_ambiguous(text)
    return c.select("c_custkey", opt.code.alias("code"), opt.label.alias("label"), F.size(parts).alias("n_parts"),
                    F.array_join(parts[0].forms, "|").alias("first_forms"), parts[0]["name"].alias("first_name"),
                    F.element_at(parts, -1)["name"].alias("last_name"))


_SI = "(^|[^a-z0-9_])si($|[^a-z0-9_])"
_TRIG = "si\\s+se\\s+(?:selecciona|elige|marca)\\s+([^,.;]+?)\\s+se\\s+(?:debe(?:\\s+de)?\\s+)?(?:habilitar|desplegar|mostrar|visualizar)\\s+(?:el\\s+campo\\s+)?([^,.;]+)"
_EQ = "si\\s+(?:el\\s+campo\\s+|el\\s+|la\\s+|los\\s+)?([a-z0-9 áéíóúñ]+?)\\s+(?:es|=|==|igual\\s+a)\\s+([a-z0-9 ]+)"
_DEP = "depende\\s+de\\s+([a-z0-9 áéíóúñ]+)"


def _condition_sql(text: str, source: str, keys: str) -> str:
    return f"""
SELECT {keys}, CASE WHEN t THEN 'trigger' WHEN e THEN 'equals' WHEN d THEN 'depends' END AS kind,
  CASE WHEN t THEN trim(regexp_replace(regexp_extract(n, '{_TRIG}', 2), '[.,:;]+$', '')) WHEN e THEN trim(regexp_extract(n, '{_EQ}', 1)) WHEN d THEN trim(regexp_extract(n, '{_DEP}', 1)) END AS label,
  CASE WHEN t THEN trim(regexp_extract(n, '{_TRIG}', 1)) WHEN e THEN trim(regexp_extract(n, '{_EQ}', 2)) END AS value,
  CASE WHEN regexp_matches(n, '{_SI}') AND regexp_matches(n, '(^|[^a-z0-9_])no($|[^a-z0-9_])') AND regexp_matches(n, 'desplega|habilita|muestra') THEN 'ambiguous_rule'
    WHEN regexp_matches(n, '{_SI}|(^|[^a-z0-9_])(depende|visualiza)($|[^a-z0-9_])|(^|[^a-z0-9_])desplieg') THEN 'unparsed_rule' END AS leftover
FROM (SELECT *, regexp_matches(n, '{_TRIG}') AS t, regexp_matches(n, '{_EQ}') AS e, regexp_matches(n, '{_DEP}') AS d
  FROM (SELECT *, trim(regexp_replace(strip_accents(lower({text})), '\\s+', ' ', 'g')) AS n FROM {source}))"""


@family.query(_condition_sql("rule || ' · ' || visualization", duck(MATRIX), "ord"))
def rule_conditions(spark, sf):
    c = C.parse_condition(C.join_texts(F.col("rule"), F.col("visualization")))
    return spark_table(spark, sf, MATRIX).select(
        "ord", c.kind.alias("kind"), c.label.alias("label"), c.value.alias("value"), c.leftover.alias("leftover"))


@family.query(_condition_sql("line", LINES, "doc_id, line_no"))
def line_conditions(spark, sf):
    c = C.parse_condition(F.col("line"))
    return lines(spark, sf).select("doc_id", "line_no", c.kind.alias("kind"), c.label.alias("label"), c.value.alias("value"),
                                   c.leftover.alias("leftover"))


@family.query("""
SELECT o_orderkey, '{"logic":"or","conditions":[{"fieldId":"field_' || o_custkey || '","operator":"' || CASE o_orderstatus WHEN 'F' THEN 'equals' WHEN 'O' THEN 'empty' ELSE 'not_empty' END || '"'
  || CASE o_orderstatus WHEN 'F' THEN ',"value":""' ELSE '' END || '},{"fieldId":"field_a","operator":"equals","value":"' || o_orderpriority || '"}]}' AS fixed,
  CASE WHEN o_orderstatus = 'F' THEN 'Si "' || lower(o_orderpriority) || '" → mostrar "' || 'Cliente ' || o_custkey || '"' ELSE 'Si Cliente = ' || o_custkey || ' y' END AS shown
FROM (SELECT * REPLACE (upper(substr(o_orderpriority, 1, 1)) || substr(o_orderpriority, 2) AS o_orderpriority) FROM orders)""")
def condition_fixes(spark, sf):
    o = read(spark, sf, "orders")
    op = F.when(F.col("o_orderstatus") == "F", "equals").when(F.col("o_orderstatus") == "O", "empty").otherwise("greater")
    text = F.concat(F.lit('{"logic":"or","conditions":[{"fieldId":"'), "o_custkey", F.lit('","operator":"'), op,
                    F.lit('"},{"fieldId":"field_a","operator":"equals","value":"'), "o_orderpriority", F.lit('"}]}'))
    rule = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Si se marca "), "o_orderpriority", F.lit(" se debe mostrar el campo cliente "), "o_custkey")
                  ).otherwise(F.concat(F.lit("si el campo cliente es "), "o_custkey", F.lit(" y")))
    return o.select("o_orderkey", C.fix_condition(text).alias("fixed"), C.condition_text(rule, F.lit("")).alias("shown"))


_IDX = "CASE ord % 5 WHEN 0 THEN 'asegurado_' WHEN 1 THEN 'beneficiario_2_' WHEN 2 THEN 'dme_' WHEN 3 THEN 'otro_' ELSE '' END"


@family.query(f"""
SELECT ord, main, secondary, main_path, CASE WHEN bare AND k IS NOT NULL THEN replace(main_path, 'personas', 'personas[' || k || ']') ELSE main_path END AS indexed,
  bare AND k IS NULL AS warning, replace(main_path, 'datosFormulario', 'x') AS first,
  trim(regexp_replace(lower(strip_accents(regexp_replace(leaf, '([A-Z])', ' \\1', 'g'))), '[^a-z0-9]+', ' ', 'g')) AS json_leaf,
  regexp_replace(lower(regexp_replace(leaf, '([A-Z])', '_\\1', 'g')), '^_', '') AS derived,
  regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace('personas' || (CASE ord % 3 WHEN 0 THEN '[0]' WHEN 1 THEN '' ELSE '[]' END) || '_' || leaf, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[^a-zA-Z0-9]+', '_', 'g')), '^_', ''), '_$', '') AS widget_name,
  leaf, segments
FROM (SELECT *, json_name AS main_path, NOT regexp_matches(json_name, 'personas\\[') AS bare, list_last(string_split(json_name, '.')) AS leaf,
  CASE {_IDX} WHEN 'asegurado_' THEN '0' WHEN 'beneficiario_2_' THEN '2' END AS k, json_name AS main, 'a.b' || p_size || ' | c.' || p_name AS secondary,
  CASE ord % 3 WHEN 0 THEN 'datosFormulario|personas:0|' ELSE CASE ord % 3 WHEN 1 THEN 'datosFormulario|personas|' ELSE 'datosFormulario|personas:-1|' END END || list_last(string_split(json_name, '.')) AS segments
  FROM {duck(MATRIX)})""")
def path_expressions(spark, sf):
    m = spark_table(spark, sf, MATRIX)
    cell = F.concat("json_name", F.lit(", a.b"), "p_size", F.lit("\nc."), "p_name")
    split = P.split_paths(cell)
    k = F.col("ord") % 5
    prefix = F.when(k == 0, "asegurado_").when(k == 1, "beneficiario_2_").when(k == 2, "dme_").when(k == 3, "otro_").otherwise("")
    indexed = P.index_path(split.main, prefix)
    segs = F.transform(P.parse_path(split.main), lambda s: F.concat_ws(":", s["key"], s["index"]))
    return m.select(
        "ord", split.main.alias("main"), F.array_join(split.secondary, " | ").alias("secondary"), split.main.alias("main_path"),
        indexed.path.alias("indexed"), indexed.warning.alias("warning"),
        F.replace(P.first_path(F.concat("json_name", F.lit(" y otra"))), F.lit("datosFormulario"), F.lit("x")).alias("first"),
        P.json_leaf(cell).alias("json_leaf"), P.derive_name(cell).alias("derived"),
        P.derive_widget_name("json_name", "pdf_field_name").alias("widget_name"), P.last_segment("json_name").alias("leaf"),
        F.array_join(segs, "|").alias("segments"))


@family.query(f"""
SELECT ord, regexp_replace(pdf_field_name, '\\[\\d+\\]$', '') AS bare, nullif(regexp_extract(pdf_field_name, '\\[(\\d+)\\]$', 1), '')::INT AS idx,
  nullif(regexp_extract(pdf_field_name, '(?i)Row\\s*(\\d+)', 1), '')::INT AS row_no,
  CASE WHEN regexp_matches(pdf_field_name, '_\\d+_\\d+$') THEN 3 WHEN regexp_matches(pdf_field_name, '_\\d+$') THEN 2 ELSE 1 END AS variants,
  CASE p_size % 4 WHEN 0 THEN 'NoAplica' WHEN 1 THEN 'Si' WHEN 2 THEN 'No' END AS suffix, replace(p_name, ' ', '_') || CASE p_size % 4 WHEN 3 THEN 'x' ELSE '' END AS option_base,
  'datosFormulario.personas.' || p_size || '.datosGenerales.personas' AS corrected, p_name AS key_path, '==' || p_size AS key_condition
FROM {duck(MATRIX)}""")
def name_expressions(spark, sf):
    m = spark_table(spark, sf, MATRIX)
    k = F.col("p_size") % 4
    opt = F.concat(F.translate("p_name", " ", "_"), F.when(k == 0, "_NoAplica").when(k == 1, "Si").when(k == 2, "_No").otherwise("x"))
    key = P.split_prefill_key(F.concat("p_name", F.lit(" == "), "p_size"))
    return m.select(
        "ord", P.strip_index("pdf_field_name").alias("bare"), P.index_of("pdf_field_name").alias("idx"),
        P.row_number_of("pdf_field_name").alias("row_no"), F.size(P.name_variants("pdf_field_name")).alias("variants"),
        P.option_suffix(opt).alias("suffix"), P.strip_option(opt).alias("option_base"),
        P.correct_path(F.concat(F.lit("datosGenerales.personas."), "p_size", F.lit(".datosGenerales.personas"))).alias("corrected"),
        key.path.alias("key_path"), key.condition.alias("key_condition"))


_SN = """CASE o_orderkey % 8 WHEN 0 THEN 'asegurado_primer_apellido' WHEN 1 THEN 'asegurado_sexo_' || o_custkey WHEN 2 THEN 'vigencia_' || o_custkey || '_dia'
  WHEN 3 THEN 'beneficiario_' || (o_custkey % 12) || '_numero' WHEN 4 THEN 'poliza_numero' WHEN 5 THEN 'asegurado_x_mes' WHEN 6 THEN 'solicitud_fecha_ano' ELSE 'monto_' || o_custkey END"""


@family.query(f"""
SELECT o_orderkey, CASE WHEN path LIKE 'encabezado.%' THEN 'mandatory' WHEN k IN (0, 1, 2, 4) THEN 'mandatory' WHEN k = 5 AND o_orderstatus = 'F' THEN 'mandatory' ELSE 'optional' END AS mode,
  CASE k WHEN 2 THEN 31 WHEN 5 THEN 12 WHEN 6 THEN 57 END AS n_options, CASE k WHEN 2 THEN '31' WHEN 5 THEN 'Dic' WHEN 6 THEN '2080' END AS last_option,
  CASE k WHEN 0 THEN 'Primer apellido del asegurado según documento de identidad.' WHEN 3 THEN CASE WHEN o_custkey % 12 BETWEEN 1 AND 10 THEN 'Número consecutivo del beneficiario.' END
    WHEN 4 THEN 'Número de póliza asignado por el INS.' WHEN 6 THEN 'Año de la fecha de solicitud.' END AS help,
  CASE k WHEN 3 THEN o_custkey % 12 END AS row_no,
  substr(CASE k WHEN 0 THEN 'RODRÍGUEZ' WHEN 1 THEN 'Dato de prueba' WHEN 2 THEN '28' WHEN 3 THEN '0123456789' WHEN 4 THEN '0123456789' WHEN 5 THEN '09' WHEN 6 THEN '2026' ELSE '1.250.000,00' END, 1, 10) AS sample
FROM (SELECT *, o_orderkey % 8 AS k, CASE WHEN o_orderstatus = 'O' AND o_custkey % 2 = 0 THEN 'encabezado.x' ELSE 'polizaMadre.y' END AS path FROM orders)""")
def prefill_and_samples(spark, sf):
    o = read(spark, sf, "orders")
    name = F.expr(_SN)
    path = F.when((F.col("o_orderstatus") == "O") & (F.col("o_custkey") % 2 == 0), "encabezado.x").otherwise("polizaMadre.y")
    group = F.when(F.col("o_orderstatus") == "F", "sexo").otherwise("")
    o = o.select("o_orderkey", name.alias("sn"), path.alias("path"), group.alias("grp"))
    options = C.date_part_options("sn")
    return o.select("o_orderkey", C.prefill_mode("sn", "path", "grp").alias("mode"), F.when(options.isNotNull(), F.size(options)).alias("n_options"),
                    F.element_at(options, -1).pdf_value.alias("last_option"), C.help_text("sn").alias("help"),
                    C.default_row_number("sn").alias("row_no"), C.synthetic_value("sn", max_length=F.lit(10)).alias("sample"))


@family.query(f"""
SELECT ord, j, w, h, r, p, e, l, CASE WHEN e THEN 'excluido' WHEN l THEN 'label' WHEN j THEN 'soloJSON' WHEN w THEN 'soloWeb' WHEN h THEN 'oculto' WHEN r THEN 'readOnly' ELSE 'normal' END AS dest
FROM (SELECT ord, p_size % 9 = 0 OR ord % 11 = 0 AS j, p_size % 9 = 1 AS w, visualization = 'No aplica' AS h, visualization LIKE 'Disabled%' AS r, visualization = 'Dato Prellenado' AS p,
  ord % 13 = 0 AS e, ord % 4 = 0 AS l FROM {duck(MATRIX)})""")
def ficha_flags(spark, sf):
    m = spark_table(spark, sf, MATRIX)
    req = F.when(F.col("p_size") % 9 == 0, "json ").when(F.col("p_size") % 9 == 1, "Web").otherwise("Si")
    step = F.when(F.col("ord") % 11 == 0, " Json").otherwise("1")
    rule = F.when(F.col("ord") % 13 == 0, "NO APLICA  Formulario").otherwise(F.lit("no aplica"))
    route = F.when(F.col("ord") % 4 == 0, " ").otherwise(F.col("json_name"))
    flags = C.ficha_flags(req, step, F.col("visualization"), rule, route)
    names = {"j": "json_only", "w": "web_only", "h": "hidden", "r": "read_only", "p": "prefill", "e": "excluded", "l": "is_label"}
    return m.select("ord", *[flags[v].alias(k) for k, v in names.items()], C.ficha_dest(flags).alias("dest"))


@family.query("""
SELECT grade, accepted, count(*) AS n FROM (SELECT CASE WHEN conf IS NULL THEN 'none' WHEN conf >= 85 THEN 'high' WHEN conf >= 70 THEN 'medium' ELSE 'low' END AS grade,
  coalesce(conf >= 70 AND conf < 75, false) AS accepted FROM (SELECT CASE WHEN l_linenumber < 7 THEN l_quantity + 50 END AS conf FROM lineitem)) GROUP BY ALL""")
def match_grades(spark, sf):
    conf = F.when(F.col("l_linenumber") < 7, F.col("l_quantity") + 50)
    return read(spark, sf, "lineitem").select(C.match_grade(conf).alias("grade"), C.accept_medium(conf).alias("accepted")).groupBy(
        "grade", "accepted").agg(F.count(F.lit(1)).alias("n"))


@family.query("""
SELECT e_type, section, part, seg, by_prefix, coalesce(entity, '') AS entity, lookup, count(*) AS n FROM (
SELECT event_type AS e_type, CASE event_type WHEN 'click' THEN 'Datos del Tomador' WHEN 'signup' THEN 'Declaraciones Legales' WHEN 'view' THEN 'Datos Generales' WHEN 'error' THEN 'Coberturas del Seguro' ELSE 'Datos Generales' END AS section,
  CASE event_type WHEN 'click' THEN 'contacto' WHEN 'signup' THEN 'aceptacion' WHEN 'view' THEN 'solicitud' WHEN 'error' THEN 'basicas' ELSE 'sistema' END AS part,
  CASE event_type WHEN 'click' THEN 'DATOS DE LA PÓLIZA' WHEN 'view' THEN 'FIRMA' ELSE '' END AS seg,
  CASE event_type WHEN 'click' THEN 'Dependientes' WHEN 'signup' THEN 'Beneficiarios' WHEN 'view' THEN 'Cuestionario de Salud' ELSE 'General' END AS by_prefix,
  CASE event_type WHEN 'click' THEN 'depTit' WHEN 'signup' THEN 'benef' END AS entity, CASE event_type WHEN 'error' THEN 'enf' END AS lookup FROM events) GROUP BY ALL""")
def section_inference(spark, sf):
    t = F.col("event_type")
    title = (F.when(t == "click", "Ubicación del contratistas").when(t == "signup", "CONSENTIMIENTO ").when(t == "view", "x")
             .when(t == "error", "Cobertura Básica").otherwise("Titular del sistema"))
    path = F.when(t == "click", "datosPoliza.a").when(t == "view", "DatosFirma.x").otherwise("nada")
    name = F.when(t == "click", "depTitNombre").when(t == "signup", "benefiX").when(t == "view", "riesgo1").when(t == "error", "enfCancer").otherwise("otro")
    s = C.classify_section(title)
    return read(spark, sf, "events").select(
        t.alias("e_type"), s.section.alias("section"), s.part.alias("part"), C.section_of_path(path).alias("seg"),
        C.section_by_prefix(name).alias("by_prefix"), C.entity_of(name).alias("entity"), C.lookup_prefix(name).alias("lookup")
    ).groupBy("e_type", "section", "part", "seg", "by_prefix", "entity", "lookup").agg(F.count(F.lit(1)).alias("n"))


@family.query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, least(l_quantity, l_suppkey) AS x, least(l_partkey / 10.0, l_linenumber) AS y, abs(l_suppkey - l_quantity) AS w,
  floor(abs(l_linenumber - l_partkey / 10.0) + 0.5)::BIGINT AS h, CASE l_returnflag WHEN 'A' THEN 'boolean (solo true)' WHEN 'N' THEN 'string (fecha)' ELSE CASE l_linestatus WHEN 'O' THEN 'number' ELSE 'string' END END AS emitted,
  CASE WHEN l_linenumber = 1 THEN 'concat' WHEN l_linenumber = 2 THEN 'default' WHEN l_linenumber = 3 THEN 'prefill' ELSE 'usuario' END AS origin,
  CASE WHEN l_linenumber = 1 THEN NULL WHEN l_returnflag = 'A' THEN NULL WHEN l_returnflag = 'N' THEN 'p.' || l_partkey ELSE 's.' || l_suppkey END AS out_path,
  CASE WHEN l_returnflag = 'R' THEN '<radio: ' || l_partkey || CASE WHEN l_suppkey <> l_partkey THEN ' | ' || l_suppkey ELSE '' END || CASE WHEN l_linenumber <> l_partkey AND l_linenumber <> l_suppkey THEN ' | ' || l_linenumber ELSE '' END || '>'
    WHEN l_returnflag = 'N' THEN '<date dd/MM/yyyy>' ELSE '<select: 1 | 2 | 3 | 4 | 5 | 6' || CASE WHEN l_linenumber > 6 THEN ' | …' ELSE '' END || '>' END AS sample
FROM lineitem""")
def field_values(spark, sf):
    li = read(spark, sf, "lineitem")
    rf, ln = F.col("l_returnflag"), F.col("l_linenumber")
    rect = C.rect_norm(F.col("l_quantity"), F.col("l_partkey") / 10.0, F.col("l_suppkey"), ln)
    whole = C.rect_norm(F.col("l_quantity"), F.col("l_partkey") / 10.0, F.col("l_suppkey"), ln, rounded=True)
    type_ = F.when(rf == "A", "checkbox").when(rf == "N", "date").otherwise("select")
    shown = F.when(rf == "R", "radio").when(rf == "N", "date").otherwise("select")
    none = F.array().cast("array<string>")
    values = F.when(rf == "R", F.array(*[F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_partkey")])).otherwise(none)
    options = F.transform(F.sequence(F.lit(1), F.greatest(ln, F.lit(6))), lambda i: i.cast("string"))
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", rect.x.alias("x"), rect.y.alias("y"), rect.width.alias("w"), whole.height.alias("h"),
        P.emitted_type(type_, F.when(F.col("l_linestatus") == "O", "number"), F.lit(None).cast("string")).alias("emitted"),
        P.value_origin(ln == 1, F.when(ln == 2, "x"), F.when(ln <= 3, "k")).alias("origin"),
        P.output_path(ln == 1, F.when(rf == "A", "").when(rf == "N", F.concat(F.lit("p."), "l_partkey")), F.concat(F.lit("s."), "l_suppkey")).alias("out_path"),
        P.sample_value(shown, values, options, F.lit(None).cast("string")).alias("sample"))


@family.query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, part, fmt, CASE WHEN pos0 = 0 THEN true ELSE s = pos0 - 1 AND e = pos0 - 1 + size END AS ok,
  CASE WHEN pos0 > 0 THEN pos0 - 1 END AS expected_start, substr(sample, s + 1, e - s) AS got, CASE WHEN pos0 > 0 THEN substr(sample, pos0, size) END AS expected
FROM (SELECT *, CASE part WHEN 'dia' THEN instr(fmt, 'DD') WHEN 'mes' THEN instr(fmt, 'MM') ELSE instr(fmt, 'YYYY') END AS pos0, CASE part WHEN 'anio' THEN 4 ELSE 2 END AS size,
  replace(replace(replace(fmt, 'YYYY', '2026'), 'DD', '28'), 'MM', '09') AS sample
FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'dia' WHEN 'N' THEN 'mes' ELSE 'anio' END AS part, CASE l_linenumber % 3 WHEN 0 THEN 'DD/MM/YYYY' WHEN 1 THEN 'YYYY-MM-DD' ELSE 'MM.YY' END AS fmt,
  (l_quantity % 9)::INT AS s, (l_quantity % 9)::INT + CASE WHEN l_linestatus = 'O' THEN 2 ELSE 4 END AS e FROM lineitem))""")
def date_slices(spark, sf):
    rf, ln = F.col("l_returnflag"), F.col("l_linenumber")
    part = P.date_part_of_id(F.when(rf == "A", "f_dia").when(rf == "N", "F_MES").otherwise("f_ano"))
    fmt = F.when(ln % 3 == 0, "DD/MM/YYYY").when(ln % 3 == 1, "YYYY-MM-DD").otherwise("MM.YY")
    start = (F.col("l_quantity") % 9).cast("int")
    check = P.date_slice_check(part, fmt, start, start + F.when(F.col("l_linestatus") == "O", 2).otherwise(4))
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", part.alias("part"), fmt.alias("fmt"), check.ok.alias("ok"),
        check.expected_start.alias("expected_start"), check.got.alias("got"), check.expected.alias("expected"))


@family.query("SELECT doc_id, source, lang FROM documents WHERE contains(lower(source || ' ' || lang || ' ' || text), 'und der') AND lang = 'de'")
def search_documents(spark, sf):
    d = read(spark, sf, "documents").where("lang = 'de'")
    return d.where(C.search_filter(F.concat_ws(" ", "source", "lang", "text"), " UND der ")).select("doc_id", "source", "lang")




@family.query("""
WITH c AS (SELECT *, c_custkey % 4 AS k, c_nationkey % 3 AS f FROM customer), d AS (SELECT *, CASE f WHEN 0 THEN 'vida colectiva' WHEN 1 THEN 'vida universal' END AS product,
  CASE WHEN k = 0 AND f = 0 THEN c_name WHEN k = 0 AND f = 1 THEN 'no se llena' WHEN k = 0 THEN 'Vida Colectiva: ' || c_name || ' / Vida universal: no se llena' WHEN k = 1 THEN 'a/b' WHEN k = 2 THEN '' ELSE 'No se llena en PDF' END AS shown,
  CASE c_custkey % 5 WHEN 0 THEN 'todos' WHEN 1 THEN 'vida universal' ELSE '' END AS scope FROM c)
SELECT c_custkey, product, shown, NOT (product IS NOT NULL AND scope = 'vida universal' AND product <> scope) AND shown <> '' AND NOT shown ILIKE '%no se llena%' AS printed FROM d""")
def rows_of_a_pdf(spark, sf):
    k = F.col("c_custkey") % 4
    label = (F.when(k == 0, F.concat(F.lit("Vida Colectiva: "), "c_name", F.lit(" / Vida universal: no se llena"))).when(k == 1, "a/b").when(k == 2, "").otherwise("No se llena en PDF"))
    f = F.col("c_nationkey") % 3
    file = F.when(f == 0, "1009052 Vida  Colectiva.pdf").when(f == 1, "VidaUniversal_2.pdf").otherwise("otro.pdf")
    scope = F.when(F.col("c_custkey") % 5 == 0, "Todos").when(F.col("c_custkey") % 5 == 1, "Vida Universal").otherwise("")
    return read(spark, sf, "customer").select("c_custkey", C.product_of_file(file).alias("product"), C.name_for_product(label, file).alias("shown"),
                                              C.printed_in(label, scope, file).alias("printed"))


# Widget types, notes, prefill modes and path lists of the orders.
_TEXTS = """SELECT o_orderkey AS ord, CASE o_orderkey % 7 WHEN 0 THEN 'textfield' WHEN 1 THEN 'checkbox2' WHEN 2 THEN 'radiogroup' WHEN 3 THEN 'combobox' WHEN 4 THEN 'listbox' WHEN 5 THEN 'pushbutton' ELSE 'other' END AS widget,
  CASE o_custkey % 4 WHEN 0 THEN concat('Concatenar automático ', o_custkey) WHEN 1 THEN 'concatena auto' WHEN 2 THEN concat('auto ', o_custkey) END AS obs,
  CASE o_custkey % 5 WHEN 0 THEN 'Obligatorio' WHEN 1 THEN 'es OPCIONAL' WHEN 2 THEN 'No prellenar' WHEN 3 THEN '' END AS mode, o_orderkey % 2 = 0 AS required,
  CASE o_orderkey % 3 WHEN 0 THEN concat('datos.personas.', lower(o_orderstatus)) WHEN 1 THEN 'datos.personas[3].x' ELSE 'cliente.x[12].y[]' END AS main,
  CASE o_orderkey % 4 WHEN 0 THEN 'personas.z|cliente.w' WHEN 1 THEN 'cliente.w' ELSE '' END AS secondary, CASE o_orderkey % 5 WHEN 0 THEN 'asegurado_' WHEN 1 THEN 'beneficiario_3_' ELSE 'dme_' END AS prefix FROM @orders"""


@family.query(f"""
WITH t AS (SELECT *, CASE prefix WHEN 'asegurado_' THEN 'personas[0]' WHEN 'beneficiario_3_' THEN 'personas[3]' ELSE 'personas' END AS person FROM {duck(_TEXTS)})
SELECT ord, CASE widget WHEN 'textfield' THEN 'text' WHEN 'checkbox2' THEN 'checkbox' WHEN 'radiogroup' THEN 'radio' WHEN 'combobox' THEN 'select' WHEN 'listbox' THEN 'select' WHEN 'pushbutton' THEN 'button' ELSE 'other' END AS widget_type,
  coalesce(starts_with(obs, 'C') OR obs = 'concatena auto', false) AS computed,
  CASE mode WHEN 'Obligatorio' THEN 'required' WHEN 'es OPCIONAL' THEN 'optional' WHEN 'No prellenar' THEN 'none' ELSE CASE WHEN required THEN 'required' ELSE 'optional' END END AS prefill,
  CASE ord % 3 WHEN 0 THEN replace(main, 'personas', person) ELSE main END AS main, CASE ord % 4 WHEN 0 THEN person || '.z | cliente.w' WHEN 1 THEN 'cliente.w' ELSE '' END AS secondary,
  person = 'personas' AND (ord % 3 = 0 OR ord % 4 = 0) AS warning, regexp_replace(main, '\\[\\d*\\]', '[]', 'g') AS plain FROM t""")
def field_texts(spark, sf):
    p = P.index_paths(F.col("main"), F.col("secondary"), F.col("prefix"))
    return spark_table(spark, sf, _TEXTS).select("ord", C.simple_widget_type("widget").alias("widget_type"), C.computed_concat("obs").alias("computed"),
                                                 C.prefill_mode_text("mode", F.col("required")).alias("prefill"), p.main.alias("main"), p.secondary.alias("secondary"),
                                                 F.coalesce(p.warning, F.lit(False)).alias("warning"), P.normal_path("main").alias("plain"))
