"""Audit rules over form fields made of the orders (form = customer)."""

from __future__ import annotations

from pyspark.sql import functions as F

from formspark.operators import json_paths as J
from formspark.operators.rules.registry import hit
from formspark.operators.rules import RULES, Model, audit, checks, finding_order, form_rules, run_rules, with_titles
from formspark.plans.registry import Family
from formspark.plans.tables import FORM_FIELDS, FORM_WIDGETS, duck, read, spark_table, stored

family = Family()
FF = duck(FORM_FIELDS)
WW = duck(FORM_WIDGETS)


def model(spark, sf) -> Model:
    return Model(spark_table(spark, sf, FORM_FIELDS), spark_table(spark, sf, FORM_WIDGETS))


def stored_model(spark, sf) -> Model:
    """for runs of many rules, which read the fields many times"""
    return Model(stored(spark_table(spark, sf, FORM_FIELDS)), stored(spark_table(spark, sf, FORM_WIDGETS)))


def _sql(rule: str, source: str, field: str = "id", subject: str = "NULL", path: str = "NULL") -> str:
    from formspark.operators.rules.registry import TITLES
    return (f"SELECT form_id, '{rule}' AS rule, '{TITLES[rule][0]}' AS severity, {field} AS field_id, {subject}::VARCHAR AS subject, {path}::VARCHAR AS path "
            f"FROM ({source})")


_OWN = f"(SELECT * FROM {FF} WHERE in_repeater IS NULL)"
_ASID = "trim(regexp_replace(lower(source_name), '[^a-z0-9]+', '_', 'g'), '_')"
_COND = "CASE WHEN json_valid({0}) THEN {0} END"
_CV, _CR = _COND.format("condition_visibility"), _COND.format("condition_required")


def _same(want: str) -> str:
    return (f"(lower(id) = {want} OR strip_accents(lower(id)) = strip_accents({want}) OR "
            f"((hidden OR concat IS NOT NULL) AND starts_with(lower(id), {want} || '_')))")


_CMP = f"""(SELECT form_id, f AS id, v AS text FROM (SELECT form_id, unnest(json_extract_string({_CV}, '$.conditions[*].fieldId')) f, unnest(json_extract_string({_CV}, '$.conditions[*].operator')) o, unnest(json_extract_string({_CV}, '$.conditions[*].value')) v FROM {FF}) WHERE o = 'equals'
  UNION SELECT form_id, f, v FROM (SELECT form_id, unnest(json_extract_string({_CR}, '$.conditions[*].fieldId')) f, unnest(json_extract_string({_CR}, '$.conditions[*].value')) v FROM {FF})
  UNION SELECT form_id, json_extract_string(concat, '$.parts[0].condition.fieldId'), json_extract_string(concat, '$.parts[0].condition.values') FROM {FF} WHERE concat IS NOT NULL)"""
_WRITERS = f"(SELECT form_id, id, type, json_value, coalesce(json_output_path, salida_json) AS p FROM {_OWN} WHERE NOT exclude AND coalesce(json_output_path, salida_json, '') <> '')"
_DATE = f"""SELECT form_id, id, CASE WHEN part = 'dia' THEN instr(fmt, 'DD') WHEN instr(fmt, 'YYYY') > 0 THEN instr(fmt, 'YYYY') ELSE instr(fmt, 'AAAA') END AS p, CASE part WHEN 'dia' THEN 2 ELSE 4 END AS n, s, e,
  replace(replace(replace(replace(fmt, 'YYYY', '2026'), 'AAAA', '2026'), 'DD', '28'), 'MM', '09') AS ex
  FROM (SELECT form_id, id, CASE WHEN ends_with(id, '_dia') THEN 'dia' ELSE 'anio' END AS part, json_extract(concat, '$.parts[0].transforms[0].start')::INT AS s, json_extract(concat, '$.parts[0].transforms[0].end')::INT AS e FROM {FF} WHERE concat IS NOT NULL AND regexp_matches(id, '_(dia|ano)$')) c
  JOIN (SELECT form_id, arg_max(coalesce(pdf_date_format, date_format, 'DD/MM/YYYY'), ord) AS fmt FROM {_OWN} WHERE id = 'field_titular_fecha' GROUP BY 1) d USING (form_id)"""

SQL = {
    "R01": _sql("R01", f"SELECT *, {_ASID} AS b FROM {FF} WHERE coalesce(source_name, '') <> '' AND NOT ({_same(chr(39) + 'field_' + chr(39) + ' || ' + _ASID)} OR {_same(chr(39) + 'field_' + chr(39) + ' || lower(source_name)')})", subject="'field_' || b"),
    "R02": _sql("R02", f"SELECT form_id, id, count(*) AS n FROM {_OWN} GROUP BY ALL HAVING count(*) > 1", subject="n"),
    "R03": _sql("R03", f"SELECT * FROM (SELECT form_id, id, unnest(list_concat(coalesce(json_extract_string({_CV}, '$.conditions[*].fieldId'), []), coalesce(json_extract_string({_CR}, '$.conditions[*].fieldId'), []))) AS ref FROM {_OWN}) WHERE ref <> 'field_NEVER_EXISTS' AND (form_id, ref) NOT IN (SELECT (form_id, id) FROM {_OWN})", subject="ref"),
    "R04": _sql("R04", f"SELECT * FROM {FF} WHERE salida_json IS DISTINCT FROM json_output_path", subject="coalesce(json_output_path, 'ninguna')"),
    "R05": _sql("R05", f"SELECT * FROM {FF} WHERE has_repeater AND (coalesce(json_output_path, '') <> '' OR coalesce(salida_json, '') <> '')"),
    "R06": _sql("R06", f"SELECT * FROM {FF} WHERE has_repeater AND slot_pattern IS NULL"),
    "R07": _sql("R07", f"SELECT * FROM {FF} WHERE has_repeater AND slot_pattern LIKE '%{{i1}}%'", subject="slot_pattern"),
    "R08": _sql("R08", f"SELECT *, json_extract_string(concat, '$.parts[0].condition.fieldId') AS ref FROM {FF} WHERE concat IS NOT NULL AND NOT list_contains(json_extract_string(concat, '$.sourceFieldIds[*]'), json_extract_string(concat, '$.parts[0].condition.fieldId'))", subject="ref"),
    "R09": _sql("R09", f"SELECT * FROM {FF} WHERE native_type IN ('Checkbox', 'RadioGroup') AND checked_pdf_value <> 'X'", subject="checked_pdf_value"),
    "R10": _sql("R10", f"""SELECT DISTINCT o.form_id, o.id FROM {FF} o WHERE type = 'select' AND options IS NOT NULL AND coalesce(prefill_key, '') <> '' AND (o.form_id, o.id, 'Si') IN (SELECT (form_id, id, text) FROM {_CMP})
        AND (o.form_id, o.id, '1') NOT IN (SELECT (form_id, id, text) FROM {_CMP} WHERE text IS NOT NULL AND id IS NOT NULL)""", subject="'Si / 1'"),
    "R11": _sql("R11", f"SELECT * FROM {FF} WHERE hidden AND concat IS NULL AND coalesce(default_value, '') <> '' AND coalesce(try_cast(regexp_extract(coalesce(json_output_path, salida_json, ''), 'personas\\[(\\d+)\\]', 1) AS INT), 0) > 0", path="json_output_path"),
    "R12": _sql("R12", f"""SELECT w.*, n FROM {_WRITERS} w JOIN (SELECT form_id, p, count(*) AS n, count(DISTINCT CASE WHEN type IN ('radio', 'checkbox') THEN nullif(json_value, '') END) AS v,
        count(*) FILTER (type IN ('radio', 'checkbox') AND coalesce(json_value, '') <> '') AS o FROM {_WRITERS} GROUP BY ALL) g USING (form_id, p) WHERE n > 1 AND NOT (o = n AND v = n)""", subject="n", path="p"),
    "R13": _sql("R13", f"SELECT * FROM {FF} WHERE coalesce(source_name, '') <> '' AND type <> 'signature' AND concat IS NULL AND coalesce(prefill_key, '') = '' AND coalesce(json_output_path, '') = '' AND hidden"),
    "R14": _sql("R14", f"SELECT * FROM {FF} WHERE prefill_mode = 'api'"),
    "R15": _sql("R15", f"SELECT * FROM {FF} WHERE NOT hidden AND NOT hidden_effective AND label = 'Informacion de la poliza'", subject="'Información de la póliza'"),
    "R16": _sql("R16", f"SELECT * FROM {FF} WHERE regexp_matches(coalesce(json_output_path, salida_json, ''), '\\.descripcion[A-Z]') AND concat IS NULL AND coalesce(prefill_key, '') = '' AND default_value IS NULL", path="json_output_path"),
    "R17": _sql("R17", f"SELECT * FROM {FF} WHERE json_output_path LIKE '%.edad' AND concat IS NULL"),
    "R18": _sql("R18", f"SELECT * FROM (SELECT form_id, id, unnest([parent_id, grandparent_id]) AS p FROM {FF}) WHERE p <> '' AND split_part(regexp_replace(id, '^field_', ''), '_', 1) <> split_part(regexp_replace(p, '^field_', ''), '_', 1)", subject="p"),
    "R19": _sql("R19", f"SELECT * FROM ({_DATE}) WHERE NOT (p = 0 OR (s = p - 1 AND e = p - 1 + n))", subject="substr(ex, s + 1, e - s) || ' / ' || substr(ex, p, n)"),
    "R20": _sql("R20", f"SELECT * FROM {FF} WHERE json_output_path LIKE '%.nombreCompleto' AND concat IS NOT NULL AND (NOT read_only OR coalesce(prefill_key, '') <> '')"),
    "R21": _sql("R21", f"SELECT * FROM (SELECT form_id, id, unnest(json_extract_string(radio_fields, '$[*]')) AS ref FROM {FF}) WHERE (form_id, ref) NOT IN (SELECT (form_id, id) FROM {_OWN})", subject="ref"),
    "R22": _sql("R22", f"SELECT form_id FROM {FF} GROUP BY 1 HAVING NOT bool_or(type = 'signature')", field="NULL"),
    "R23": _sql("R23", f"SELECT form_id, min(section_ord) FILTER (coalesce(section_title, section_id) ILIKE '%declaracion%') AS d FROM {FF} GROUP BY 1 HAVING min(section_ord) FILTER (coalesce(section_title, section_id) ILIKE '%declaracion%') < max(section_ord)", field="NULL", subject="d"),
    "R24": _sql("R24", f"SELECT *, 'asegurado: ' || CASE WHEN condition_visibility LIKE '%\"DME\"%' THEN 'DMA' ELSE 'DME, DMA' END AS lack FROM {FF} WHERE condition_visibility LIKE '%\"or\"%'", subject="lack"),
    "R25": _sql("R25", f"SELECT form_id, count(*) AS n FROM {WW} WHERE (form_id, name) NOT IN (SELECT (form_id, source_name) FROM {FF} WHERE source_name IS NOT NULL) GROUP BY 1", field="NULL", subject="n"),
    "R26": _sql("R26", f"SELECT form_id, id, 'Sexo' AS f FROM {FF} WHERE NOT hidden AND NOT hidden_effective AND label = 'Género' UNION ALL SELECT form_id, id, 'sexo y Sexo' FROM {FF} WHERE NOT hidden AND NOT hidden_effective AND radio_label IS NOT NULL", subject="f"),
}


def _rule_query(rule: str):
    def run(spark, sf):
        return RULES[rule](model(spark, sf))
    run.__name__ = f"rule_{rule.lower()}_{RULES[rule].__name__}"
    return run


for _rule in SQL:
    family.query(SQL[_rule])(_rule_query(_rule))


@family.query("SELECT rule, severity, count(*) AS n FROM (" + " UNION ALL ".join(SQL.values()) + ") GROUP BY ALL")
def rule_summary(spark, sf):
    findings = run_rules(stored_model(spark, sf))
    return with_titles(findings).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


_X01 = f"""SELECT form_id, 'X01' AS rule, 'nota' AS severity, id AS field_id, NULL AS subject, NULL AS path FROM {FF} WHERE json_value LIKE 'B%' AND try_cast(substr(json_value, 2) AS INT) >= 3
  UNION ALL SELECT form_id, 'R00', 'aviso', id, 'X01: unreadable row', NULL FROM {FF} WHERE json_value = 'A'"""


@family.query(f"""SELECT *, row_number() OVER (PARTITION BY form_id ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'aviso' THEN 1 ELSE 2 END, rule, coalesce(field_id, ''), coalesce(subject, ''), coalesce(path, '')) AS place
FROM ({SQL["R02"]} UNION ALL {SQL["R13"]} UNION ALL {SQL["R14"]} UNION ALL {_X01})""")
def ordered_findings(spark, sf):
    """findings in order, among them those of a rule that cannot read some of the rows"""
    digits = F.substr("json_value", F.lit(2))
    over = (lambda: hit(digits.cast("int") >= 3), lambda: F.col("json_value").isNull() | digits.try_cast("int").isNotNull())
    return finding_order(run_rules(model(spark, sf), only=["R02", "R13", "R14"], more={"X01": over}))


# Rows that rules cannot read: texts cut off or of another shape, lists that are none.
_HOSTILE = {"concat": """CASE WHEN ord % 7 = 0 THEN '{"parts":5}' WHEN ord % 7 = 1 THEN '[1' ELSE concat END""", "options": """CASE WHEN ord % 5 = 0 THEN '{"a":1}' ELSE options END""",
            "radio_fields": "CASE WHEN ord % 11 = 0 THEN '7' ELSE radio_fields END", "condition_visibility": """CASE WHEN ord % 13 = 0 THEN '{"conditions":7}' WHEN ord % 13 = 1 THEN 'oops' ELSE condition_visibility END"""}
_LOST = {"ord % 7 < 2": ("concat", "'R08', 'R10', 'R19'"), "ord % 5 = 0": ("options", "'R10'"), "ord % 11 = 0": ("radio_fields", "'R21'"), "ord % 13 = 0": ("condition_visibility", "'R03', 'R10', 'R24'")}


@family.query(" UNION ALL ".join(f"SELECT form_id, 'R00' AS rule, id AS field_id, r || ': unreadable {c}' AS subject FROM {FF}, unnest([{rules}]) t(r) WHERE {when}" for when, (c, rules) in _LOST.items())
              + f" UNION ALL SELECT form_id, rule, field_id, subject FROM ({SQL['R02']})")
def unreadable_rows(spark, sf):
    """the audit goes on beside rows that some of its rules cannot read"""
    m = stored_model(spark, sf)
    hostile = Model(m.fields.withColumns({c: F.expr(x) for c, x in _HOSTILE.items()}), m.widgets)
    return run_rules(hostile).where(F.col("rule").isin("R00", "R02")).select("form_id", "rule", "field_id", "subject")


_P = f"(SELECT *, coalesce(nullif(salida_json, ''), nullif(json_output_path, '')) AS main FROM {FF})"
_OUT = f"""(SELECT form_id, ord, main AS path, id AS field_id, false AS secondary, type, json_value FROM {_P} WHERE main IS NOT NULL AND NOT exclude
  UNION ALL SELECT form_id, ord, secondary_path, id, true, type, json_value FROM {_P} WHERE secondary_path <> '' AND NOT exclude
  UNION ALL SELECT form_id, ord, main || '[0].' || s, id || '.' || s, false, type, json_value FROM {_P}, unnest(['n', 'm']) t(s) WHERE has_repeater AND main IS NOT NULL)"""


def _outputs(m: Model):
    subs = F.when(F.col("has_repeater"), F.array(F.lit("n"), F.lit("m")))
    return J.output_paths(m.fields.withColumn("repeater_subfields", subs))


@family.query(f"SELECT form_id, path, count(*) AS writers, bool_or(secondary) AS secondary, arg_min(field_id, (ord, field_id)) AS first_field, count(nullif(json_value, '')) AS n_values FROM {_OUT} GROUP BY ALL")
def output_paths(spark, sf):
    return J.path_summary(_outputs(model(spark, sf)))


@family.query(f"""SELECT form_id, ord, id AS field_id, trim(CASE WHEN contains(k, '==') THEN split_part(k, '==', 1) ELSE k END) AS path, CASE WHEN contains(k, '==') THEN '==' || split_part(k, '==', 2) END AS condition
FROM (SELECT *, prefill_key AS k FROM {FF}) WHERE k <> ''""")
def input_paths(spark, sf):
    return J.input_paths(model(spark, sf).fields, ["prefill_key"])


@family.query(f"""SELECT DISTINCT form_id, id, ref FROM (SELECT form_id, ord, id, unnest(list_concat(coalesce(json_extract_string({_CV}, '$.conditions[*].fieldId'), []), coalesce(json_extract_string({_CR}, '$.conditions[*].fieldId'), []),
  coalesce(json_extract_string(concat, '$.sourceFieldIds[*]'), []), coalesce(json_extract_string(concat, '$.parts[*].fieldId'), []), coalesce(json_extract_string(concat, '$.parts[*].condition.fieldId'), []),
  coalesce(json_extract_string(radio_fields, '$[*]'), []), [parent_id, grandparent_id])) AS ref FROM {FF}) WHERE ref <> ''""")
def field_references(spark, sf):
    return J.field_refs(model(spark, sf).fields).distinct()


_CONFLICT = f"""(WITH w AS (SELECT DISTINCT form_id, path FROM {_OUT}), r AS (SELECT DISTINCT form_id, main AS path, true AS rep FROM {_P} WHERE has_repeater AND main IS NOT NULL)
SELECT a.form_id, a.path, min(b.path) AS child FROM w a LEFT JOIN r ON a.form_id = r.form_id AND a.path = r.path JOIN w b ON a.form_id = b.form_id AND
  (starts_with(b.path, a.path || '.') OR (starts_with(b.path, a.path || '[') AND rep IS NULL)) GROUP BY ALL)"""


@family.query(f"""SELECT form_id, rule, CASE severity WHEN 'error' THEN 'critical' WHEN 'aviso' THEN 'warning' ELSE 'info' END AS severity, field_id, subject, path FROM ({' UNION ALL '.join(SQL.values())})
UNION ALL SELECT form_id, 'C1', 'critical', NULL, child, path FROM {_CONFLICT}
UNION ALL SELECT form_id, 'C2', 'warning', id, NULL, NULL FROM {_P} WHERE main IS NULL AND NOT exclude AND type NOT IN ('header', 'paragraph')""")
def form_audit(spark, sf):
    m = stored_model(spark, sf)
    outputs = _outputs(m)
    main = F.coalesce(F.nullif("salida_json", F.lit("")), F.nullif("json_output_path", F.lit("")))
    repeaters = m.fields.where(F.col("has_repeater") & main.isNotNull()).select("form_id", main.alias("path"))
    return audit(m, J.path_prefix_conflict(outputs, repeaters), J.no_output(m.fields))


def _union(*parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@family.query(f"""
SELECT form_id, 'V1' AS "check", id AS item, source_name AS reason FROM {FF} WHERE source_name IS NOT NULL AND (form_id, source_name) NOT IN (SELECT (form_id, name) FROM {WW})
UNION ALL SELECT form_id, 'V2', id, CASE WHEN starts_with(id, 'field_') THEN 'empty' ELSE 'no prefix' END FROM {FF} WHERE NOT starts_with(id, 'field_') OR id = 'field_'
UNION ALL SELECT form_id, 'V3', id, (count(*) - 1)::VARCHAR FROM {FF} GROUP BY form_id, id HAVING count(*) > 1
UNION ALL SELECT DISTINCT form_id, 'V4', name, NULL FROM {WW} WHERE (form_id, name) NOT IN (SELECT (form_id, source_name) FROM {FF} WHERE source_name IS NOT NULL)
  AND (form_id, name) NOT IN (SELECT (form_id, 'titular_fecha') FROM {FF} WHERE concat IS NOT NULL)
UNION ALL SELECT form_id, 'V5', id, checked_pdf_value FROM {FF} WHERE type = 'checkbox' AND source_name IS NOT NULL AND checked_pdf_value = 'X'
UNION ALL SELECT form_id, 'V6', id || '.condition_visibility', 'invalid JSON' FROM {FF} WHERE condition_visibility = 'oops'
UNION ALL SELECT form_id, 'V6', id || '.condition_visibility', 'benef_nombre' FROM {FF} WHERE condition_visibility LIKE '%"benef_nombre"%'""")
def definition_checks(spark, sf):
    m = stored_model(spark, sf)
    return _union(checks.source_names_exist(m.fields, m.widgets), checks.id_convention(m.fields), checks.duplicate_ids(m.fields),
                  checks.unpainted_names(m.fields, m.widgets), checks.checkbox_values(m.fields), checks.condition_format(m.fields))


@family.query(f"""
SELECT form_id, ord, id, CASE WHEN field_order = 0 THEN 1 ELSE field_order END AS field_order,
  replace(replace(condition_visibility, '"benef_nombre"', '"field_benef_nombre"'), '"is"', '"not_empty"') AS condition_visibility,
  CASE WHEN type = 'checkbox' AND source_name IS NOT NULL AND checked_pdf_value = 'X' THEN 'true' ELSE checked_pdf_value END AS checked_pdf_value,
  array_to_string(list_filter([CASE WHEN field_order = 0 THEN 'order' END, CASE WHEN condition_visibility LIKE '%"benef_nombre"%' THEN 'condition' END,
    CASE WHEN type = 'checkbox' AND source_name IS NOT NULL AND checked_pdf_value = 'X' THEN 'checked' END], lambda x: x IS NOT NULL), ',') AS fixes FROM {FF}""")
def definition_fixes(spark, sf):
    return checks.output_fixes(model(spark, sf).fields).withColumn("fixes", F.array_join("fixes", ","))


@family.query(f"""SELECT form_id, 'V10' AS "check", 'low_label_coverage' AS item, bare || '/' || n AS reason FROM
(SELECT form_id, count(*) AS n, count(*) FILTER (label = '') AS bare FROM {WW} GROUP BY 1) WHERE bare > n * 0.4""")
def label_coverage(spark, sf):
    return checks.low_label_coverage(model(spark, sf).widgets)


@family.query(f"SELECT form_id, ord, name FROM {WW} WHERE (form_id, name) NOT IN (SELECT (form_id, source_name) FROM {FF} WHERE source_name IS NOT NULL)")
def unused_sources(spark, sf):
    return form_rules.unused_sources(model(spark, sf)).select("form_id", "ord", "name")


# Rows of a mapping, with sections, paths and catalogs that are partly missing. Form = brand.
_RUN = """SELECT p_brand AS form_id, p_partkey AS ord, CASE p_size % 4 WHEN 0 THEN 'asegurado_' WHEN 1 THEN 'beneficiario_2_' WHEN 2 THEN 'dme_' ELSE '' END AS section_prefix,
  CASE p_partkey % 4 WHEN 0 THEN concat('datos.personas.', p_type) WHEN 1 THEN 'datos.personas[0].x' WHEN 2 THEN concat('cliente.', p_type) END AS path,
  CASE p_partkey % 5 WHEN 0 THEN 'sexo' WHEN 1 THEN 'otro' END AS group_name, CASE p_partkey % 3 WHEN 0 THEN 'Tipo de Identificación' WHEN 1 THEN 'Moneda' ELSE p_name END AS label,
  CASE p_size % 3 WHEN 0 THEN 'Moneda' WHEN 1 THEN '' END AS catalog_name FROM @part"""


@family.query(f"""SELECT form_id, type, count(*) AS n FROM (SELECT form_id, unnest([CASE WHEN path LIKE '%.personas.%' AND section_prefix IN ('dme_', '') THEN 'paths_sin_indice' END,
  CASE WHEN (group_name = 'sexo' OR label IN ('Tipo de Identificación', 'Moneda')) AND coalesce(catalog_name, '') = '' THEN 'sin_catalogo' END]) AS type FROM {duck(_RUN)}
  UNION ALL SELECT form_id, 'rename_errors' FROM {duck(_RUN)} WHERE label = 'Moneda' AND group_name IS NULL) WHERE type IS NOT NULL GROUP BY ALL""")
def run_warnings(spark, sf):
    rows = spark_table(spark, sf, _RUN)
    return checks.run_warnings(rows, rows.where("label = 'Moneda' AND group_name IS NULL"), read(spark, sf, "nation"))
