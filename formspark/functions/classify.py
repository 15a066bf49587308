"""Types, flags, formats and other classifications of a field."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from formspark import constants as K
from formspark.functions.text import (col, fold, fold_upper, let, norm_compact, replace, squeeze, strip_accents,
                                      text_or_empty, trim)


def lookup(table: dict[str, object], key: Column) -> Column:
    """A fixed table as a literal map: no join, nothing to broadcast."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[key]


def first_match(c: Column, rules: list[tuple[str, object]], default: Column) -> Column:
    """Value of the first pattern found in ``c``."""
    out = None
    for pattern, value in rules:
        out = F.when(c.rlike(pattern), F.lit(value)) if out is None else out.when(c.rlike(pattern), F.lit(value))
    return out.otherwise(default)


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, NULL when the pattern does not match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


# ---- types -------------------------------------------------------------------------

def map_type(c: Column | str) -> Column:
    return first_match(strip_accents(F.lower(text_or_empty(c))), K.TYPE_PATTERNS, F.lit("text"))


def map_type_exact(c: Column | str) -> Column:
    """exact type name; NULL when unknown (the field then keeps its type)"""
    return lookup(K.TYPE_NAMES, strip_accents(F.lower(trim(text_or_empty(c)))))


def mapping_type(data_type: Column, native_type: Column, group: Column, has_options: Column) -> Column:
    """type of a mapping row: data type, native type, group, options, text"""
    return F.coalesce(lookup(K.MAPPING_TYPE_NAMES, data_type), lookup(K.NATIVE_TYPES, trim(text_or_empty(native_type))),
                      F.when(text_or_empty(group) != "", F.lit("radio")), F.when(has_options, F.lit("select")), F.lit("text"))


def enriched_type(fmt: Column, source_name: Column, native: Column, group: Column, has_options: Column) -> Column:
    f, s = F.lower(text_or_empty(fmt)), F.lower(text_or_empty(source_name))
    n, g = trim(text_or_empty(native)), trim(text_or_empty(group))
    return (F.when(f == "fecha", F.lit("date")).when(f.isin("numérico", "numerico"), F.lit("number"))
            .when(s.rlike("_(dia|mes|ano)$"), F.lit("select")).when((n == "Btn") & (g != ""), F.lit("radio"))
            .when(n == "Btn", F.lit("checkbox")).when(has_options, F.lit("select")).otherwise(F.lit("text")))


def form_type(type_: Column, label: Column, json_name: Column) -> Column:
    """type shown on the web form: e-mail and phone by name, then by field type"""
    lab, js = F.lower(text_or_empty(label)), F.lower(text_or_empty(json_name))
    return (F.when(lab.rlike("email|correo") | js.rlike("email|correo"), F.lit("email"))
            .when(lab.rlike("tel[eé]fono|celular|movil|m[oó]vil|phone") | js.rlike("telefono|celular|phone"), F.lit("phone"))
            .when(type_.isin("radio", "checkbox"), F.lit("radio")).when(type_ == "select", F.lit("select"))
            .when(type_ == "number", F.lit("number")).otherwise(F.lit("text")))


def native_type(c: Column | str) -> Column:
    """PDF type of a widget type name: Tx, Ch, Btn, else its first three letters"""
    low = F.lower(text_or_empty(c))
    return (F.when(low == "", F.lit("")).when(low.rlike("text"), F.lit("Tx")).when(low.rlike("check"), F.lit("Ch"))
            .when(low.rlike("radio|button"), F.lit("Btn")).when(low.rlike("select|drop|option"), F.lit("Ch"))
            .otherwise(F.substring(low, 1, 3)))


def native_from_data_type(c: Column | str) -> Column:
    low = F.lower(text_or_empty(c))
    return (F.when(low.rlike("text|alfa|numer|fecha"), F.lit("Tx")).when(low.rlike("combo|select|lista"), F.lit("Ch"))
            .when(low.rlike("radio|check|boton|button"), F.lit("Btn")).otherwise(F.lit("Tx")))


def simple_widget_type(c: Column | str) -> Column:
    low = text_or_empty(c)
    rules = [("text", "text"), ("checkbox", "checkbox"), ("radio", "radio"), ("dropdown|combobox|select", "select"),
             ("optionlist|listbox", "select"), ("button", "button"), ("signature", "signature")]
    return first_match(low, rules, low)


# ---- yes / no -------------------------------------------------------------------------

def yes_no(c: Column | str, variant: str = "required") -> Column:
    """the vocabularies of "yes":
    required  si, sí, yes, true, obligatorio -> true, else false
    spelling  'Si' / 'No' / the text unchanged
    accented  'Sí' / 'No' / ''
    mapping   sí, si, yes, s, x -> true; no, n, '' -> false; else NULL
    enriched  sí, si, yes, s -> true; no, n -> false; else NULL
    plain     si, sí, yes, true, 1
    """
    raw = text_or_empty(c)
    t = F.lower(trim(raw))
    if variant == "required":
        return t.isin("si", "sí", "yes", "true", "obligatorio")
    if variant == "plain":
        return t.isin("si", "sí", "yes", "true", "1")
    if variant == "spelling":
        return F.when(t.isin("si", "sí"), F.lit("Si")).when(t == "no", F.lit("No")).otherwise(raw)
    if variant == "accented":
        return F.when(t.isin("si", "sí"), F.lit("Sí")).when(t == "no", F.lit("No")).otherwise(F.lit(""))
    if variant == "mapping":
        return (F.when(t.isin("sí", "si", "yes", "s", "x"), F.lit(True)).when(t.isin("no", "n", ""), F.lit(False)))
    return F.when(t.isin("sí", "si", "yes", "s"), F.lit(True)).when(t.isin("no", "n"), F.lit(False))


# ---- products ----------------------------------------------------------------------------

def scope_split(c: Column | str) -> Column:
    t = F.lower(trim(text_or_empty(c)))
    parts = F.filter(F.transform(F.split(t, "[,;]"), trim), lambda s: s != "")
    return F.when(t.isin("", "todos", "all") | (F.size(parts) == 0), F.array(F.lit("all"))).otherwise(parts)


def applies_to_form(scope: Column | str, form_code: Column) -> Column:
    """empty or "todos" applies to every form, else a keyword of the form must occur"""
    t = norm_compact(scope)
    hit = F.lit(False)
    for code, words in K.PRODUCT_KEYWORDS.items():
        hit = hit | ((form_code == code) & t.rlike("|".join(words)))
    return (t == "") | t.contains("todos") | hit


def map_product(c: Column | str) -> Column:
    raw = text_or_empty(c)
    t = F.lower(trim(raw))
    return (F.when(t == "", F.lit("")).when(t == "todos", F.lit("TODOS")).when(t.contains("colectiva"), F.lit("VC"))
            .when(t.contains("universal"), F.lit("VU")).when(t.contains("crediticia"), F.lit("PC")).otherwise(raw))


def split_ambiguous(c: Column | str) -> Column:
    """"Form: name / Form: name" as an array of (forms, name)"""
    def part(s: Column) -> Column:
        has = s.rlike(r"^.+?:\s*.+$")
        forms = F.regexp_extract(s, r"^(.+?):\s*(.+)$", 1)
        codes = [("VC", r"(?i)Vida\s+Colectiva"), ("VU", r"(?i)Vida\s+Universal"), ("PC", r"(?i)Protecci[oó]n\s+Crediticia")]
        found = F.array_compact(F.array(*[F.when(has & forms.rlike(rx), F.lit(code)) for code, rx in codes]))
        name = F.when(has, F.regexp_extract(s, r"^(.+?):\s*(.+)$", 2)).otherwise(s)
        return F.struct(found.alias("forms"), trim(name).alias("name"))
    return F.transform(F.split(text_or_empty(c), r"\s*/\s*"), part)


def option_split(c: Column | str) -> Column:
    """"CODE - label" as (code, label); any other value stands for both"""
    rx = r"^([A-Z0-9]{1,6})\s*[-|,]\s*(.+)$"
    c = text_or_empty(c)
    hit = c.rlike(rx)
    return F.struct(F.when(hit, F.regexp_extract(c, rx, 1)).otherwise(c).alias("code"),
                    F.when(hit, trim(F.regexp_extract(c, rx, 2))).otherwise(c).alias("label"))


# ---- validation -------------------------------------------------------------------------

_DATE_SLASH = r"formato\s+dd/?mm/?(aaaa|yyyy)|dd/mm/aaaa"
_DATE_DASH = r"formato\s+dd-mm-(aaaa|yyyy)"
_MAX = r"max(?:imo)?\s*[:=]?\s*(\d+)"


def _number(c: Column) -> Column:
    return c.try_cast("int")


def parse_validation(rule: Column | str, data_type: Column | str) -> Column:
    """(max_length, pattern) told by a rule text"""
    r = fold(rule)
    length = F.coalesce(extract(r, r"(\d+)\s*caract"), extract(r, _MAX))
    pattern = (F.when(r.rlike(_DATE_SLASH), F.lit(K.PATTERN_DATE_SLASH)).when(r.rlike(_DATE_DASH), F.lit(K.PATTERN_DATE_DASH))
               .when(r.rlike(r"solo\s*numeros|only\s*digits"), F.lit(K.PATTERN_DIGITS))
               .when(r.rlike("email|correo") & (text_or_empty(data_type) != ""), F.lit(K.PATTERN_EMAIL))
               .when(r.rlike("alfanum"), F.lit(K.PATTERN_ALNUM)))
    return F.struct(_number(length).alias("max_length"), pattern.alias("pattern"))


def parse_validation_ext(rule: Column | str, field_type: Column) -> Column:
    """the wider rule vocabulary; choice, heading and read-only fields take none"""
    r = fold(rule)
    length = F.coalesce(extract(r, r"(\d+)\s*caract"), extract(r, _MAX), extract(r, r"hasta\s+(\d+)"))
    digits = F.coalesce(extract(r, r"numerico\s+y\s+(\d+)\s*digitos"), extract(r, r"(\d+)\s*digitos?\s*numerico"))
    decimal = r"(\d+)\s*caract.*?(\d+)\s*decimal"
    pattern = (F.when(r.rlike(_DATE_SLASH), F.lit(K.PATTERN_DATE_SLASH)).when(r.rlike(_DATE_DASH), F.lit(K.PATTERN_DATE_DASH))
               .when(digits.isNotNull(), F.concat(F.lit(r"^\d{"), digits, F.lit("}$")))
               .when(r.rlike(r"solo\s*numeros"), F.lit(K.PATTERN_DIGITS))
               .when(r.rlike("email|correo"), F.lit(K.PATTERN_EMAIL)).when(r.rlike("alfanum"), F.lit(K.PATTERN_ALNUM))
               .when(r.rlike(decimal), F.concat(F.lit(r"^\d{1,"), F.regexp_extract(r, decimal, 1), F.lit(r"}(\.\d{1,"),
                                                F.regexp_extract(r, decimal, 2), F.lit("})?$"))))
    skip = field_type.isin("select", "radio", "checkbox", "heading", "readonly")
    return F.struct(F.when(~skip, _number(length)).alias("max_length"), F.when(~skip, pattern).alias("pattern"))


def length_text(rule: Column | str) -> Column:
    """digits before "caracteres" or "dígitos", '' when there are none"""
    raw = text_or_empty(rule)
    return F.coalesce(extract(raw, r"(?i)(\d+)\s*car[aá]cteres"), extract(raw, r"(?i)(\d+)\s*d[ií]gitos"), F.lit(""))


def map_format(c: Column | str) -> Column:
    k = norm_compact(c)
    return (F.when(k == "", F.lit("")).when(lookup(K.FORMATS, k).isNotNull(), lookup(K.FORMATS, k))
            .when(k.contains("fecha"), F.lit("fecha")).when(k.contains("numer"), F.lit("numérico"))
            .when(k.contains("alfanum"), F.lit("alfanumérico")).when(k.rlike("combo|radio|checkbox"), F.lit(""))
            .otherwise(F.lit("alfanumérico")))


def data_type_format(c: Column | str) -> Column:
    t = F.lower(text_or_empty(c))
    return first_match(t, [("numer", "numérico"), ("alfa", "alfanumérico"), ("fecha", "fecha"), ("texto", "texto"),
                           ("correo", "email")], t)


def number_format(c: Column | str) -> Column:
    f = F.lower(text_or_empty(c))
    n = K.NUMBER_FORMATS
    return (F.when(f.rlike("monto|moneda|currency"), F.lit(n["monto"])).when(f.rlike("porcentaje|%"), F.lit(n["porcentaje"]))
            .when(f.rlike("entero|integer") | f.isin("numérico", "numerico", "numero"), F.lit(n["entero"])))


# ---- flags ---------------------------------------------------------------------------------

def ficha_flags(required: Column, step: Column, visualization: Column, rule: Column, route: Column) -> Column:
    req, vis = fold_upper(required), fold_upper(visualization)
    return F.struct(
        ((req == "JSON") | (fold_upper(step) == "JSON")).alias("json_only"), (req == "WEB").alias("web_only"),
        vis.contains("NO APLICA").alias("hidden"), vis.contains("DISABLED").alias("read_only"),
        vis.contains("DATO PRELLENADO").alias("prefill"),
        squeeze(text_or_empty(rule)).rlike(r"(?i)no aplica\s+formulario").alias("excluded"),
        (F.trim(squeeze(text_or_empty(route))) == "").alias("is_label"))


def ficha_dest(flags: Column) -> Column:
    order = [("excluded", "excluido"), ("is_label", "label"), ("json_only", "soloJSON"), ("web_only", "soloWeb"),
             ("hidden", "oculto"), ("read_only", "readOnly")]
    return F.coalesce(*[F.when(flags[flag], F.lit(name)) for flag, name in order], F.lit("normal"))


def visibility_flags(visualization: Column | str, read_only: Column, hidden: Column) -> Column:
    """(read_only, hidden) after the visualisation text was applied to the field"""
    v = F.lower(text_or_empty(visualization))
    disabled = v.contains("disabled")
    ro = F.when(disabled, F.lit(True)).when(v.contains("editable"), F.lit(False)).otherwise(read_only)
    hide = (disabled & v.rlike(r"no\s*visible")) | v.rlike(r"no\s*aplica") | hidden
    return F.struct(ro.alias("read_only"), hide.alias("hidden"))


def matrix_flags(visualization: Column | str) -> Column:
    v = text_or_empty(visualization)
    return F.struct(v.rlike("(?i)lectura|readonly|solo lectura").alias("read_only"),
                    v.rlike("(?i)oculto|hidden|no visible").alias("hidden"))


def computed_concat(obs: Column | str) -> Column:
    return text_or_empty(obs).rlike(r"(?i)concatenar?\s*auto")


# ---- prefill, dates, help -----------------------------------------------------------------

def prefill_mode(source_name: Column | str, path: Column | str, group: Column | str) -> Column:
    """mandatory or optional. The path is lower-cased before the test, so prefixes with a
    capital never match (kept)."""
    s, p, g = (F.lower(text_or_empty(x)) for x in (source_name, path, group))
    by_path = F.lit(False)
    for prefix in K.MANDATORY_PATHS:
        by_path = by_path | p.startswith(prefix)
    rest = F.substr(s, F.lit(11))
    insured = rest.isin(*K.MANDATORY_INSURED_FIELDS) | g.isin(*K.MANDATORY_INSURED_GROUPS) | rest.rlike(
        "^(" + "|".join(K.MANDATORY_INSURED_PREFIXES) + ")")
    must = by_path | F.when(s.startswith("asegurado_"), insured).otherwise(
        s.rlike("^(" + "|".join(K.MANDATORY_PREFIXES) + ")"))
    return F.when(must, F.lit("mandatory")).otherwise(F.lit("optional"))


def prefill_mode_text(mode: Column | str, required: Column) -> Column:
    m = F.lower(text_or_empty(mode))
    return (F.when(m.contains("obligatorio"), F.lit("required")).when(m.contains("opcional"), F.lit("optional"))
            .when(m.contains("no pre"), F.lit("none")).when(required, F.lit("required")).otherwise(F.lit("optional")))


def date_part(source_name: Column | str) -> Column:
    return extract(F.lower(text_or_empty(source_name)), "_(dia|mes|ano)_?$")


def date_part_options(source_name: Column | str) -> Column:
    """array of (value, label, pdf_value) of a day, month or year field, else NULL"""
    def option(value: Column, label: Column, pdf: Column) -> Column:
        return F.struct(value.alias("value"), label.alias("label"), pdf.alias("pdf_value"))
    part = date_part(source_name)
    days = F.transform(F.sequence(F.lit(1), F.lit(31)), lambda i: option(
        i.cast("string"), i.cast("string"), F.lpad(i.cast("string"), 2, "0")))
    months = F.array(*[option(F.lit(str(i + 1)), F.lit(m), F.lit(c)) for i, (m, c) in enumerate(zip(K.MONTHS, K.MONTH_CODES))])
    years = F.transform(F.sequence(F.lit(K.YEARS[0]), F.lit(K.YEARS[1])), lambda i: option(*[i.cast("string")] * 3))
    return F.when(part == "dia", days).when(part == "mes", months).when(part == "ano", years)


def help_text(source_name: Column | str) -> Column:
    table = dict(K.HELP_TEXTS)
    for n in range(1, K.BENEFICIARY_HELP_BLOCKS + 1):
        table |= {f"beneficiario_{n}_{k}": text.replace("{n}", str(n)) for k, text in K.BENEFICIARY_HELP.items()}
    return lookup(table, col(source_name))


def default_row_number(source_name: Column | str) -> Column:
    return _number(extract(text_or_empty(source_name), r"^beneficiario_(\d+)_numero$"))


def synthetic_value(name: Column | str, long_text: bool = False, max_length: Column | None = None) -> Column:
    value = F.lit(K.SAMPLE_LONG) if long_text else first_match(F.lower(text_or_empty(name)), K.SAMPLE_RULES,
                                                               F.lit(K.SAMPLE_DEFAULT))
    if max_length is None:
        return value
    return F.when(F.coalesce(max_length, F.lit(0)) > 0, F.substring(value, F.lit(1), max_length)).otherwise(value)


# ---- grades, sections -----------------------------------------------------------------------

def match_grade(confidence: Column) -> Column:
    return (F.when(confidence.isNull(), F.lit("none")).when(confidence >= 85, F.lit("high"))
            .when(confidence >= 70, F.lit("medium")).otherwise(F.lit("low")))


def accept_medium(confidence: Column) -> Column:
    return F.coalesce((confidence >= 70) & (confidence < 75), F.lit(False))


def section_of_path(path: Column | str) -> Column:
    segment = F.element_at(F.split(text_or_empty(path), r"\."), 1)
    return F.coalesce(lookup(K.SECTION_BY_SEGMENT, norm_compact(segment)), F.lit(""))


def classify_section(title: Column | str) -> Column:
    """(section, part) of the fixed template a section title leads to"""
    t = strip_accents(F.lower(text_or_empty(title)))
    parents = {key: name for name, parts in K.SECTION_TEMPLATE for key, _ in parts}
    part = None
    for key, words in K.SECTION_KEYWORDS.items():
        folded = [w.translate(str.maketrans("áéíóú", "aeiou")) for w in words]
        test = t.rlike("|".join(folded))
        part = F.when(test, F.lit(key)) if part is None else part.when(test, F.lit(key))
    part = part.otherwise(F.lit("solicitud"))
    return let(part, lambda p: F.struct(lookup(parents, p).alias("section"), p.alias("part")))


def longest_prefix(name: Column, table: dict[str, str], default: str | None) -> Column:
    """value of the longest key of a small fixed table the name starts with"""
    out = None
    for key in sorted(table, key=len, reverse=True):
        test = name.startswith(key)
        out = F.when(test, F.lit(table[key])) if out is None else out.when(test, F.lit(table[key]))
    return out.otherwise(F.lit(default))


def section_by_prefix(name: Column) -> Column:
    return longest_prefix(name, K.SECTION_BY_PREFIX, K.DEFAULT_SECTION)


def entity_of(name: Column) -> Column:
    return longest_prefix(name, {e: e for e in K.ENTITY_PREFIXES}, "")


def lookup_prefix(name: Column) -> Column:
    return longest_prefix(name, {p: p for p in K.LOOKUP_PREFIXES}, None)


def search_filter(text: Column, query: str) -> Column:
    return F.lower(text).contains(query.strip().lower())


# ---- geometry ------------------------------------------------------------------------------

def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def rect_norm(x1: Column, y1: Column, x2: Column, y2: Column, rounded: bool = False) -> Column:
    parts = {"x": F.least(x1, x2), "y": F.least(y1, y2), "width": F.abs(x2 - x1), "height": F.abs(y2 - y1)}
    return F.struct(*[(half_up(c) if rounded else c).alias(n) for n, c in parts.items()])


# ---- conditions ----------------------------------------------------------------------------

_TRIGGER = (r"si\s+se\s+(selecciona|elige|marca)\s+([^,.;]+?)\s+se\s+(?:debe(?:\s+de)?\s+)?"
            r"(?:habilitar|desplegar|mostrar|visualizar|mostrar el campo)\s+(?:el\s+campo\s+)?([^,.;]+)")
_EQUALS = r"si\s+(?:el\s+campo\s+|el\s+|la\s+|los\s+)?([a-z0-9 áéíóúñ]+?)\s+(?:es|=|==|igual\s+a)\s+([a-z0-9 ]+)"
_DEPENDS = r"depende\s+de\s+([a-z0-9 áéíóúñ]+)"


def word(w: str) -> str:
    """a whole word with ASCII borders"""
    return f"(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])"


def clean_value(c: Column) -> Column:
    return trim(replace(replace(c, "[.,:;]+$", ""), "^['\"]+|['\"]+$", ""))


def join_texts(*cols: Column) -> Column:
    return F.array_join(F.filter(F.array(*[text_or_empty(c) for c in cols]), lambda s: s != ""), " · ")


def parse_condition(text: Column) -> Column:
    """(kind, label, value, leftover) of a free-text condition.

    kind: trigger (label is the target), equals, depends, NULL. ``leftover`` is the
    warning a text gets when no form applies or a "depends" label stays unresolved.
    """
    def build(n: Column) -> Column:
        trigger, equals, depends = n.rlike(_TRIGGER), n.rlike(_EQUALS), n.rlike(_DEPENDS)
        kind = F.when(trigger, F.lit("trigger")).when(equals, F.lit("equals")).when(depends, F.lit("depends"))
        label = (F.when(trigger, clean_value(F.regexp_extract(n, _TRIGGER, 3)))
                 .when(equals, F.trim(F.regexp_extract(n, _EQUALS, 1))).when(depends, F.trim(F.regexp_extract(n, _DEPENDS, 1))))
        value = (F.when(trigger, clean_value(F.regexp_extract(n, _TRIGGER, 2)))
                 .when(equals, clean_value(F.regexp_extract(n, _EQUALS, 2))))
        ambiguous = n.rlike(word("si")) & n.rlike(word("no")) & n.rlike("desplega|habilita|muestra")
        looks = n.rlike("|".join([word("si"), word("depende"), word("visualiza"), "(?<![A-Za-z0-9_])desplieg"]))
        leftover = F.when(ambiguous, F.lit("ambiguous_rule")).when(looks, F.lit("unparsed_rule"))
        return F.struct(kind.alias("kind"), label.alias("label"), value.alias("value"), leftover.alias("leftover"))
    return let(fold(text), build)


_CONDITION = "struct<logic:string,conditions:array<struct<fieldId:string,operator:string,value:string>>>"


def parse_condition_json(c: Column) -> Column:
    return F.from_json(c, _CONDITION)


def fix_condition(c: Column | str) -> Column:
    """a condition text with prefixed ids, known operators and a value where one is needed"""
    parsed = parse_condition_json(col(c))

    def fix(x: Column) -> Column:
        known = x.operator.isin("not_empty", "empty", "equals") | (text_or_empty(x.operator) == "")
        field = F.when((text_or_empty(x.fieldId) == "") | x.fieldId.startswith("field_"), x.fieldId).otherwise(
            F.concat(F.lit("field_"), x.fieldId))
        return F.struct(field.alias("fieldId"), F.when(known, x.operator).otherwise(F.lit("not_empty")).alias("operator"),
                        F.when((x.operator == "equals") & x.value.isNull(), F.lit("")).otherwise(x.value).alias("value"))

    fixed = F.to_json(F.struct(parsed.logic.alias("logic"), F.transform(parsed.conditions, fix).alias("conditions")))
    return F.when(parsed.conditions.isNotNull(), fixed).otherwise(col(c))


def condition_text(rule: Column, obs: Column) -> Column:
    """a condition shown to people: 'Si "x" → mostrar "y"' or 'Si x = y'"""
    n = F.lower(join_texts(rule, obs))
    trigger = (r"si\s+se\s+(?:selecciona|elige|marca)\s+([^,.;]+?)\s+se\s+(?:debe(?:\s+de)?\s+)?"
               r"(?:habilitar|desplegar|mostrar|visualizar)\s+(?:el\s+campo\s+)?([^,.;]+)")
    equals = r"si\s+(?:el\s+campo\s+|el\s+|la\s+)?([a-z0-9 áéíóúñ]+?)\s+(?:es|=|igual\s+a)\s+([a-z0-9 ]+)"

    def cap(rx: str, i: int) -> Column:
        t = trim(F.regexp_extract(n, rx, i))
        return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))

    return (F.when(n.rlike(trigger), F.concat(F.lit('Si "'), cap(trigger, 1), F.lit('" → mostrar "'), cap(trigger, 2), F.lit('"')))
            .when(n.rlike(equals), F.concat(F.lit("Si "), cap(equals, 1), F.lit(" = "), cap(equals, 2))).otherwise(F.lit("")))




# ---- rows of one PDF -------------------------------------------------------------------------

_PRODUCTS = [(r"(?i)vida\s*colectiva", "vida colectiva"), (r"(?i)protecci.n\s*credit|(?i)creditic", "protección crediticia"), (r"(?i)vida\s*universal", "vida universal")]


def product_of_file(name: Column | str) -> Column:
    return first_match(F.lower(text_or_empty(name)), _PRODUCTS, F.lit(None).cast("string"))


def name_for_product(pdf_label: Column | str, file: Column | str) -> Column:
    """the part of "Product: name / Product: name" that is meant for the file's product; a
    text without a part for it stays as it is"""
    label, low = text_or_empty(pdf_label), F.lower(text_or_empty(file))
    parts = F.split(label, "/")
    rules = [r"(?i)vida\s*colectiva", r"(?i)protecci.n\s*credit", r"(?i)vida\s*universal"]

    def own(p: Column) -> Column:
        hit = F.lit(False)
        for rx in rules:
            hit = hit | (low.rlike(rx) & p.rlike(rx))
        return hit

    mine = F.get(F.filter(parts, own), F.lit(0))
    return F.when(label.contains("/") & mine.isNotNull(), trim(replace(trim(mine), r"^.*?:\s*", ""))).otherwise(label)


def printed_in(pdf_label: Column | str, scope: Column | str, file: Column | str) -> Column:
    """whether a row is printed in the PDF of this name: for its product, and not marked as
    left out"""
    product, form = product_of_file(file), F.lower(text_or_empty(scope))
    other = product.isNotNull() & (form != "") & (form != "todos") & ~form.contains(product)
    name = name_for_product(pdf_label, file)
    return ~F.coalesce(other, F.lit(False)) & (name != "") & ~name.rlike("(?i)no se llena")
