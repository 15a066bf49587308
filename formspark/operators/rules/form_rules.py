"""Rules R01-R26 of the form audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formspark import constants as K
from formspark.functions import paths as P
from formspark.functions import text as T
from formspark.functions.classify import word
from formspark.operators.json_paths import condition_ids, conditions_of, parse_concat
from formspark.operators.rules.registry import Keyed, Model, each, hit, hits, no_records, record, register_keyed, register_row

E = T.text_or_empty


def _effective(fallback: bool = True) -> Column:
    """path a field writes to: the second name counts only where the first is NULL"""
    return F.coalesce("json_output_path", "salida_json") if fallback else F.col("json_output_path")


def _helper() -> Column:
    return F.coalesce("hidden", F.lit(False)) | F.col("concat").isNotNull()


@register_row("R01")
def id_matches_source() -> Column:
    real, base = F.lower("id"), T.as_id("source_name")
    raw = F.concat(F.lit("field_"), F.lower("source_name"))
    good = F.lit(False)
    for want, ok in ((F.concat(F.lit("field_"), base), F.lit(True)), (raw, F.lit(True)), (base, base.startswith("field_"))):
        same = (real == want) | (T.strip_accents(real) == T.strip_accents(want)) | (
            _helper() & real.startswith(F.concat(want, F.lit("_"))))
        good = good | (ok & same)
    return hit((E("source_name") != "") & ~good, F.concat(F.lit("field_"), base))


@register_row("R04")
def output_mismatch() -> Column:
    return hit(~F.col("salida_json").eqNullSafe(F.col("json_output_path")), F.coalesce("json_output_path", F.lit("ninguna")))


def _repeater() -> Column:
    return F.coalesce("has_repeater", F.lit(False))


@register_row("R05")
def repeater_with_path() -> Column:
    return hit(_repeater() & ((E("json_output_path") != "") | (E("salida_json") != "")))


@register_row("R06")
def repeater_without_pattern() -> Column:
    return hit(_repeater() & (E("slot_pattern") == ""))


@register_row("R07")
def repeater_from_one() -> Column:
    return hit(_repeater() & F.col("slot_pattern").contains("{i1}"), F.col("slot_pattern"))


@register_row("R08")
def undeclared_source() -> Column:
    c = parse_concat(F.col("concat"))
    none = F.array().cast("array<string>")
    used = F.filter(F.coalesce(F.transform(c.parts, lambda p: p.condition.fieldId), none), lambda x: E(x) != "")
    return hits(F.when(F.col("concat").isNotNull(), F.array_except(used, F.coalesce(c.sourceFieldIds, none))))


@register_row("R09")
def unused_checked_value() -> Column:
    return hit(F.col("native_type").isin("Checkbox", "RadioGroup") & (F.col("checked_pdf_value") != "X"), F.col("checked_pdf_value"))


@register_row("R11")
def phantom_person() -> Column:
    index = F.regexp_extract(F.coalesce(_effective(), F.lit("")), r"personas\[(\d+)\]", 1)
    return hit(F.coalesce("hidden", F.lit(False)) & F.col("concat").isNull() & (E("default_value") != "")
               & (F.coalesce(index.try_cast("int"), F.lit(0)) > 0), path=F.col("json_output_path"))


def path_writers(m: Model) -> DataFrame:
    """(form_id, path, field_id, type, json_value): every field that writes a path"""
    path = P.output_path(F.col("exclude"), F.col("json_output_path"), F.col("salida_json"))
    return m.own.select("form_id", path.alias("path"), F.col("id").alias("field_id"), "type", "json_value").where(
        F.col("path").isNotNull())


@register_row("R13")
def hidden_without_value() -> Column:
    return hit((E("source_name") != "") & (E("type") != "signature") & F.col("concat").isNull() & (E("prefill_key") == "")
               & (E("json_output_path") == "") & F.coalesce("hidden", F.lit(False)))


@register_row("R14")
def prefill_api() -> Column:
    return hit(F.col("prefill_mode") == "api")


def _visible() -> Column:
    return ~F.coalesce("hidden_effective", F.lit(False)) & ~F.coalesce("hidden", F.lit(False))


@register_row("R15")
def missing_accents() -> Column:
    # one scan for any known word before the word-by-word fix
    suspect = _visible() & F.coalesce(F.col("label").rlike(word("(?:" + "|".join(K.SPELLING) + ")")), F.lit(False))
    return hits(F.filter(F.array(F.when(suspect, T.spell_fix("label"))), lambda x: x.isNotNull()))


@register_row("R26")
def agreed_terms() -> Column:
    fixes = F.transform(F.array("label", "radio_label"), T.term_fix)
    return hits(F.when(_visible(), F.filter(fixes, lambda x: E(x) != "")))


@register_row("R16")
def description_without_source() -> Column:
    return hit(E(_effective()).rlike(r"\.descripcion[A-Z]") & F.col("concat").isNull() & (E("prefill_key") == "")
               & F.col("default_value").isNull(), path=F.col("json_output_path"))


@register_row("R17")
def age_without_formula() -> Column:
    return hit(E("json_output_path").rlike(r"\.edad$") & F.col("concat").isNull())


@register_row("R18")
def foreign_parent() -> Column:
    def block(c: Column) -> Column:
        return F.split(T.replace(c, "^field_", ""), "_")[0]

    return hits(F.filter(F.array("parent_id", "grandparent_id"), lambda p: (E(p) != "") & (block(F.col("id")) != block(p))))


@register_row("R20")
def unlocked_full_name() -> Column:
    return hit(E("json_output_path").rlike(r"\.nombreCompleto$") & F.col("concat").isNotNull()
               & (~F.coalesce("read_only", F.lit(False)) | (E("prefill_key") != "")))


@register_row("R24")
def incomplete_person_group() -> Column:
    """an "or" condition that names some codes of a person group but not all"""
    parsed = F.from_json("condition_visibility", "struct<logic:string,conditions:array<struct<value:string>>>")

    def code(c: Column) -> Column:
        for alias, real in K.PERSON_ALIASES.items():
            c = F.when(c == alias, F.lit(real)).otherwise(c)
        return c

    codes = F.transform(parsed.conditions, lambda x: code(x.value))
    found = []
    for name, group in K.PERSON_GROUPS.items():
        members = F.array(*[F.lit(g) for g in group])
        lack = F.array_except(members, codes)
        found.append(F.when((F.size(lack) > 0) & (F.size(lack) < len(group)), F.concat(F.lit(f"{name}: "), F.array_join(lack, ", "))))
    return hits(F.when(parsed.logic == "or", F.filter(F.array(*found), lambda x: x.isNotNull())))


def unused_sources(m: Model) -> DataFrame:
    """PDF names no field uses"""
    used = m.fields.where(E("source_name") != "").select("form_id", F.col("source_name").alias("name")).distinct()
    return m.widgets.where(E("name") != "").join(used, ["form_id", "name"], "left_anti")


# ---- rules about keys ------------------------------------------------------------------------

def _apart() -> Column:
    """fields outside repeaters, whose ids others may name"""
    return F.col("in_repeater").isNull()


def _ids() -> list[Column]:
    fmt = F.coalesce("pdf_date_format", "date_format", F.lit("DD/MM/YYYY"))
    return [record("id", F.col("id"), when=_apart(), ord=F.col("ord"), a=F.col("type"), b=fmt)]


def _unknown() -> Column:
    return F.coalesce("n_own", F.lit(0)) == 0


def duplicate_id() -> list[Column]:
    return _ids()


register_keyed(Keyed("R02", duplicate_id, space="id", judge=lambda: F.col("n_own") > 1, field=lambda: F.col("key"), subject=lambda: F.col("n_own")))


def broken_condition() -> list[Column]:
    return _ids()


def _condition_refs() -> list[Column]:
    refs = F.concat(condition_ids(F.col("condition_visibility")), condition_ids(F.col("condition_required")))
    named = F.filter(refs, lambda r: (E(r) != "") & (r != "field_NEVER_EXISTS"))
    return [F.when(_apart(), each(named, lambda r: record("id", r, "R03", field_id=F.col("id"), subject=r))).otherwise(no_records())]


register_keyed(Keyed("R03", broken_condition, _condition_refs, decide=_unknown))

_BETWEEN = "\x01"


def compared_by_label() -> list[Column]:
    """prefilled choices by label, with their stored value, and the values that conditions compare"""
    def pair(a: Column, b: Column) -> Column:
        return F.concat(a, F.lit(_BETWEEN), b)

    options = F.transform(F.from_json("options", "array<struct<label:string,jsonValue:string>>"), lambda o, i: F.struct(o["label"].alias("label"), o["jsonValue"].alias("stored"), i.alias("at")))
    named = F.filter(options, lambda o: (E(o["label"]) != "") & (E(o["stored"]) != "") & (o["label"] != o["stored"]))
    # a label listed twice keeps its last stored value
    origins = each(named, lambda o: record("compared", pair(F.col("id"), o["label"]), ord=F.col("ord"), num=o["at"], field_id=F.col("id"), subject=o["label"], a=o["stored"]))
    conds = F.concat(*[F.transform(conditions_of(F.col(n)), lambda x: F.struct(x.fieldId.alias("id"), x.operator.alias("op"), x.value.alias("value")))
                       for n in ("condition_visibility", "condition_required")])
    parts = F.coalesce(F.transform(parse_concat(F.col("concat")).parts, lambda p: F.struct(
        p.condition.fieldId.alias("id"), p.condition.op.alias("op"), p.condition["values"].alias("value"))), F.array().cast("array<struct<id:string,op:string,value:string>>"))
    equal = F.filter(F.concat(conds, parts), lambda c: (c["op"] == "equals") & (E(c["value"]) != "") & c["id"].isNotNull())
    return [F.when(E("prefill_key") != "", origins).otherwise(no_records()), each(equal, lambda c: record("compared", pair(c["id"], c["value"]), use=True))]


def only_by_label(known: DataFrame) -> DataFrame:
    """choices compared by their label whose stored value is never compared"""
    pairs = known.where(F.col("space") == "compared")
    by_label = pairs.where((F.col("n_own") > 0) & (F.col("n_use") > 0)).select("form_id", F.col("owner").alias("field_id"), F.col("about").alias("label"), F.col("last_a").alias("stored"))
    by_label = by_label.withColumn("key", F.concat("field_id", F.lit(_BETWEEN), "stored"))
    only = by_label.join(pairs.where(F.col("n_use") > 0).select("form_id", "key"), ["form_id", "key"], "left_anti")
    none = F.lit(None).cast("string")
    return only.select("form_id", F.lit("R10").alias("rule"), "field_id", F.concat("label", F.lit(" / "), "stored").alias("subject"), none.alias("path"))


register_keyed(Keyed("R10", compared_by_label), only_by_label)


def _written() -> Column:
    return P.output_path(F.col("exclude"), F.col("json_output_path"), F.col("salida_json"))


def shared_path() -> list[Column]:
    """paths by the values that are written to them"""
    option = F.col("type").isin("radio", "checkbox") & (E("json_value") != "")
    return [record("path", _written(), when=_apart() & _written().isNotNull(), sub=F.col("json_value"), flag=F.coalesce(option, F.lit(False)))]


def _writers() -> list[Column]:
    return [record("path", _written(), "R12", when=_apart() & _written().isNotNull(), field_id=F.col("id"), path=_written())]


# a path several fields write, unless they are options with a value of their own
register_keyed(Keyed("R12", shared_path, _writers, decide=lambda: (F.col("n_own") > 1) & ((F.col("n_flag") < F.col("n_own")) | (F.col("n_sub") < F.col("n_own"))), subject=lambda: F.col("n_own")))


def date_cut() -> list[Column]:
    return _ids()


def _cuts() -> list[Column]:
    part = P.date_part_of_id("id")
    cuts = F.flatten(F.transform(F.filter(parse_concat(F.col("concat")).parts, lambda p: p["kind"] == "field"), lambda p: F.transform(
        F.filter(p["transforms"], lambda t: t["kind"] == "substring"), lambda t: F.struct(p["fieldId"].alias("source"), t["start"].alias("start"), t["end"].alias("end")))))
    return [F.when(part.isNotNull(), each(cuts, lambda c: record("id", c["source"], "R19", field_id=F.col("id"), a=part, num=c["start"], ord=c["end"]))).otherwise(no_records())]


def _cut() -> Column:
    return P.date_slice_check(F.col("a"), F.col("last_b"), F.col("num"), F.col("ord").cast("int"))


register_keyed(Keyed("R19", date_cut, _cuts, decide=lambda: (F.col("last_a") == "date") & ~_cut().ok, subject=lambda: F.concat(_cut().got, F.lit(" / "), _cut().expected)))


def broken_radio_group() -> list[Column]:
    return _ids()


def _siblings() -> list[Column]:
    return [each(F.from_json("radio_fields", "array<string>"), lambda r: record("id", r, "R21", field_id=F.col("id"), subject=r))]


register_keyed(Keyed("R21", broken_radio_group, _siblings, decide=_unknown))


def no_signature() -> list[Column]:
    return [record("signature", F.lit(""), flag=E("type") == "signature")]


register_keyed(Keyed("R22", no_signature, space="signature", judge=lambda: F.col("n_flag") == 0))


def declaration_not_last() -> list[Column]:
    decl = F.coalesce("section_title", "section_id").rlike("(?i)declaracion")
    return [record("declaration", F.lit(""), flag=F.coalesce(decl, F.lit(False)), num=F.col("section_ord"))]


register_keyed(Keyed("R23", declaration_not_last, space="declaration", judge=lambda: F.col("low") < F.col("high"), subject=lambda: F.col("low")))


def unused_pdf_names() -> list[Column]:
    return [record("name", F.col("source_name"), when=E("source_name") != "", use=True)]


def _widget_names() -> list[Column]:
    return [record("name", F.col("name"), when=E("name") != "")]


def unused_by_form(known: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    names = known.where((F.col("space") == "name") & (F.col("n_own") > 0) & (F.col("n_use") == 0))
    return names.groupBy("form_id").agg(F.sum("n_own").cast("string").alias("subject")).select("form_id", F.lit("R25").alias("rule"), none.alias("field_id"), "subject", none.alias("path"))


register_keyed(Keyed("R25", unused_pdf_names, widget_keys=_widget_names), unused_by_form)
