"""Checks on a built form definition (V rules) and the fixes applied to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formspark import constants as K
from formspark.functions import paths as P
from formspark.functions import text as T
from formspark.functions.classify import fix_condition
from formspark.operators.json_paths import condition_ids, parse_concat

E = T.text_or_empty


def _check(rows: DataFrame, check: str, item, reason) -> DataFrame:
    return rows.select("form_id", F.lit(check).alias("check"), item.alias("item"), reason.alias("reason"))


def source_names_exist(fields: DataFrame, widgets: DataFrame) -> DataFrame:
    """V1: source names that are no widget of the PDF"""
    names = widgets.select("form_id", F.col("name").alias("source_name")).distinct()
    rows = fields.where(F.col("source_name").isNotNull()).join(names, ["form_id", "source_name"], "left_anti")
    return _check(rows, "V1", F.col("id"), F.col("source_name"))


def id_convention(fields: DataFrame) -> DataFrame:
    """V2: ids without the prefix, or with nothing after it"""
    bare = ~E("id").startswith("field_")
    rows = fields.where(bare | (F.col("id") == "field_"))
    return _check(rows, "V2", F.col("id"), F.when(bare, F.lit("no prefix")).otherwise(F.lit("empty")))


def duplicate_ids(fields: DataFrame) -> DataFrame:
    """V3: ids seen before, over all fields"""
    n = fields.groupBy("form_id", "id").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0")
    return _check(n, "V3", F.col("id"), F.col("n").cast("string"))


def unpainted_names(fields: DataFrame, widgets: DataFrame, slots: DataFrame | None = None) -> DataFrame:
    """V4: PDF names no source, concatenation source or repeater slot paints"""
    none = F.array().cast("array<string>")
    sources = F.coalesce(parse_concat(F.col("concat")).sourceFieldIds, none)
    names = F.concat(F.array("source_name"), F.transform(sources, lambda x: T.replace(x, "^field_", "")))
    painted = fields.select("form_id", F.explode(names).alias("name"))
    if slots is not None:
        painted = painted.unionByName(slots.select("form_id", "name"))
    rows = widgets.select("form_id", "name").distinct().join(painted.distinct(), ["form_id", "name"], "left_anti")
    return _check(rows, "V4", F.col("name"), F.lit(None).cast("string"))


def checkbox_values(fields: DataFrame) -> DataFrame:
    """V5: painted checkboxes that carry "X" instead of true"""
    rows = fields.where((F.col("type") == "checkbox") & F.col("source_name").isNotNull() & F.col("checked_pdf_value").isin("X", "x"))
    return _check(rows, "V5", F.col("id"), F.col("checked_pdf_value"))


def condition_format(fields: DataFrame) -> DataFrame:
    """V6: conditions that are no JSON, or name an id without the prefix"""
    rows = fields.select("form_id", "id", F.explode(F.array(
        *[F.struct(F.lit(c).alias("prop"), F.col(c).alias("raw")) for c in ("condition_visibility", "condition_required")])).alias("c"))
    rows = rows.select("form_id", "id", "c.prop", "c.raw").where(E("raw") != "")
    broken = rows.where(F.try_parse_json("raw").isNull()).select("form_id", "id", "prop", F.lit("invalid JSON").alias("reason"))
    bare = rows.where(F.try_parse_json("raw").isNotNull()).select("form_id", "id", "prop", F.explode(condition_ids(F.col("raw"))).alias("reason"))
    bare = bare.where((E("reason") != "") & ~F.col("reason").startswith("field_"))
    both = broken.unionByName(bare)
    return _check(both, "V6", F.concat("id", F.lit("."), "prop"), F.col("reason"))


def output_fixes(fields: DataFrame) -> DataFrame:
    """V9: order 0 becomes 1, conditions are repaired, "X" of a painted checkbox becomes
    true; with the list of repairs made"""
    order = F.when(F.coalesce("field_order", F.lit(0)) == 0, 1).otherwise(F.col("field_order"))
    valid = (E("condition_visibility") != "") & F.try_parse_json("condition_visibility").isNotNull()
    condition = F.when(valid, fix_condition("condition_visibility")).otherwise(F.col("condition_visibility"))
    checked = (F.col("type") == "checkbox") & F.col("source_name").isNotNull() & F.col("checked_pdf_value").isin("X", "x")
    value = F.when(checked, F.lit("true")).otherwise(F.col("checked_pdf_value"))
    made = F.array_compact(F.array(F.when(F.coalesce("field_order", F.lit(0)) == 0, F.lit("order")),
                                   F.when(~condition.eqNullSafe(F.col("condition_visibility")), F.lit("condition")),
                                   F.when(F.coalesce(checked, F.lit(False)), F.lit("checked"))))
    return fields.select("form_id", "ord", "id", order.alias("field_order"), condition.alias("condition_visibility"),
                         value.alias("checked_pdf_value"), made.alias("fixes"))


def low_label_coverage(widgets: DataFrame, share: float = 0.4) -> DataFrame:
    """V10: forms with more than 40% of their widgets without a label"""
    n = widgets.groupBy("form_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(E("label") == "").alias("bare"))
    return n.where(F.col("bare") > F.col("n") * share).select(
        "form_id", F.lit("V10").alias("check"), F.lit("low_label_coverage").alias("item"),
        F.concat("bare", F.lit("/"), "n").alias("reason"))


def run_warnings(rows: DataFrame, rename_errors: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Warnings about a whole run: (form_id, type, n).

    No catalogs at all (without a form), names that were not renamed, paths of a person without an
    index, and fields that should have a catalog and have none. ``rows``: form_id, section_prefix,
    path, group_name, label, catalog_name; ``rename_errors``: form_id, one row per name.
    """
    expected = F.col("group_name").isin(*K.CATALOG_GROUPS) | F.lower(T.text_or_empty("label")).rlike(K.CATALOG_LABELS)
    lacking = F.coalesce(expected, F.lit(False)) & (T.text_or_empty("catalog_name") == "")
    bare = P.index_path(F.col("path"), F.col("section_prefix")).warning
    kinds = F.filter(F.array(F.when(bare, F.lit("paths_sin_indice")), F.when(lacking, F.lit("sin_catalogo"))), lambda x: x.isNotNull())
    found = rows.select("form_id", F.explode(kinds).alias("type")).unionByName(rename_errors.select("form_id", F.lit("rename_errors").alias("type")))
    none = catalogs.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("form_id"), F.lit("no_catalogos").alias("type"), "n")
    return found.groupBy("form_id", "type").agg(F.count(F.lit(1)).alias("n")).unionByName(none)
