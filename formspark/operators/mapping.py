"""The mapping of a PDF: a row of 22 columns for each of its fields, from its layout and the matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formspark import constants as K
from formspark.functions import classify as C
from formspark.functions import paths as P
from formspark.functions import text as T
from formspark.kernels import SLICE, ordered_scan
from formspark.operators.assign import match_in_section
from formspark.operators.joins import find_catalog
from formspark.session import cut_lineage

E = T.text_or_empty

#: The columns of the mapping, in order.
COLUMNS = ["number", "section_pdf", "acro_actual", "acro_proposed", "label", "source_name", "native_type", "group_name", "page", "main_path", "secondary_paths",
           "prefilled", "required", "max_length", "pattern", "format", "condition", "catalog_name", "catalog_options", "data_type", "rule", "catalog_sheet"]


def _options(items: Column) -> Column:
    """options as JSON text, in order"""
    return F.to_json(F.transform(F.array_sort(items), lambda o: F.struct(o["value"].alias("value"), o["label"].alias("label"))))


def _enriched(rows: DataFrame, prefix: Column) -> list[Column]:
    """what a matched matrix row says; '' where there is none"""
    paths = P.split_paths("json_name")
    indexed = P.index_paths(paths.main, F.array_join(paths.secondary, " | "), prefix)
    checks = C.parse_validation("rule", "data_type")
    found = F.col("row_ord").isNotNull()

    def told(c: Column, name: str) -> Column:
        return F.when(found, F.coalesce(c.cast("string"), F.lit(""))).otherwise(F.lit("")).alias(name)

    return [told(indexed.main, "main_path"), told(indexed.secondary, "secondary_paths"), told(C.yes_no("required", "accented"), "required"),
            told(checks.max_length, "max_length"), told(checks.pattern, "pattern"), told(C.map_format("data_type"), "format"),
            told(C.condition_text(F.col("rule"), F.col("notes")), "condition"), told(E("data_type"), "data_type"), told(E("rule"), "rule"),
            F.coalesce(found & indexed.warning, F.lit(False)).alias("path_warning")]


def mapping_columns(placed: DataFrame, rows: DataFrame, catalog_items: DataFrame, scope: Sequence[str] = ("form_id",)) -> DataFrame:
    """The 22 columns (``COLUMNS``) of every field of a PDF, with ``ord``, ``matched`` and ``path_warning``.

    A field takes its matrix row one to one, in the fields' order; the row tells paths, checks, format
    and condition. Options come from the catalog of the field's group or label, else from the values of
    the matrix rows that share the matched row's label, if there are several.

    placed: scope, ord, name, label, section, section_prefix, group_name, final_name, context_label, type,
    page; rows: scope, ord, field_label, pdf_label, json_name, rule, notes, data_type, required, value;
    catalog_items: catalog, cat_ord, item_ord, code, label. The options of one catalog are one text.
    """
    scope = list(scope)
    matched = match_in_section(placed, rows, scope).drop("source")
    said = rows.select(*scope, F.col("ord").alias("row_ord"), "field_label", "json_name", "rule", "notes", "data_type", "required")
    prefix = F.coalesce(F.nullif(F.regexp_extract(E("final_name"), r"^(beneficiario_\d+_)", 1), F.lit("")), E("section_prefix"))
    fields = matched.join(said, [*scope, "row_ord"], "left")
    fields = cut_lineage(fields.select(*scope, "ord", "name", "section", "group_name", "final_name", "context_label", "type", "page", "row_ord", "field_label", *_enriched(rows, prefix)))

    # catalogs: the options of a sheet, of a built-in catalog, of a label's own rows
    label, code = E("label"), F.coalesce(F.nullif(F.col("code").cast("string"), F.lit("")), E("label"))
    listed = catalog_items.groupBy(F.lower(T.trim("catalog")).alias("sheet")).agg(_options(F.collect_list(F.struct("item_ord", code.alias("value"), label.alias("label")))).alias("listed"))
    built_in = F.create_map(*[F.lit(x) for name, options in K.SYNTHETIC_CATALOGS.values() for x in (
        name, "[" + ",".join(f'{{"value":"{v}","label":"{t}"}}' for v, t in options) + "]")])
    sheets = catalog_items.groupBy("catalog").agg(F.min("cat_ord").alias("cat_ord"))
    named = find_catalog(fields.select(*scope, "ord", "group_name", F.col("context_label").alias("label")), sheets).select(*scope, "ord", "sheet", "synthetic")
    values = rows.where(T.trim(E("value")) != "").select(*scope, "field_label", "ord", T.trim("value").alias("value"))
    several = values.groupBy(*scope, "field_label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    distinct = values.groupBy(*scope, "field_label", "value").agg(F.min("ord").alias("item_ord"))
    inline = distinct.groupBy(*scope, "field_label").agg(_options(F.collect_list(F.struct("item_ord", "value", F.col("value").alias("label")))).alias("inline"))
    inline = inline.join(several, [*scope, "field_label"], "left_semi")

    out = fields.join(named, [*scope, "ord"], "left").join(listed, "sheet", "left").join(inline, [*scope, "field_label"], "left")
    known = F.when(F.col("synthetic"), built_in[F.col("sheet")]).otherwise(F.col("listed"))
    own = F.when(F.col("row_ord").isNotNull(), F.col("inline"))
    catalog = F.when(known.isNotNull(), F.col("sheet")).when(own.isNotNull(), F.lit("(inline)")).otherwise(F.lit(""))
    numbered = ordered_scan(out.withColumns({"catalog_name": catalog, "catalog_options": F.coalesce(known, own, F.lit(""))}), scope, [F.col("ord")], F.floor(F.col("ord") / SLICE), number="number")
    native = F.when(E("type") == "", F.lit("")).when(F.lower("type").contains("text"), F.lit("Tx")).otherwise(F.lit("Btn"))
    columns = {"section_pdf": E("section"), "acro_actual": F.col("name"), "acro_proposed": F.col("final_name"), "label": F.col("context_label"), "source_name": F.col("final_name"),
               "native_type": native, "group_name": E("group_name"), "page": F.col("page") + 1, "prefilled": F.lit("No"), "catalog_sheet": F.col("catalog_name")}
    return numbered.select(*scope, "ord", *[columns[c].alias(c) if c in columns else F.col(c) for c in COLUMNS], F.col("row_ord").isNotNull().alias("matched"), "path_warning")


def mapping_summary(mapping: DataFrame, scope: Sequence[str] = ("form_id",)) -> DataFrame:
    """Counts of a mapping: fields, with and without a matrix row, that lack a catalog, paths without an index."""
    expected = F.col("group_name").isin(*K.CATALOG_GROUPS) | F.lower(E("label")).rlike(K.CATALOG_LABELS)
    return mapping.groupBy(*scope).agg(F.count(F.lit(1)).alias("fields"), F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"),
                                       F.count_if(expected & (F.col("catalog_options") == "")).alias("without_catalog"), F.count_if("path_warning").alias("paths_without_index"))
