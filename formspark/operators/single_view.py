"""The single view of a ficha: a row of 19 columns for each field, and its summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formspark.functions import classify as C
from formspark.functions.text import text_or_empty as E
from formspark.kernels import SLICE, ordered_scan

# The columns of the view, and the lines of its summary, in order.
VIEW_COLUMNS = ["#", "Hoja", "Paso", "Sección", "Label (ficha)", "Nombre en PDF", "Tipo (ficha)", "Tipo (form-def)", "Opciones", "Regla", "Obligatorio", "Visualización",
                "Observaciones", "Formulario", "Ruta JSON", "sourceName", "Destino", "Estado", "Motivo"]
VIEW_SUMMARY = ["hojas", "hojasConCampos", "filasConRuta", "campos", "soloJSON", "ocultos", "readOnly", "prefill", "excluidos", "labels", "conSourceName"]
NOT_CROSSED = "sin-cruzar"

#: What a field takes from its first row.
_TEXTS = ["step", "section", "label", "pdf_name", "ficha_type", "type", "required", "visualization", "notes", "forms", "routes"]


def _listed(column: str, distinct: bool) -> Column:
    """the filled values of a field's rows as one text, in row order"""
    values = F.transform(F.array_sort(F.collect_list(F.when(E(column) != "", F.struct("ord", column)))), lambda x: x[column])
    return F.array_join(F.array_distinct(values) if distinct else values, " | ")


def ficha_fields(rows: DataFrame, keys: Sequence[str] = ("form_id",)) -> DataFrame:
    """Rows of a sheet with the same route are one field: the first row's texts and flags, and the values, distinct
    rules and distinct source names of all of its rows, each as the text of one cell. A row without a route is a field.

    rows: form_id, sheet, ord (in the whole ficha), step, section, label, pdf_name, ficha_type, type, value, rule, required,
    visualization, notes, forms, route, routes (text), source_name.
    """
    flags = C.ficha_flags(F.col("required"), F.col("step"), F.col("visualization"), F.col("rule"), F.col("route"))
    marked = rows.withColumns({"_flags": flags, "_route": E("route"), "_single": F.when(E("route") == "", F.col("ord"))})
    first = F.min_by(F.struct("_flags", *_TEXTS), "ord").alias("_first")
    fields = marked.groupBy(*keys, "sheet", "_route", "_single").agg(
        F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n_rows"), first, _listed("value", False).alias("options"), _listed("rule", True).alias("rules"),
        _listed("source_name", True).alias("source_names"))
    return fields.select(*keys, "sheet", "ord", F.col("_route").alias("route"), "n_rows", "options", "rules", "source_names", F.col("_first._flags").alias("flags"), *[f"_first.{c}" for c in _TEXTS])


def single_view(fields: DataFrame, keys: Sequence[str] = ("form_id",), size: int = SLICE) -> DataFrame:
    """The 19 columns of every field (``VIEW_COLUMNS``), numbered in the order of the ficha; the side of the
    form definition is not crossed yet, so its columns say so."""
    numbered = ordered_scan(fields, keys, [F.col("ord")], F.floor(F.col("ord") / size), number="n")
    cells = [F.col("n"), F.col("sheet"), *[E(c) for c in ("step", "section", "label", "pdf_name", "ficha_type", "type")], F.col("options"), F.col("rules"),
             *[E(c) for c in ("required", "visualization", "notes", "forms", "routes")], F.col("source_names"), C.ficha_dest(F.col("flags")), F.lit(NOT_CROSSED), F.lit("")]
    return numbered.select(*keys, *[c.alias(name) for c, name in zip(cells, VIEW_COLUMNS, strict=True)])


def view_summary(fields: DataFrame, sheets: DataFrame, typos: DataFrame, keys: Sequence[str] = ("form_id",)) -> DataFrame:
    """(form_id, line, metric, value): the counts of a ficha, then the names that differ from the sample's by a typo.

    sheets: form_id, sheet, a row for each node sheet; typos: form_id, name, suggestion. A form without
    fields has counts of 0; typos come after the counts, all with the same line number.
    """
    flag = {"soloJSON": "json_only", "ocultos": "hidden", "readOnly": "read_only", "prefill": "prefill", "excluidos": "excluded", "labels": "is_label"}
    per_sheet = fields.groupBy(*keys, "sheet").agg(
        F.count(F.lit(1)).alias("campos"), F.sum(F.when(F.col("route") != "", F.col("n_rows")).otherwise(0)).alias("filasConRuta"),
        *[F.count_if(F.col(f"flags.{f}")).alias(name) for name, f in flag.items()], F.count_if(F.col("source_names") != "").alias("conSourceName"))
    counted = [c for c in VIEW_SUMMARY if c not in ("hojas", "hojasConCampos")]
    per_form = sheets.select(*keys, "sheet").distinct().join(per_sheet, [*keys, "sheet"], "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hojas"), F.count("campos").alias("hojasConCampos"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted])
    lines = per_form.select(*keys, F.posexplode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in VIEW_SUMMARY])).alias("line", "_l"))
    named = typos.select(*keys, "name", "suggestion").distinct()
    told = named.select(*keys, F.lit(len(VIEW_SUMMARY)).alias("line"), F.col("name").alias("metric"), F.concat(F.lit("ejemplo: "), "suggestion").alias("value"))
    return lines.select(*keys, "line", "_l.metric", "_l.value").unionByName(told)
