"""Spreadsheet cells as tables.

All readers start from long cells: (form_id, file, sheet, sheet_ord, row_idx, col_idx, value),
one row per cell, rows and columns from 0. Headers are found from the few cells of the first
rows and met with the data cells by a join on (sheet, column), so a sheet of any length stays
split over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formspark import constants as K
from formspark.functions import classify as C
from formspark.functions import text as T
from formspark.kernels import SLICE, ordered_scan
from formspark.session import cut_lineage

E = T.text_or_empty
FILE = ["form_id", "file"]
SHEET = ["form_id", "file", "sheet"]


def filled(cells: DataFrame) -> DataFrame:
    """cells with a text, trimmed"""
    return cells.withColumn("value", T.trim(E("value"))).where(F.col("value") != "")


def pick_matrix_sheet(cells: DataFrame) -> DataFrame:
    """the first sheet named like a form, else the sheet with most rows (the first on ties)"""
    sheets = cells.groupBy(*SHEET, "sheet_ord").agg((F.max("row_idx") - F.min("row_idx") + 1).alias("rows"))
    named = F.col("sheet").rlike("(?i)formulario")
    rank = F.struct(~named, F.when(named, 0).otherwise(-F.col("rows")), "sheet_ord")
    return sheets.groupBy(*FILE).agg(F.min_by("sheet", rank).alias("sheet"))


def _roles(c: Column, synonyms: dict[str, list[str]]) -> Column:
    """roles a header text may stand for, in order of preference"""
    hits = [F.when(_contains_any(c, words), F.lit(role)) for role, words in synonyms.items()]
    return F.array_compact(F.array(*hits))


def _contains_any(c: Column, words: Sequence[str]) -> Column:
    out = c.contains(words[0])
    for w in words[1:]:
        out = out | c.contains(w)
    return out


def detect_header(cells: DataFrame, synonyms: dict[str, list[str]] | None = None, min_roles: int = 4, must_have: str | None = "field_label",
                  max_rows: int = 10, fallback: Sequence[str] | None = None) -> DataFrame:
    """Role of each column: (sheet, header_row, role, col_idx).

    In each of the first rows every cell takes its first role that no cell before it took;
    the first row with enough roles (and the one it must have) is the header. Without one, row
    0 holds the fallback roles by position.
    """
    synonyms = synonyms or K.MATRIX_ROLES
    top = filled(cells.where(F.col("row_idx") < max_rows)).select(*SHEET, "row_idx", "col_idx", "value")
    # comparing a text with all synonyms is the work: it is done where the cells of a row are met, not where they are
    # read (a filter on roles would be moved there)
    top = top.repartition(*SHEET, "row_idx").select(*SHEET, "row_idx", "col_idx", _roles(F.lower("value"), synonyms).alias("roles"))
    # one row's header cells: as many as a sheet has named columns
    named = F.when(F.size("roles") > 0, F.struct("col_idx", "roles"))
    rows = top.groupBy(*SHEET, "row_idx").agg(F.array_sort(F.collect_list(named)).alias("cells")).where(F.size("cells") > 0)
    start = F.array().cast("array<struct<role:string,col_idx:int>>")

    def take(acc: Column, cell: Column) -> Column:
        taken = F.transform(acc, lambda a: a.role)
        free = F.filter(cell.roles, lambda r: ~F.array_contains(taken, r))
        return F.when(F.size(free) > 0, F.concat(acc, F.array(F.struct(free[0].alias("role"), cell.col_idx.cast("int").alias("col_idx"))))).otherwise(acc)

    picked = rows.select(*SHEET, "row_idx", F.aggregate("cells", start, take).alias("picks"))
    enough = F.size("picks") >= min_roles
    if must_have:
        enough = enough & F.exists("picks", lambda p: p.role == must_have)
    header = picked.where(enough).groupBy(*SHEET).agg(F.min_by(F.struct("row_idx", "picks"), "row_idx").alias("_h"))
    if fallback is not None:
        header = cut_lineage(header)  # read for what is found and for what is not: a row for each sheet
    found = header.select(*SHEET, F.col("_h.row_idx").alias("header_row"), F.explode("_h.picks").alias("_p")).select(*SHEET, "header_row", "_p.role", "_p.col_idx")
    if fallback is None:
        return found
    lost = cells.select(*SHEET).distinct().join(header.select(*SHEET), SHEET, "left_anti")
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(i).alias("col_idx")) for i, r in enumerate(fallback)])).alias("_p")
    return found.unionByName(lost.select(*SHEET, F.lit(0).alias("header_row"), roles).select(*SHEET, "header_row", "_p.role", "_p.col_idx"))


def header_by_density(cells: DataFrame, max_rows: int = 8) -> DataFrame:
    """row with most filled cells among the first (the first one on ties)"""
    n = filled(cells.where(F.col("row_idx") < max_rows)).groupBy(*SHEET, "row_idx").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*SHEET).agg(F.max_by("row_idx", F.struct("n", -F.col("row_idx"))).alias("header_row"))
    return cells.select(*SHEET).distinct().join(best, SHEET, "left").na.fill(0, ["header_row"])


def header_by_pattern(cells: DataFrame, patterns: Sequence[tuple[str, str]], priority: str = "column") -> DataFrame:
    """Roles of row 0 by ordered patterns: (sheet, role, col_idx).

    column   each column takes its first pattern whose role is still free
    pattern  each role takes the first column of its first pattern that occurs
    last     like column, but the last column of a role wins
    """
    heads = filled(cells.where("row_idx = 0")).select(*SHEET, "col_idx", "value")
    if priority == "pattern":
        tries = F.array_compact(F.array(*[F.when(F.col("value").rlike(rx), F.struct(F.lit(i).alias("rank"), F.lit(role).alias("role"))) for i, (role, rx) in enumerate(patterns)]))
        hits = heads.select(*SHEET, "col_idx", F.explode(tries).alias("_t")).select(*SHEET, "col_idx", "_t.*")
        return hits.groupBy(*SHEET, "role").agg(F.min_by("col_idx", F.struct("rank", "col_idx")).alias("col_idx"))
    if priority == "last":
        hits = heads.select(*SHEET, "col_idx", F.explode(F.array_compact(F.array(*[F.when(F.col("value").rlike(rx), F.lit(role)) for role, rx in patterns]))).alias("role"))
        return hits.groupBy(*SHEET, "role").agg(F.max("col_idx").alias("col_idx"))
    roles = F.array_compact(F.array(*[F.when(F.col("value").rlike(rx), F.lit(role)) for role, rx in patterns]))
    one = heads.select(*SHEET, "col_idx", roles.alias("roles")).where(F.size("roles") > 0).groupBy(*SHEET).agg(
        F.array_sort(F.collect_list(F.struct("col_idx", "roles"))).alias("cells"))
    start = F.array().cast("array<struct<role:string,col_idx:int>>")

    def take(acc: Column, cell: Column) -> Column:
        free = F.filter(cell.roles, lambda r: ~F.exists(acc, lambda a: a.role == r))
        return F.when(F.size(free) > 0, F.concat(acc, F.array(F.struct(free[0].alias("role"), cell.col_idx.cast("int").alias("col_idx"))))).otherwise(acc)

    return one.select(*SHEET, F.explode(F.aggregate("cells", start, take)).alias("_p")).select(*SHEET, "_p.role", "_p.col_idx")


def pivot_rows(cells: DataFrame, header: DataFrame, roles: Sequence[str], keep_any: Sequence[str]) -> DataFrame:
    """Rows below the header with a column per role ('' when absent); rows where none of
    ``keep_any`` has a text are dropped."""
    heads = header if "header_row" in header.columns else header.withColumn("header_row", F.lit(0))
    data = filled(cells).join(heads, [*SHEET, "col_idx"]).where(F.col("row_idx") > F.col("header_row"))
    rows = data.groupBy(*SHEET, "row_idx").agg(*[F.coalesce(F.max(F.when(F.col("role") == r, F.col("value"))), F.lit("")).alias(r) for r in roles])
    keep = F.lit(False)
    for r in keep_any:
        keep = keep | (F.col(r) != "")
    return rows.where(keep)


def read_custom_matrix(cells: DataFrame, columns: dict[str, int], keep_any: Sequence[str]) -> DataFrame:
    """rows by column positions the caller names"""
    header = cells.select(*SHEET).distinct().select(*SHEET, F.explode(F.array(*[
        F.struct(F.lit(r).alias("role"), F.lit(i).alias("col_idx")) for r, i in columns.items()])).alias("_p")).select(*SHEET, "_p.role", "_p.col_idx")
    return pivot_rows(cells, header, list(columns), keep_any)


def _positional(cells: DataFrame, names: Sequence[str], squeeze: bool = False) -> DataFrame:
    value = F.trim(T.squeeze(E("value"))) if squeeze else T.trim(E("value"))
    return cells.where("row_idx > 0").withColumn("value", value).groupBy(*SHEET, "row_idx").agg(*[
        F.coalesce(F.max(F.when(F.col("col_idx") == i, F.col("value"))), F.lit("")).alias(n) for i, n in enumerate(names)])


def sheet_roles(cells: DataFrame) -> DataFrame:
    """role of each ficha sheet: indice, ejemplo or nodo; and whether it says it has no fields"""
    marks = "|".join(K.FICHA_EMPTY_MARKS)
    found = cells.groupBy(*SHEET).agg(F.bool_or(F.coalesce(T.fold_upper("value").rlike(marks), F.lit(False))).alias("says_empty"))
    name = T.fold_upper("sheet")
    role = (F.when(name == K.FICHA_INDEX_SHEET.upper(), F.lit("indice")).when(name == K.FICHA_SAMPLE_SHEET.upper(), F.lit("ejemplo")).otherwise(F.lit("nodo")))
    return found.select(*SHEET, role.alias("role"), ((role == "nodo") & F.col("says_empty")).alias("empty"))


def read_positional(cells: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """Ficha rows of the node sheets: 14 columns by position, the routes of the row, its type,
    flags and destination. Kept when they have a label, a route or a source name."""
    roles = sheet_roles(cells) if roles is None else roles
    nodes = cells.join(roles.where((F.col("role") == "nodo") & ~F.col("empty")).select(*SHEET), SHEET, "left_semi")
    rows = _positional(nodes, K.FICHA_COLUMNS, squeeze=True).where((F.col("label") != "") | (F.col("route") != "") | (F.col("source_name") != ""))
    routes = F.filter(F.transform(F.split("route", ","), lambda r: F.trim(r)), lambda r: r != "")
    flags = C.ficha_flags(F.col("required"), F.col("step"), F.col("visualization"), F.col("rule"), F.col("route"))
    rows = rows.withColumn("routes", routes).withColumn("flags", flags).withColumn("type", C.lookup(K.FICHA_TYPES, T.fold_upper("data_type")))
    return rows.withColumn("dest", C.ficha_dest(F.col("flags"))).withColumn("route", F.coalesce(F.get("routes", F.lit(0)), F.lit("")))


def read_mapping22(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, warnings) of the 22 column mapping; rows need their current widget name. The
    options column is JSON; what cannot be parsed gives a warning."""
    def named(cells: DataFrame) -> DataFrame:
        return _positional(cells, K.MAPPING_COLUMNS).where(F.col("acro_actual") != "")

    rows = named(cells)
    bad = (F.col("options_raw") != "") & F.try_parse_json("options_raw").isNull()
    # a warning is made of two columns: their cells alone are put together for it, not the 22 of a row once more
    told = [K.MAPPING_COLUMNS.index(c) for c in ("acro_actual", "options_raw")]
    warnings = named(cells.where(F.col("col_idx").isin(told))).where(bad).select(*SHEET, (F.col("row_idx") + 1).alias("row"), F.col("acro_actual").alias("field"), F.lit("invalid_options_json").alias("type"))
    typed = rows.withColumns({
        "page": F.col("page").try_cast("int"), "max_length": F.nullif(F.col("max_length").try_cast("int"), F.lit(0)),
        "prefilled": C.yes_no("prefilled", "mapping"), "required": C.yes_no("required", "mapping"), "format": F.lower("format"),
        "data_type": F.lower("data_type"), "options": F.from_json("options_raw", "array<struct<value:string,label:string,jsonValue:string,pdfValue:string>>")})
    return typed, warnings


def validate_headers(cells: DataFrame, expected: Sequence[str], at_least: int = 20) -> DataFrame:
    """one missing_columns warning for a short header, else one per column that differs"""
    heads = cells.where("row_idx = 0").groupBy(*SHEET).agg((F.max("col_idx") + 1).alias("n"))
    short = heads.where(F.col("n") < at_least).select(*SHEET, F.lit("missing_columns").alias("type"), F.lit(None).cast("int").alias("column"),
                                                      F.lit(None).cast("string").alias("expected"), F.col("n").cast("string").alias("actual"))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("col_idx"), F.lit(n).alias("expected")) for i, n in enumerate(expected)])).alias("_w")
    long = heads.where(F.col("n") >= at_least).select(*SHEET, wanted).select(*SHEET, "_w.*")
    actual = cells.where("row_idx = 0").select(*SHEET, F.col("col_idx").cast("int").alias("col_idx"), T.trim(E("value")).alias("actual"))
    diff = long.join(actual, [*SHEET, "col_idx"], "left").withColumn("actual", F.coalesce("actual", F.lit(""))).where(F.lower("actual") != F.lower("expected"))
    return short.unionByName(diff.select(*SHEET, F.lit("header_mismatch").alias("type"), (F.col("col_idx") + 1).alias("column"), "expected", "actual"))


def read_rename_pairs(cells: DataFrame, changed_only: bool = False) -> DataFrame:
    """(actual, proposed) widget names of the first header row that names both columns"""
    top = cells.where("row_idx < 5").withColumn("v", F.lower(T.trim(E("value"))))
    heads = top.groupBy(*SHEET, "row_idx").agg(F.max(F.when(F.col("v").rlike(r"acroform\s*actual"), F.col("col_idx"))).alias("a"),
                                               F.max(F.when(F.col("v").rlike(r"acroform\s*propuesto"), F.col("col_idx"))).alias("p"))
    head = heads.where("a IS NOT NULL AND p IS NOT NULL").groupBy(*SHEET).agg(F.min_by(F.struct("row_idx", "a", "p"), "row_idx").alias("_h"))
    head = head.select(*SHEET, F.col("_h.row_idx").alias("header_row"), "_h.a", "_h.p")
    rows = cells.join(head, SHEET).where(F.col("row_idx") > F.col("header_row")).withColumn("v", T.trim(E("value")))
    pairs = rows.groupBy(*SHEET, "row_idx").agg(F.coalesce(F.max(F.when(F.col("col_idx") == F.col("a"), F.col("v"))), F.lit("")).alias("actual"),
                                                F.coalesce(F.max(F.when(F.col("col_idx") == F.col("p"), F.col("v"))), F.lit("")).alias("proposed"))
    pairs = pairs.where(F.col("actual") != "").withColumn("proposed", T.or_else(F.col("proposed"), F.col("actual")))
    return pairs.where(F.col("actual") != F.col("proposed")) if changed_only else pairs


def detect_layout(cells: DataFrame) -> DataFrame:
    """layout of each file: new (its own sheet), canonical (two sheets), flexible (label and
    section headers in row 0 of the first sheet), else mapping22"""
    # texts in the buffers of an aggregate make Spark sort its rows: the few sheets are told from the cells first
    sheets = cells.select(*SHEET, "sheet_ord").distinct()
    names = sheets.groupBy(*FILE).agg(F.bool_or(F.col("sheet") == "Campos del formulario").alias("_new"), F.bool_or(F.col("sheet") == "Campos").alias("_a"),
                                     F.bool_or(F.col("sheet") == "Opciones").alias("_b"), F.min_by("sheet", "sheet_ord").alias("sheet"))
    first = cells.join(names.select(*FILE, "sheet"), SHEET, "left_semi")
    flex = header_by_pattern(first, K.FLEX_HEADERS).groupBy(*FILE).agg(
        (F.bool_or(F.col("role") == "label") & F.bool_or(F.col("role") == "section")).alias("_flex"))
    layout = (F.when(F.col("_new"), F.lit("new")).when(F.col("_a") & F.col("_b"), F.lit("canonical"))
              .when(F.coalesce("_flex", F.lit(False)), F.lit("flexible")).otherwise(F.lit("mapping22")))
    return names.join(flex, FILE, "left").select(*FILE, layout.alias("layout"))


def read_catalogs(cells: DataFrame, strict: bool = False) -> DataFrame:
    """catalog items: every sheet is a catalog with a code and a label column.

    The code is the first header that names one (else the first column), the label the first
    other header that names one (else the second column). Strict reading wants the exact
    headers Codigo and Nombre or Descripcion and drops rows without a label.
    """
    data = cells.where("row_idx > 0")
    if strict:
        low = F.lower(T.trim(E("value")))
        heads = cells.where("row_idx = 0").groupBy(*SHEET).agg(F.min(F.when(low == "codigo", F.col("col_idx"))).alias("code_col"),
                                                               F.min_by("col_idx", F.when(low.isin("nombre", "descripcion"), F.struct(low == "descripcion", F.col("col_idx")))).alias("label_col"))
    else:
        low = F.lower(E("value"))
        named = cells.where("row_idx = 0").select(*SHEET, "col_idx", _contains_any(low, K.CATALOG_CODE_HEADERS).alias("c"), _contains_any(low, K.CATALOG_LABEL_HEADERS).alias("l"))
        code = named.groupBy(*SHEET).agg(F.coalesce(F.min(F.when(F.col("c"), F.col("col_idx"))), F.lit(0)).alias("code_col"), F.max("col_idx").alias("_last"))
        label = named.join(code, SHEET).groupBy(*SHEET, "code_col", "_last").agg(F.min(F.when(F.col("l") & (F.col("col_idx") != F.col("code_col")), F.col("col_idx"))).alias("_l"))
        heads = label.withColumn("label_col", F.coalesce("_l", F.when(F.col("_last") >= 1, F.lit(1)), F.col("code_col"))).drop("_l", "_last")
    value = T.trim(E("value"))
    rows = data.join(heads, SHEET).groupBy(*SHEET, "row_idx").agg(
        F.coalesce(F.max(F.when(F.col("col_idx") == F.col("code_col"), value)), F.lit("")).alias("code"),
        F.coalesce(F.max(F.when(F.col("col_idx") == F.col("label_col"), value)), F.lit("")).alias("label"))
    keep = F.col("label") != "" if strict else (F.col("code") != "") | (F.col("label") != "")
    return rows.where(keep).select(*FILE, F.col("sheet").alias("catalog"), T.key_slug("sheet").alias("catalog_key"), F.col("row_idx").alias("ord"), "code", "label")


def read_ficha_index(cells: DataFrame, size: int = SLICE) -> DataFrame:
    """nodes with their step and section; a blank node takes the one above and is an instance"""
    rows = _positional(cells, ["node", "step", "section"], squeeze=True).where("node <> '' OR step <> '' OR section <> ''")
    out = ordered_scan(rows, SHEET, [F.col("row_idx")], F.floor(F.col("row_idx") / size), carried={"_node": F.nullif("node", F.lit(""))})
    return out.select(*SHEET, F.col("row_idx").alias("ord"), F.coalesce("_node", F.lit("")).alias("node"), "step", "section", (F.col("node") == "").alias("is_instance"))


def read_lines_as_json(cells: DataFrame) -> DataFrame:
    """a sheet that holds one JSON document, a line per row: (sheet, body, valid).

    The document is one value by nature; only its own lines are gathered.
    """
    line = cells.groupBy(*SHEET, "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", E("value").alias("v")))).alias("c")).select(
        *SHEET, "row_idx", F.array_join(F.transform("c", lambda x: x.v), "").alias("line"))
    doc = line.groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct("row_idx", "line"))).alias("l")).select(
        *SHEET, F.array_join(F.transform("l", lambda x: x.line), "\n").alias("body"))
    return doc.withColumn("valid", F.try_parse_json("body").isNotNull())


def read_by_header(cells: DataFrame) -> DataFrame:
    """long rows (sheet, row_idx, header, value) of sheets whose row 0 names the columns"""
    heads = filled(cells.where("row_idx = 0")).select(*SHEET, "col_idx", F.col("value").alias("header"))
    return filled(cells.where("row_idx > 0")).join(heads, [*SHEET, "col_idx"]).select(*SHEET, "row_idx", "header", "value")


def read_canonical(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields, options) of the two sheet workbook as long rows by header; blank rows are gone
    because only filled cells make rows"""
    long = read_by_header(cells)
    return long.where(F.col("sheet") == "Campos"), long.where(F.col("sheet") == "Opciones")


# ---- counting rules ------------------------------------------------------------------------

def sheet_rules(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sheet statistics, field keys) of rule sheets: business and conditional rules, catalog
    references, field rows; catalogs carry items and no rules; output sheets are ignored."""
    full = filled(cells)
    ignored = F.col("sheet").rlike(K.IGNORED_SHEET)
    header = header_by_density(cells.where(~ignored))
    placed = full.where(~ignored).join(header, SHEET)
    kind = C.first_match(F.col("value"), [(rx, k) for k, rx in K.RULE_COLUMNS], F.lit(None).cast("string"))
    heads = placed.where(F.col("row_idx") == F.col("header_row")).select(
        *SHEET, "col_idx", kind.alias("kind"), F.col("value").rlike(K.FIELD_COLUMN).alias("is_field"))
    columns = heads.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("columns"), F.count("kind").alias("rule_columns"))
    data = placed.where(F.col("row_idx") > F.col("header_row")).select(*SHEET, "row_idx", "col_idx", "value")
    rows = data.select(*SHEET, "row_idx").distinct().groupBy(*SHEET).agg(F.count(F.lit(1)).alias("rows"))
    value = F.col("value")
    known = data.join(heads.where("kind IS NOT NULL OR is_field"), [*SHEET, "col_idx"])
    condition = value.rlike(K.CONDITION_TEXT)
    # what a rule cell counts as: c(onditional), b(usiness), r(eference to a catalog)
    counted = (F.when(F.col("kind").isNull() | T.is_junk_value(value), F.lit(""))
               .when(F.col("kind") == "obligatorio", F.when(value.rlike(K.YES_TEXT), F.lit("b")).otherwise(F.lit("")))
               .when(F.col("kind").isin("visualizacion", "observaciones", "regla") & condition, F.lit("c"))
               .when((F.col("kind") == "valor") & value.rlike(K.CATALOG_REFERENCE), F.lit("r")).otherwise(F.lit("b")))
    rules = known.withColumn("_as", counted).groupBy(*SHEET).agg(
        F.count_if(F.col("_as").isin("b", "r")).alias("business_rules"), F.count_if(F.col("_as") == "c").alias("conditional_rules"),
        F.count_if(F.col("_as") == "r").alias("catalog_refs"))
    # the key of a field row: the texts of its few naming columns
    keys = known.where("is_field").groupBy(*SHEET, "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", T.strip_accents(F.lower("value")).alias("v")))).alias("k")).select(
        *SHEET, "row_idx", F.array_join(F.transform("k", lambda x: x.v), "|").alias("field_key"))
    field_rows = keys.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("field_rows"))
    stats = columns.join(rows, SHEET, "left").join(rules, SHEET, "left").join(field_rows, SHEET, "left").na.fill(0)
    catalog = F.col("sheet").rlike(K.CATALOG_SHEET) | ((F.col("rule_columns") == 0) & (F.col("columns") > 0) & (F.col("columns") <= 3) & (F.col("rows") >= 5))
    stats = stats.withColumn("is_catalog", catalog).withColumn("catalog_items", F.when(catalog, F.col("rows")).otherwise(0)).withColumn("ignored", F.lit(False))
    stats = stats.withColumns({c: F.when(catalog, 0).otherwise(F.col(c)) for c in ("business_rules", "conditional_rules")})
    skipped = full.where(ignored).select(*SHEET, "row_idx").distinct().groupBy(*SHEET).agg(F.count(F.lit(1)).alias("rows")).withColumn("ignored", F.lit(True))
    out = stats.unionByName(skipped, allowMissingColumns=True)
    return out.withColumn("is_catalog", F.coalesce("is_catalog", F.lit(False))).na.fill(0), keys


def file_rules(sheet_stats: DataFrame) -> DataFrame:
    """sheet statistics added up per file, without the ignored sheets"""
    live = ~F.col("ignored")
    return sheet_stats.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("sheet_count"), F.count_if("ignored").alias("ignored_sheets"),
        *[F.sum(F.when(live, F.col(c)).otherwise(0)).alias(c) for c in ("business_rules", "conditional_rules", "field_rows", "catalog_items", "catalog_refs")],
        F.count_if(live & F.col("is_catalog")).alias("catalogs"))


