"""Matching records of one source to another: catalogs, matrix rows, widgets, ficha rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formspark import constants as K
from formspark.functions import classify as C
from formspark.functions import paths as P
from formspark.functions import text as T
from formspark.kernels import SLICE, by_key, first_by, last_by, ordered_scan, ranked_join
from formspark.operators.fuzzy import best_similar, contained_words
from formspark.session import cut_lineage

E = T.text_or_empty


# ---- catalogs ------------------------------------------------------------------------------

def join_catalog(fields: DataFrame, catalog_items: DataFrame) -> DataFrame:
    """catalog_name of choice fields, by the first of several names that is a catalog;
    use_catalog tells whether its items replace the options (one option or none so far).

    fields: form_id, ord, type, label, pdf_label, json_name, n_options
    """
    label = F.col("label")
    names = [label, F.col("pdf_label"), T.replace(label, r"(?i)^tipo\s+de\s+", "tipo "), F.col("json_name")]
    low = F.lower(E(label))
    names += [F.when(low.rlike(rx), F.lit(name)) for rx, name in K.CATALOG_HINTS]
    attempts = [(i, "name", T.key_slug(n)) for i, n in enumerate(names)]
    catalogs = catalog_items.select(F.col("catalog").alias("catalog_name")).distinct()
    choice = F.col("type").isin("select", "radio")
    tries = [(r, i, F.when(choice, k).otherwise(F.lit(""))) for r, i, k in attempts]
    out = ranked_join(fields, ["form_id", "ord"], tries, catalogs, [("name", T.key_slug("catalog_name"))], ["catalog_name"],
                      ["catalog_name"], last_wins=True)
    return out.withColumn("use_catalog", F.col("catalog_name").isNotNull() & (F.coalesce("n_options", F.lit(0)) <= 1))


def find_catalog(rows: DataFrame, catalogs: DataFrame) -> DataFrame:
    """(sheet, synthetic) of a group or label: a built-in catalog, the sheet of the group,
    then the sheet of the first label pattern that has one. A sheet is found by its name,
    else by containment either way (the first sheet).

    rows: form_id, ord, group_name, label; catalogs: catalog (sheet name), cat_ord
    """
    g = F.lower(T.trim(E("group_name")))
    by_group = C.lookup(K.GROUP_CATALOGS, g)
    by_label = [F.when(E("label").rlike(rx), F.lit(sheet)) for rx, sheet in K.LABEL_CATALOGS]
    # the sheets a text may lead to are a fixed short list, so containment is decided per
    # (sheet wanted, catalog) once and not per row
    wanted = sorted({*K.GROUP_CATALOGS.values(), *[s for _, s in K.LABEL_CATALOGS]})
    names = catalogs.select("cat_ord", F.lower(T.trim("catalog")).alias("key")).where(F.col("key") != "")
    hits = names.select("cat_ord", "key", F.explode(F.array(*[F.lit(w) for w in wanted])).alias("want")).where(
        F.col("key").contains(F.col("want")) | F.col("want").contains(F.col("key")))
    sheet = hits.groupBy("want").agg(F.min_by("key", F.struct(F.col("key") != F.col("want"), "cat_ord")).alias("sheet"))
    tries = F.filter(F.array(*[F.struct(F.lit(i).alias("rank"), c.alias("want")) for i, c in enumerate([by_group, *by_label])]),
                     lambda t: t.want.isNotNull())
    synthetic = C.lookup({k: v[0] for k, v in K.SYNTHETIC_CATALOGS.items()}, g)
    probe = rows.where(synthetic.isNull()).select("form_id", "ord", F.explode(tries).alias("t")).select("form_id", "ord", "t.*")
    best = probe.join(sheet, "want").groupBy("form_id", "ord").agg(F.min_by("sheet", "rank").alias("sheet"))
    return rows.join(best, ["form_id", "ord"], "left").withColumn("synthetic", synthetic.isNotNull()).withColumn(
        "sheet", F.coalesce(synthetic, F.col("sheet")))


def inline_options(rows: DataFrame) -> DataFrame:
    """options of a label that stands on several rows with a value: its distinct values"""
    full = rows.where(T.trim(E("value")) != "")
    many = full.groupBy("form_id", "label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("form_id", "label")
    values = full.groupBy("form_id", "label", T.trim("value").alias("value")).agg(F.min("ord").alias("ord"))
    return values.join(many, ["form_id", "label"])


def resolve_options(fields: DataFrame, combo: DataFrame, catalog_items: DataFrame) -> DataFrame:
    """Where the options of a choice field come from: combo rows, a direct list, the catalog a
    rule points to, a catalog known by words of the label.

    fields: form_id, ord, type, label, field_label, pdf_label, rule, catalog_direct
    combo: form_id, label (labels with value rows); catalog_items: catalog
    Adds origin and catalog_name (the options themselves stay in the long tables).
    """
    choice = F.col("type").isin("select", "radio")
    combos = combo.select("form_id", F.col("label").alias("field_label")).distinct().withColumn("has_combo", F.lit(True))
    direct = E("catalog_direct")
    listed = T.trim(T.replace(direct, "^[^:]*:", ""))
    has_direct = direct.contains(":")
    direct_name = F.when(has_direct & listed.startswith("("), T.trim(F.split(direct, ":")[0]))
    tipo = [T.replace(F.col(c), r"(?i)^tipo\s+de\s+", "tipo ") for c in ("field_label", "pdf_label", "label")]
    by_rule = F.lower(E("rule")).rlike(r"cat[aá]logo|ver\s+cat")
    low = F.lower(T.or_else(E("field_label"), E("label")))
    attempts = [(1, "name", T.key_slug(direct_name))]
    for i, (plain, short) in enumerate(zip((F.col("field_label"), F.col("pdf_label"), F.col("label")), tipo)):
        attempts += [(10 + 2 * i, "name", F.when(by_rule, T.key_slug(plain)).otherwise(F.lit(""))),
                     (11 + 2 * i, "name", F.when(by_rule, T.key_slug(short)).otherwise(F.lit("")))]
    attempts += [(20 + i, "name", F.when(low.rlike(rx.replace(r"\s+", r"\s*")), T.key_slug(F.lit(name))).otherwise(F.lit("")))
                 for i, (rx, name) in enumerate(K.CATALOG_HINTS)]
    catalogs = catalog_items.select(F.col("catalog").alias("catalog_name")).distinct()
    out = ranked_join(fields.join(combos, ["form_id", "field_label"], "left"), ["form_id", "ord"], attempts, catalogs,
                      [("name", T.key_slug("catalog_name"))], ["catalog_name"], ["catalog_name"], rank_name="_rank")
    rank = F.col("_rank")
    origin = (F.when(~choice, F.lit(None)).when(F.col("has_combo"), F.lit("combo"))
              .when(rank == 1, F.lit("direct_catalog")).when(has_direct & (listed != ""), F.lit("direct"))
              .when(rank < 20, F.lit("rule_catalog")).when(rank >= 20, F.lit("known_catalog")))
    used = origin.isin("direct_catalog", "rule_catalog", "known_catalog")
    return out.withColumn("origin", origin).withColumn("catalog_name", F.when(used, F.col("catalog_name"))).drop("_rank", "has_combo")


# ---- conditions ---------------------------------------------------------------------------

def resolve_condition_target(conditions: DataFrame, fields: DataFrame) -> DataFrame:
    """Field a condition depends on, by folded label (the last field of a label wins).

    conditions: form_id, ord, kind, label, value, leftover; fields: form_id, ord, id, label, pdf_label
    Adds depends_on, operator and warning.
    """
    index = [("label", T.fold("label")), ("label", F.when(E("pdf_label") != E("label"), T.fold("pdf_label")).otherwise(F.lit("")))]
    asks = F.when(F.col("kind").isin("equals", "depends"), T.fold("label")).otherwise(F.lit(""))
    targets = fields.select("form_id", F.col("ord").alias("f_ord"), F.col("id").alias("depends_on"), "label", "pdf_label")
    out = ranked_join(conditions, ["ord"], [(0, "label", asks)], targets, index, ["depends_on"], ["f_ord"], ["form_id"], last_wins=True)
    warning = (F.when((F.col("kind") == "equals") & F.col("depends_on").isNull(), F.lit("unknown_reference"))
               .when(F.col("kind").isNull() | ((F.col("kind") == "depends") & F.col("depends_on").isNull()), F.col("leftover")))
    operator = F.when(F.col("depends_on").isNotNull(), F.when(E("value") == "", F.lit("not_empty")).otherwise(F.lit("equals")))
    return out.withColumn("warning", warning).withColumn("operator", operator).drop("match_rank")


def move_trigger(triggers: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triggers moved to the field they show: (form_id, id, depends_on, value) with the last
    trigger of a target, and the triggers without a target.

    triggers: form_id, ord, id, target, value; fields: form_id, ord, id, label, source_name
    """
    index = [("label", T.fold("label")), ("label", F.lower(F.translate(E("source_name"), "_", " ")))]
    targets = fields.select("form_id", F.col("ord").alias("f_ord"), F.col("id").alias("target_id"), "label", "source_name")
    asked = triggers.withColumn("_t", T.fold("target"))
    found = ranked_join(asked, ["ord"], [(0, "label", F.col("_t"))], targets, index, ["target_id"], ["f_ord"], ["form_id"], last_wins=True)
    moved = last_by(found.where(F.col("target_id").isNotNull()).withColumnRenamed("id", "depends_on"), ["form_id", "target_id"], ["ord"],
                    ["depends_on", "value"]).withColumnRenamed("target_id", "id")
    return moved, found.where(F.col("target_id").isNull()).select("form_id", "ord", "id", "target")


# ---- matrix and widgets ---------------------------------------------------------------------

def join_coords(rows: DataFrame, widgets: DataFrame, cols: Sequence[str] = ("name", "page", "x", "y")) -> DataFrame:
    """Widget of a matrix row: its PDF name, its PDF name normalised, its PDF label."""
    attempts = [(1, "exact", E("pdf_field_name")), (2, "norm", T.key_slug("pdf_field_name", drop_index=True)),
                (3, "norm", T.key_slug("pdf_label", drop_index=True))]
    keys = [("exact", F.col("name")), ("norm", T.key_slug("name", drop_index=True))]
    right = widgets.withColumnRenamed("ord", "w_ord")
    out = ranked_join(rows, ["ord"], attempts, right, keys, list(cols), ["w_ord"], ["form_id"], last_wins=True)
    miss = F.col("match_rank").isNull() & (E("pdf_field_name") != "")
    return out.withColumn("warning", F.when(miss, F.lit("pdf_field_not_found")))


def enrich_by_source(fields: DataFrame, rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Matrix row of a form field: by exact PDF name, then by any of its normalised names.
    The last row of a name wins. Adds ``row_ord``, ``cols`` and a warning."""
    key = T.key_slug("source_name", drop_index=True)
    names = [T.key_slug(c, drop_index=True) for c in ("pdf_field_name", "pdf_label", "label")]
    right = rows.withColumnRenamed("ord", "row_ord")
    out = ranked_join(fields, ["ord"], [(1, "exact", E("source_name")), (2, "norm", key)], right,
                      [("exact", E("pdf_field_name")), *[("norm", n) for n in names]], ["row_ord", *cols], ["row_ord"], ["form_id"], last_wins=True)
    warning = (F.when(E("source_name") == "", F.lit("no_source_name")).when(F.col("row_ord").isNull(), F.lit("no_excel_match")))
    return out.withColumn("warning", warning)


def unused_rows(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """matrix rows whose PDF name no field carries"""
    used = fields.where(E("source_name") != "").select("form_id", T.key_slug("source_name", drop_index=True).alias("_k")).distinct()
    return rows.where(E("pdf_field_name") != "").withColumn("_k", T.key_slug("pdf_field_name", drop_index=True)).join(
        used, ["form_id", "_k"], "left_anti").drop("_k")


# The lookups of the cascade, in order, with their confidence.
CASCADE = [
    ("pdf-field-name", 100, "pdf_name"), ("pdf-field-name-base", 95, "pdf_name"), ("pdf-label", 90, "pdf_label"),
    ("form-label", 85, "form_label"), ("snake-to-form", 80, "form_label"), ("snake-to-pdf", 75, "pdf_label"), ("json-leaf", 70, "json_leaf"),
    ("last-segment-pdf", 65, "pdf_label"), ("last-segment-form", 60, "form_label"),
]
#: A hit of less confidence ends the lookups of a variant of the name, but is no match.
CASCADE_GATE = 70


def _row_keys() -> list[tuple[str, Column]]:
    return [("pdf_name", T.norm_words("pdf_field_name")), ("pdf_label", T.norm_words("pdf_label")),
            ("form_label", T.norm_words("field_label")), ("json_leaf", P.json_leaf("json_name"))]


def base_name(c: Column | str) -> Column:
    return T.replace(T.replace(E(c), r"_(\d+)$", ""), r"(?i)_Row_(\d+)$", "")


def _last_segment(c: Column) -> Column:
    """the last of several parts of a name between underscores"""
    parts = F.filter(F.split(c, "_"), lambda p: p != "")
    return F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit(""))


def cascade_match(fields: DataFrame, rows: DataFrame) -> DataFrame:
    """First hit of nine lookups for each of up to four variants of the source name, of the
    first variant whose hit reaches the gate: adds row_ord, confidence, source and row_index.
    Indexes keep their first row.

    fields: form_id, ord, source_name, label; rows: form_id, ord, pdf_field_name, pdf_label,
    field_label, json_name
    """
    keyed = fields.withColumn("_variants", P.name_variants("source_name")).withColumn("_label", T.norm_words(T.clean_label("label", drop_number=True)))
    attempts = []
    for v in range(4):
        variant = F.coalesce(F.get("_variants", F.lit(v)), F.lit(""))
        there = F.size("_variants") > v
        human = T.norm_words(base_name(variant))
        last = T.norm_words(_last_segment(base_name(variant)))
        keys = [T.norm_words(variant), human, F.col("_label"), F.col("_label"), human, human, human, last, last]
        attempts += [(100 * v + i, CASCADE[i][2], F.when(there & (F.length(k) >= 2), k).otherwise(F.lit("")))
                     for i, k in enumerate(keys)]
    right = rows.withColumnRenamed("ord", "row_ord")
    rounds = [[100 * v + i for i in range(len(CASCADE))] for v in range(4)]
    passing = [rank for ranks in rounds for rank, (_, confidence, _) in zip(ranks, CASCADE, strict=True) if confidence >= CASCADE_GATE]
    out = ranked_join(keyed, ["ord"], attempts, right, _row_keys(), ["row_ord"], ["row_ord"], ["form_id"], rounds=rounds, passing=passing)
    step = F.col("match_rank") % 100
    confidence = F.array(*[F.lit(c) for _, c, _ in CASCADE])
    source = F.array(*[F.lit(s) for s, _, _ in CASCADE])
    return out.select(*fields.columns, "row_ord", F.get(confidence, step).alias("confidence"), F.get(source, step).alias("source"),
                      P.repeat_index("source_name").alias("row_index"))


def catalog_value_match(fields: DataFrame, rows: DataFrame) -> DataFrame:
    """fields named like a value of a row's own list ("Name: a|b"): (form_id, ord, row_ord)"""
    values = F.split(T.replace(F.col("catalog_direct"), "^[^:]*:", ""), r"\|")
    listed = rows.where(E("catalog_direct").contains(":")).select("form_id", F.col("ord").alias("row_ord"), F.explode(values).alias("v"))
    index = listed.select("form_id", "row_ord", T.norm_words("v").alias("key")).groupBy("form_id", "key").agg(F.min("row_ord").alias("row_ord"))
    probe = fields.select("form_id", "ord", T.norm_words("source_name").alias("key")).where(F.length("key") >= 2)
    return probe.join(by_key(index), ["form_id", "key"]).select("form_id", "ord", "row_ord")


def _last_variant() -> Column:
    return F.element_at(P.name_variants("source_name"), -1)


def _long_texts(fields: DataFrame) -> DataFrame:
    """the label and the name of a field as two ranked keys"""
    keys = F.array(F.struct(F.lit(0).alias("key_rank"), T.norm_words(T.clean_label("label", drop_number=True)).alias("key")),
                   F.struct(F.lit(1).alias("key_rank"), T.norm_words(_last_variant()).alias("key")))
    return fields.select("form_id", "ord", F.explode(keys).alias("k")).select("form_id", "ord", "k.*").where(F.length("key") >= 3)


def _label_index(rows: DataFrame, kinds: Sequence[str]) -> DataFrame:
    entry = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), k.alias("key")) for i, (n, k) in enumerate(
        [(n, k) for n, k in _row_keys() if n in kinds])])).alias("e")
    return rows.select("form_id", F.col("ord").alias("row_ord"), entry).select("form_id", "row_ord", "e.*").where(F.length("key") >= 3)


def fuzzy_row_match(fields: DataFrame, rows: DataFrame) -> DataFrame:
    """most similar label (similarity over 0.72): (form_id, ord, row_ord, score)"""
    index = _label_index(rows, ["pdf_label", "form_label", "json_leaf"])
    return best_similar(_long_texts(fields), ["ord"], index, ["kind", "row_ord"], ["row_ord"], ["form_id"], 0.72).select(
        "form_id", "ord", "row_ord", "score")


def word_match(fields: DataFrame, rows: DataFrame) -> DataFrame:
    """first row whose label holds every word of the name, else of the label"""
    texts = _long_texts(fields).withColumn("key_rank", 1 - F.col("key_rank"))
    index = first_by(_label_index(rows, ["pdf_label", "form_label"]), ["form_id", "kind", "key"], ["row_ord"], ["row_ord"])
    pairs = contained_words(texts, index, ["form_id"])
    hits = pairs.join(by_key(index.withColumnRenamed("key", "right_key")), ["form_id", "right_key"]).groupBy("form_id", "left_key").agg(
        F.min(F.struct("kind", "row_ord")).alias("h"))
    found = texts.join(by_key(hits.withColumnRenamed("left_key", "key")), ["form_id", "key"])
    return found.groupBy("form_id", "ord").agg(F.min_by("h.row_ord", "key_rank").alias("row_ord"))


def match_fields(fields: DataFrame, rows: DataFrame) -> DataFrame:
    """The whole cascade: lookups, listed values (75), similar labels (65 x score), words
    (55). Each later stage reads only what the earlier ones left over, so the leftovers are
    materialised once instead of being worked out again by every later stage."""
    cols = ["form_id", "ord", "row_ord", "confidence", "source"]
    exact = cut_lineage(cascade_match(fields, rows))
    left = exact.where(F.col("row_ord").isNull()).select(*fields.columns)
    listed = catalog_value_match(left, rows).select("form_id", "ord", "row_ord", F.lit(75).alias("confidence"), F.lit("catalog-value-match").alias("source"))
    left = cut_lineage(left.join(by_key(listed), ["form_id", "ord"], "left_anti"))
    fuzzy = fuzzy_row_match(left, rows).select("form_id", "ord", "row_ord", F.floor(F.col("score") * 65 + 0.5).cast("int").alias("confidence"),
                                               F.lit("fuzzy").alias("source"))
    fuzzy = cut_lineage(fuzzy)
    left = left.join(by_key(fuzzy), ["form_id", "ord"], "left_anti")
    words = word_match(left, rows).select("form_id", "ord", "row_ord", F.lit(55).alias("confidence"), F.lit("word-match").alias("source"))
    found = exact.where(F.col("row_ord").isNotNull()).select(*cols).unionByName(listed).unionByName(fuzzy).unionByName(words)
    return fields.join(by_key(found), ["form_id", "ord"], "left").withColumn("row_index", P.repeat_index("source_name"))


def fuzzy_join(left: DataFrame, right: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """Best partner of each left name: equal names 1.0, equal loose names 0.95, else similarity
    of the loose names from ``threshold`` on. Right rows are reused.

    left: form_id, ord, name; right: form_id, ord, name. Adds row_ord, match_type, match_score.
    """
    rights = right.select("form_id", F.col("ord").alias("row_ord"), "name")
    named = ranked_join(left, ["ord"], [(1, "exact", E("name")), (2, "loose", T.name_loose("name"))], rights,
                        [("exact", F.col("name")), ("loose", T.name_loose("name"))], ["row_ord"], ["row_ord"], ["form_id"])
    rest = named.where(F.col("match_rank").isNull()).select("form_id", "ord", T.name_loose("name").alias("key"))
    near = best_similar(rest, ["ord"], rights.withColumn("key", T.name_loose("name")), ["row_ord"], ["row_ord"], ["form_id"], threshold, strict)
    near = near.select("form_id", "ord", F.col("row_ord").alias("near_ord"), "score")
    out = named.join(near, ["form_id", "ord"], "left")
    kind = (F.when(F.col("match_rank") == 1, F.lit("exact")).when(F.col("match_rank") == 2, F.lit("normalized"))
            .when(F.col("near_ord").isNotNull(), F.lit("fuzzy")).otherwise(F.lit("none")))
    score = F.when(kind == "exact", F.lit(1.0)).when(kind == "normalized", F.lit(0.95)).when(kind == "fuzzy", F.col("score")).otherwise(F.lit(0.0))
    return out.select(*left.columns, F.coalesce("row_ord", "near_ord").alias("row_ord"), kind.alias("match_type"), score.alias("match_score"))


def _cell(tolerance: int) -> int:
    return max(4 * tolerance, 1)


def _cells_in_reach(x: str, y: str, tolerance: int) -> Column:
    """the cells (cx, cy) that lie within ``tolerance`` of a position, its own included"""
    def touched(at: str) -> Column:
        return F.sequence(*[F.floor((F.col(at).cast("long") + d) / _cell(tolerance)) for d in (-tolerance, tolerance)])
    return F.flatten(F.transform(touched(x), lambda i: F.transform(touched(y), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def near_point_join(widgets: DataFrame, positions: DataFrame, tolerance: int = 8) -> DataFrame:
    """First known position on the same page within ``tolerance`` points of the widget.

    Grid join: positions are rounded and made distinct, then listed in the cells that their reach touches. Cells
    are four times as wide as the tolerance, so that a position is in 2.3 of them on average, and a cell
    holds at most (6 * tolerance + 1)^2 of them.
    """
    fx, fy = C.half_up(F.col("x")).cast("int"), C.half_up(F.col("y")).cast("int")
    known = first_by(positions.withColumn("px", fx).withColumn("py", fy), ["form_id", "page", "px", "py"], ["ord"], ["ord", "source_name"])
    cell = _cell(tolerance)
    cells = F.explode(_cells_in_reach("px", "py", tolerance)).alias("c")
    spread = known.select("form_id", "page", "px", "py", F.col("ord").alias("p_ord"), "source_name", cells).select(
        "form_id", "page", "px", "py", "p_ord", "source_name", "c.cx", "c.cy")
    placed = widgets.select("form_id", "ord", "page", fx.alias("fx"), fy.alias("fy")).withColumn("cx", F.floor(F.col("fx") / cell)).withColumn(
        "cy", F.floor(F.col("fy") / cell))
    near = placed.join(spread, ["form_id", "page", "cx", "cy"]).where(
        (F.abs(F.col("px") - F.col("fx")) <= tolerance) & (F.abs(F.col("py") - F.col("fy")) <= tolerance))
    best = near.groupBy("form_id", "ord").agg(F.min_by("source_name", "p_ord").alias("source_name"))
    return widgets.join(best, ["form_id", "ord"], "left")


def name_from_row(name: Column, json_name: Column, field_name: Column, label: Column) -> Column:
    """new widget name told by a matrix row: its PDF name, the leaf of its path, the label"""
    def numbered(c: Column, n: Column) -> Column:
        block = T.replace(c, "(?i)beneficiario", "beneficiario")
        put = F.concat(F.substring_index(block, "beneficiario", 1), F.lit("beneficiario"), n,
                       F.substring(block, F.instr(block, "beneficiario") + 12, F.length(block)))
        return (F.when(n.isNull() | c.rlike(r"(?i)beneficiario\d"), c).when(c.rlike("(?i)beneficiario"), put)
                .otherwise(F.concat(c, F.lit("_"), n)))

    def told(r: Column) -> Column:
        """the raw name: each part is worked out once and named here"""
        keeps = r["name"].rlike(r"_\d+_") | r["name"].rlike(r"\d$")
        return (F.when(~r["blank"], F.when(keeps, r["name"]).otherwise(numbered(r["name"], r["n"]))).when(r["leaf"] != "", numbered(r["leaf"], r["n"]))
                .when(r["label"] != "", r["label"]))

    leaf = T.camel_to_snake(P.last_segment(T.trim(F.split(E(json_name), ",")[0])), "acronym")
    row = F.struct(E(name).alias("name"), T.is_placeholder(name).alias("blank"), E(leaf).alias("leaf"), P.row_number_of(field_name).alias("n"),
                   T.replace(T.norm_words(label), " ", "_").alias("label"))
    return T.let(T.let(row, told), lambda c: F.when(c.isNotNull(), T.sanitize_name(c)))


def resolve_name(widgets: DataFrame, rows: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """New name of a widget and where it comes from: its label among the rows (95), a similar
    label (75), its own name (90), a known position (85), its label as a name (50), unchanged.

    widgets: form_id, ord, name, label, page, x, y; rows: form_id, ord, pdf_label, field_label,
    pdf_field_name, json_name
    """
    cols = ["pdf_field_name", "json_name"]
    right = rows.select("form_id", F.col("ord").alias("row_ord"), "pdf_label", "field_label", *cols)
    label_keys = [("label", T.norm_words("pdf_label")), ("label", F.when(E("field_label") != E("pdf_label"), T.norm_words("field_label")).otherwise(F.lit("")))]
    name_keys = [("name", F.when(T.is_placeholder("pdf_field_name"), F.lit("")).otherwise(T.norm_words("pdf_field_name")))]
    by_label = ranked_join(widgets, ["ord"], [(1, "label", T.norm_words("label"))], right, label_keys, [*cols, "row_ord"], ["row_ord"], ["form_id"],
                           last_wins=True, rank_name="r1").withColumnsRenamed({c: f"l_{c}" for c in [*cols, "row_ord"]})
    rest = by_label.where(F.col("r1").isNull()).select("form_id", "ord", T.norm_words("label").alias("key"))
    entry = F.explode(F.array(*[k for _, k in label_keys])).alias("key")
    texts = last_by(right.select("form_id", "row_ord", *cols, entry).where(F.col("key") != ""), ["form_id", "key"], ["row_ord"], ["row_ord", *cols])
    near = best_similar(rest, ["ord"], texts, ["row_ord"], cols, ["form_id"], 0.75).select(
        "form_id", "ord", *[F.col(c).alias(f"f_{c}") for c in cols], F.lit(1).alias("r2"))
    bare = T.norm_words(T.replace(F.col("name"), r"\.\d+(\.\d+)*$", ""))
    asked = F.when(F.col("name").startswith("_unnamed_"), F.lit("")).otherwise(bare)
    named = ranked_join(by_label.join(near, ["form_id", "ord"], "left"), ["ord"], [(1, "name", asked), (2, "label", asked)], right, [*name_keys, *label_keys],
                        cols, ["row_ord"], ["form_id"], last_wins=True, rank_name="r3").withColumnsRenamed({c: f"n_{c}" for c in cols})
    if positions is None:
        named = named.withColumn("source_name", F.lit(None).cast("string"))
    else:
        named = near_point_join(named, positions)

    # names are made from one long expression per row: kept out of the stage of the joins
    named = cut_lineage(named)
    # the row that names the widget: by label, by similar label, by name (a label always gives a
    # name, so only the last of them can fail to)
    found = [F.when(F.col(r).isNotNull(), F.struct(F.lit(s).alias("source"), F.lit(k).alias("confidence"), F.col(f"{p}_pdf_field_name").alias("pdf"),
                                                   F.col(f"{p}_json_name").alias("json")))
             for r, s, k, p in (("r1", "excel-exact", 95, "l"), ("r2", "excel-fuzzy", 75, "f"), ("r3", "excel-field-name", 90, "n"))]
    named = named.withColumn("_row", F.coalesce(*found)).withColumn("_made", F.when(
        F.col("_row").isNotNull(), name_from_row(F.col("_row.pdf"), F.col("_row.json"), F.col("name"), F.col("label"))))
    derived = T.replace(T.norm_words("label"), " ", "_")
    picks = [(F.col("_made"), F.col("_row.source"), F.col("_row.confidence")), (F.col("source_name"), F.lit("reference-json"), F.lit(85)),
             (F.when((derived != "") & (derived != F.col("name")), derived), F.lit("derived"), F.lit(50)),
             (F.col("name"), F.lit("unchanged"), F.lit(0))]
    pick = F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("new_name"), s.alias("source"), k.alias("confidence"))) for c, s, k in picks])
    return named.withColumn("_p", pick).select(*widgets.columns, "_p.*")


def mapping_join(widgets: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Renames by a mapping (the last pair of a name wins) and the pairs no widget has."""
    last = last_by(pairs.where((E("actual") != "") & (E("proposed") != "")).withColumnRenamed("ord", "p_ord"), ["form_id", "actual"], ["p_ord"], ["proposed"])
    out = widgets.join(last.withColumnRenamed("actual", "name"), ["form_id", "name"], "left")
    named = out.select(*widgets.columns, F.coalesce("proposed", "name").alias("new_name"),
                       F.when(F.col("proposed").isNotNull(), F.lit("excel-exact")).otherwise(F.lit("unchanged")).alias("source"),
                       F.when(F.col("proposed").isNotNull(), 100).otherwise(0).alias("confidence"))
    lost = last.join(widgets.select("form_id", F.col("name").alias("actual")).distinct(), ["form_id", "actual"], "left_anti")
    return named, lost


def verify_renames(renames: DataFrame, widgets: DataFrame) -> DataFrame:
    """renames whose new name is not among the widgets"""
    return renames.join(widgets.select("form_id", F.col("name").alias("new_name")).distinct(), ["form_id", "new_name"], "left_anti")


def cross_reference(rows: DataFrame, widgets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Widget of each mapping row (exact name, then loose name; the first widget) and the
    widgets no row names."""
    right = widgets.select("form_id", F.col("ord").alias("w_ord"), F.col("name").alias("widget"))
    loose = T.name_loose("acro_actual", fold_vowels=False)
    out = ranked_join(rows, ["ord"], [(1, "exact", E("acro_actual")), (2, "loose", loose)], right,
                      [("exact", F.col("widget")), ("loose", T.name_loose("widget", fold_vowels=False))], ["widget"], ["w_ord"], ["form_id"])
    used = out.where(F.col("widget").isNotNull()).select("form_id", F.col("widget").alias("name")).distinct()
    return out, widgets.join(used, ["form_id", "name"], "left_anti")


def combine(fields: DataFrame, rows: DataFrame, cols: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Mapping row of each form field (by source name, else by its widget names) and the rows
    no field uses under any of their names.

    source names and current names keep their last row; a proposed name only fills a gap
    """
    key = F.when(E("source_name") != "", F.col("source_name")).otherwise(T.replace(E("id"), "^field_", ""))
    right = rows.withColumnRenamed("ord", "row_ord").withColumnRenamed("source_name", "row_source")
    out = ranked_join(fields.withColumn("_key", key), ["ord"], [(1, "source", F.col("_key")), (2, "acro", F.col("_key"))], right,
                      [("source", E("row_source")), ("acro", E("acro_actual"))], ["row_ord", *cols], ["row_ord"], ["form_id"], last_wins=True)
    proposed = first_by(right.where(E("acro_proposed") != "").withColumn("_key", F.col("acro_proposed")), ["form_id", "_key"], ["row_ord"], ["row_ord", *cols])
    gap = proposed.select("form_id", "_key", *[F.col(c).alias(f"_g_{c}") for c in ["row_ord", *cols]])
    out = out.join(gap, ["form_id", "_key"], "left")
    hit = F.col("match_rank").isNotNull()
    matched = out.select(*fields.columns, *[F.when(hit, F.col(c)).otherwise(F.col(f"_g_{c}")).alias(c) for c in ["row_ord", *cols]])
    names = right.select("form_id", "row_ord", F.explode(F.array("row_source", "acro_actual", "acro_proposed")).alias("n")).where(F.col("n").isNotNull())
    used = names.join(matched.where(F.col("row_ord").isNotNull()).select("form_id", "row_ord").distinct(), ["form_id", "row_ord"]).select("form_id", "n").distinct()
    asked = right.select("form_id", "row_ord", F.explode(F.array(E("row_source"), E("acro_actual"))).alias("n"))
    hit_rows = asked.join(used, ["form_id", "n"], "left_semi").select("form_id", F.col("row_ord").alias("ord")).distinct()
    return matched, rows.join(hit_rows, ["form_id", "ord"], "left_anti")


def overlay_fields(matched: DataFrame) -> DataFrame:
    """Attributes of a matched mapping row laid over a form field. Id and source never change.

    matched: id, label, hidden, read_only, output, source_name and, of the row, m_label,
    m_data_type, m_native, m_group, m_options, m_required, m_prefilled, m_path, m_secondary,
    m_max_length, m_pattern, m_format
    """
    path = P.correct_path("m_path")
    type_ = C.mapping_type(F.col("m_data_type"), F.col("m_native"), F.col("m_group"), E("m_options") != "")
    has_path = E(path) != ""
    mode = F.when(F.col("m_prefilled"), F.lit("required")).when(~F.col("m_prefilled"), F.lit("none"))
    bar = F.col("m_secondary").contains("|")
    secondary = F.when(bar, F.split("m_secondary", r"\|")).otherwise(F.split("m_secondary", ","))
    width = F.when((type_ == "date") | ((type_ == "select") & (E("m_options") != "")), F.lit("half")).otherwise(F.lit("full"))
    return matched.select(
        "form_id", "ord", "id", "source_name", T.or_else(E("m_label"), E("label")).alias("label"), type_.alias("type"),
        F.coalesce("m_required", F.lit(False)).alias("required"), F.coalesce("hidden", F.lit(False)).alias("hidden"),
        F.when(E("source_name") != "", F.lit(False)).otherwise(F.coalesce("read_only", F.lit(False))).alias("read_only"), mode.alias("prefill_mode"),
        F.when(has_path, path).otherwise(F.col("output")).alias("output"), F.when(has_path, path).alias("prefill_key"),
        F.when(has_path, F.lit(False)).when(E("output") == "", F.lit(True)).alias("exclude"),
        F.array_join(F.filter(F.transform(secondary, T.trim), lambda p: p != ""), " | ").alias("mapped_paths"),
        F.when(F.col("m_max_length") > 0, F.col("m_max_length")).alias("max_length"), F.nullif("m_pattern", F.lit("")).alias("pattern"),
        C.number_format("m_format").alias("number_format"), width.alias("width"))


def merge_business(groups: DataFrame, members: DataFrame, ficha: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Ficha row of a group: of its root, else of its first member that has one.

    groups: form_id, key, root; members: form_id, key, ord, source_name; ficha: form_id, ord, source_name
    """
    index = first_by(ficha.where(E("source_name") != ""), ["form_id", "source_name"], ["ord"], list(cols))
    tries = groups.select("form_id", "key", F.lit(-1).cast("long").alias("rank"), F.col("root").alias("source_name")).unionByName(
        members.select("form_id", "key", F.col("ord").cast("long").alias("rank"), "source_name"))
    best = tries.join(index, ["form_id", "source_name"]).groupBy("form_id", "key").agg(F.min_by(F.struct(*cols), "rank").alias("b"))
    return groups.join(best.select("form_id", "key", "b.*"), ["form_id", "key"], "left")


# ---- leftovers, edits, positions --------------------------------------------------------------

def orphans(matches: DataFrame, widgets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows without a match of 75 or more, and widgets no such match uses

    matches: form_id, ord, widget, confidence
    """
    good = F.col("widget").isNotNull() & (F.coalesce("confidence", F.lit(0)) >= 75)
    used = matches.where(good).select("form_id", F.col("widget").alias("name")).distinct()
    return matches.where(~good), widgets.join(used, ["form_id", "name"], "left_anti")


def match_stats(matches: DataFrame) -> DataFrame:
    grade = C.match_grade(F.col("confidence"))
    return matches.groupBy("form_id").agg(F.count(F.lit(1)).alias("rows"), *[
        F.count_if(grade == g).alias(g) for g in ("high", "medium", "low", "none")])


def bulk_edit(entries: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited names and places. Edit lines are "old<TAB>new[<TAB>x y w h]", or two or more
    spaces between the parts; the last line of a name wins; ``changes`` counts real changes.

    entries: form_id, ord, old_name, new_name, x, y, width, height; edits: form_id, line_no, line
    """
    by_tab = F.split("line", "\t")
    parts = F.when(F.size(by_tab) < 2, F.split("line", r"\s{2,}")).otherwise(by_tab)
    spots = [T.trim(F.get(parts, F.lit(i))).try_cast("double") for i in range(2, 6)]
    placed = (F.size(parts) >= 6) & spots[0].isNotNull() & spots[1].isNotNull() & spots[2].isNotNull() & spots[3].isNotNull()
    names = ["x", "y", "width", "height"]
    rows = edits.where(T.trim("line") != "").select(
        "form_id", "line_no", T.trim(F.get(parts, F.lit(0))).alias("old_name"), T.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("e_new"),
        *[F.when(placed, s).alias(f"e_{n}") for n, s in zip(names, spots)]).where(F.col("old_name") != "")
    cols = ["e_new", *[f"e_{n}" for n in names]]
    last = last_by(rows, ["form_id", "old_name"], ["line_no"], cols).withColumn("_hit", F.lit(True))
    out = entries.join(last, ["form_id", "old_name"], "left")
    renamed = F.col("_hit").isNotNull() & ~F.col("new_name").eqNullSafe(F.col("e_new"))
    moved = F.col("e_x").isNotNull() & ~((F.col("x") == F.col("e_x")) & (F.col("y") == F.col("e_y")) & (F.col("width") == F.col("e_width"))
                                         & (F.col("height") == F.col("e_height")))
    return out.select("form_id", "ord", "old_name", F.when(F.col("_hit").isNotNull(), F.col("e_new")).otherwise(F.col("new_name")).alias("new_name"),
                      *[F.coalesce(f"e_{n}", n).alias(n) for n in names], (renamed.cast("int") + moved.cast("int")).alias("changes"))


def positional_join(rows: DataFrame, widgets: DataFrame, row_cols: Sequence[str], widget_cols: Sequence[str], size: int = SLICE) -> DataFrame:
    """i-th matrix row next to i-th widget of a form; further widgets come without a row"""
    def numbered(df: DataFrame, cols: Sequence[str]) -> DataFrame:
        return ordered_scan(df.select("form_id", "ord", *cols), ["form_id"], [F.col("ord")], F.floor(F.col("ord") / size), number="i").drop("ord")
    return numbered(rows, row_cols).join(numbered(widgets, widget_cols), ["form_id", "i"], "full").withColumn(
        "matched", F.col(row_cols[0]).isNotNull() & F.col(widget_cols[0]).isNotNull())


def align_groups(groups: DataFrame, members: DataFrame, rows: DataFrame, size: int = SLICE) -> DataFrame:
    """Matrix row suggested for a group: one named like its root or a member (exact), else
    the row at the same place (the last row when there are fewer).

    groups: form_id, ord, key, root; members: form_id, key, ord, source_name;
    rows: form_id, ord, row_num, source_name, acro_actual, label
    """
    entry = F.explode(F.array("source_name", "acro_actual", "label")).alias("n")
    index = rows.select("form_id", "ord", "row_num", entry).withColumn("n", T.norm_words("n")).where(F.col("n") != "")
    index = index.groupBy("form_id", "n").agg(F.min_by("row_num", "ord").alias("exact_row"))
    tries = groups.select("form_id", "key", F.lit(-1).cast("long").alias("rank"), T.norm_words("root").alias("n")).unionByName(
        members.select("form_id", "key", F.col("ord").cast("long").alias("rank"), T.norm_words("source_name").alias("n")))
    exact = tries.join(index, ["form_id", "n"]).groupBy("form_id", "key").agg(F.min_by("exact_row", "rank").alias("exact_row"))
    at = ordered_scan(groups, ["form_id"], [F.col("ord")], F.floor(F.col("ord") / size), number="i")
    placed = ordered_scan(rows.select("form_id", "ord", "row_num"), ["form_id"], [F.col("ord")], F.floor(F.col("ord") / size), number="i")
    last = rows.groupBy("form_id").agg(F.count(F.lit(1)).alias("n_rows"))
    out = at.join(exact, ["form_id", "key"], "left").join(last, "form_id", "left").withColumn("i", F.least("i", "n_rows"))
    out = out.join(placed.select("form_id", "i", F.col("row_num").alias("place_row")), ["form_id", "i"], "left")
    kind = F.when(F.col("exact_row").isNotNull(), F.lit("exact")).otherwise(F.lit("position"))
    return out.select(*groups.columns, F.coalesce("exact_row", "place_row").alias("row_num"), kind.alias("kind"))


def pick_known_name(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """of source name, proposed and current name the first one some field carries, else the
    first that is not blank"""
    known = fields.where(E("source_name") != "").select("form_id", F.col("source_name").alias("n")).distinct().withColumn("known", F.lit(True))
    tries = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.col(c).alias("n")) for i, c in enumerate(("source_name", "acro_proposed", "acro_actual"))])).alias("t")
    probe = rows.select("form_id", "ord", tries).select("form_id", "ord", "t.*").where(E("n") != "")
    best = probe.join(known, ["form_id", "n"], "left").groupBy("form_id", "ord").agg(
        F.min_by("n", F.struct(F.col("known").isNull(), "rank")).alias("item"), F.bool_or(F.coalesce("known", F.lit(False))).alias("known"))
    return rows.join(best, ["form_id", "ord"], "left")
