"""Reading order, text lines, labels and sections from positions on a page.

Pages count from the top down in reading order, while y grows upwards; ``-y`` therefore
ascends. All ordered work runs per slice of (page, height band).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formspark import constants as K
from formspark.functions import classify as C
from formspark.functions import text as T
from formspark.kernels import by_key, carry_above, islands, ordered_scan
from formspark.operators.fuzzy import containing_pairs
from formspark.session import cut_lineage

E = T.text_or_empty
BAND = 200


def page_slice(y: str = "y", band: int = BAND) -> Column:
    return F.struct(F.col("page").alias("p"), F.floor(-F.col(y) / band).alias("b"))


def visual_order(widgets: DataFrame, keys: Sequence[str] = ("form_id",), tol: float = 5.0) -> DataFrame:
    """visual_row (runs on across pages) and visual_ord (left to right inside a row).

    A row ends where the next widget down is more than ``tol`` lower. (Comparing pairs within
    a tolerance is not transitive; splitting at gaps is the rule that numbers rows the same
    way and gives one answer.)
    """
    order = [F.col("page"), -F.col("y"), F.col("x"), F.col("ord")]
    starts = (F.col("_pp") != F.col("page")) | (F.col("_py") - F.col("y") > tol)
    rows = islands(widgets, keys, order, page_slice(), {"_pp": F.col("page"), "_py": F.col("y")}, starts, ["page", "y"], name="visual_row").drop("_pp", "_py")
    return ordered_scan(rows, keys, [F.col("visual_row"), F.col("x"), F.col("ord")], F.floor(F.col("visual_row") / 1024), number="visual_ord")


def merge_adjacent(items: DataFrame, keys: Sequence[str] = ("form_id",), ytol: float = 3.0, gap: float = 12.0) -> DataFrame:
    """Text pieces of one line that touch (gap -2..12) become one piece.

    A line is what lies within ``ytol`` of its highest piece, so a slanting chain of pieces is cut
    where it leaves that reach. Heights are folded once per page and chain of near heights: at most
    as many as a page has positions.
    """
    heights = items.select(*keys, "page", "y").distinct()
    down = (F.col("_pp") != F.col("page")) | (F.col("_py") - F.col("y") > ytol)
    chains = islands(heights, keys, [F.col("page"), -F.col("y")], page_slice(), {"_pp": F.col("page"), "_py": F.col("y")}, down, ["page", "y"], name="_chain").drop("_pp", "_py")
    own = chains.groupBy(*keys, "_chain").agg(F.sort_array(F.collect_list(F.col("y").cast("double")), asc=False).alias("_ys"))
    tops = F.aggregate("_ys", F.array().cast("array<double>"), lambda acc, y: F.when((F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1)) - y > ytol), F.concat(acc, F.array(y))).otherwise(acc))
    # the line of a height: the lowest top at or above it
    line = F.array_min(F.filter("_tops", lambda t: t >= F.col("y")))
    placed = chains.join(own.select(*keys, "_chain", tops.alias("_tops")), [*keys, "_chain"]).select(*keys, "page", "y", line.alias("line"))
    placed = cut_lineage(placed)  # a few numbers a height; the shuffles it took are dropped before the pieces are moved
    lines = items.join(placed, [*keys, "page", "y"])
    space = F.col("x") - F.col("_end")
    pieces = islands(lines, [*keys, "page", "line"], [F.col("x"), F.col("ord")], F.floor(F.col("x") / 1000), {"_end": F.col("x") + F.col("width")},
                     (space > gap) | (space < -2), ["x"], name="piece").drop("_end")
    at = F.struct("x", "ord")
    # a piece is a run of touching words on one line of a page: as wide as the page at most
    words = F.transform(F.array_sort(F.collect_list(F.struct("x", "ord", "str"))), lambda w: w["str"])
    merged = pieces.groupBy(*keys, "page", "line", "piece").agg(
        F.trim(F.array_join(words, " ")).alias("str"), F.min_by("y", at).alias("y"), F.min("x").alias("x"),
        F.max_by(F.col("x") + F.col("width"), at).alias("_end"), F.max("height").alias("height"), F.count(F.lit(1)).alias("pieces"),
        F.min_by("ord", at).alias("ord"))
    return merged.withColumn("width", F.col("_end") - F.col("x")).drop("_end", "line", "piece")


# ---- labels ----------------------------------------------------------------------------------

#: Reach of a label to the left of a widget and above it, and tiles of a page wider and higher than both.
LEFT_REACH, ABOVE_REACH, SHIFT, SLACK = 200, 80, 30, 4
TILE = (1000, 160)


def _tiles(rows: DataFrame, across: tuple[Column, Column], down: tuple[Column, Column]) -> DataFrame:
    """a row for each tile that a rectangle touches: (cx, cy). Tiles are larger than what is looked for, so that most
    rows are moved once or twice, and small next to a page, so that few rows meet in one."""
    for name, size, (low, high) in zip(("cx", "cy"), TILE, (across, down), strict=True):
        rows = rows.select("*", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))).alias(name))
    return rows


def _nearest_widgets(widgets: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(cols, w_ord, left_of, above_of): where the nearest other widget begins that stands to the left of a
    widget on its line, and where the nearest one above it ends. A text beyond either is hidden."""
    x, y, top = F.col("wx"), F.col("wy"), F.col("wy") + F.col("wheight")
    line = F.col("wheight") + SLACK
    probe = _tiles(widgets, (x - LEFT_REACH, x + SHIFT), (F.least(y - line, top), F.greatest(y + line, top + ABOVE_REACH)))
    others = widgets.select(*cols, F.col("w_ord").alias("o_ord"), *[F.col(f"w{c}").alias(f"o{c}") for c in ("x", "y", "width", "height")])
    others = _tiles(others, (F.col("ox"), F.col("ox")), (F.col("oy"), F.col("oy")))
    beside = (F.abs(F.col("oy") - y) <= line) & (F.col("ox") + F.col("owidth") <= x)
    over = (F.col("oy") > top) & (F.abs(F.col("ox") - x) < SHIFT)
    met = probe.join(by_key(others), [*cols, "cx", "cy"]).where((F.col("o_ord") != F.col("w_ord")) & (beside | over))
    return met.groupBy(*cols, "w_ord").agg(F.max(F.when(beside, F.col("ox"))).alias("left_of"), F.min(F.when(over, F.col("oy") + F.col("oheight"))).alias("above_of"))


def detect_labels(widgets: DataFrame, texts: DataFrame, keys: Sequence[str] = ("form_id",)) -> DataFrame:
    """Best text next to a widget: to its left on its line, or above it, with no other widget between.

    A range join on tiles of a page: a text is in the tiles that it covers, and a widget looks into the tiles of
    its reach, to the left and above at once. What hides texts is a number a widget on each side, where the
    nearest other one stands, so it is found once a widget and not once a text. A text that is met in
    several tiles counts once, as the best one is a minimum.
    """
    cols = [*keys, "page"]
    w = widgets.select(*cols, F.col("ord").alias("w_ord"), *[F.col(c).alias(f"w{c}") for c in ("x", "y", "width", "height")])
    w = w.join(_nearest_widgets(w, cols), [*cols, "w_ord"], "left")
    x, y, top, far = F.col("wx"), F.col("wy"), F.col("wy") + F.col("wheight"), F.col("wx") + F.col("wwidth")
    line = SLACK + F.col("wheight") * 0.5
    probe = _tiles(w, (x - LEFT_REACH, F.greatest(far, x)), (F.least(y - line, top - 2), F.greatest(y + line, top + ABOVE_REACH)))
    t = texts.where(~T.is_section_header("str")).select(*cols, F.col("ord").alias("t_ord"), T.trim("str").alias("text"), *[F.col(c).alias(f"t{c}") for c in ("x", "y", "width")])
    start, end, ty = F.col("tx"), F.col("tx") + F.col("twidth"), F.col("ty")
    t = _tiles(t, (F.least(start, end) - SHIFT, F.greatest(start, end) + SHIFT), (ty, ty))
    bonus = F.when(F.col("text").endswith(":"), 15).otherwise(0) - F.when(F.length("text") <= 2, 20).otherwise(0) + F.when(F.length("text").between(3, 40), 5).otherwise(0)
    gap, above = x - end, ty - top
    is_left = (gap > 0) & (gap < LEFT_REACH) & (F.abs(ty - y) < line)
    is_above = (above > -2) & (above < ABOVE_REACH) & ((F.abs(start - x) < SHIFT) | (F.least(end, far) - F.greatest(start, x) > 0))
    free_left = is_left & F.coalesce(F.col("left_of") < end, F.lit(True))
    free_above = is_above & ~is_left & F.coalesce(F.col("above_of") >= ty, F.lit(True))
    score = F.lit(100.0) - F.when(is_left, gap * 0.4).otherwise(F.greatest(F.lit(0.0), above) * 0.6) + F.when(is_left, 10).otherwise(0) + bonus
    found = probe.join(by_key(t), [*cols, "cx", "cy"]).where(free_left | free_above)
    best = found.groupBy(*keys, F.col("w_ord").alias("ord")).agg(F.min(F.struct((-score).alias("s"), "t_ord", "text")).alias("b"))
    best = best.select(*keys, "ord", F.nullif(T.trim(T.replace(F.col("b.text"), ":$", "")), F.lit("")).alias("label"))
    return widgets.join(best, [*keys, "ord"], "left")


# ---- sections --------------------------------------------------------------------------------

def _first(n: Column, entries: list[tuple[str, Column]]) -> Column:
    out = None
    for pattern, value in entries:
        out = F.when(n.rlike(pattern), value) if out is None else out.when(n.rlike(pattern), value)
    return out


def _plain(text: Column) -> Column:
    return T.strip_accents(F.lower(T.trim(text)))


def _heading(plain: Column) -> Column:
    return _first(plain, [("|".join(words), F.struct(F.lit(prefix).alias("prefix"), F.lit(name).alias("name"), F.lit(repeat).alias("repeatable")))
                          for words, prefix, name, repeat in K.HEADINGS])


def _subheading(bare: Column) -> Column:
    return _first(bare, [("^(.* )?(" + "|".join(words) + ")$|^(" + "|".join(words) + ") ", F.struct(F.lit(prefix).alias("prefix"), F.lit(group).alias("group")))
                         for words, prefix, group in K.SUBHEADINGS])


def _bare(plain: Column) -> Column:
    return T.trim(T.replace(plain, "[:.]+$", ""))


def match_heading(text: Column) -> Column:
    """the first known heading a text contains: (prefix, name, repeatable)"""
    return T.let(_plain(text), _heading)


def match_subheading(text: Column) -> Column:
    """the first known subheading a text is, begins or ends with: (prefix, group)"""
    return T.let(_bare(_plain(text)), _subheading)


def detect_sections(texts: DataFrame, widgets: DataFrame, keys: Sequence[str] = ("form_id",)) -> tuple[DataFrame, DataFrame]:
    """(headings, subheadings). A short text that ends in ":" above a line of two to eight
    check boxes is a subheading as well."""
    cols = [*keys, "page", "ord", "str", "x", "y"]
    text = T.trim("str")
    # every text is looked at once; the few that may be headings are kept and read from there on. Most hold no
    # word of any heading and ask for nothing: one pattern leaves them out before the others are tried.
    words = "|".join(chain.from_iterable(entry[0] for entry in (*K.HEADINGS, *K.SUBHEADINGS)))
    able = _plain(F.col("str")).rlike(words) | text.endswith(":")
    rows = texts.where((text != "") & able).select(*cols, F.length(text).alias("_n"), text.endswith(":").alias("_colon"), _plain(F.col("str")).alias("_plain"))
    rows = rows.select("*", _bare(F.col("_plain")).alias("_bare")).select("*", _heading(F.col("_plain")).alias("_h"), _subheading(F.col("_bare")).alias("_s"))
    kind = (F.when(F.col("_h").isNotNull() & (F.col("_n") >= 4), F.lit("heading")).when((F.col("_n") <= 40) & F.col("_s").isNotNull(), F.lit("known"))
            .when((F.col("_n") <= 40) & F.col("_colon"), F.lit("asked")))
    rows = rows.select(*cols, kind.alias("_kind"), "_h", "_s")
    rows = cut_lineage(rows)
    number = F.when(F.col("_h.repeatable"), C.extract(text, r"(\d+)").try_cast("int"))
    headings = rows.where("_kind = 'heading'").select(*cols, "_h.prefix", "_h.name", "_h.repeatable", number.alias("number"))
    known = rows.where("_kind = 'known'").select(*cols, "_s.prefix", F.col("_s.group").alias("group_name"), F.lit("whitelist").alias("source"))
    asked = rows.where("_kind = 'asked'").select(*cols)
    # check boxes of one line (6 points) below the text, at most 30 points down. Boxes are first
    # counted per place, so a line of any number of boxes is met as a few heights with a count.
    boxes = widgets.where(F.col("type").isin("checkbox", "radio", "button"))
    places = boxes.groupBy(*keys, "page", "y").agg(F.count(F.lit(1)).alias("k"))
    near = places.select(*keys, "page", F.col("y").alias("wy"), F.explode(F.array(*[F.floor(F.col("y") / 6) + i for i in (-1, 0, 1)])).alias("c"))
    same = near.join(places.select(*keys, "page", F.col("y").alias("oy"), "k", F.floor(F.col("y") / 6).alias("c")), [*keys, "page", "c"])
    lines = same.where(F.abs(F.col("oy") - F.col("wy")) <= 6).groupBy(*keys, "page", "wy").agg(F.sum("k").alias("n"))
    tops = boxes.select(*keys, "page", F.col("y").alias("wy"), (F.col("y") + F.col("height")).alias("top")).distinct().join(lines, [*keys, "page", "wy"])
    tops = tops.groupBy(*keys, "page", "top").agg(F.max("n").alias("n")).withColumn("c", F.floor(F.col("top") / 30))
    spread = asked.select(*keys, "page", "ord", "y", F.explode(F.array(*[F.floor(F.col("y") / 30) + i for i in (-1, 0)])).alias("c"))
    over = spread.join(tops, [*keys, "page", "c"]).where((F.col("top") <= F.col("y") - 4) & (F.col("y") - F.col("top") <= 30))
    over = over.groupBy(*keys, "ord").agg(F.max("n").alias("n")).where("n BETWEEN 2 AND 8")
    found = asked.join(over.select(*keys, "ord"), [*keys, "ord"], "left_semi").select(
        *cols, F.lit("").alias("prefix"), T.slugify(T.replace(text, ":$", "")).alias("group_name"), F.lit("fallback").alias("source"))
    # few next to the texts, and met with the widgets by several operators
    return headings, cut_lineage(known.unionByName(found))


def _above(points: DataFrame, marks: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """nearest mark strictly above the top of each point on its page; the first one on ties"""
    p = points.withColumn("_at", -(F.col("y") + F.col("height")))
    m = marks.withColumn("_at", -F.col("y")).withColumn("_tie", -F.col("ord"))
    return carry_above(p, m, [*keys, "page"], "_at", F.floor(F.col("_at") / BAND), {name: value}, ties=["_tie"]).drop("_at")


def assign_section(widgets: DataFrame, headings: DataFrame, subheadings: DataFrame, keys: Sequence[str] = ("form_id",)) -> DataFrame:
    """Section and subheading of each widget: the nearest heading above it on its page; the
    nearest subheading, not above the heading, within 25 points (60 when it is a fallback)."""
    # headings and subheadings are carried down the page in one scan
    def mark(df: DataFrame, name: str, cols: Sequence[str]) -> DataFrame:
        return df.select(*keys, "page", "ord", "y", F.struct(*cols).alias(name))
    marks = mark(headings, "_h", ["str", "name", "prefix", "number", "repeatable", "y"]).unionByName(
        mark(subheadings, "_s", ["str", "prefix", "group_name", "source", "y"]), allowMissingColumns=True)
    marks = marks.withColumn("_at", -F.col("y")).withColumn("_tie", -F.col("ord"))
    points = widgets.withColumn("_at", -(F.col("y") + F.col("height")))
    s = carry_above(points, marks, [*keys, "page"], "_at", F.floor(F.col("_at") / BAND), {"_h": F.col("_h"), "_s": F.col("_s")}, ties=["_tie"]).drop("_at")
    top = F.col("y") + F.col("height")
    within = F.col("_s.y") - top <= F.when(F.col("_s.source") == "whitelist", 25).otherwise(60)
    use = F.col("_s").isNotNull() & (F.col("_h").isNull() | (F.col("_s.y") <= F.col("_h.y"))) & within
    warning = F.when(F.col("_h").isNull(), F.lit("no_section_match"))
    return s.select(*widgets.columns, F.col("_h.str").alias("heading"), F.col("_h.name").alias("section_name"), F.coalesce("_h.prefix", F.lit("")).alias("section_prefix"),
                    F.col("_h.number").alias("block_no"), F.coalesce("_h.repeatable", F.lit(False)).alias("repeatable"), F.col("_h.y").alias("heading_y"),
                    F.when(use, F.col("_s.str")).alias("subheading"), F.when(use, F.col("_s.prefix")).otherwise(F.lit("")).alias("sub_prefix"),
                    F.when(use, F.col("_s.group_name")).alias("group_name"), warning.alias("warning"))


def date_label(label: Column) -> Column:
    n = T.trim(T.replace(T.strip_accents(F.lower(T.trim(E(label)))), "[:.]+$", ""))
    return F.when(n.isin("dia", "mes", "ano"), n)


def date_groups(widgets: DataFrame, headings: DataFrame, texts: DataFrame, keys: Sequence[str] = ("form_id",)) -> DataFrame:
    """Day, month and year fields that stand in one row: part, run, group_key, sub_prefix."""
    parts = widgets.where(F.col("type") == "text").withColumn("part", date_label(F.col("label"))).where(F.col("part").isNotNull())
    by_page = [*keys, "page"]
    lines = islands(parts, by_page, [-F.col("y"), F.col("x"), F.col("ord")], F.floor(-F.col("y") / BAND), {"_py": F.col("y")},
                    F.col("_py") - F.col("y") > 5, ["y"], name="line").drop("_py")
    runs = islands(lines, by_page, [F.col("line"), F.col("x"), F.col("ord")], F.floor(F.col("line") / 1024),
                   {"_pl": F.col("line"), "_end": F.col("x") + F.col("width")},
                   (F.col("_pl") != F.col("line")) | (F.col("x") - F.col("_end") > 80), ["line", "x"], name="run").drop("_pl", "_end")
    # the runs are read for their heads and again for the result: worked out once
    runs = cut_lineage(runs)
    at = F.struct("line", "x", "ord")
    heads = runs.groupBy(*by_page, "run").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("ord", "y", "height"), at).alias("f")).where("n > 1")
    heads = heads.select(*by_page, "run", "f.ord", "f.y", "f.height")
    heads = _above(heads, headings, keys, F.struct("str", "y"), "_h")
    between = texts.where(date_label(F.col("str")).isNull() & (T.trim("str") != ""))
    heads = _above(heads, between, keys, F.struct("str", "y"), "_t")
    title = T.strip_accents(F.lower(T.trim(E("_h.str"))))
    middle = F.when(F.col("_t.y") < F.col("_h.y"), T.strip_accents(F.lower(T.trim("_t.str"))))
    slug = T.slugify(T.replace(F.col("_t.str"), "[:.]+$", ""))
    prefix = (F.when(F.col("_h").isNull() | title.contains("fecha de solicitud") | middle.isNull(), F.lit("fecha_"))
              .when(middle.contains("nacimiento"), F.lit("fecha_nacimiento_")).when(middle.contains("desde"), F.lit("fecha_desde_"))
              .when(middle.contains("hasta"), F.lit("fecha_hasta_")).when((slug != "") & (F.length(slug) < 30), F.concat(F.lit("fecha_"), slug, F.lit("_")))
              .otherwise(F.lit("fecha_")))
    heads = heads.withColumn("date_prefix", prefix)
    group = (F.when(F.col("date_prefix") == "fecha_nacimiento_", F.lit("fecha_nacimiento")).when(F.col("date_prefix") == "fecha_desde_", F.lit("vigencia_desde"))
             .when(F.col("date_prefix") == "fecha_hasta_", F.lit("vigencia_hasta")).when(title.contains("solicitud"), F.lit("fecha_solicitud")).otherwise(F.lit("fecha")))
    named = heads.select(*by_page, "run", "date_prefix", group.alias("date_group"), F.col("_h.str").alias("date_heading"))
    return runs.join(named, [*by_page, "run"]).drop("line")


def context_prefix(widgets: DataFrame, texts: DataFrame, keys: Sequence[str] = ("form_id",)) -> DataFrame:
    """Prefix of ambiguous names: the heading at most 200 above, and "desde" or "hasta" on the
    left (30 up or down, 300 away)."""
    marks = texts.where(T.is_context_heading("str"))
    h = _above(widgets, marks, keys, F.struct("str", "y"), "_h")
    heading = F.when(F.col("_h.y") - (F.col("y") + F.col("height")) <= 200, T.strip_accents(F.lower("_h.str")))
    word = T.replace(F.lower(T.trim("str")), ":$", "")
    subs = texts.withColumn("_w", word).where(F.col("_w").isin("desde", "hasta")).select(
        *keys, "page", "_w", F.col("ord").alias("t_ord"), F.col("y").alias("ty"), (F.col("x") + F.col("width")).alias("right"), F.floor(F.col("y") / 30).alias("c"))
    spread = widgets.select(*keys, "page", "ord", "x", "y", F.explode(F.array(*[F.floor(F.col("y") / 30) + i for i in (-1, 0, 1)])).alias("c"))
    near = spread.join(subs, [*keys, "page", "c"]).where((F.abs(F.col("ty") - F.col("y")) <= 30) & (F.col("right") <= F.col("x")) & (F.col("x") - F.col("right") <= 300))
    sub = near.groupBy(*keys, "ord").agg(F.min_by("_w", F.struct(F.col("x") - F.col("right"), F.col("t_ord"))).alias("_sub"))
    first = (F.when(heading.contains("vigencia"), F.lit("vigencia")).when(heading.contains("nacimiento"), F.lit("fecha_nacimiento"))
             .when(heading.contains("fecha"), F.lit("fecha")).when(heading.contains("beneficiario"), F.lit("beneficiario")))
    out = h.join(sub, [*keys, "ord"], "left")
    return out.select(*widgets.columns, F.nullif(F.concat_ws("_", first, F.col("_sub")), F.lit("")).alias("context_prefix"))


# ---- names ------------------------------------------------------------------------------------

def propose_name(fields: DataFrame) -> DataFrame:
    """Proposed name, group and public label of a widget.

    fields: name, label, section_name, heading, section_prefix, block_no, repeatable,
    sub_prefix, group_name, date_part, date_prefix, date_group
    """
    row = C.extract(E("name"), r"(?i)Row\s*(\d+)$")
    date = F.col("date_part").isNotNull()
    titles = F.concat_ws(" ", *[T.strip_accents(F.lower(T.trim(E(c)))) for c in ("section_name", "heading")])
    block = F.when(F.col("repeatable"), F.coalesce(F.nullif(F.col("block_no"), F.lit(0)).cast("string"), row.try_cast("int").cast("string"))).otherwise(row.try_cast("int").cast("string"))
    main = (F.when(row.isNotNull() & (F.col("repeatable") | titles.contains("beneficiario")), F.concat(F.lit("beneficiario_"), block, F.lit("_")))
            .when(row.isNotNull(), F.concat(F.lit("fila_"), row.try_cast("int"), F.lit("_"))).otherwise(E("section_prefix")))
    sub = F.when(date, T.or_else(E("date_prefix"), F.lit("fecha_"))).otherwise(E("sub_prefix"))
    group = F.when(date, F.col("date_group")).when(E("sub_prefix") != "", F.col("group_name"))
    bare = T.trim(T.replace(E("name"), r"(?i)Row\s*(\d+)$", ""))
    base = F.when(row.isNotNull(), T.or_else(E("label"), bare, E("name"))).otherwise(T.or_else(E("label"), E("name")))
    fields = fields.withColumn("_slug", F.when(date, F.col("date_part")).otherwise(T.slugify(base)))
    name = T.replace(T.replace(F.concat(main, sub, T.simplify_slug(F.col("_slug"))), "_+", "_"), "^_|_$", "")
    fallback = T.or_else(T.slugify("name"), F.lit("_unnamed"))
    return fields.withColumn("proposed", T.or_else(name, fallback)).withColumn("group_proposed", group).withColumn(
        "public_label", T.or_else(T.trim(E("label")), E("name"))).drop("_slug")


def _numbered(rows: DataFrame, keys: Sequence[str], size: int, name: str = "_k", whole: dict[str, Column] | None = None) -> DataFrame:
    return ordered_scan(rows, keys, [F.col("ord")], F.floor(F.col("ord") / size), number=name, whole=whole)


def _named(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows that have all of ``keys``: one that lacks a name clashes with none and gets none"""
    return rows.dropna(subset=list(keys))


def resolve_collisions(rows: DataFrame, keys: Sequence[str] = ("form_id",), size: int = 1 << 16) -> DataFrame:
    """Equal proposed names: one text among buttons gets ``_texto``, else the second and later
    get their number. The names made are not checked again."""
    by = [*keys, "proposed"]
    text = F.col("type") == "text"
    out = _numbered(_named(rows, by), by, size, whole={"_n": F.lit(1), "_t": F.when(text, 1).otherwise(0)})
    one_text = (F.col("_t") == 1) & (F.col("_n") > 1)
    final = (F.when(one_text & text, F.concat("proposed", F.lit("_texto"))).when(one_text | (F.col("_k") == 1), F.col("proposed"))
             .otherwise(F.concat("proposed", F.lit("_"), "_k")))
    return out.withColumn("final_name", final).drop("_n", "_t", "_k")


def suffix_by_row(rows: DataFrame, keys: Sequence[str] = ("form_id",), tol: float = 15.0) -> DataFrame:
    """Equal new names get the number of their row on the page (a new row from 15 points on);
    ``warning`` marks the names concerned."""
    by = [*keys, "new_name"]
    starts = (F.col("_pp") != F.col("page")) | (F.abs(F.col("_py") - F.col("y")) > tol)
    order = [F.col("page"), -F.col("y"), F.col("ord")]
    runs = islands(_named(rows, by), by, order, page_slice(), {"_pp": F.col("page"), "_py": F.col("y")}, starts, ["page", "y"], name="row_no", count="_n").drop("_pp", "_py")
    clash = F.col("_n") > 1
    return runs.withColumn("final_name", F.when(clash, F.concat("new_name", F.lit("_"), "row_no")).otherwise(F.col("new_name"))).withColumn(
        "warning", F.when(clash, F.lit("collision-resolved"))).drop("_n")


def suffix_all(rows: DataFrame, keys: Sequence[str] = ("form_id",), size: int = 1 << 16) -> DataFrame:
    """First rename of each old name; dots of unchanged names become ``_``; equal new names are
    numbered from 1. rows: form_id, ord, old_name, new_name"""
    first = rows.groupBy(*keys, "old_name").agg(F.min_by(F.struct("ord", "new_name"), "ord").alias("r")).select(*keys, "old_name", "r.*")
    clean = F.when(F.col("new_name") == F.col("old_name"), F.replace("new_name", F.lit("."), F.lit("_"))).otherwise(F.col("new_name"))
    first = first.withColumn("new_name", clean)
    by = [*keys, "new_name"]
    out = _numbered(_named(first, by), by, size, whole={"_n": F.lit(1)})
    return out.withColumn("final_name", F.when(F.col("_n") > 1, F.concat("new_name", F.lit("_"), "_k")).otherwise(F.col("new_name"))).drop("_n", "_k")


def dedupe_across_docs(rows: DataFrame, keys: Sequence[str] = ("form_id",), size: int = 1 << 16) -> DataFrame:
    """The first field of a name keeps it, later ones become ``name__p<page>``, then ``_2``, ``_3``.

    A made name that some other field already carries moves on to the next free number.
    """
    by = [*keys, "name"]
    first = rows.groupBy(*by).agg(F.min("ord").alias("_first"))
    tagged = rows.join(first, by)
    keep = tagged.where(F.col("ord") == F.col("_first")).withColumn("final_name", F.col("name"))
    later = tagged.where(F.col("ord") != F.col("_first")).withColumn("_base", F.concat("name", F.lit("__p"), F.col("page") + 1))
    numbered = _numbered(later, [*keys, "_base"], size)
    # numbers of a base that other fields use as their own name are skipped
    rx = r"^(.*__p\d+)(?:_(\d+))?$"
    taken = keep.select(*keys, F.regexp_extract("name", rx, 1).alias("_base"),
                        F.coalesce(F.nullif(F.regexp_extract("name", rx, 2), F.lit("")).try_cast("int"), F.lit(1)).alias("t")).where(F.col("_base") != "")
    # the j-th taken number t has t - j free ones below it: the k-th free number lies above all taken ones
    # with fewer than k below them, and is k and as many as those
    base = [*keys, "_base"]
    ranked = ordered_scan(taken.distinct(), base, [F.col("t")], F.floor(F.col("t") / size), number="_j")
    marks = ranked.select(*base, (F.col("t") - F.col("_j")).alias("_k"), "_j")
    out = carry_above(numbered, marks, base, "_k", F.floor(F.col("_k") / size), {"_above": F.col("_j")}, ties=["_j"])
    free = F.col("_k") + F.coalesce("_above", F.lit(0))
    final = F.when(free == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("_"), free))
    cols = [*rows.columns, "final_name"]
    return keep.select(*cols).unionByName(out.withColumn("final_name", final).select(*cols))


def dup_index(widgets: DataFrame, keys: Sequence[str] = ("form_id",), size: int = 1 << 16) -> DataFrame:
    """index and count of repeated names; key ``name#i``"""
    by = [*keys, "name"]
    out = _numbered(_named(widgets, by), by, size, whole={"dup_count": F.lit(1)}).withColumn("dup_index", F.col("_k") - 1).drop("_k")
    return out.withColumn("dup_key", F.when(F.col("dup_count") > 1, F.concat("name", F.lit("#"), "dup_index")).otherwise(F.col("name")))


def context_labels(rows: DataFrame, keys: Sequence[str] = ("form_id",)) -> DataFrame:
    """a repeated public label gets its context in brackets: date group, group, section

    rows: public_label, date_group, group_name, section_name
    """
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(K.GROUP_LABELS.items())])
    n = rows.where(E("public_label") != "").groupBy(*keys, "public_label").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    context = F.coalesce(names[F.col("date_group")], names[F.col("group_name")], F.nullif("section_name", F.lit("")), F.nullif("group_name", F.lit("")))
    out = rows.join(n, [*keys, "public_label"], "left")
    label = F.when(F.col("_n").isNotNull() & context.isNotNull(), F.concat("public_label", F.lit(" ("), context, F.lit(")"))).otherwise(F.col("public_label"))
    return out.withColumn("context_label", label).drop("_n")


def interleave_prefilled(rows: DataFrame, extra: DataFrame, keys: Sequence[str] = ("form_id",), size: int = 1 << 16) -> DataFrame:
    """Rows not printed in the PDF go to the end of the first run of a matching section (equal
    or containing, either way), the others to the end; then everything is renumbered.

    rows, extra: form_id, ord, section. Gives (form_id, origin, ord, section, number).
    """
    runs = cut_lineage(islands(rows, keys, [F.col("ord")], F.floor(F.col("ord") / size), {"_prev": E("section")}, F.col("_prev") != E("section"), ["section"], name="run").drop("_prev"))
    heads = runs.groupBy(*keys, "run").agg(F.min_by("section", "ord").alias("_sec")).withColumn("_n", T.norm_compact("_sec"))
    firsts = heads.where(F.col("_n") != "").groupBy(*keys, "_n").agg(F.min("run").alias("run"))
    wanted = extra.select(*keys, T.norm_compact("section").alias("key"))
    pairs = containing_pairs(wanted, firsts.withColumnRenamed("_n", "key"), keys)
    hit = cut_lineage(pairs.select(*keys, F.col("left_key").alias("_e"), F.col("right_key").alias("_n")).join(firsts, [*keys, "_n"]).groupBy(*keys, "_e").agg(F.min("run").alias("run")))
    placed = extra.withColumn("_e", T.norm_compact("section")).join(hit, [*keys, "_e"], "left").drop("_e")
    last = F.lit(1 << 60)
    both = runs.select(*keys, F.lit("pdf").alias("origin"), "ord", "section", F.col("run").cast("long").alias("run"), F.lit(0).alias("_x")).unionByName(
        placed.select(*keys, F.lit("matrix").alias("origin"), "ord", "section", F.coalesce(F.col("run").cast("long"), last).alias("run"), F.lit(1).alias("_x")))
    slice_by = F.struct("run", "_x", F.floor(F.col("ord") / size))
    return ordered_scan(both, keys, [F.col("run"), F.col("_x"), F.col("ord")], slice_by, number="number").drop("run", "_x")


def reading_order(rows: DataFrame, keys: Sequence[str], order: str = "ord", size: int = 1 << 16) -> DataFrame:
    """numbers 1..n inside each part"""
    return ordered_scan(rows, keys, [F.col(order)], F.floor(F.col(order) / size), number="field_order")
