"""Grouping: runs of rows, routes, name groups, sections, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formspark import constants as K
from formspark.functions import classify as C
from formspark.functions import paths as P
from formspark.functions import text as T
from formspark.kernels import SLICE, first_by, islands, ordered_scan
from formspark.session import cut_lineage

E = T.text_or_empty


def by_ord(size: int = SLICE, ord_: str = "ord") -> Column:
    return F.floor(F.col(ord_) / size)


# ---- forms ----------------------------------------------------------------------------------

def group_by_form(fields: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Fields of each form code, after the shared ones (no code, "todos" or "all"). A scope
    without codes is one form ``_all``. Order inside a form: is_shared first, then ord.

    Shared rows are repeated for every code because every form shows them: that is the
    result itself, nothing is kept that is not one of its rows.
    """
    low = F.lower(E("form_code"))
    marked = fields.withColumn("is_shared", low.isin("", "todos", "all"))
    own = marked.where(~F.col("is_shared")).withColumn("form_id", F.col("form_code"))
    codes = own.select(*scope, "form_id").distinct()
    shared = marked.where("is_shared").join(codes, list(scope), "left").withColumn("form_id", F.coalesce("form_id", F.lit("_all")))
    return own.unionByName(shared)


def unique_codes(rows: DataFrame, scope: Sequence[str], col: str, size: int = SLICE) -> DataFrame:
    """distinct values in order of appearance"""
    first = rows.where(E(col) != "").groupBy(*scope, col).agg(F.min("ord").alias("first_ord"))
    return ordered_scan(first, scope, [F.col("first_ord"), F.col(col)], by_ord(size, "first_ord"), number="pos")


# ---- runs ------------------------------------------------------------------------------------

def collapse_runs(rows: DataFrame, keys: Sequence[str] = ("form_id",), size: int = SLICE) -> DataFrame:
    """Rows with the run they belong to: a choice row and the option rows below it.

    A row joins the run above it when it has a value, no label or the label of the run, and
    a choice type or none. Adds run (number), is_head and the option (code, label). Each
    step is an ordered scan in slices, so a form of any length is split over tasks.
    """
    choice = F.lower(E("data_type")).rlike(K.CHOICE_TYPES)
    # a run has one label, so the last label seen is the label of the run above
    seen = ordered_scan(rows, keys, [F.col("ord")], by_ord(size), carried_before={"_label": F.nullif("field_label", F.lit(""))})
    starts = choice & (E("field_label") != "")
    joins = ((E("value") != "") & (choice | (E("data_type") == "")) & ((E("field_label") == "") | (F.col("field_label") == F.col("_label"))))
    marked = seen.withColumn("_s", starts).withColumn("_c", F.coalesce(joins, F.lit(False)))
    # a run reaches the row above when its last start is not older than the last row that breaks
    marked = ordered_scan(marked, keys, [F.col("ord")], by_ord(size), carried_before={
        "_ps": F.when(F.col("_s"), F.col("ord")), "_pb": F.when(~F.col("_s") & ~F.col("_c"), F.col("ord"))})
    # read twice by the numbering below: worked out once
    marked = cut_lineage(marked)
    absorbed = F.col("_c") & F.col("_ps").isNotNull() & (F.col("_pb").isNull() | (F.col("_ps") > F.col("_pb")))
    heads = marked.withColumn("is_head", ~absorbed)
    out = ordered_scan(heads, keys, [F.col("ord")], by_ord(size), running={"run": F.when(F.col("is_head"), 1).otherwise(0)})
    # a plain row has no options of its own
    in_run = ~F.col("is_head") | F.col("_s")
    option = C.option_split("value")
    has = in_run & (E("value") != "")
    return out.select(*rows.columns, "run", "is_head", F.when(has, option.code).alias("option_code"), F.when(has, option.label).alias("option_label"))


def run_heads(runs: DataFrame, keys: Sequence[str] = ("form_id",)) -> DataFrame:
    """One row per run: the head's label and type, its option count, and the first text that
    is not blank of json name, rule, obs and product scope."""
    def first_text(c: str) -> Column:
        return F.coalesce(F.min_by(c, F.when(E(c) != "", F.col("ord"))), F.lit("")).alias(c)
    return runs.groupBy(*keys, "run").agg(
        F.min("ord").alias("ord"), F.min_by("field_label", "ord").alias("field_label"), F.min_by("data_type", "ord").alias("data_type"),
        F.count("option_code").alias("n_options"), *[first_text(c) for c in ("json_name", "rule", "obs", "product_scope")])


def collapse_logical(rows: DataFrame, keys: Sequence[str] = ("form_id",), size: int = SLICE) -> DataFrame:
    """Consecutive rows of the same label with a value and no path are one logical row:
    adds run and is_head"""
    same = (T.norm_words("label") == F.col("_prev")) & (E("value") != "") & (E("path") == "")
    runs = islands(rows, keys, [F.col("ord")], by_ord(size), {"_prev": T.norm_words("label")}, ~same, ["label", "value", "path"], name="run")
    first = F.col("_prev").isNull()
    return runs.withColumn("is_head", first | ~F.coalesce(same, F.lit(False))).drop("_prev")


def collapse_by_route(rows: DataFrame, keys: Sequence[str] = ("form_id", "sheet")) -> DataFrame:
    """Ficha rows of the same route are one field; rows without a route stay alone.

    Gives the first row's texts and the sizes of the long lists (options, rules, sources)."""
    single = F.when(E("route") == "", F.col("ord"))
    # distinct rules and sources through a first aggregate per value: no distinct set in memory
    key = [*keys, "route", "_single"]
    rows = rows.withColumn("_single", single)
    base = rows.groupBy(*key).agg(
        F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n_rows"), F.count(F.nullif("value", F.lit(""))).alias("n_options"),
        F.min_by("label", "ord").alias("label"), F.min_by("dest", "ord").alias("dest"))

    def distinct_count(c: str, name: str) -> DataFrame:
        values = rows.where(E(c) != "").select(*key, c).distinct()
        return values.groupBy(*key).agg(F.count(F.lit(1)).alias(name)).withColumnsRenamed({k: f"_{name}_{k}" for k in key})

    out = base
    for c, name in (("source_name", "n_sources"), ("rule", "n_rules")):
        n = distinct_count(c, name)
        on = [out[k].eqNullSafe(n[f"_{name}_{k}"]) for k in key]
        out = out.join(n, on, "left").drop(*[f"_{name}_{k}" for k in key])
    return out.na.fill(0, ["n_sources", "n_rules"]).drop("_single")


def combo_options(rows: DataFrame, keys: Sequence[str] = ("form_id",)) -> DataFrame:
    """options of a label: distinct code and label in any case, the first spelling of each"""
    opt = C.option_split("value")
    full = rows.where((E("value") != "") & (E("field_label") != "")).select(*keys, "ord", "field_label", opt.code.alias("code"), opt.label.alias("label"))
    dedup = full.withColumn("_k", F.lower(F.concat_ws("|", "code", "label")))
    return first_by(dedup, [*keys, "field_label", "_k"], ["ord"], ["ord", "code", "label"]).drop("_k")


# ---- name groups -------------------------------------------------------------------------------

def name_groups(items: DataFrame, keys: Sequence[str] = ("form_id",), lookups: bool = True) -> DataFrame:
    """Group of every name: a lookup by prefix, a repeater by indexed root, a radio by option
    base with two or more siblings, else simple. Adds kind, group_name, group_key.

    items: form_id, ord, source_name. Without ``lookups`` the option mark needs no ``_``.
    """
    sn = F.col("source_name")
    look = C.lookup_prefix(sn) if lookups else F.lit(None).cast("string")
    indexed = sn.rlike(r"\[\d+\]$")
    base = P.strip_option(sn) if lookups else T.replace(sn, "(" + "|".join(K.OPTION_SUFFIXES) + ")$", "")
    tagged = items.withColumn("_look", look).withColumn("_idx", indexed).withColumn(
        "_base", F.when(F.col("_look").isNull() & ~F.col("_idx") & (base != sn), base))
    siblings = tagged.where(F.col("_base").isNotNull()).groupBy(*keys, "_base").agg(F.count(F.lit(1)).alias("_n"))
    out = tagged.join(siblings, [*keys, "_base"], "left")
    kind = (F.when(F.col("_look").isNotNull(), F.lit("lookup")).when(F.col("_idx"), F.lit("repeater"))
            .when(F.coalesce("_n", F.lit(0)) >= 2, F.lit("radio")).otherwise(F.lit("simple")))
    group = (F.when(kind == "lookup", C.lookup({p: g for p, (_, _, g) in K.LOOKUP_PREFIXES.items()}, F.col("_look")))
             .when(kind == "repeater", P.strip_index(sn)).when(kind == "radio", F.col("_base")).otherwise(sn))
    root = F.coalesce("_look", group)
    return out.select(*items.columns, kind.alias("kind"), group.alias("group_name"), F.concat(kind, F.lit(":"), root).alias("group_key"))


def canonical_groups(items: DataFrame, keys: Sequence[str] = ("form_id",)) -> DataFrame:
    """One row per name group: kind, section by longest prefix, entity, member count, place."""
    g = name_groups(items, keys)
    section = F.when(F.col("kind") == "lookup", F.lit(next(iter(K.LOOKUP_PREFIXES.values()))[1])).otherwise(C.section_by_prefix(F.col("group_name")))
    return g.groupBy(*keys, "group_key", "kind", "group_name").agg(
        F.count(F.lit(1)).alias("members"), F.min("ord").alias("ord"), F.min_by("page", "ord").alias("page")).withColumn(
        "section", section).withColumn("entity", C.entity_of(F.col("group_name")))


def option_details(members: DataFrame) -> DataFrame:
    """details of grouped names: option mark, repeater item, lookup needle, PDF value"""
    sn, kind = F.col("source_name"), F.col("kind")
    mark = F.coalesce(P.option_suffix(sn), F.lit(""))
    option = F.when(kind.isin("radio", "lookup"), mark).otherwise(F.lit(""))
    item = F.when(kind == "repeater", P.index_of(sn))
    needle = T.humanize(F.substring(P.strip_option(sn), F.length(C.lookup_prefix(sn)) + 1, F.length(sn)))
    quoted = F.when(needle.rlike("[,()/]"), F.concat(F.lit('"'), needle, F.lit('"'))).otherwise(needle)
    pdf = F.when(kind == "radio", option).when((kind == "lookup") & (option != ""), F.lit("X")).otherwise(F.lit(""))
    return members.where(kind != "simple").select("form_id", "ord", "group_name", "kind", "source_name", option.alias("option"), item.alias("item"),
                                                  F.when(kind == "lookup", quoted).otherwise(F.lit("")).alias("needle"), pdf.alias("pdf_value"))


def radio_groups(fields: DataFrame, keys: Sequence[str] = ("form_id",), size: int = SLICE) -> DataFrame:
    """Members of radio groups of two or more: (group, id, member number, members).

    The group is the source name up to its last "/", else the label. A field's siblings are
    the other members of its group; they stay rows and are not repeated per member.
    """
    src = E("source_name")
    key = F.when(src == "", F.lit("")).when(F.instr(src, "/") > 1, T.replace(src, "/[^/]*$", "")).otherwise(T.trim(F.lower(E("label"))))
    radios = fields.where(F.col("type") == "radio").withColumn("radio_group", key).where(F.col("radio_group") != "")
    n = radios.groupBy(*keys, "radio_group").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    grouped = radios.join(n, [*keys, "radio_group"])
    return ordered_scan(grouped.select(*keys, "radio_group", "ord", "id", "members"), [*keys, "radio_group"], [F.col("ord")], by_ord(size), number="member_no")


def matrix_radio_groups(rows: DataFrame, keys: Sequence[str] = ("form_id",)) -> DataFrame:
    """groups with a button or a radio type among their rows, with their sizes"""
    g = T.trim("group_name")
    radio = (T.trim(E("native_type")) == "Btn") | F.lower(E("data_type")).contains("radio")
    return rows.where(E("group_name") != "").groupBy(*keys, g.alias("group_name")).agg(
        F.count(F.lit(1)).alias("members"), F.bool_or(radio).alias("_r")).where("_r").drop("_r")


def entity_repeaters(members: DataFrame, keys: Sequence[str] = ("form_id",)) -> DataFrame:
    """Repeaters of an entity: subfields, highest item, names the slot pattern cannot make.

    members: form_id, entity, group_name, source_name (grouped as repeater)
    """
    idx = P.index_of("source_name")
    made = F.concat("entity", F.substring("group_name", F.length("entity") + 1, F.length("group_name")), F.lit("["), idx, F.lit("]"))
    rows = members.where(E("entity") != "").select(*keys, "entity", "group_name", "source_name", idx.alias("idx"),
                                                   F.coalesce(made == F.col("source_name"), F.lit(False)).alias("ok"))
    per_group = rows.groupBy(*keys, "entity", "group_name").agg(F.max("idx").alias("top"), F.count_if(~F.col("ok")).alias("extra"))
    return per_group.groupBy(*keys, "entity").agg(F.count(F.lit(1)).alias("subfields"), F.coalesce(F.max("top"), F.lit(-1)).alias("max_index"),
                                                  F.sum("extra").alias("extra")).withColumn("ok", F.col("extra") == 0).withColumn(
        "pattern", F.concat("entity", F.lit("{sub}[{i0}]")))


# ---- widgets -----------------------------------------------------------------------------------

def collapse_widgets(widgets: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("form_id",)) -> DataFrame:
    """one widget per name: the longest label, the earliest on ties"""
    rank = F.struct(F.length(E("label")), -F.col("ord"))
    pick = F.max_by(F.struct("ord", "label", *cols), rank).alias("w")
    return widgets.groupBy(*keys, "name").agg(pick).select(*keys, "name", "w.*")


def propagate_row_labels(widgets: DataFrame, keys: Sequence[str] = ("form_id",)) -> DataFrame:
    """widgets named "<base>Row n" take the first good label of their base when theirs is bad"""
    rx = r"(?i)^(.+?)Row\s*(\d+)$"
    base = F.when(F.col("name").rlike(rx), F.lower(F.regexp_extract("name", rx, 1)))
    n = F.regexp_extract("name", rx, 2).try_cast("long")
    rows = widgets.withColumn("_base", base)
    good = ~T.is_bad_label("label")
    donors = rows.where(F.col("_base").isNotNull()).groupBy(*keys, "_base").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("label", F.when(good, F.struct(n, F.col("ord")))).alias("_donor")).where("_n > 1")
    out = rows.join(donors, [*keys, "_base"], "left")
    return out.select(*[c for c in widgets.columns if c != "label"],
                      F.when(T.is_bad_label("label") & F.col("_donor").isNotNull(), F.col("_donor")).otherwise(F.col("label")).alias("label"))


# ---- sections -----------------------------------------------------------------------------------

def section_group(fields: DataFrame, strategy: str, keys: Sequence[str] = ("form_id",), size: int = SLICE) -> DataFrame:
    """Fields with their section (id, title, order of first appearance).

    ``logical`` groups by step and section, ``pdf_page`` by page, ``matched`` by the matched
    row's step and section (fields without a match go last, to "Sin clasificar").
    """
    step, section = F.col("step") if "step" in fields.columns else F.lit(""), F.col("section") if "section" in fields.columns else F.lit("")
    if strategy == "pdf_page":
        page = F.coalesce("page", F.lit(0))
        title = F.concat(F.lit("Página "), page + 1)
        key, sec_id = F.concat(F.lit("page_"), page), F.concat(F.lit("sec_page_"), page + 1)
    else:
        default_step = T.or_else(E(step), F.lit("General")) if strategy == "logical" else T.or_else(E(step), E(section), F.lit("General"))
        title = T.or_else(E(section), E(step), F.lit("Datos")) if strategy == "logical" else T.or_else(E(section), default_step)
        key = F.concat(T.slug_n(default_step, 40), F.lit("__"), T.slug_n(title, 40))
        prefix = "sec_" if strategy == "logical" else "section_"
        sec_id = F.concat(F.lit(prefix), T.slug_n(default_step, 40), F.lit("_"), T.slug_n(title, 40))
    if strategy == "matched":
        lost = ~F.col("matched")
        key = F.when(lost, F.lit("~")).otherwise(key)
        sec_id = F.when(lost, F.lit("section_sin_clasificar")).otherwise(sec_id)
        title = F.when(lost, F.lit("Sin clasificar")).otherwise(title)
    tagged = fields.withColumn("_key", key).withColumn("_id", sec_id).withColumn("_title", title)
    sections = tagged.groupBy(*keys, "_key").agg(F.min("ord").alias("_first"), F.min_by("_id", "ord").alias("section_id"),
                                                 F.min_by("_title", "ord").alias("section_title"))
    last = F.when(F.col("_key") == "~", 1).otherwise(0)
    ordered = ordered_scan(sections.withColumn("_last", last), keys, [F.col("_last"), F.col("_first")],
                           F.struct("_last", by_ord(size, "_first")), number="section_order").drop("_first", "_last")
    return tagged.drop("_id", "_title").join(ordered, [*keys, "_key"]).drop("_key")


def section_two_level(fields: DataFrame, keys: Sequence[str] = ("form_id",), size: int = SLICE) -> DataFrame:
    """step -> section headings with ids, titles, orders; unmatched fields last, hidden.

    fields: form_id, ord, step, section, matched
    """
    sec = T.or_else(T.trim(E("step")), T.trim(E("section")), F.lit("Sin Sección"))
    sub = T.or_else(T.trim(E("section")), sec)
    lost = ~F.col("matched")
    rows = fields.withColumn("_sec", F.when(lost, F.lit("Sistema")).otherwise(sec)).withColumn(
        "_sub", F.when(lost, F.lit("Datos del Sistema (oculto)")).otherwise(sub)).withColumn("_lost", lost.cast("int"))
    subs = rows.groupBy(*keys, "_lost", "_sec", "_sub").agg(F.min("ord").alias("_first"), F.count(F.lit(1)).alias("fields"))
    secs = subs.groupBy(*keys, "_lost", "_sec").agg(F.min("_first").alias("_sfirst"))
    order = [F.col("_lost"), F.col("_sfirst")]
    secs = ordered_scan(secs, keys, order, F.struct("_lost", by_ord(size, "_sfirst")), number="section_order").drop("_sfirst")
    subs = ordered_scan(subs, [*keys, "_lost", "_sec"], [F.col("_first")], by_ord(size, "_first"), number="part_order")

    def key(c: str) -> Column:
        return T.slug_n(c, None, "otros")

    def title(c: str) -> Column:
        return F.when(F.col("_lost") == 1, F.col(c)).otherwise(T.title_case(F.col(c)))

    part_id = F.when(F.col("_lost") == 1, F.lit("subsection_sistema_oculto")).otherwise(F.concat(F.lit("subsection_"), key("_sec"), F.lit("_"), key("_sub")))
    return subs.join(secs, [*keys, "_lost", "_sec"]).select(
        *keys, F.concat(F.lit("section_"), key("_sec")).alias("section_id"), title("_sec").alias("section_title"), "section_order",
        part_id.alias("part_id"), title("_sub").alias("part_title"), "part_order", (F.col("_lost") == 1).alias("hidden"), "fields")


def numbered_parent(sections: DataFrame, keys: Sequence[str] = ("form_id",)) -> DataFrame:
    """"NAME n" sections under a plural parent when their base has several; others alone.

    sections: form_id, name, first_ord. Adds base, num, parent_title (NULL when alone).
    """
    name = T.trim("name")
    rx = r"^(.+?)\s+(\d+)\s*$"
    hit = name.rlike(rx)
    rows = sections.withColumn("base", F.when(hit, T.trim(F.regexp_extract(name, rx, 1))).otherwise(name)).withColumn(
        "num", F.when(hit, F.regexp_extract(name, rx, 2)))
    n = rows.groupBy(*keys, "base").agg(F.count(F.lit(1)).alias("_n"), F.count("num").alias("_k"))
    parent = T.title_case(F.col("base"))
    parent = F.when(parent.endswith("s"), parent).otherwise(F.concat(parent, F.lit("s")))
    return rows.join(n, [*keys, "base"]).withColumn("parent_title", F.when((F.col("_k") > 0) & (F.col("_n") > 1), parent)).drop("_n", "_k")


# ---- counts --------------------------------------------------------------------------------------

def stats(rows: DataFrame, dims: Sequence[str], flags: Sequence[str] = (), keys: Sequence[str] = ("form_id",)) -> DataFrame:
    """long statistics (metric, value): row count, one count per dimension value, one per flag"""
    entries = [F.struct(F.lit("total").alias("metric"), F.lit("").alias("value"))]
    entries += [F.struct(F.lit(d).alias("metric"), E(d).alias("value")) for d in dims]
    entries += [F.when(F.col(f), F.struct(F.lit(f).alias("metric"), F.lit("").alias("value"))) for f in flags]
    long = rows.select(*keys, F.explode(F.array_compact(F.array(*entries))).alias("e"))
    return long.groupBy(*keys, "e.metric", "e.value").agg(F.count(F.lit(1)).alias("n"))


def matrix_issues(rows: DataFrame) -> DataFrame:
    """issues of matrix rows, one row each: (form_id, ord, issue, suggested)"""
    pdf = E("pdf_label")
    ambiguous = pdf.rlike(r"(?i)Vida\s+(Colectiva|Universal)") & pdf.contains("/")
    missing = (T.trim(E("pdf_field_name")) == "") & (T.trim(E("json_name")) != "")
    req, scope = T.trim(E("required")), T.trim(E("product_scope"))
    none = F.lit(None).cast("string")

    def issue(test: Column, name: str, suggested: Column) -> Column:
        return F.when(test, F.struct(F.lit(name).alias("issue"), suggested.alias("suggested")))

    found = F.array_compact(F.array(
        issue(ambiguous, "ambiguous_pdf_name", none), issue(missing, "missing_pdf_field", P.derive_name("json_name")),
        issue(req.isin("NO", "no"), "obligatorio_case", F.lit("No")), issue(scope != "", "derive_formulario", C.map_product(scope))))
    return rows.select("form_id", "ord", F.explode(found).alias("i")).select("form_id", "ord", "i.*")


def widget_stats(widgets: DataFrame, keys: Sequence[str] = ("form_id",)) -> DataFrame:
    """per PDF: fields, pages, repeated roots, distinct configurations (index taken off)"""
    root = P.strip_index("name")
    by_root = widgets.groupBy(*keys, root.alias("_root")).agg(
        F.count(F.lit(1)).alias("n"), F.max("page").alias("page"), F.bool_or(F.col("name") != root).alias("rep"))
    return by_root.groupBy(*keys).agg(F.sum("n").alias("fields"), (F.max("page") + 1).alias("pages"),
                                      F.count_if("rep").alias("repeater_groups"), F.count(F.lit(1)).alias("unique_configs"))


def formdef_stats(fields: DataFrame, sections: DataFrame, keys: Sequence[str] = ("form_id",)) -> DataFrame:
    """sections, fields, repeaters, lookups, conditionals and autofills of a definition

    fields: form_id, type, condition_visibility, condition_required, concat;
    sections: form_id, condition_visibility
    """
    conditional = (E("condition_visibility") != "") | (E("condition_required") != "")
    f = fields.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fields"), F.count_if(F.col("type") == "repeater").alias("repeaters"), F.count_if(conditional).alias("_c"),
        F.count("concat").alias("autofill"), F.count_if(E("concat").rlike('"type" *: *"repeaterLookup"')).alias("lookups"))
    s = sections.groupBy(*keys).agg(F.count(F.lit(1)).alias("sections"), F.count_if(E("condition_visibility") != "").alias("_s"))
    return s.join(f, list(keys), "left").na.fill(0).withColumn("conditionals", F.col("_c") + F.col("_s")).drop("_c", "_s")
