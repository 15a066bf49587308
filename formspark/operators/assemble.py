"""Built form definitions.

Fields stay rows to the end. A document is written as lines with a sort key, whose texts in
that order are the JSON of the form. Every field and every option is a line of its
own, so a form of any size is never gathered in one row, one group or one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formspark import constants as K
from formspark.functions import classify as C
from formspark.functions import paths as P
from formspark.functions import text as T
from formspark.kernels import SLICE, ordered_scan

E = T.text_or_empty
_KEEP_NULLS = {"ignoreNullFields": "false"}


def _open_object(c: Column) -> Column:
    """a JSON object without its closing brace"""
    return F.substring(c, F.lit(1), F.length(c) - 1)


def _comma(first: Column) -> Column:
    return F.when(first, F.lit("")).otherwise(F.lit(","))


LINE_KEY = ["section_order", "part", "field_order", "item"]
LAST_ITEM = 1 << 30
LAST_SECTION = 1 << 60


def document_lines(forms: DataFrame, sections: DataFrame, fields: DataFrame, options: DataFrame | None = None, tail: str = "") -> DataFrame:
    """Lines of the JSON documents of all forms: (form_id, LINE_KEY, text).

    forms: form_id
    sections: form_id, section_order (from 1), body (struct of the section's own members)
    fields: form_id, section_order, field_order (from 1), body (struct)
    options: form_id, section_order, field_order, option_no (from 1), body (struct)
    tail: members that follow the sections, as JSON text that starts with a comma

    Each table is read once; the texts that open and close a node are two lines of one row.
    """
    def lines(df: DataFrame, *made: tuple[int, Column | int, Column | int, Column | int, Column]) -> DataFrame:
        def number(c: Column | int) -> Column:
            return (F.lit(c) if isinstance(c, int) else c).cast("long")
        row = [F.struct(number(s).alias("section_order"), F.lit(p).alias("part"), number(f).alias("field_order"), number(i).alias("item"), t.alias("text"))
               for p, s, f, i, t in made]
        return df.select("form_id", F.explode(F.array(*row)).alias("_l")).select("form_id", "_l.*")

    sec, fld = F.col("section_order"), F.col("field_order")
    body = F.to_json("body", _KEEP_NULLS)
    head = _open_object(body)
    # parts of a section: 0 opens it, 1 its fields, 2 closes it
    out = lines(forms, (0, 0, 0, 0, F.lit('{"sections":[')), (3, LAST_SECTION, 0, 0, F.lit("]" + tail + "}")))
    out = out.unionAll(lines(sections, (0, sec, 0, 0, F.concat(_comma(sec == 1), head, F.lit(',"fields":['))), (2, sec, 0, 0, F.lit("]}"))))
    if options is None:
        return out.unionAll(lines(fields, (1, sec, fld, 0, F.concat(_comma(fld == 1), body))))
    out = out.unionAll(lines(fields, (1, sec, fld, 0, F.concat(_comma(fld == 1), head, F.lit(',"options":['))), (1, sec, fld, LAST_ITEM, F.lit("]}"))))
    no = F.col("option_no")
    return out.unionAll(lines(options, (1, sec, fld, no, F.concat(_comma(no == 1), body))))


# ---- the web form -----------------------------------------------------------------------------

def web_field(f: DataFrame) -> DataFrame:
    """fields with the members the web form shows, as ``body``

    f: form_id, section_order, field_order, id, label, type, json_name, required, read_only,
    pattern, value, n_options, depends_on, equals, source_name, page, x, y, width, height
    """
    def prefixed(c: Column) -> Column:
        return F.when(E(c) == "", F.lit("field_unknown")).when(c.startswith("field_"), c).otherwise(F.concat(F.lit("field_"), c))

    empty = E("equals") == ""
    op = F.when(empty, F.struct(prefixed(F.col("depends_on")).alias("fieldId"), F.lit("not_empty").alias("operator"), F.lit(None).cast("string").alias("value"))).otherwise(
        F.struct(prefixed(F.col("depends_on")).alias("fieldId"), F.lit("equals").alias("operator"), F.col("equals").alias("value")))
    condition = F.when(E("depends_on") != "", F.to_json(F.struct(F.lit("and").alias("logic"), F.array(op).alias("conditions"))))
    rect = F.when(F.col("x").isNotNull(), F.struct("x", "y", "width", "height"))
    source = F.when((E("source_name") != "") | F.col("x").isNotNull(), F.struct(
        F.lit("pdf").alias("kind"), F.nullif("source_name", F.lit("")).alias("sourceName"), F.coalesce(F.col("page") + 1, F.lit(1)).alias("page"), rect.alias("rect")))
    body = F.struct(
        prefixed(F.col("id")).alias("id"), E("label").alias("label"), C.form_type(F.col("type"), F.col("label"), F.col("json_name")).alias("type"),
        F.coalesce("required", F.lit(False)).alias("required"), F.coalesce("read_only", F.lit(False)).alias("readOnly"), F.lit("full").alias("width"),
        F.nullif("pattern", F.lit("")).alias("validationPattern"), condition.alias("conditionalVisibility"),
        F.when(F.coalesce("n_options", F.lit(0)) == 0, F.nullif("value", F.lit(""))).alias("defaultValue"), source.alias("sourceMeta"),
        F.when(F.coalesce("required", F.lit(False)), F.lit("required")).otherwise(F.lit("optional")).alias("prefillMode"), P.first_path("json_name").alias("prefillKey"))
    return f.select("form_id", "section_order", "field_order", body.alias("body"))


def web_section(s: DataFrame) -> DataFrame:
    """sections as ``body``; a page section is titled "Page n" """
    page = F.concat(F.lit("Page "), "section_order")
    title = F.when((E("section_title") == "") | F.col("section_title").rlike(r"(?i)^p[aá]gina\s+\d+$"), page).otherwise(F.col("section_title"))
    return s.select("form_id", "section_order", F.struct(F.col("section_id").alias("id"), title.alias("title"), F.lit(None).cast("string").alias("description"),
                                                         F.col("section_order").alias("order")).alias("body"))


def field_positions(widgets: DataFrame) -> DataFrame:
    """one row per widget rectangle: page from 1, whole numbers rounded half up; a field
    without a widget has zeros"""
    there = F.col("x").isNotNull()
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("x", "y", "width", "height")]
    return widgets.select("form_id", F.col("name").alias("source_name"), (F.coalesce("page", F.lit(0)) + 1).alias("page"), there.alias("has_coordinates"),
                          *[c.alias(f"{n}_px") for n, c in zip(("x", "y", "width", "height"), cols)],
                          *[C.half_up(c).alias(f"{n}_int") for n, c in zip(("x", "y", "width", "height"), cols)])


# ---- mapping rows to form fields ------------------------------------------------------------------

def section_condition(title: Column) -> Column:
    """a second or later beneficiary shows once the one before it has a name"""
    n = C.extract(T.strip_accents(F.lower(E(title))), r"beneficiario\s*(\d+)").try_cast("int")
    text = F.concat(F.lit('{"logic":"and","conditions":[{"fieldId":"field_beneficiario_'), (n - 1).cast("string"), F.lit('_nombre","operator":"not_empty"}]}'))
    return F.when(n >= 2, text)


def enriched_sections(rows: DataFrame, size: int = SLICE) -> DataFrame:
    """Sections of mapping rows in order of appearance, after the hidden header section.

    rows: form_id, ord, section_pdf. Gives form_id, section_order, section_id, title, condition.
    """
    title = T.or_else(E("section_pdf"), F.lit("Sin Sección"))
    first = rows.withColumn("title", title).groupBy("form_id", "title").agg(F.min("ord").alias("_first"))
    numbered = ordered_scan(first, ["form_id"], [F.col("_first")], F.floor(F.col("_first") / size), number="_n")
    slug_of = F.concat(F.lit("section_"), T.or_else(_title_slug(), F.lit("sin_seccion")))
    own = numbered.select("form_id", (F.col("_n") + 1).alias("section_order"), slug_of.alias("section_id"), "title", section_condition(F.col("title")).alias("condition"))
    head = rows.select("form_id").distinct().select("form_id", F.lit(1).cast("long").alias("section_order"), F.lit(K.HEADER_SECTION[0]).alias("section_id"),
                                                    F.lit(K.HEADER_SECTION[1]).alias("title"), F.lit(K.NEVER_VISIBLE).alias("condition"))
    return head.unionByName(own)


def _title_slug() -> Column:
    plain = T.replace(T.strip_accents(F.lower(F.col("title"))), "[^a-z0-9" + T.WS[1:-1] + "]", "")
    return T.replace(T.replace(T.replace(plain, T.WS + "+", "_"), "_+", "_"), "^_|_$", "")


def header_fields(forms: DataFrame) -> DataFrame:
    """the ten hidden header fields of every form"""
    entries = F.explode(F.array(*[F.struct(F.lit(i + 1).cast("long").alias("field_order"), F.lit(name).alias("name"), F.lit(label).alias("label"), F.lit(type_).alias("type"))
                                  for i, (name, label, type_) in enumerate(K.HEADER_FIELDS)])).alias("_h")
    rows = forms.select("form_id", entries).select("form_id", "_h.*")
    path = F.concat(F.lit("encabezado."), "name")
    return rows.select("form_id", F.lit(K.HEADER_SECTION[1]).alias("title"), "field_order", F.concat(F.lit("field_encabezado_"), "name").alias("id"), "type", "label",
                       F.lit(True).alias("required"), F.lit(True).alias("read_only"), path.alias("prefill_key"), F.lit("mandatory").alias("prefill_mode"),
                       F.lit(None).cast("string").alias("help_text"), F.lit(None).cast("int").alias("default_value"), F.lit(None).cast("int").alias("max_length"),
                       F.lit(None).cast("string").alias("pattern"))


def enriched_fields(rows: DataFrame, size: int = SLICE) -> DataFrame:
    """Form fields of mapping rows, numbered inside their section, after the header fields.

    rows: form_id, ord, section_pdf, source_name, acro_proposed, label, format, native_type,
    group_name, catalog_name, path_main, required, max_length, pattern
    """
    name = T.or_else(E("source_name"), E("acro_proposed"))
    rows = rows.withColumn("_sn", name).withColumn("title", T.or_else(E("section_pdf"), F.lit("Sin Sección")))
    type_ = C.enriched_type(F.col("format"), F.col("source_name"), F.col("native_type"), F.col("group_name"), E("catalog_name") != "")
    number = C.default_row_number("_sn")
    numbered = ordered_scan(rows, ["form_id", "title"], [F.col("ord")], F.floor(F.col("ord") / size), number="field_order").withColumn("_type", type_)
    free = ~F.col("_type").isin("select", "radio", "checkbox")
    own = numbered.select(
        "form_id", "title", "field_order", F.concat(F.lit("field_"), "_sn").alias("id"), F.col("_type").alias("type"), T.or_else(E("label"), F.col("_sn")).alias("label"),
        F.coalesce("required", F.lit(False)).alias("required"), number.isNotNull().alias("read_only"), F.nullif("path_main", F.lit("")).alias("prefill_key"),
        C.prefill_mode("_sn", "path_main", "group_name").alias("prefill_mode"), C.help_text("_sn").alias("help_text"), number.alias("default_value"),
        F.when(free & (F.col("max_length") > 0), F.col("max_length")).alias("max_length"),
        F.when(F.col("_sn") != "solicitud_lugar", F.nullif("pattern", F.lit(""))).alias("pattern"))
    return header_fields(rows.select("form_id").distinct()).unionByName(own)


def enriched_stats(fields: DataFrame) -> DataFrame:
    """counts of a built form"""
    return fields.groupBy("form_id").agg(
        F.count(F.lit(1)).alias("fields"), F.count_if("required").alias("required"), F.count("prefill_key").alias("with_prefill"),
        F.count("help_text").alias("with_help"), F.count_if(F.col("prefill_mode") == "mandatory").alias("mandatory"),
        F.count_if(F.col("prefill_mode") == "optional").alias("optional"))


def matrix_fields(rows: DataFrame, widgets: DataFrame, size: int = SLICE) -> DataFrame:
    """Form fields of a mapping and its PDF: the members of each group as radios numbered in
    their group, single rows, and a hidden field for every widget no row names.

    rows: form_id, ord, acro_actual, acro_proposed, source_name, label, data_type, native_type,
    group_name, options_raw, required, path_main; widgets: form_id, ord, name, type
    """
    from formspark.operators.joins import cross_reference
    matched, lost = cross_reference(rows, widgets)
    name = T.or_else(E("source_name"), E("acro_proposed"), E("acro_actual"))
    grouped = E("group_name") != ""
    rows_ = matched.withColumn("_sn", name).withColumn("_g", F.when(grouped, F.col("group_name")).otherwise(F.lit("")))
    numbered = ordered_scan(rows_, ["form_id", "_g"], [F.col("ord")], F.floor(F.col("ord") / size), number="_no")
    path = P.correct_path("path_main")
    type_ = F.when(grouped, F.lit("radio")).otherwise(C.mapping_type(F.col("data_type"), F.col("native_type"), F.col("group_name"), E("options_raw") != ""))
    own = numbered.select("form_id", F.lit(False).alias("orphan"), F.concat(F.lit("field_"), "_sn").alias("id"), type_.alias("type"), T.or_else(E("label"), F.col("_sn")).alias("label"),
                          F.coalesce("required", F.lit(False)).alias("required"), F.lit(False).alias("hidden"), F.col("widget").alias("source_name"),
                          F.nullif(path, F.lit("")).alias("output"), F.nullif("_g", F.lit("")).alias("radio_group"),
                          F.when(grouped, F.col("_no")).otherwise(F.col("ord").cast("long")).alias("field_order"))
    none = F.lit(None).cast("string")
    hidden = lost.groupBy("form_id", "name").agg(F.min_by("type", "ord").alias("type")).select(
        "form_id", F.lit(True).alias("orphan"), F.concat(F.lit("field_"), "name").alias("id"),
        F.when(F.col("type") == "Button", F.lit("checkbox")).otherwise(F.lit("text")).alias("type"), F.col("name").alias("label"), F.lit(False).alias("required"),
        F.lit(True).alias("hidden"), F.col("name").alias("source_name"), none.alias("output"), none.alias("radio_group"), F.lit(0).cast("long").alias("field_order"))
    return own.unionByName(hidden)


def synthetic_source(rows: DataFrame) -> DataFrame:
    """rows without any PDF name get one of their label and row number"""
    bare = (E("source_name") == "") & (E("acro_actual") == "") & (E("acro_proposed") == "")
    base = T.or_else(F.substring(T.replace(T.norm_words("label"), " ", "_"), 1, 40), F.lit("campo"))
    return rows.withColumn("acro_proposed", F.when(bare, F.concat(base, F.lit("_r"), "row_num")).otherwise(F.col("acro_proposed")))


def apply_links(rows: DataFrame, links: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields that people linked to matrix rows.

    The first source linked to a row is its field, further ones are reported; a linked source
    the form lacks makes a new field; fields nobody linked stay, hidden.
    links: form_id, ord, source_name, row_num (NULL: linked to nothing); fields: form_id, ord, source_name
    """
    live = links.where(F.col("row_num").isNotNull())
    first = live.groupBy("form_id", "row_num").agg(F.min_by("source_name", "ord").alias("source_name"), F.min("ord").alias("_ord"))
    extra = live.join(first.select("form_id", "row_num", "_ord"), ["form_id", "row_num"]).where(F.col("ord") > F.col("_ord")).select("form_id", "row_num", "source_name")
    known = fields.select("form_id", "source_name").distinct().withColumn("_known", F.lit(True))
    made = rows.join(first.drop("_ord"), ["form_id", "row_num"]).join(known, ["form_id", "source_name"], "left").select(
        "form_id", "source_name", "row_num", F.when(F.col("_known"), F.lit("linked")).otherwise(F.lit("new")).alias("state"))
    rest = fields.select("form_id", "source_name").distinct().join(first.select("form_id", "source_name").distinct(), ["form_id", "source_name"], "left_anti").select(
        "form_id", "source_name", F.lit(None).cast("long").alias("row_num"), F.lit("hidden").alias("state"))
    return made.unionByName(rest), extra


def mapping_rows(widgets: DataFrame, texts: DataFrame, keys: Sequence[str] = ("form_id",)) -> DataFrame:
    """Mapping rows of a PDF from its layout alone: section, date group, proposed name, free of
    collisions and sentence-like names, and the label shown to people.

    widgets: form_id, ord, name, type, page, x, y, width, height, label; texts: form_id, ord, page,
    str, x, y, width, height
    """
    from formspark.operators import layout as L
    headings, subheadings = L.detect_sections(texts, widgets, keys)
    # scans move all columns of their rows: only those that are read go on
    placed = L.assign_section(widgets.select(*keys, "ord", "name", "type", "page", "y", "height", "label"), headings, subheadings, keys)
    dates = L.date_groups(widgets, headings, texts, keys).select(*keys, "ord", F.col("part").alias("date_part"), "date_prefix", "date_group")
    named = L.propose_name(placed.join(dates, [*keys, "ord"], "left")).where(~T.is_noise_name("proposed"))
    named = named.select(*keys, "ord", "page", "name", "type", "heading", "section_name", F.col("group_proposed").alias("group_name"), "date_group", "proposed", "public_label")
    free = L.resolve_collisions(named, keys)
    out = L.context_labels(free, keys)
    return out.select(*keys, "ord", F.coalesce("heading", F.lit("")).alias("section_pdf"), F.col("name").alias("acro_actual"), F.col("final_name").alias("acro_proposed"),
                      F.col("context_label").alias("label"), F.when(F.col("type") == "text", F.lit("Tx")).otherwise(F.lit("Btn")).alias("native_type"),
                      "group_name", (F.col("page") + 1).alias("page"))


def group_fields(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Form fields of name groups: a simple name is a field, each member of a radio group a
    radio, an entity's repeaters one repeater, another repeater its own, a lookup a repeater
    of its catalog and a check box per member.

    groups: form_id, group_key, kind, group_name, entity, label, path, section, ord
    members: form_id, group_key, ord, source_name
    Gives form_id, ord, id, type, label, section, source_name, radio_group, slot_pattern,
    json_pattern, max_items, lookup (what a check box looks up).
    """
    none = F.lit(None).cast("string")
    named = members.join(groups.drop("ord"), ["form_id", "group_key"])
    sn = F.col("source_name")
    label = T.or_else(E("label"), F.col("group_name"))
    path = T.or_else(E("path"), F.concat(F.lit("datosFormulario."), F.col("group_name")))
    mark = P.option_suffix(sn)
    needle = T.humanize(F.substring(P.strip_option(sn), F.length(C.lookup_prefix(sn)) + 1, F.length(sn)))
    quoted = F.when(needle.rlike("[,()/]"), F.concat(F.lit('"'), needle, F.lit('"'))).otherwise(needle)
    found = F.when(mark == "Si", F.lit("X")).otherwise(F.lit(""))
    lost = F.when(mark == "Si", F.lit("")).otherwise(F.lit("X"))
    lookup = F.to_json(F.struct(F.lit("repeaterLookup").alias("type"), F.concat(F.lit("field_"), "group_name").alias("repeaterId"), quoted.alias("needle"),
                                found.alias("ifFound"), lost.alias("ifNotFound")))
    one = F.lit(None).cast("int")
    flat = named.where(F.col("kind") != "repeater").select(
        "form_id", "ord", F.concat(F.lit("field_"), sn).alias("id"),
        F.when(F.col("kind") == "radio", F.lit("radio")).when(F.col("kind") == "lookup", F.lit("checkbox")).otherwise(F.lit("text")).alias("type"),
        F.when(F.col("kind") == "lookup", T.or_else(needle, label)).otherwise(label).alias("label"), "section", sn.alias("source_name"),
        F.when(F.col("kind") == "radio", F.col("group_name")).alias("radio_group"), none.alias("slot_pattern"), none.alias("json_pattern"), one.alias("max_items"),
        F.when(F.col("kind") == "lookup", lookup).alias("lookup"))
    # repeaters: per entity, or alone
    rep = named.where(F.col("kind") == "repeater").withColumn("_e", F.coalesce(*[F.when(F.col("group_name").startswith(e), F.lit(e)) for e in K.ENTITY_REPEATERS]))
    top = rep.groupBy("form_id", F.coalesce("_e", "group_name").alias("_r"), "_e").agg(
        F.min("ord").alias("ord"), F.max(P.index_of("source_name")).alias("_top"), F.min_by(F.struct("section", label.alias("label"), path.alias("path")), "ord").alias("_g"))
    info = {e: (plural, most, where) for e, (_, plural, most, where) in K.ENTITY_REPEATERS.items()}

    def known(i: int) -> Column:
        return F.coalesce(*[F.when(F.col("_e") == e, F.lit(v[i])) for e, v in info.items()])

    entity = F.col("_e").isNotNull()
    repeaters = top.select(
        "form_id", "ord", F.concat(F.lit("field_"), "_r").alias("id"), F.lit("repeater").alias("type"), F.coalesce(known(0), F.col("_g.label")).alias("label"),
        F.col("_g.section").alias("section"), none.alias("source_name"), none.alias("radio_group"),
        F.when(entity, F.concat("_r", F.lit("{sub}[{i0}]"))).otherwise(F.concat("_r", F.lit("[{i0}]"))).alias("slot_pattern"),
        F.when(entity, F.concat(known(2), F.lit("[{i0}].{sub}"))).otherwise(F.concat(F.col("_g.path"), F.lit("[{i0}]"))).alias("json_pattern"),
        F.coalesce(known(1), F.col("_top") + 1).cast("int").alias("max_items"), none.alias("lookup"))
    catalogs = named.where(F.col("kind") == "lookup").groupBy("form_id", "group_name").agg(
        F.min("ord").alias("ord"), F.count(F.lit(1)).cast("int").alias("_n"), F.min_by(F.struct("section", label.alias("label"), path.alias("path")), "ord").alias("_g")).select(
        "form_id", "ord", F.concat(F.lit("field_"), "group_name").alias("id"), F.lit("repeater").alias("type"), F.col("_g.label").alias("label"), F.col("_g.section").alias("section"),
        none.alias("source_name"), none.alias("radio_group"), none.alias("slot_pattern"), F.col("_g.path").alias("json_pattern"), F.col("_n").alias("max_items"), none.alias("lookup"))
    return flat.unionByName(repeaters).unionByName(catalogs)


def with_unused(fields: DataFrame, known: DataFrame) -> DataFrame:
    """built fields and, hidden, the known source names none of them carries"""
    used = fields.where(F.col("source_name").isNotNull()).select("form_id", "source_name").distinct()
    rest = known.select("form_id", "source_name").distinct().join(used, ["form_id", "source_name"], "left_anti")
    hidden = rest.select("form_id", F.concat(F.lit("field_"), "source_name").alias("id"), "source_name", F.lit(True).alias("hidden"))
    return fields.withColumn("hidden", F.lit(False)).unionByName(hidden, allowMissingColumns=True)
