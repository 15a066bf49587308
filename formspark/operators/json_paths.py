"""JSON documents as path tables: flattening, comparing, covering, conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formspark.functions import paths as P
from formspark.functions.text import replace, text_or_empty, trim
from formspark.constants import SECTION_LEVELS
from formspark.kernels import ancestors, ordered_scan, spread, suffixes
from formspark.session import cut_lineage

LEVELS = 8  # levels that one chain opens


def _parse(c: Column) -> Column:
    """one whole JSON value; parsed inside an array, as text after the value would pass otherwise"""
    wrapped = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return F.when(F.try_variant_get(wrapped, "$[1]", "variant").isNull(), F.try_variant_get(wrapped, "$[0]", "variant"))


def read_json_lenient(c: Column | str) -> Column:
    """a document, also one with trailing commas; NULL when it is no JSON at all"""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(_parse(c), _parse(replace(c, r",(\s*[}\]])", "$1")))


def nesting(brackets: Column) -> Column:
    """how deeply a text of nothing but brackets nests"""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        now = s["now"] + F.when(x.isin("[", "{"), 1).when(x.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, step, lambda s: s["most"])


def deepest(docs: DataFrame, body: str) -> int:
    """How many levels the documents have, at least: what is left of a text without its strings and scalars
    is its brackets, and documents of one shape leave the same ones, so few are looked at in full. Lists
    of scalars and of empty containers leave one pair, however long they are."""
    brackets = replace(F.col(body), r'"(?:[^"\\]++|\\.)*+"|[^\[\]{}"]++', "")
    for _ in range(2):
        brackets = replace(brackets, r"(?:\[\]){2,}+", "[]")
        brackets = replace(brackets, r"(?:\{\}){2,}+", "{}")
    shapes = docs.select(brackets.alias("_brackets")).distinct()
    return shapes.agg(F.max(nesting(F.col("_brackets")))).first()[0] or 0


def json_nodes(docs: DataFrame, ids: Sequence[str], body: str, first_only: bool = False) -> DataFrame:
    """Every node below the root: (ids, ord, path, kind, value), however deep it lies.

    A document is parsed once and opened level by level in one narrow chain, no shuffle and no
    second read. The deepest nesting of the texts (one number, from their brackets) says how many
    levels there are; beyond ``LEVELS`` the containers still shut are written down and opened on
    from there, again until none is left. ``ord`` is the position trail, so comparing it gives
    document order. With ``first_only`` an array contributes its first element only.
    """
    left = deepest(docs, body)
    shut = docs.select(*ids, F.array().cast("array<int>").alias("_ord"), F.lit("").alias("_path"), read_json_lenient(body).alias("_value"))
    out = None
    while True:
        nodes = _opened(shut, ids, max(1, min(left, LEVELS)), first_only)
        found = nodes.drop("_shut")
        out = found if out is None else out.unionAll(found)
        left -= LEVELS
        if left <= 0:
            return out
        shut = cut_lineage(nodes.where("_shut is not null").select(*ids, F.col("ord").alias("_ord"), F.col("path").alias("_path"), F.col("_shut").alias("_value")))
        if shut.isEmpty():
            return out


def _opened(shut: DataFrame, ids: Sequence[str], levels: int, first_only: bool) -> DataFrame:
    """The nodes of ``levels`` levels below the containers of ``shut``; ``_shut`` is a container with
    something in it on the last of them. Each row of the chain is one deepest node; a container is
    given by the row of its first descendant only, and its content is dropped once it is opened."""
    tvf = shut.sparkSession.tvf
    cur = shut.select(*ids, "_ord", F.col("_path").alias("_path0"), F.col("_value").alias("_v0"))
    for j in range(1, levels + 1):
        kept = [c for c in cur.columns if c != f"_v{j - 1}"]
        cur = cur.lateralJoin(tvf.variant_explode_outer(F.col(f"_v{j - 1}").outer()))
        above = F.col(f"_path{j - 1}")
        step = F.when(F.col("pos").isNull(), F.lit(None)).when(F.col("key").isNull(), F.concat(above, F.lit("[]"))).when(
            above == "", F.col("key")).otherwise(F.concat(above, F.lit("."), "key"))
        if first_only:
            cur = cur.where(F.col("pos").isNull() | F.col("key").isNotNull() | (F.col("pos") == 0))
        rest = F.when(F.col("pos").isNull(), F.col(f"_v{j - 1}"))
        cur = cur.select(*kept, rest.alias(f"_v{j - 1}"), F.col("pos").alias(f"_pos{j}"), F.col("key").isNull().alias(f"_array{j}"), F.col("value").alias(f"_v{j}"), step.alias(f"_path{j}"))
    nodes = []
    for j in range(1, levels + 1):
        first = F.col(f"_pos{j}").isNotNull()
        for k in range(j + 1, levels + 1):
            first = first & (F.coalesce(f"_pos{k}", F.lit(0)) == 0)
        own = F.col(f"_v{j}")
        head = F.substring(F.to_json(own), 1, 1)
        end = F.when(head == "{", F.lit("object")).when(head == "[", F.lit("array")).otherwise(F.lit("leaf"))
        kind, value, still = end, F.try_variant_get(own, "$", "string"), F.lit(None).cast("variant")
        if j < levels:  # an opened container is known by its child
            opened = F.col(f"_pos{j + 1}").isNotNull()
            kind = F.when(opened, F.when(F.col(f"_array{j + 1}"), F.lit("array")).otherwise(F.lit("object"))).otherwise(end)
        else:
            still = F.when(head.isin("{", "["), own)
        trail = F.concat("_ord", F.array(*[F.col(f"_pos{k}") for k in range(1, j + 1)]))
        nodes.append(F.when(first, F.struct(trail.alias("ord"), F.col(f"_path{j}").alias("path"), kind.alias("kind"), value.alias("value"), still.alias("_shut"))))
    out = cur.select(*ids, F.explode(F.array_compact(F.array(*nodes))).alias("_n")).select(*ids, "_n.*")
    return out.withColumn("value", F.when(F.col("kind") == "leaf", F.col("value")))


def flatten_paths(docs: DataFrame, ids: Sequence[str], body: str) -> DataFrame:
    """Known paths of a document: ``a.b``, arrays as ``a[]``, first elements only."""
    nodes = json_nodes(docs, ids, body, first_only=True)
    path = F.when(F.col("kind") == "array", F.concat("path", F.lit("[]"))).otherwise(F.col("path"))
    keep = (F.col("kind") != "leaf") | F.col("value").isNotNull()
    return nodes.where(keep).select(*ids, path.alias("path")).distinct()


def flatten_shape(docs: DataFrame, ids: Sequence[str], body: str, per: Sequence[str] | None = None) -> DataFrame:
    """Shape of the documents of each ``per`` key: path, kind (a container wins over a
    leaf) and position of first appearance."""
    per = list(per if per is not None else ids)
    nodes = json_nodes(docs, ids, body)
    rank = F.struct((F.col("kind") == "leaf").alias("leaf"), *[i for i in ids if i not in per], "ord")
    first = F.struct(*[i for i in ids if i not in per], "ord")
    return nodes.groupBy(*per, "path").agg(F.min_by("kind", rank).alias("kind"), F.min(first).alias("first_seen"),
                                           F.count(F.lit(1)).alias("n"))


def path_samples(docs: DataFrame, ids: Sequence[str], body: str, k: int = 3,
                 per: Sequence[str] | None = None) -> DataFrame:
    """The first ``k`` leaf values of each path, one row each (limited map-side first)."""
    per = list(per if per is not None else ids)
    nodes = json_nodes(docs, ids, body).where(F.col("kind") == "leaf")
    order = Window.partitionBy(*per, "path").orderBy(*[i for i in ids if i not in per], "ord")
    return nodes.select("*", F.row_number().over(order).alias("sample_no")).where(F.col("sample_no") <= k).select(
        *per, "path", "sample_no", "value")


def flatten_leaves(shape_nodes: DataFrame, per: Sequence[str]) -> DataFrame:
    return shape_nodes.where(F.col("kind") == "leaf").select(*per, "path").distinct()


def sample_keys(nodes: DataFrame, per: Sequence[str]) -> DataFrame:
    """distinct object keys of the documents"""
    key = replace(F.element_at(F.split("path", r"\."), -1), r"(\[\])+$", "")
    return nodes.where(~F.col("path").endswith("[]")).select(*per, key.alias("key")).distinct()


def compare_shape(contract: DataFrame, generated: DataFrame, per: Sequence[str]) -> DataFrame:
    """Contract against generated paths: ok, forma (other kind), falta, sobra."""
    left = contract.select(*per, "path", F.col("kind").alias("expected"))
    right = generated.select(*per, "path", F.col("kind").alias("found"))
    status = (F.when(F.col("found").isNull(), "falta").when(F.col("expected").isNull(), "sobra")
              .when(F.col("expected") != F.col("found"), "forma").otherwise("ok"))
    return left.join(right, [*per, "path"], "full").select(
        *per, "path", status.alias("status"), F.coalesce("expected", "found").alias("kind"), "expected", "found")


def compare_counts(diff: DataFrame, per: Sequence[str]) -> DataFrame:
    n = {s: F.count_if(F.col("status") == s).alias(s) for s in ("ok", "falta", "sobra", "forma")}
    expected = F.col("ok") + F.col("falta") + F.col("forma")
    coverage = F.when(expected > 0, F.floor(F.col("ok") * 100 / expected + 0.5)).otherwise(F.lit(0)).cast("int")
    return diff.groupBy(*per).agg(*n.values()).select("*", coverage.alias("coverage"))


STATUS_ORDER = {"forma": 0, "falta": 1, "sobra": 2, "ok": 3}


def order_diff(diff: DataFrame, per: Sequence[str]) -> DataFrame:
    """the diff in reading order: other shape, missing, superfluous, right; then by path. ``place`` is
    the row's number in that order, so that it outlives the sort"""
    rank = F.create_map(*[F.lit(x) for pair in STATUS_ORDER.items() for x in pair])[F.col("status")]
    placed = ordered_scan(diff, per, [rank, F.col("path")], F.struct(rank.alias("rank"), F.substring("path", 1, 3).alias("head")), number="place")
    return placed.orderBy(*per, "place")


def suggest_path(diff: DataFrame, generated: DataFrame, per: Sequence[str]) -> DataFrame:
    """For each missing path the generated path that shares the longest end of two or
    more segments (the first in path order on ties)."""
    index = generated.select(*per, "path", F.explode(suffixes(F.col("path"))).alias("s"))
    index = index.groupBy(*per, F.col("s.text").alias("suffix")).agg(F.min("path").alias("suggestion"))
    missing = diff.where(F.col("status") == "falta")
    probe = missing.select(*per, "path", F.explode(suffixes(F.col("path"))).alias("s")).select(
        *per, "path", "s.n", F.col("s.text").alias("suffix"))
    best = probe.join(index, [*per, "suffix"]).groupBy(*per, "path").agg(
        F.max_by(F.struct("suggestion", F.col("n").alias("segments")), "n").alias("b"))
    return diff.join(best.select(*per, "path", "b.*"), [*per, "path"], "left")


def path_exists(paths: DataFrame, known: DataFrame, per: Sequence[str]) -> DataFrame:
    """whether a path (any index) can be walked in the known documents"""
    wanted = paths.withColumn("_p", replace(F.col("path"), r"\[\d*\]", "[]"))
    containers = known.select(*per, F.explode(F.array("path", replace(F.col("path"), r"(\[\])+$", ""))).alias("_p")).distinct()
    return wanted.join(containers.withColumn("exists", F.lit(True)), [*per, "_p"], "left").select(
        *paths.columns, F.coalesce("exists", F.lit(False)).alias("exists"))


# ---- paths a form definition writes and reads ---------------------------------------------

def output_paths(fields: DataFrame, per: Sequence[str] = ("form_id",)) -> DataFrame:
    """One row per (path, field) the form writes: main and secondary paths of fields that
    are not excluded, and ``path[0].sub`` of repeater subfields.

    Expects id, type, salida_json, json_output_path, secondary_path, exclude, json_value and
    repeater_subfields (array of ids) columns.
    """
    primary = F.coalesce(F.nullif("salida_json", F.lit("")), F.nullif("json_output_path", F.lit("")))
    subs = F.transform(F.coalesce("repeater_subfields", F.array().cast("array<string>")), lambda s: F.struct(
        F.concat(primary, F.lit("[0]."), s).alias("path"), F.concat("id", F.lit("."), s).alias("field_id"), F.lit(False).alias("secondary")))
    own = F.array(F.struct(primary.alias("path"), F.col("id").alias("field_id"), F.lit(False).alias("secondary")),
                  F.struct(F.nullif("secondary_path", F.lit("")).alias("path"), F.col("id").alias("field_id"), F.lit(True).alias("secondary")))
    excluded = F.coalesce("exclude", F.lit(False))
    entries = F.when(excluded, F.when(primary.isNotNull(), subs).otherwise(F.array().cast(
        "array<struct<path:string,field_id:string,secondary:boolean>>"))).otherwise(F.concat(own, F.when(
            primary.isNotNull(), subs).otherwise(F.array().cast("array<struct<path:string,field_id:string,secondary:boolean>>"))))
    rows = fields.select(*per, "ord", "type", "json_value", F.explode(entries).alias("e"))
    return rows.select(*per, "ord", trim(F.col("e.path")).alias("path"), "e.field_id", "e.secondary", "type", "json_value").where(
        F.col("path") != "")


def path_summary(paths: DataFrame, per: Sequence[str] = ("form_id",)) -> DataFrame:
    """one row per path: number of writers, first writer, whether a secondary path writes it"""
    return paths.groupBy(*per, "path").agg(
        F.count(F.lit(1)).alias("writers"), F.min_by("field_id", F.struct("ord", "field_id")).alias("first_field"),
        F.bool_or("secondary").alias("secondary"), F.count(F.nullif("json_value", F.lit(""))).alias("n_values"))


def no_output(fields: DataFrame) -> DataFrame:
    """fields that write nowhere and are not marked as excluded"""
    primary = F.coalesce(F.nullif("salida_json", F.lit("")), F.nullif("json_output_path", F.lit("")))
    return fields.where(primary.isNull() & ~F.coalesce("exclude", F.lit(False)) & ~F.col("type").isin("header", "paragraph"))


def input_paths(fields: DataFrame, keys: Sequence[str], per: Sequence[str] = ("form_id",)) -> DataFrame:
    """One row per (path, field) the form is prefilled from; ``path==v`` gives a condition."""
    rows = fields.select(*per, "ord", F.col("id").alias("field_id"), F.explode(F.array(*keys)).alias("key"))
    parsed = P.split_prefill_key("key")
    return rows.where(text_or_empty("key") != "").select(*per, "ord", "field_id", parsed.path.alias("path"),
                                                         parsed.condition.alias("condition")).where(F.col("path") != "")


def path_prefix_conflict(paths: DataFrame, repeaters: DataFrame, per: Sequence[str] = ("form_id",)) -> DataFrame:
    """Written paths that contain another written path: (path, type, child).

    Every path is exploded to its containers (a handful per path) and met with the paths by
    an equi-join; the first child in path order is kept. An array below a repeater is fine;
    a child object below one is ``array-y-objeto``.
    """
    written = paths.select(*per, "path").distinct()
    below = written.select(*per, F.col("path").alias("child"), F.explode(ancestors(F.col("path"))).alias("path"))
    rep = repeaters.select(*per, "path", F.lit(True).alias("repeater")).distinct()
    dotted = F.substring("child", F.length("path") + 1, F.lit(1)) == "."
    first = below.withColumn("dotted", dotted).groupBy(*per, "path").agg(
        F.min("child").alias("any_child"), F.min(F.when(F.col("dotted"), F.col("child"))).alias("dot_child"))
    hits = written.join(first, [*per, "path"]).join(rep, [*per, "path"], "left")
    child = F.when(F.col("repeater"), F.col("dot_child")).otherwise(F.col("any_child"))
    kind = F.when(F.col("repeater"), "array-y-objeto").otherwise("contenedor")
    return hits.select(*per, "path", kind.alias("type"), child.alias("child")).where(F.col("child").isNotNull())


def coverage(contract_leaves: DataFrame, written: DataFrame, per: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(missing contract leaves, totals): which contract leaves nobody writes."""
    ours = written.select(*per, replace(F.col("path"), r"\[\d+\]", "[]").alias("path")).distinct().withColumn("hit", F.lit(1))
    marked = contract_leaves.select(*per, "path").distinct().join(ours, [*per, "path"], "left")
    totals = marked.groupBy(*per).agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("covered"),
                                      F.count_if(F.col("hit").isNull()).alias("missing"))
    return marked.where(F.col("hit").isNull()).drop("hit"), totals


def unknown_paths(keys: DataFrame, known: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """Keys that are no known path: exactly, without ``[]`` in any case, or as a last
    segment. Three normalised forms and one anti join, no scan of the path set per key."""
    bare = F.lower(F.replace("path", F.lit("[]"), F.lit("")))
    leaf = F.lower(F.replace(F.element_at(F.split("path", r"\."), -1), F.lit("[]"), F.lit("")))
    index = known.select(*per, F.explode(F.array(F.concat(F.lit("b:"), bare), F.concat(F.lit("l:"), leaf))).alias("form")).where(
        F.col("form") != "l:").distinct()
    tries = F.array(F.concat(F.lit("b:"), F.lower(F.replace("key", F.lit("[]"), F.lit("")))), F.concat(F.lit("l:"), F.lower("key")))
    probe = keys.select(*per, "key").distinct().select(*per, "key", F.explode(tries).alias("form"))
    found = probe.join(index, [*per, "form"], "left_semi").select(*per, "key").distinct()
    return keys.join(found, [*per, "key"], "left_anti")


def route_tree(paths: DataFrame, per: Sequence[str]) -> DataFrame:
    """tree nodes of dotted paths: (path, name, depth, leaf)"""
    parts = F.filter(F.split("path", r"\."), lambda p: p != "")
    rows = paths.select(*per, parts.alias("p")).select(*per, "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"))
    nodes = rows.select(*per, F.array_join(F.slice("p", F.lit(1), F.col("depth")), ".").alias("path"),
                        F.element_at("p", F.col("depth")).alias("name"), "depth", (F.col("depth") == F.size("p")).alias("leaf"))
    return nodes.groupBy(*per, "path", "name", "depth").agg(F.bool_or("leaf").alias("leaf"))


def expand_slots(repeaters: DataFrame, per: Sequence[str] = ("form_id",)) -> DataFrame:
    """names of a slot pattern: {sub} x {i0} (from 0), {i1} and {i} (from 1)"""
    rows = repeaters.select(*per, "pattern", F.explode("subfields").alias("sub"), "max_items").select(
        *per, "pattern", "sub", F.explode(F.sequence(F.lit(0), F.greatest("max_items", F.lit(1)) - 1)).alias("i"))
    name = F.replace("pattern", F.lit("{sub}"), F.col("sub"))
    for mark, shift in (("{i0}", 0), ("{i1}", 1), ("{i}", 1)):
        name = F.replace(name, F.lit(mark), (F.col("i") + shift).cast("string"))
    return rows.select(*per, "sub", "i", name.alias("name"))


# ---- form definitions -------------------------------------------------------------------

_FIELD = ("struct<id:string,label:string,type:string,hidden:boolean,salidaJSON:string,jsonOutputPath:string,"
          "conditionalVisibility:string,sourceMeta:struct<sourceName:string,nativeType:string>,"
          "repeaterConfig:struct<jsonSlotPattern:string,fields:array<struct<id:string,label:string,type:string>>>>")


_ENTRIES = f"array<struct<ord:array<int>,section_path:array<string>,section_id:string,hid:boolean,f:{_FIELD}>>"


def _section_type(levels: int) -> str:
    below = f",subsections:array<{_section_type(levels - 1)}>" if levels > 1 else ""
    return f"struct<id:string,title:string,hidden:boolean,conditionalVisibility:string,fields:array<{_FIELD}>{below}>"


def _entries(sections: Column, trail: Column, up: Column, hid: Column, levels: int) -> Column:
    """the fields below these sections, as one array"""
    none = F.array().cast(_ENTRIES)

    def of(sec: Column, i: Column) -> Column:
        here = F.concat(trail, F.array(i))
        path = F.concat(up, F.array(F.coalesce(sec["title"], sec["id"])))
        never = F.coalesce(sec["conditionalVisibility"].contains("NEVER_EXISTS"), F.lit(False))
        off = hid | F.coalesce(sec["hidden"], F.lit(False)) | never
        own = F.transform(sec["fields"], lambda f, k: F.struct(
            F.concat(here, F.array(F.lit(-1), k)).alias("ord"), path.alias("section_path"), sec["id"].alias("section_id"), off.alias("hid"), f.alias("f")))
        own = F.coalesce(own, none)
        return own if levels == 1 else F.concat(own, _entries(sec["subsections"], here, path, off, levels - 1))

    return F.coalesce(F.flatten(F.transform(sections, of)), none)


def flatten_formdef(defs: DataFrame, ids: Sequence[str], body: str) -> DataFrame:
    """Fields of nested form definitions, in reading order.

    Accepts the three root shapes and as many levels of sections as a definition may have. A document
    is parsed once into one array of fields, which is exploded once. Subfields of repeaters follow
    their field. A hidden section (or one whose condition can never hold) hides everything below it.
    """
    one = _section_type(SECTION_LEVELS)
    schema = (f"struct<sections:array<{one}>,jsonDefinition:struct<sections:array<{one}>>,"
              f"data:struct<jsonDefinition:struct<sections:array<{one}>>>>")
    parsed = F.from_json(F.col(body), schema)
    sections = F.coalesce(parsed.sections, parsed.data.jsonDefinition.sections, parsed.jsonDefinition.sections)
    entries = _entries(F.col("_sections"), F.array().cast("array<int>"), F.array().cast("array<string>"), F.lit(False), SECTION_LEVELS)
    fields = spread(defs.select(*ids, body)).select(*ids, sections.alias("_sections")).select(*ids, F.explode(entries).alias("_e")).select(*ids, "_e.*")
    none = F.lit(None).cast("string")
    own = F.array(F.struct(F.col("ord").alias("ord"), F.col("section_path").alias("section_path"), none.alias("in_repeater"),
                           (F.col("hid") | F.coalesce("f.hidden", F.lit(False))).alias("hidden_effective"), F.col("f.id").alias("id"), F.col("f.label").alias("label"), F.col("f.type").alias("type"),
                           F.col("f.salidaJSON").alias("salidaJSON"), F.col("f.jsonOutputPath").alias("jsonOutputPath"), F.col("f.sourceMeta.sourceName").alias("source_name")))
    subs = F.transform("f.repeaterConfig.fields", lambda s, k: F.struct(
        F.concat("ord", F.array(k)).alias("ord"), F.concat("section_path", F.array(F.coalesce("f.label", "f.id"))).alias("section_path"), F.col("f.id").alias("in_repeater"),
        F.col("hid").alias("hidden_effective"), s["id"].alias("id"), s["label"].alias("label"), s["type"].alias("type"), none.alias("salidaJSON"), none.alias("jsonOutputPath"), none.alias("source_name")))
    rows = fields.select(*ids, "section_id", F.explode(F.when(subs.isNull(), own).otherwise(F.concat(own, subs))).alias("_r"))
    return rows.select(*ids, "_r.ord", "_r.section_path", "section_id", "_r.in_repeater", "_r.hidden_effective", "_r.id", "_r.label", "_r.type", "_r.salidaJSON", "_r.jsonOutputPath", "_r.source_name")


def field_refs(fields: DataFrame, per: Sequence[str] = ("form_id",)) -> DataFrame:
    """edges (id, ref): conditions, concatenation sources and parts, radio siblings, parents.

    Expects condition_visibility, condition_required, concat (JSON texts), radio_fields
    (JSON array text), parent_id and grandparent_id.
    """
    ids = [condition_ids(F.col(c)) for c in ("condition_visibility", "condition_required")]
    concat = parse_concat(F.col("concat"))
    none = F.array().cast("array<string>")
    ids += [F.coalesce(concat.sourceFieldIds, none),
            F.coalesce(F.transform(concat.parts, lambda p: p.fieldId), none),
            F.coalesce(F.transform(concat.parts, lambda p: p.condition.fieldId), none),
            F.coalesce(F.from_json("radio_fields", "array<string>"), none),
            F.array("parent_id", "grandparent_id")]
    refs = F.array_distinct(F.filter(F.flatten(F.array(*ids)), lambda x: x.isNotNull() & (x != "")))
    return fields.select(*per, "id", F.explode(refs).alias("ref"))


_CONDITIONS = "struct<logic:string,conditions:array<struct<fieldId:string,operator:string,value:string>>>"
_CONCAT = ("struct<sourceFieldIds:array<string>,parts:array<struct<kind:string,type:string,fieldId:string,"
           "condition:struct<fieldId:string,op:string,values:string>,"
           "transforms:array<struct<kind:string,start:int,end:int>>>>>")


def conditions_of(c: Column) -> Column:
    return F.coalesce(F.from_json(c, _CONDITIONS).conditions,
                      F.array().cast("array<struct<fieldId:string,operator:string,value:string>>"))


def condition_ids(c: Column) -> Column:
    return F.transform(conditions_of(c), lambda x: x.fieldId)


def parse_concat(c: Column) -> Column:
    return F.from_json(c, _CONCAT)


# ---- sample documents -----------------------------------------------------------------------

def _steps(path: Column) -> Column:
    """A path as steps into containers: a key of an object, or an index of an array (an open
    index is 0). Steps compare in document order."""
    def of(seg: Column) -> Column:
        key = F.when(seg["key"].isNotNull(), F.struct(F.lit("k").alias("kind"), seg["key"].alias("key"), F.lit(0).alias("at")))
        index = F.when(seg["index"].isNotNull(), F.struct(F.lit("i").alias("kind"), F.lit("").alias("key"), F.greatest(seg["index"], F.lit(0)).alias("at")))
        return F.array_compact(F.array(key, index))
    return F.flatten(F.transform(P.parse_path(path), of))


def sample_tree_lines(samples: DataFrame, keys: Sequence[str] = ("form_id",)) -> DataFrame:
    """The sample document of a form as lines in document order: (keys, steps, text).

    ``samples`` are (keys, path, value), one row per written path, without container
    conflicts. Each line closes what the line before left open, opens what its own path needs
    and writes its value; holes of arrays are null. A line only looks at the one before it, so
    the document is never gathered.
    """
    rows = samples.select(*keys, _steps(F.col("path")).alias("steps"), "value").where(F.size("steps") > 0)
    rows = rows.groupBy(*keys, "steps").agg(F.min("value").alias("value"))
    seen = ordered_scan(rows, keys, [F.col("steps")], F.slice("steps", 1, 3), previous={"_prev": F.col("steps")})
    joined = seen.withColumn("_same", F.when(F.col("_prev").isNull(), F.lit(0)).otherwise(F.aggregate(
        F.sequence(F.lit(0), F.least(F.size("steps"), F.size("_prev")) - 1), F.lit(0),
        lambda n, i: F.when((n == i) & (F.get("steps", i) == F.get("_prev", i)), n + 1).otherwise(n))))
    same = F.col("_same")

    def closers(steps: Column, down_to: Column) -> Column:
        """ends of the containers entered by the steps after ``down_to``, innermost first"""
        inner = F.slice(steps, down_to + 1, F.greatest(F.size(steps) - down_to, F.lit(0)))
        return F.array_join(F.reverse(F.transform(inner, lambda s: F.when(s["kind"] == "k", F.lit("}")).otherwise(F.lit("]")))), "")

    def label(step: Column, holes: Column) -> Column:
        quoted = F.regexp_replace(F.to_json(F.array(step["key"])), r"^\[|\]$", "")
        return F.when(step["kind"] == "k", F.concat(quoted, F.lit(":"))).otherwise(F.repeat(F.lit("null,"), holes))

    first = F.get("steps", same)
    holes = F.when(F.col("_prev").isNull(), first["at"]).otherwise(first["at"] - F.get("_prev", same)["at"] - 1)
    deeper = F.slice("steps", same + 2, F.greatest(F.size("steps") - same - 1, F.lit(0)))
    opened = F.array_join(F.transform(deeper, lambda s: F.concat(
        F.when(s["kind"] == "k", F.lit("{")).otherwise(F.lit("[")), label(s, s["at"]))), "")
    value = F.regexp_replace(F.to_json(F.array("value"), {"ignoreNullFields": "false"}), r"^\[|\]$", "")
    start = F.when(F.col("_prev").isNull(), F.lit("{")).otherwise(F.concat(closers(F.col("_prev"), same + 1), F.lit(",")))
    lines = joined.select(*keys, F.lit(0).alias("part"), "steps", F.concat(start, label(first, F.greatest(holes, F.lit(0))), opened, value).alias("text"))
    ends = rows.groupBy(*keys).agg(F.max("steps").alias("steps"))
    return lines.unionAll(ends.select(*keys, F.lit(1), "steps", closers(F.col("steps"), F.lit(0))))
