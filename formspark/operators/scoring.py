"""Reuse between files, effort scores, file roles and documents of a delivery."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formspark import constants as K
from formspark.functions import text as T
from formspark.session import cut_lineage
from formspark.functions.classify import half_up


def tenth(c: Column) -> Column:
    """rounded half up to one decimal"""
    return half_up(c * 10) / 10


def reuse(names: DataFrame) -> DataFrame:
    """Per file: distinct names, how many a larger file already had, how many are its own.

    names: project, file, file_ord, size, name (repeats allowed; larger ``size`` comes first,
    then ``file_ord``). A name is shared unless this file is the first to have it; the first
    file of a name is a partial aggregate, so a name every file has costs one row per file.
    """
    rank = F.struct((-F.col("size")).alias("s"), F.col("file_ord").alias("o"))
    distinct = names.select("project", "file", rank.alias("rank"), "name").distinct()
    first = distinct.groupBy("project", "name").agg(F.min("rank").alias("first"))
    marked = distinct.join(first, ["project", "name"])
    return marked.groupBy("project", "file", "rank").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("first") < F.col("rank")).alias("shared")).withColumn("own", F.col("total") - F.col("shared"))


def reuse_pairs(per_file: DataFrame) -> DataFrame:
    """every file but the largest, next to the largest of its project"""
    top = per_file.groupBy("project").agg(F.min_by("file", "rank").alias("against"), F.min("rank").alias("_top"))
    percent = half_up(F.col("shared") * 100 / F.greatest("total", F.lit(1))).cast("int")
    return per_file.join(top, "project").where(F.col("rank") > F.col("_top")).select("project", "file", "against", "shared", "own", percent.alias("percent"))


def reuse_totals(pdf: DataFrame, excel: DataFrame) -> DataFrame:
    """per project: totals of both kinds of files and the share of what is reused"""
    def totals(df: DataFrame, kind: str) -> DataFrame:
        return df.groupBy("project").agg(*[F.sum(c).alias(f"{kind}_{c}") for c in ("total", "shared", "own")])
    out = totals(pdf, "pdf").join(totals(excel, "excel"), "project", "full").na.fill(0)
    everything = F.col("pdf_total") + F.col("excel_total")
    shared = F.col("pdf_shared") + F.col("excel_shared")
    return out.withColumn("percent", F.when(everything > 0, half_up(shared * 100 / everything)).otherwise(0).cast("int"))


def project_totals(pdfs: DataFrame, excels: DataFrame, definitions: DataFrame) -> DataFrame:
    """Sums over the files of a project. What a form definition shows counts where it is more.

    pdfs: project, field_count, pages, repeater_groups, unique_configs; excels: project,
    business_rules, conditional_rules, catalogs, catalog_refs, catalog_items; definitions:
    project, fields, repeaters, lookups, conditionals, rules
    """
    p = pdfs.groupBy("project").agg(F.count(F.lit(1)).alias("pdfs"), F.sum("field_count").alias("pdf_fields"), F.sum("pages").alias("pages"),
                                    F.sum("repeater_groups").alias("repeaters"), F.sum("unique_configs").alias("unique_configs"))
    e = excels.groupBy("project").agg(F.count(F.lit(1)).alias("excels"), F.sum("business_rules").alias("business_rules"), F.sum("conditional_rules").alias("conditional_rules"),
                                      F.sum(F.col("catalogs") + F.col("catalog_refs")).alias("catalogs"), F.sum("catalog_items").alias("catalog_items"))
    d = definitions.groupBy("project").agg(F.max(F.col("repeaters") + F.col("lookups")).alias("_r"), F.max("conditionals").alias("_c"), F.max("rules").alias("_b"), F.max("fields").alias("_f"))
    out = p.join(e, "project", "full").join(d, "project", "full").na.fill(0)
    for name, other in (("repeaters", "_r"), ("conditional_rules", "_c"), ("business_rules", "_b"), ("pdf_fields", "_f")):
        out = out.withColumn(name, F.greatest(name, other))
    return out.withColumn("extra_forms", F.greatest(F.col("pdfs") - 1, F.lit(0))).drop("_r", "_c", "_b", "_f")


def breakdown(totals: DataFrame, weights: Mapping[str, float] = K.SCORE_WEIGHTS, reuse_factor: float = K.REUSE_FACTOR) -> DataFrame:
    """ten weighted lines per project: (project, line, label, count, points)

    totals as of project_totals with repeated_fields and repeated_rules (what is reused)
    """
    w = weights
    fields = F.least("repeated_fields", "pdf_fields")
    rules = F.least("repeated_rules", "business_rules")
    lines = [
        ("Campos del PDF (nuevos)", F.col("pdf_fields") - fields, w["pdf_field"]), ("Campos repetidos", fields, w["pdf_field"] * reuse_factor),
        ("Páginas", F.col("pages"), w["pdf_page"]), ("Reglas de negocio (nuevas)", F.col("business_rules") - rules, w["business_rule"]),
        ("Reglas repetidas", rules, w["business_rule"] * reuse_factor), ("Visibilidad condicional", F.col("conditional_rules"), w["conditional_rule"]),
        ("Bloques repetidos", F.col("repeaters"), w["repeater"]), ("Catálogos", F.col("catalogs"), w["catalog"]),
        ("Ítems de catálogo", F.col("catalog_items"), w["catalog_item"]), ("Formularios extra", F.col("extra_forms"), w["extra_form"]),
    ]
    entries = F.array(*[F.struct(F.lit(i + 1).alias("line"), F.lit(label).alias("label"), n.cast("double").alias("count"), tenth(n * F.lit(float(weight))).alias("points"))
                        for i, (label, n, weight) in enumerate(lines)])
    return totals.select("project", F.explode(entries).alias("e")).select("project", "e.*")


def level(points: Column, thresholds: Mapping[str, float] = K.SCORE_THRESHOLDS) -> Column:
    return F.when(points <= thresholds["baja"], F.lit("baja")).when(points <= thresholds["media"], F.lit("media")).otherwise(F.lit("alta"))


def weeks(level_: Column, by_level: Mapping[str, int] = K.SCORE_WEEKS) -> Column:
    return F.coalesce(*[F.when(level_ == k, F.lit(v)) for k, v in by_level.items()])


def score(totals: DataFrame, weights: Mapping[str, float] = K.SCORE_WEIGHTS, thresholds: Mapping[str, float] = K.SCORE_THRESHOLDS,
          reuse_factor: float = K.REUSE_FACTOR, hours_per_point: float = K.HOURS_PER_POINT) -> DataFrame:
    """points, level, weeks, hours and the points saved by reuse, per project"""
    points = breakdown(totals, weights, reuse_factor).groupBy("project").agg(tenth(F.sum("points")).alias("points"))
    fields = F.least("repeated_fields", "pdf_fields")
    rules = F.least("repeated_rules", "business_rules")
    saved = tenth(fields * F.lit(weights["pdf_field"] * (1 - reuse_factor)) + rules * F.lit(weights["business_rule"] * (1 - reuse_factor)))
    out = totals.select("project", saved.alias("saved_points")).join(points, "project").withColumn("level", level(F.col("points"), thresholds))
    hours = F.col("points") * hours_per_point
    return out.withColumn("weeks", weeks(F.col("level"))).withColumn("hours_min", half_up(hours * 0.8)).withColumn("hours_max", half_up(hours * 1.3))


def calibrate(points: Column, target: Column, baja: Column, media: Column) -> Column:
    """(baja, media) cuts that put a case of these points into the target level"""
    def cut(c: Column) -> Column:
        return F.greatest(F.lit(10.0), (half_up(c / 10) * 10).cast("double"))
    t = T.strip_accents(F.lower(T.text_or_empty(target)))
    low, high = cut(points * 1.3), cut(points * 0.8)
    easy = F.struct(low.alias("baja"), F.when(media <= low, cut(low * 3)).otherwise(media).alias("media"))
    hard = F.struct(F.when(baja >= high, cut(high * 0.35)).otherwise(baja).alias("baja"), high.alias("media"))
    middle = F.struct(cut(points * 0.55).alias("baja"), cut(points * 1.45).alias("media"))
    return F.when(t.startswith("baja") | t.startswith("facil"), easy).when(t.startswith("alta") | t.startswith("complej"), hard).otherwise(middle)


def classify_files(pdfs: DataFrame, excels: DataFrame, jsons: DataFrame, scores: DataFrame, weights: Mapping[str, float] = K.SCORE_WEIGHTS) -> DataFrame:
    """role, points, level and share of every file of a project

    pdfs and excels as for project_totals, with file and file_ord; jsons: project, file,
    is_definition; scores: project, points
    """
    w = weights
    main = pdfs.groupBy("project").agg(F.count(F.lit(1)).alias("_n"), F.max_by("file", F.struct("field_count", -F.col("file_ord"))).alias("_main"))
    p = pdfs.join(main, "project")
    p = p.select("project", "file", F.lit("pdf").alias("kind"),
                 F.when(F.col("_n") == 1, F.lit("Formulario")).when(F.col("file") == F.col("_main"), F.lit("Formulario principal")).otherwise(F.lit("Variante / anexo")).alias("role"),
                 tenth(F.col("field_count") * w["pdf_field"] + F.col("pages") * w["pdf_page"] + F.col("repeater_groups") * w["repeater"]).alias("points"))
    cats = F.col("catalogs") + F.col("catalog_refs")
    only = (F.col("business_rules") == 0) & (F.col("conditional_rules") == 0) & (cats > 0)
    e = excels.select("project", "file", F.lit("excel").alias("kind"), F.when(only, F.lit("Catálogos / datos")).otherwise(F.lit("Ficha de reglas")).alias("role"),
                      tenth(F.col("business_rules") * w["business_rule"] + F.col("conditional_rules") * w["conditional_rule"] + cats * w["catalog"]
                            + F.col("catalog_items") * w["catalog_item"]).alias("points"))
    j = jsons.select("project", "file", F.lit("json").alias("kind"), F.when(F.col("is_definition"), F.lit("Definición ya construida")).otherwise(F.lit("Datos / ejemplo")).alias("role"),
                     F.lit(0.0).alias("points"))
    out = p.unionByName(e).unionByName(j).join(scores.select("project", F.col("points").alias("_total")), "project", "left")
    is_json = F.col("kind") == "json"
    share = F.when(~is_json & (F.coalesce("_total", F.lit(0.0)) > 0), half_up(F.col("points") * 100 / F.col("_total"))).otherwise(0)
    return out.select("project", "file", "kind", "role", "points", F.when(is_json, F.lit("info")).otherwise(level(F.col("points"))).alias("level"), share.cast("int").alias("share"))


def top_files(files: DataFrame, k: int = 5) -> DataFrame:
    """the k files of most points per project, with a bar of 3 to 100 percent: the file's share of
    all points. Files without points are left out.

    The limit is the report; Spark limits each partition before the rows are moved.
    """
    from pyspark.sql import Window
    order = Window.partitionBy("project").orderBy(F.desc("points"), "file")
    top = files.where("points > 0").select("*", F.row_number().over(order).alias("place")).where(F.col("place") <= k)
    return top.withColumn("bar", F.greatest(F.lit(3), F.least(F.lit(100), "share")))


def affinity_candidates(excels: DataFrame, pdfs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words of every spreadsheet and PDF that may be each other's best, pairs): (project, excel, own, pdf, pdf_ord).

    A spreadsheet's words are looked up by rarity among the PDFs of its project. Its rarest one says how
    many shared words are there to be had; further words lead to more PDFs only while all words that are
    left could still make up as many. Of the commonest word no list is needed at all: a PDF that shares
    nothing else counts that word alone, and of those the first one is the best.
    """
    spread = excels.select("project", F.col("file").alias("excel"), F.explode(T.name_words("file")).alias("word"))
    counted = spread.groupBy("project", "excel", "word").agg(F.count(F.lit(1)).alias("n"))
    names = cut_lineage(pdfs.select("project", F.col("file").alias("pdf"), F.col("file_ord").alias("pdf_ord"), F.array_distinct(T.name_words("file")).alias("words")).distinct())
    lists = names.select("project", "pdf", "pdf_ord", F.explode("words").alias("word"))
    often = lists.groupBy("project", "word").agg(F.count(F.lit(1)).alias("often"), F.min(F.struct("pdf_ord", "pdf")).alias("first"))
    own = counted.join(often, ["project", "word"]).groupBy("project", "excel").agg(F.array_sort(F.collect_list(F.struct("often", "word", "n", "first"))).alias("own"))
    own = cut_lineage(own)
    last, rarer = F.element_at("own", -1), F.slice("own", F.lit(1), F.size("own") - 1)
    alone = own.select("project", "excel", last["first"]["pdf_ord"].alias("pdf_ord"), last["first"]["pdf"].alias("pdf"))

    def met(words: DataFrame) -> DataFrame:
        return words.join(lists, ["project", "word"]).select("project", "excel", "pdf_ord", "pdf").distinct()

    rarest = own.where(F.size("own") > 1).select("project", "excel", F.col("own")[0]["word"].alias("word"))
    first = cut_lineage(met(rarest).unionByName(alone).distinct())
    known = _affinities(first, own, names).groupBy("project", "excel").agg(F.max("affinity").alias("known"))
    # a word and those after it, by rarity: what a PDF without the words before may share at most
    left = F.transform(rarer, lambda w, i: F.struct(w["word"].alias("word"), F.aggregate(F.slice("own", i + 1, F.size("own")), F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("most")))
    further = own.join(known, ["project", "excel"]).select("project", "excel", "known", F.explode(F.slice(left, F.lit(2), F.size("own"))).alias("w")).where(F.col("w.most") >= F.col("known"))
    return own, first.unionByName(met(further.select("project", "excel", "w.word"))).distinct()


def _affinities(pairs: DataFrame, own: DataFrame, names: DataFrame) -> DataFrame:
    shared = F.aggregate(F.filter("own", lambda w: F.array_contains("words", w["word"])), F.lit(0).cast("long"), lambda n, w: n + w["n"])
    return pairs.join(own, ["project", "excel"]).join(names, ["project", "pdf", "pdf_ord"]).withColumn("affinity", shared)


def name_affinity_best(excels: DataFrame, pdfs: DataFrame) -> DataFrame:
    """PDF of a spreadsheet: the most words shared by their file names, the first PDF on ties.

    A repeated word of the spreadsheet's name counts each time, one of the PDF's name once.
    """
    own, pairs = affinity_candidates(excels, pdfs)
    names = pdfs.select("project", F.col("file").alias("pdf"), F.col("file_ord").alias("pdf_ord"), F.array_distinct(T.name_words("file")).alias("words")).distinct()
    hits = _affinities(pairs, own, names)
    return hits.groupBy("project", "excel").agg(F.max_by(F.struct("pdf", "affinity"), F.struct("affinity", -F.col("pdf_ord"))).alias("b")).select(
        "project", "excel", "b.pdf", "b.affinity")


def documents(pdfs: DataFrame, excels: DataFrame, weights: Mapping[str, float] = K.SCORE_WEIGHTS) -> DataFrame:
    """Score of every PDF with the rules of its spreadsheets: those that name it, and its
    share (by fields) of those that name none.

    The unassigned rules are summed per project before they are shared out, so spreadsheets
    and PDFs are never paired.
    """
    w = weights
    counts = ["business_rules", "conditional_rules", "catalogs"]
    x = excels.select("project", F.col("file").alias("excel"), "business_rules", "conditional_rules", (F.col("catalogs") + F.col("catalog_refs")).alias("catalogs"))
    sizes = pdfs.groupBy("project").agg(F.count(F.lit(1)).alias("_n"), F.sum("field_count").alias("_all"))
    best = name_affinity_best(excels, pdfs)
    placed = x.join(best, ["project", "excel"], "left").join(sizes, "project")
    named = F.col("pdf").isNotNull() & (F.col("_n") > 1)
    own = placed.where(named).groupBy("project", F.col("pdf").alias("file")).agg(*[F.sum(c).alias(f"_o_{c}") for c in counts], F.count(F.lit(1)).alias("_own"))
    spare = placed.where(~named).groupBy("project").agg(*[F.sum(c).alias(f"_s_{c}") for c in counts], F.count(F.lit(1)).alias("_spare"))
    out = pdfs.join(sizes, "project").join(own, ["project", "file"], "left").join(spare, "project", "left").na.fill(0)
    share = F.col("field_count") / F.when(F.col("_all") == 0, F.lit(1)).otherwise(F.col("_all"))
    for c in counts:
        out = out.withColumn(c, half_up(F.col(f"_o_{c}") + F.col(f"_s_{c}") * share))
    points = tenth(F.col("field_count") * w["pdf_field"] + F.col("pages") * w["pdf_page"] + F.col("repeater_groups") * w["repeater"]
                   + F.col("business_rules") * w["business_rule"] + F.col("conditional_rules") * w["conditional_rule"] + F.col("catalogs") * w["catalog"])
    out = out.withColumn("points", points).withColumn("level", level(F.col("points")))
    return out.select("project", "file", F.col("field_count").alias("fields"), "pages", *counts, (F.col("_own") + F.col("_spare")).alias("sources"),
                      "points", "level", weeks(F.col("level")).alias("weeks"))
