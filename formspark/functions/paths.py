"""Expressions over output paths, field names and dates inside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formspark import constants as K
from formspark.functions.classify import extract, lookup
from formspark.functions.text import camel_to_snake, col, norm_words, or_else, replace, text_or_empty, trim

_PERSON = r"(?<![A-Za-z0-9_])personas(?![A-Za-z0-9_])(?!\s*\[)"


def _pieces(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text_or_empty(c), pattern), trim), lambda s: s != "")


def split_paths(c: Column | str, by: str = "lines_or_commas") -> Column:
    """(main, secondary) of a cell that lists several paths"""
    pattern = {"lines_or_commas": "[,\n]+", "commas": "[,;]", "lines": "\n"}[by]
    parts = _pieces(col(c), pattern)
    main = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    return F.struct(main.alias("main"), F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))).alias("secondary"))


def first_path(c: Column | str) -> Column:
    """text before the first comma, semicolon, slash or " y "; NULL when blank"""
    return F.nullif(trim(F.split(trim(text_or_empty(c)), r"(?i)[,;/]|\s+y\s+")[0]), F.lit(""))


def last_segment(c: Column | str) -> Column:
    return F.element_at(F.split(text_or_empty(c), r"\."), -1)


def route_leaf(c: Column | str) -> Column:
    return replace(last_segment(c), r"\[\]$", "")


def json_leaf(c: Column | str) -> Column:
    """words of the last segment of the first path"""
    leaf = last_segment(trim(F.split(text_or_empty(c), ",")[0]))
    return norm_words(replace(leaf, "([A-Z])", " $1"))


def derive_name(c: Column | str) -> Column:
    """snake name of the last segment; NULL for a blank path"""
    return F.nullif(camel_to_snake(last_segment(trim(F.split(text_or_empty(c), "[,\n]")[0]))), F.lit(""))


def derive_widget_name(path: Column | str, fallback: Column | str) -> Column:
    """snake name of the last two segments of a long path, of the last of a short one, or of the fallback"""
    first = trim(F.split(text_or_empty(path), "\n")[0])
    parts = F.split(first, r"\.")
    name = (F.when(F.size(parts) >= 3, F.concat_ws("_", F.element_at(parts, -2), F.element_at(parts, -1)))
            .otherwise(F.element_at(parts, -1)))
    return camel_to_snake(F.when(text_or_empty(path) == "", text_or_empty(fallback)).otherwise(name), "border")


def index_path(path: Column | str, prefix: Column | str) -> Column:
    """(path, warning): a bare ``personas`` token gets the index of its section"""
    p = trim(text_or_empty(path))
    index = lookup({k: str(v) for k, v in K.PERSON_INDEX.items()}, col(prefix))
    bare = p.rlike(_PERSON)
    indexed = F.regexp_replace(p, F.lit(_PERSON), F.concat(F.lit("personas["), index, F.lit("]")))
    return F.struct(F.when(bare & index.isNotNull(), indexed).otherwise(p).alias("path"),
                    (bare & index.isNull()).alias("warning"))


def index_paths(main: Column, secondary: Column, prefix: Column) -> Column:
    """(main, secondary, warning) with every path of a ``|`` list indexed"""
    head = index_path(main, prefix)
    rest = F.transform(_pieces(secondary, r"\|"), lambda p: index_path(p, prefix))
    return F.struct(head.path.alias("main"), F.array_join(F.transform(rest, lambda r: r.path), " | ").alias("secondary"),
                    (head.warning | F.exists(rest, lambda r: r.warning)).alias("warning"))


def correct_path(c: Column | str) -> Column:
    """known misspellings, the first occurrence of each, in order"""
    out = col(c)
    for wrong, right in K.PATH_CORRECTIONS:
        at = F.instr(out, wrong)
        out = F.when(at > 0, F.overlay(out, F.lit(right), at, F.lit(len(wrong)))).otherwise(out)
    return out


def strip_index(c: Column | str) -> Column:
    return replace(col(c), r"\[\d+\]$", "")


def index_of(c: Column | str) -> Column:
    return extract(col(c), r"\[(\d+)\]$").try_cast("int")


def option_suffix(c: Column | str) -> Column:
    """the option a name ends with, NULL when none (or nothing would remain)"""
    c = col(c)
    return F.coalesce(*[F.when(c.rlike(f"^.+?_?{s}$") & (F.length(replace(c, f"_?{s}$", "")) > 0), F.lit(s))
                        for s in K.OPTION_SUFFIXES])


def strip_option(c: Column | str) -> Column:
    c = col(c)
    out = None
    for s in K.OPTION_SUFFIXES:
        base = replace(c, f"_?{s}$", "")
        test = c.rlike(f"_?{s}$") & (F.length(base) > 0)
        out = F.when(test, base) if out is None else out.when(test, base)
    return out.otherwise(c)


def row_number_of(c: Column | str) -> Column:
    c = text_or_empty(c)
    return F.coalesce(extract(c, r"(?i)Row\s*(\d+)"), extract(c, r"\.(\d+)\.\d+$")).try_cast("int")


def name_variants(c: Column | str) -> Column:
    """the name, then the name with up to three numeric suffixes taken off"""
    steps = [text_or_empty(c)]
    for _ in range(3):
        steps.append(replace(steps[-1], r"_\d+$", ""))
    return F.array_distinct(F.array(*steps))


def repeat_index(c: Column | str) -> Column:
    return extract(text_or_empty(c), r"_(\d+)$").try_cast("int")


def split_prefill_key(c: Column | str) -> Column:
    """(path, condition) of "path==value" or "path!=value\""""
    rx = r"^(.*?)(==|!=)(.*)$"
    s = trim(text_or_empty(c))
    hit = s.rlike(rx)
    return F.struct(F.when(hit, trim(F.regexp_extract(s, rx, 1))).otherwise(s).alias("path"),
                    F.when(hit, F.concat(F.regexp_extract(s, rx, 2), trim(F.regexp_extract(s, rx, 3)))).alias("condition"))


def parse_path(c: Column | str) -> Column:
    """array of (key, index): "a[0].b[]" is (a,0), (b,-1); a chained index has no key;
    no index is NULL"""
    rx = r"^([^\[\]]+)((?:\[\d*\])+)$"

    def segment(p: Column) -> Column:
        plain = F.array(F.struct(p.alias("key"), F.lit(None).cast("int").alias("index")))
        key = F.regexp_extract(p, rx, 1)
        marks = F.regexp_extract_all(F.regexp_extract(p, rx, 2), F.lit(r"\[(\d*)\]"), 1)
        indexed = F.transform(marks, lambda m, i: F.struct(
            F.when(i == 0, key).alias("key"), F.coalesce(m.try_cast("int"), F.lit(-1)).alias("index")))
        return F.when(p.rlike(rx), indexed).otherwise(plain)

    parts = F.filter(F.split(trim(text_or_empty(c)), r"\."), lambda p: p != "")
    return F.flatten(F.transform(parts, segment))


def normal_path(c: Column | str) -> Column:
    """every index as ``[]``"""
    return replace(col(c), r"\[\d*\]", "[]")


# ---- what a field emits --------------------------------------------------------------------

def emitted_type(type_: Column, select_value_type: Column, json_value: Column) -> Column:
    return (F.when(type_ == "boolean", F.lit("boolean")).when(type_ == "number", F.lit("number"))
            .when(type_ == "date", F.lit("string (fecha)"))
            .when((type_ == "select") & (select_value_type == "number"), F.lit("number"))
            .when(type_.isin("radio", "checkbox") & json_value.isNull(), F.lit("boolean (solo true)")).otherwise(F.lit("string")))


def value_origin(has_concat: Column, default: Column, prefill_key: Column) -> Column:
    return (F.when(has_concat, F.lit("concat")).when(text_or_empty(default) != "", F.lit("default"))
            .when(text_or_empty(prefill_key) != "", F.lit("prefill")).otherwise(F.lit("usuario")))


def output_path(excluded: Column, json_output_path: Column, output: Column) -> Column:
    """effective path; '' in the first column hides the second, as only NULL is skipped"""
    return F.when(~F.coalesce(excluded, F.lit(False)), F.nullif(F.coalesce(json_output_path, output), F.lit("")))


def sample_value(type_: Column, values: Column, options: Column, date_format: Column) -> Column:
    """placeholder of a field: its only value, up to six values, or its type"""
    t = F.lower(or_else(type_, F.lit("text")))
    distinct = F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))
    opts = F.filter(options, lambda v: v.isNotNull() & (v != ""))

    def listed(xs: Column) -> Column:
        more = F.when(F.size(xs) > 6, F.lit(" | …")).otherwise(F.lit(""))
        return F.concat(F.lit("<"), t, F.lit(": "), F.array_join(F.slice(xs, 1, 6), " | "), more, F.lit(">"))

    return (F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0))).when(F.size(distinct) > 1, listed(distinct))
            .when(t == "checkbox", F.lit("<boolean>"))
            .when(t == "date", F.concat(F.lit("<date "), or_else(date_format, F.lit("dd/MM/yyyy")), F.lit(">")))
            .when(t.isin("number", "signature"), F.concat(F.lit("<"), t, F.lit(">")))
            .when(t.isin("select", "radio") & (F.size(opts) > 0), listed(opts))
            .otherwise(F.concat(F.lit("<"), t, F.lit(">"))))


def date_slice_check(part: Column, fmt: Column, start: Column, end: Column) -> Column:
    """(ok, expected_start, expected_end, got, expected) of cutting a date text of format
    ``fmt`` from ``start`` to ``end`` to get the day, month or year"""
    year = F.when(F.instr(fmt, "YYYY") > 0, F.instr(fmt, "YYYY")).otherwise(F.instr(fmt, "AAAA"))
    at = F.when(part == "dia", F.instr(fmt, "DD")).when(part == "mes", F.instr(fmt, "MM")).when(part == "anio", year)
    size = F.when(part == "anio", F.lit(4)).otherwise(F.lit(2))
    first = at - 1
    sample = F.regexp_replace(fmt, "YYYY|AAAA", "2026")
    for mark, value in (("DD", "28"), ("MM", "09")):
        where = F.instr(sample, mark)
        sample = F.when(where > 0, F.overlay(sample, F.lit(value), where, F.lit(2))).otherwise(sample)
    ok = (at <= 0) | ((start == first) & (end == first + size))
    return F.struct(ok.alias("ok"), F.when(at > 0, first).alias("expected_start"),
                    F.when(at > 0, first + size).alias("expected_end"),
                    F.substring(sample, start + 1, F.greatest(end - start, F.lit(0))).alias("got"),
                    F.when(at > 0, F.substring(sample, first + 1, size)).alias("expected"))


def date_part_of_id(c: Column | str) -> Column:
    s = F.lower(text_or_empty(c))
    return F.when(s.rlike("_dia$"), F.lit("dia")).when(s.rlike("_mes$"), F.lit("mes")).when(s.rlike("_(anio|ano|año)$"), F.lit("anio"))
