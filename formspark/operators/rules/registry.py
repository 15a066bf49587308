"""Rule registry. A finding is one row (form_id, rule, severity, field_id, subject, path).

A rule that speaks about several fields gives one row per field, so nothing is gathered in
a single value however many fields share a path or an id.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formspark.kernels import ordered_scan
from formspark.session import cut_lineage

Rule = Callable[["Model"], DataFrame]
RowRule = Callable[[], Column]
RULES: dict[str, Rule] = {}
ROW_RULES: dict[str, RowRule] = {}
READABLE: dict[str, RowRule] = {}

# Severity and title of each rule.
SEVERITY = {"error": 0, "aviso": 1, "nota": 2}
TITLES = {
    "R00": ("aviso", "Una regla falló y no se evaluó"),
    "R01": ("error", "El id no coincide con su sourceName"),
    "R02": ("error", "id duplicado"),
    "R03": ("error", "Condición apuntando a un campo inexistente"),
    "R04": ("nota", "salidaJSON y jsonOutputPath no coinciden"),
    "R05": ("error", "Repeater con jsonOutputPath"),
    "R06": ("error", "Repeater sin jsonSlotPattern"),
    "R07": ("error", "Patrón de repeater 1-based"),
    "R08": ("error", "Helper que escribe siempre"),
    "R09": ("nota", "checkedPdfValue que no se usa"),
    "R10": ("error", "Condición comparada solo por etiqueta"),
    "R11": ("aviso", "Puede generar una persona fantasma"),
    "R12": ("aviso", "Dos campos escriben la misma ruta"),
    "R13": ("nota", "Casillero del PDF que queda vacío"),
    "R14": ("aviso", 'prefillMode "api"'),
    "R15": ("nota", "Label sin tildes"),
    "R16": ("aviso", "Descripción que nunca se llena"),
    "R17": ("aviso", "Edad sin calcular"),
    "R18": ("aviso", "Cascada apuntando a otra persona"),
    "R19": ("error", "Fecha cortada contra el formato equivocado"),
    "R20": ("aviso", "Nombre completo desbloqueado"),
    "R21": ("error", "Grupo de radios roto"),
    "R22": ("aviso", "No hay campo de firma"),
    "R23": ("nota", "Declaraciones no está al final"),
    "R24": ("aviso", "Grupo de tipo de persona incompleto"),
    "R25": ("nota", "campos del PDF sin usar"),
    "R26": ("nota", "Término distinto al acordado"),
}


class Model:
    """The tables a rule may read.

    fields: form_id, ord, section_ord, section_id, section_title, id, label, type,
        source_name, native_type, hidden, hidden_effective, in_repeater, salida_json,
        json_output_path, secondary_path, exclude, prefill_key, prefill_mode,
        default_value, json_value, checked_pdf_value, condition_visibility,
        condition_required, parent_id, grandparent_id, read_only, concat (JSON text),
        radio_fields (JSON array text), radio_label, slot_pattern, has_repeater,
        pdf_date_format, date_format, options (JSON array text)
    widgets: form_id, ord, name (names found in the PDF); may be None
    """

    def __init__(self, fields: DataFrame, widgets: DataFrame | None = None) -> None:
        self.fields = fields
        self.widgets = widgets

    @property
    def own(self) -> DataFrame:
        """fields outside repeaters"""
        return self.fields.where(F.col("in_repeater").isNull())

    def ids(self) -> DataFrame:
        return self.own.select("form_id", F.col("id").alias("ref")).distinct()


def register(rule: str) -> Callable[[Rule], Rule]:
    """Register a rule over tables: ``Model -> findings``."""
    def add(fn: Rule) -> Rule:
        RULES[rule] = fn
        return fn
    return add


_HIT = "array<struct<field_id:string,subject:string,path:string>>"


def hit(when: Column, subject: Column | None = None, path: Column | None = None) -> Column:
    """at most one finding about the row itself"""
    none = F.lit(None).cast("string")
    one = F.struct(F.col("id").alias("field_id"), (none if subject is None else subject.cast("string")).alias("subject"),
                   (none if path is None else path).alias("path"))
    return F.when(when, F.array(one)).otherwise(F.array().cast(_HIT))


def hits(subjects: Column) -> Column:
    """one finding per subject of an array of texts"""
    return F.coalesce(F.transform(subjects, lambda s: F.struct(
        F.col("id").alias("field_id"), s.alias("subject"), F.lit(None).cast("string").alias("path"))), F.array().cast(_HIT))


def register_row(rule: str, readable: RowRule | None = None) -> Callable[[RowRule], Rule]:
    """Register a rule that needs nothing but the row: it returns an array of hits. All of
    them together cost one pass over the fields. ``readable`` says whether the rule can judge a row;
    where it cannot, the row gets an R00 finding that names the rule instead of ending the audit."""
    def add(fn: RowRule) -> Rule:
        def run(model: Model) -> DataFrame:
            return row_findings(model.fields, [guarded(rule, fn, readable)])
        run.__name__ = fn.__name__
        ROW_RULES[rule] = fn
        if readable is not None:
            READABLE[rule] = readable
        RULES[rule] = run
        return run
    return add


# ---- rules about keys ------------------------------------------------------------------------
#
# A rule that compares rows says so as records: a row *owns* or *uses* a key of a space (an id, a path, a
# name), or *needs* to know about one. All records of all rules are exploded in one pass and counted in
# one aggregate, whatever rules there are; needs are then joined with the counts once.

_RECORD = "array<struct<space:string,key:string,sub:string,use:boolean,flag:boolean,ord:bigint,num:int,rule:string,field_id:string,subject:string,path:string,a:string,b:string>>"


def record(space: str, key: Column, rule: str | None = None, when: Column | None = None, use: bool = False, **parts: Column) -> Column:
    """at most one record of the row, as an array"""
    given = {"sub": None, "flag": F.lit(False), "ord": None, "num": None, "field_id": None, "subject": None, "path": None, "a": None, "b": None, **parts}
    columns = {"space": F.lit(space), "key": key, "use": F.lit(use), "rule": F.lit(rule), **{k: F.lit(None) if c is None else c for k, c in given.items()}}
    types = dict(f.split(":") for f in _RECORD.removeprefix("array<struct<").removesuffix(">>").split(","))
    one = F.array(F.struct(*[columns[k].cast(t).alias(k) for k, t in types.items()]))
    return one if when is None else F.when(F.coalesce(when, F.lit(False)), one).otherwise(no_records())


def no_records() -> Column:
    return F.array().cast(_RECORD)


def each(items: Column, of: Callable[[Column], Column]) -> Column:
    """records of every item of an array"""
    return F.coalesce(F.flatten(F.transform(items, of)), no_records())


class Keyed:
    """A rule about keys. ``keys`` and ``needs`` are records of a field, ``widget_keys`` of a widget;
    ``decide`` judges a need next to its key's counts (``n_own``, ``n_use``, ``n_flag``, ``n_sub``, ``low``, ``high``,
    ``last_a``, ``last_b``), and ``spaces`` are spaces whose keys ``judge`` judges by themselves."""

    def __init__(self, rule: str, keys: Callable[[], list[Column]], needs: Callable[[], list[Column]] | None = None, widget_keys: Callable[[], list[Column]] | None = None,
                 decide: Callable[[], Column] | None = None, subject: Callable[[], Column] | None = None, space: str | None = None, judge: Callable[[], Column] | None = None,
                 field: Callable[[], Column] | None = None) -> None:
        self.rule, self.keys, self.needs, self.widget_keys = rule, keys, needs, widget_keys
        self.decide, self.subject, self.space, self.judge, self.field = decide, subject, space, judge, field


KEYED: dict[str, Keyed] = {}
#: Rules that go on from the counts of the keys by themselves: (counts) -> findings.
FOLLOWING: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_keyed(keyed: Keyed, following: Callable[[DataFrame], DataFrame] | None = None) -> Rule:
    def run(model: Model) -> DataFrame:
        return keyed_findings(model, [keyed.rule])
    run.__name__ = keyed.keys.__name__
    KEYED[keyed.rule] = keyed
    RULES[keyed.rule] = run
    if following is not None:
        FOLLOWING[keyed.rule] = following
    return run


def _exploded(rows: DataFrame, records: list[Column]) -> DataFrame:
    return rows.select("form_id", F.explode(F.concat(*records)).alias("r")).select("form_id", "r.*")


def key_counts(model: Model, rules: list[str]) -> DataFrame:
    """What is known of every key that a rule speaks of, in two partial aggregates."""
    # several rules may count the same keys: equal records are kept once
    lists = {str(c): c for r in rules for c in KEYED[r].keys()}
    rows = _exploded(model.fields, list(lists.values())) if lists else None
    widgets = [c for r in rules if KEYED[r].widget_keys for c in KEYED[r].widget_keys()]
    if widgets:
        more = _exploded(model.widgets, widgets)
        rows = more if rows is None else rows.unionByName(more)
    own = ~F.col("use")
    subs = rows.groupBy("form_id", "space", "key", "sub").agg(
        F.count_if(own).alias("n_own"), F.count_if("use").alias("n_use"), F.count_if(own & F.col("flag")).alias("n_flag"),
        F.min(F.when(F.col("flag"), F.col("num"))).alias("low"), F.max("num").alias("high"), F.min(F.when(own, F.col("field_id"))).alias("field_id"),
        F.min(F.when(own, F.col("subject"))).alias("subject"), F.max(F.when(own, F.struct("ord", "num", "a", "b"))).alias("last"))
    known = subs.groupBy("form_id", "space", "key").agg(
        F.sum("n_own").alias("n_own"), F.sum("n_use").alias("n_use"), F.sum("n_flag").alias("n_flag"), F.count_if(F.col("n_flag") > 0).alias("n_sub"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("field_id").alias("owner"), F.min("subject").alias("about"), F.max("last").alias("last"))
    return known.select("*", F.col("last.a").alias("last_a"), F.col("last.b").alias("last_b")).drop("last")


def keyed_findings(model: Model, rules: list[str]) -> DataFrame:
    """Findings of rules about keys: one pass for their keys, one for their needs, one join."""
    for r in rules:
        if KEYED[r].widget_keys and model.widgets is None:
            raise ValueError("no widgets")
    known = cut_lineage(key_counts(model, rules))
    none = F.lit(None).cast("string")
    out = []
    judged = [KEYED[r] for r in rules if KEYED[r].judge is not None]
    if judged:
        told = [F.when((F.col("space") == k.space) & F.coalesce(k.judge(), F.lit(False)), F.struct(F.lit(k.rule).alias("rule"), (none if k.field is None else k.field()).alias("field_id"),
                                                                                  (none if k.subject is None else k.subject().cast("string")).alias("subject"))) for k in judged]
        rows = known.select("form_id", F.explode(F.array_compact(F.array(*told))).alias("f"))
        out.append(rows.select("form_id", "f.rule", "f.field_id", "f.subject", none.alias("path")))
    needing = [KEYED[r] for r in rules if KEYED[r].needs is not None]
    if needing:
        needs = _exploded(model.fields, [c for k in needing for c in k.needs()])
        met = needs.join(known.drop("owner", "about"), ["form_id", "space", "key"], "left")
        wrong, subject = F.lit(False), F.col("subject")
        for k in needing:
            mine = F.col("rule") == k.rule
            wrong = wrong | (mine & F.coalesce(k.decide(), F.lit(False)))
            if k.subject is not None:
                subject = F.when(mine, k.subject().cast("string")).otherwise(subject)
        out.append(met.where(wrong).select("form_id", "rule", "field_id", subject.alias("subject"), "path"))
    out += [FOLLOWING[r](known) for r in rules if r in FOLLOWING]
    grade = F.create_map(*[F.lit(x) for rule, (severity, _) in TITLES.items() for x in (rule, severity)])
    return reduce(DataFrame.unionByName, out).select("form_id", "rule", grade[F.col("rule")].alias("severity"), "field_id", "subject", "path")


# ---- rows that a rule cannot read ------------------------------------------------------------

def _shape(c: Column, path: str = "$") -> Column:
    """OBJECT, ARRAY, a scalar's type, VOID for null and nothing; NULL where the text is no JSON"""
    value = F.try_parse_json(c)
    inner = value if path == "$" else F.try_variant_get(value, path, "variant")
    kind = F.regexp_extract(F.coalesce(F.schema_of_variant(inner), F.lit("VOID")), "^[A-Z]+", 0)
    return F.when(value.isNotNull(), kind)


def _not(kind: Column, *good: str) -> Column:
    return ~F.coalesce(kind, F.lit("")).isin(*good, "VOID")


def unreadable(column: str) -> Column:
    """whether a field's column cannot be read: a JSON text that is none, or of another shape, a missing id.
    A condition that is no JSON is no condition; one whose conditions are no list cannot be read."""
    c = F.col(column)
    if column == "id":
        return c.isNull()
    given = F.coalesce(c, F.lit("")) != ""
    if column.startswith("condition_"):
        return given & _not(F.coalesce(_shape(c, "$.conditions"), F.lit("VOID")), "ARRAY")
    if column == "concat":
        return given & (_not(_shape(c), "OBJECT") | _not(_shape(c, "$.parts"), "ARRAY") | _not(_shape(c, "$.sourceFieldIds"), "ARRAY"))
    return given & _not(_shape(c), "ARRAY")


#: What a rule reads beside plain values.
READS = {"R01": ["id"], "R03": ["condition_visibility", "condition_required"], "R08": ["concat"], "R10": ["options", "concat", "condition_visibility", "condition_required"],
         "R18": ["id"], "R19": ["id", "concat"], "R21": ["radio_fields"], "R24": ["condition_visibility"]}


def faults(rules: list[str]) -> list[Column]:
    """R00 findings of a row, one for every rule and column that the rule cannot read. A rule's own
    expressions give nothing for such a column, so the audit goes on."""
    columns = sorted({c for r in rules for c in READS.get(r, ())})
    if not columns:
        return []
    none = F.lit(None).cast("string")
    found = [F.when(unreadable(c), F.transform(F.array(*[F.lit(f"{r}: unreadable {c}") for r in rules if c in READS.get(r, ())]), lambda s: F.struct(
        F.col("id").alias("field_id"), s.alias("subject"), none.alias("path")))).otherwise(F.array().cast(_HIT)) for c in columns]
    return [_tag("R00", F.coalesce(f, F.array().cast(_HIT))) for f in found]


def guarded(rule: str, fn: RowRule, readable: RowRule | None = None) -> Column:
    """Tagged findings of a row rule; its expression is not evaluated on rows that it cannot read."""
    found = _tag(rule, fn())
    if readable is None:
        return found
    fault = F.array(F.struct(F.lit("R00").alias("rule"), F.lit(TITLES["R00"][0]).alias("severity"), F.col("id").alias("field_id"),
                             F.lit(f"{rule}: unreadable row").alias("subject"), F.lit(None).cast("string").alias("path")))
    return F.when(F.coalesce(readable(), F.lit(False)), found).otherwise(fault)


def row_findings(fields: DataFrame, tagged: list[Column]) -> DataFrame:
    rows = fields.select("form_id", F.explode(F.concat(*tagged)).alias("f"))
    return rows.select("form_id", "f.rule", "f.severity", "f.field_id", "f.subject", "f.path")


def _tag(rule: str, found: Column) -> Column:
    return F.transform(found, lambda h: F.struct(F.lit(rule).alias("rule"), F.lit(TITLES.get(rule, ("nota",))[0]).alias("severity"),
                                                 h.field_id.alias("field_id"), h.subject.alias("subject"), h.path.alias("path")))


def finding(rows: DataFrame, rule: str, field: str | Column | None = "id", subject: Column | None = None,
            path: Column | None = None, form: str = "form_id") -> DataFrame:
    none = F.lit(None).cast("string")
    field = F.col(field) if isinstance(field, str) else (none if field is None else field)
    return rows.select(F.col(form).alias("form_id"), F.lit(rule).alias("rule"), F.lit(TITLES[rule][0]).alias("severity"),
                       field.alias("field_id"), (none if subject is None else subject.cast("string")).alias("subject"),
                       (none if path is None else path).alias("path"))


def run_rules(model: Model, only: list[str] | None = None, more: Mapping[str, tuple[RowRule, RowRule | None]] | None = None) -> DataFrame:
    """All findings: one pass for the rules about single rows, three for all rules about keys, one plan
    for each of the others. ``more`` are further row rules by name, each with what makes a row readable.

    A rule that cannot be planned (a missing column, say) leaves a visible R00 finding and the
    others go on; a row that a rule cannot read gets an R00 finding of its own."""
    spark = model.fields.sparkSession
    more = dict(more or {})
    wanted = [r for r in RULES if only is None or r in only] + list(more)
    parts: list[DataFrame] = []
    columns: list[Column] = []
    keyed: list[str] = []
    read: list[str] = []
    for rule in wanted:
        try:
            if rule in more or rule in ROW_RULES:
                column = guarded(rule, *(more[rule] if rule in more else (ROW_RULES[rule], READABLE.get(rule))))
                model.fields.select(column).schema  # analyse now, so that a broken rule fails here
                columns.append(column)
            elif rule in KEYED:
                of = KEYED[rule]
                model.fields.select(F.concat(*of.keys(), *(of.needs() if of.needs else []))).schema
                if of.widget_keys:
                    model.widgets.select(F.concat(*of.widget_keys())).schema
                keyed.append(rule)
            else:
                part = RULES[rule](model)
                part.schema
                parts.append(part)
            if rule in READS:
                model.fields.select(*READS[rule]).schema
                read.append(rule)
        except Exception as error:  # noqa: BLE001 - isolation is the feature
            name = (error.getCondition() if hasattr(error, "getCondition") else None) or type(error).__name__
            parts.append(finding(spark.range(1).select(F.lit(None).cast("string").alias("form_id")), "R00", None,
                                 F.lit(f"{rule}: {name}")))
    columns += faults(read)
    if columns:
        parts.insert(0, row_findings(model.fields, columns))
    if keyed:
        parts.append(keyed_findings(model, keyed))
    return reduce(DataFrame.unionByName, parts)


def finding_order(findings: DataFrame) -> DataFrame:
    """a form's errors, warnings, notes, each by rule; ``place`` is a finding's number in that order"""
    rank = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])[F.col("severity")]
    rest = [F.coalesce(c, F.lit("")) for c in ("field_id", "subject", "path")]
    known = findings.withColumn("form_id", F.coalesce("form_id", F.lit("")))
    placed = ordered_scan(known, ["form_id"], [rank, F.col("rule"), *rest], F.struct(rank.alias("rank"), "rule"), number="place")
    return placed.orderBy("form_id", "place")


def with_titles(findings: DataFrame) -> DataFrame:
    titles = F.create_map(*[F.lit(x) for rule, (_, title) in TITLES.items() for x in (rule, title)])
    return findings.withColumn("title", titles[F.col("rule")])


def audit(model: Model, conflicts: DataFrame | None = None, missing_output: DataFrame | None = None) -> DataFrame:
    """Findings of the rules next to container conflicts (C1) and fields without output
    (C2), under the severities of the audit."""
    grade = F.create_map(*[F.lit(x) for x in ("error", "critical", "aviso", "warning", "nota", "info")])
    out = run_rules(model).withColumn("severity", grade[F.col("severity")])
    none = F.lit(None).cast("string")
    if conflicts is not None:
        out = out.unionByName(conflicts.select("form_id", F.lit("C1").alias("rule"), F.lit("critical").alias("severity"),
                                               none.alias("field_id"), F.col("child").alias("subject"), "path"))
    if missing_output is not None:
        out = out.unionByName(missing_output.select("form_id", F.lit("C2").alias("rule"), F.lit("warning").alias("severity"),
                                                    F.col("id").alias("field_id"), none.alias("subject"), none.alias("path")))
    return out
