"""Text, type, rule, path and naming cases with their expected values."""

import re

import pytest
from pyspark.sql import functions as F

from formspark import constants as K
from formspark.functions import classify as C
from formspark.functions import paths as P
from formspark.functions import text as T


@pytest.mark.parametrize("fn,value,want", [
    (T.fold, "Código", "codigo"),
    (T.fold, "  Día\t de  PAGO ", "dia de pago"),
    (T.key_slug, "N° de Identificación:", "n_de_identificacion"),
    (T.slugify, "N° de Identificación:", "n_de_identificacion"),
    (T.as_id, "Número[0]", "n_mero_0"),
    (T.norm_compact, "N.I.T. (dos)", "nit dos"),
    (T.norm_words, "N.I.T. (dos)", "n i t dos"),
    (T.name_loose, "Text Ñandú_1.b", "textnandu1b"),
    (T.sanitize_name, "__", "unnamed"),
    (T.humanize, "primerApellido_del", "primer Apellido del"),
    (T.title_case, "datos_DEL tomador", "Datos Del Tomador"),
    (T.clean_label, "Nombre_Row_2", "Nombre"),
    (T.camel_to_snake, "codigoProvincia", "codigo_provincia"),
])
def test_text(one, fn, value, want):
    assert one(fn("x"), x=value) == want


def test_capitalize_uses_ascii_borders(one):
    assert one(T.capitalize(F.col("x")), x="nombre completo") == "Nombre Completo"
    assert one(T.capitalize(F.col("x")), x="día") == "DíA"
    assert one(T.capitalize(F.col("x")), x="Mixto aquí") == "Mixto aquí"


def test_camel_styles(one):
    assert one(T.camel_to_snake("x", "acronym"), x="datosABTest") == "datos_ab_test"
    assert one(T.camel_to_snake("x", "border"), x="datos.primerApellido") == "datos_primer_apellido"


def test_simplify_slug(one):
    long = "nombre_completo_de_la_persona_que_firma"
    assert one(T.simplify_slug(F.col("x")), x=long) == "nombre_persona_firma"
    assert one(T.simplify_slug(F.col("x")), x="corto_de_la") == "corto_de_la"


@pytest.mark.parametrize("a,b,edit,dice", [("nacionalidad", "nacionalidad", 1.0, 1.0), ("abc", "abd", 2 / 3, 0.5), ("", "a", 0.0, 0.0)])
def test_similarity(one, a, b, edit, dice):
    assert one(T.edit_similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(edit)
    assert one(T.dice_bigrams("a", "b"), a=a, b=b) == pytest.approx(dice)


def test_characters_outside_a_class(one):
    assert T.outside("a-z0-9", "_") == r"[\x{0}-\x{2F}\x{3A}-\x{5E}\x{60}-\x{60}\x{7B}-\x{10FFFF}]"
    odd = "\x00 Ab_c\u00a0-9\ufeff\U0001f600z ñ\t_ .\u2003- x_"
    assert one(T.replace(F.col("x"), T.outside("A-Za-z", "ñ_"), ""), x=odd) == "Ab_czñ_x_"
    assert one(T.norm_compact("x"), x=odd) == "abc 9 z n x"
    assert one(T.slugify("x"), x=odd) == "ab_c_9_z_n_x"
    assert one(T.sanitize_name("x"), x=odd) == "ab_c_9_z_n_x"
    assert one(T.name_loose("x"), x=" á_b.- .c\u2003d") == "abcd"
    assert one(T.camel_to_snake("x", "acronym"), x="datos.ABTest_é_x") == "datos_ab_test_x"


@pytest.mark.parametrize("text,section,context", [
    ("DATOS DEL AÑO", True, True), ("DATOS DEL AñO", False, False), ("AB CD EFG", False, True), ("ABCDEFGHIJ", True, True), ("ABCD 12345", False, False),
    ("ABCDEF 1234", False, True), ("ABCDE F 123456", False, False), ("A B C D E F", True, True), (None, None, None)])
def test_texts_in_capitals(one, text, section, context):
    assert one(T.is_section_header(F.col("x").cast("string")), x=text) is section
    assert one(T.is_context_heading(F.col("x").cast("string")), x=text) is context


def test_text_patterns_negate_no_class_of_three_parts(spark):
    """such a class is ten times as slow as one that is written as what it holds"""
    made = [T.norm_compact("x"), T.slugify("x"), T.sanitize_name("x"), T.looks_like_heading("x"), T.is_section_header("x"), T.is_context_heading("x"),
            T.camel_to_snake("x", "border"), T.camel_to_snake("x", "acronym")]
    plan = spark.range(1).select(F.col("id").cast("string").alias("x")).select(*made)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan
    assert not [p for p in re.findall(r"\[\^([^\]]*)\]", plan) if p != "a-z0-9"]


def test_vocabulary(one):
    assert one(T.spell_fix("x"), x="Informacion de la poliza") == "Información de la póliza"
    assert one(T.spell_fix("x"), x="Diaé") == "Díaé"
    assert one(T.spell_fix("x"), x="Polizas") is None
    assert one(T.term_fix("x"), x="Género del titular") == "Sexo del titular"


@pytest.mark.parametrize("rule,data_type,length,pattern", [
    ("16 caracteres", "Texto", 16, None),
    ("Formato dd/mm/aaaa", "Fecha", None, K.PATTERN_DATE_SLASH),
    ("Sólo números", "Texto", None, K.PATTERN_DIGITS),
    ("correo", "", None, None),
    ("correo", "Texto", None, K.PATTERN_EMAIL),
    ("Máximo: 20 alfanuméricos", "Texto", 20, K.PATTERN_ALNUM),
    ("99999999999 caracteres", "Texto", None, None),
])
def test_validation(one, rule, data_type, length, pattern):
    got = one(C.parse_validation("r", "d"), r=rule, d=data_type)
    assert (got.max_length, got.pattern) == (length, pattern)


def test_validation_ext(one):
    assert one(C.parse_validation_ext("r", F.lit("text")), r="Numérico y 9 dígitos").pattern == r"^\d{9}$"
    assert one(C.parse_validation_ext("r", F.lit("text")), r="10 caracteres con 2 decimales").pattern == r"^\d{1,10}(\.\d{1,2})?$"
    assert one(C.parse_validation_ext("r", F.lit("select")), r="hasta 5").max_length is None


@pytest.mark.parametrize("value,want", [("Combo", "select"), ("Numérico", "number"), ("Radio/Combo", "radio"), ("Título", "heading"), ("", "text")])
def test_types(one, value, want):
    assert one(C.map_type("x"), x=value) == want


def test_yes_no_vocabularies(one):
    assert one(C.yes_no("x"), x=" Sí ") is True
    assert one(C.yes_no("x"), x="NO") is False
    assert one(C.yes_no("x", "mapping"), x="x") is True
    assert one(C.yes_no("x", "mapping"), x="") is False
    assert one(C.yes_no("x", "enriched"), x="") is None
    assert one(C.yes_no("x", "spelling"), x="Quizás") == "Quizás"


def test_scope(one):
    assert one(C.scope_split("x"), x="TODOS") == ["all"]
    assert one(C.scope_split("x"), x="vida_universal, proteccion_crediticia") == ["vida_universal", "proteccion_crediticia"]
    assert one(C.applies_to_form("x", F.lit("1009052")), x="Vida Colectiva") is True
    assert one(C.applies_to_form("x", F.lit("D0306")), x="Vida Colectiva") is False


@pytest.mark.parametrize("text,kind,label,value", [
    ("Si se selecciona Otro se debe habilitar el campo Detalle.", "trigger", "detalle", "otro"),
    ("Si el campo Tipo es Física", "equals", "tipo", "fisica"),
    ("Depende de la provincia", "depends", "la provincia", None),
    ("Texto libre", None, None, None),
])
def test_conditions(one, text, kind, label, value):
    got = one(C.parse_condition(F.col("x")), x=text)
    assert (got.kind, got.label, got.value) == (kind, label, value)


def test_condition_warnings(one):
    assert one(C.parse_condition(F.col("x")), x="si o no se habilita").leftover == "ambiguous_rule"
    assert one(C.parse_condition(F.col("x")), x="visualiza algo").leftover == "unparsed_rule"


@pytest.mark.parametrize("path,prefix,want,warning", [
    ("datos.personas.nombre", "asegurado_", "datos.personas[0].nombre", False),
    ("datos.personas.nombre", "beneficiario_3_", "datos.personas[3].nombre", False),
    ("datos.personas[2].nombre", "asegurado_", "datos.personas[2].nombre", False),
    ("datos.mispersonas.x", "asegurado_", "datos.mispersonas.x", False),
    ("datos.personas.nombre", "dme_", "datos.personas.nombre", True),
    ("", "asegurado_", "", False),
])
def test_index_path(one, path, prefix, want, warning):
    got = one(P.index_path("p", "s"), p=path, s=prefix)
    assert (got.path, got.warning) == (want, warning)


def test_parse_path(one):
    got = [(s["key"], s["index"]) for s in one(P.parse_path("x"), x="a[0].b[].c[1][2].d")]
    assert got == [("a", 0), ("b", -1), ("c", 1), (None, 2), ("d", None)]


def test_path_pieces(one):
    assert one(P.first_path("x"), x="a.b y c.d") == "a.b"
    assert one(P.route_leaf("x"), x="personas[].codigos[]") == "codigos"
    assert one(P.correct_path("x"), x="datosGenerales.personas.Consentimiento") == "datosFormulario.personas.consentimiento"
    assert one(P.name_variants("x"), x="a_1_2_3_4") == ["a_1_2_3_4", "a_1_2_3", "a_1_2", "a_1"]
    got = one(P.split_prefill_key("x"), x="a.b != 3")
    assert (got.path, got.condition) == ("a.b", "!=3")


@pytest.mark.parametrize("part,fmt,start,end,ok,got", [
    ("dia", "DD/MM/YYYY", 0, 2, True, "28"), ("dia", "DD/MM/YYYY", 8, 10, False, "26"), ("dia", "YYYY-MM-DD", 8, 10, True, "28"), ("anio", "DD/MM/AAAA", 6, 10, True, "2026"),
])
def test_date_slice(one, part, fmt, start, end, ok, got):
    r = one(P.date_slice_check(F.lit(part), F.lit(fmt), F.lit(start), F.lit(end)))
    assert (r.ok, r.got) == (ok, got)


def test_sample_value(one):
    none = F.array().cast("array<string>")
    many = F.array(*[F.lit(str(i)) for i in range(8)])
    assert one(P.sample_value(F.lit("select"), many, none, F.lit(None))) == "<select: 0 | 1 | 2 | 3 | 4 | 5 | …>"
    assert one(P.sample_value(F.lit("text"), F.array(F.lit("v"), F.lit("v")), none, F.lit(None))) == "v"
    assert one(P.sample_value(F.lit("date"), none, none, F.lit(""))) == "<date dd/MM/yyyy>"


def test_functions_are_idempotent(spark):
    df = spark.createDataFrame([("Año  ñandú/Ó-1",), ("  ",), ("A_b[3]",)], "x string")
    for fn in (T.fold, T.key_slug, T.norm_words, T.norm_compact, T.slugify, T.sanitize_name):
        a, b = df.select(fn("x").alias("a"), fn(fn("x")).alias("b")).toPandas().T.values.tolist()
        assert a == b, fn.__name__
