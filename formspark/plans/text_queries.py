"""Text normalisation, naming and similarity over whole documents and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from formspark.functions import text as T
from formspark.plans.registry import Family
from formspark.plans.tables import LINES, MATRIX, duck, lines, read, spark_table

family = Family()
FOLD = "trim(regexp_replace(strip_accents(lower(line)), '\\s+', ' ', 'g'))"


@family.query(f"""
SELECT doc_id, line_no,
  {FOLD} AS fold,
  trim(regexp_replace(regexp_replace(strip_accents(lower(line)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS words,
  trim(regexp_replace(regexp_replace(strip_accents(lower(line)), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS compact
FROM {LINES}""")
def fold_lines(spark, sf):
    return lines(spark, sf).select("doc_id", "line_no", T.fold("line").alias("fold"), T.norm_words("line").alias("words"),
                                   T.norm_compact("line").alias("compact"))


@family.query(f"""
SELECT doc_id, line_no, slug, CASE WHEN substr(slug, 1, 40) = '' THEN 'x' ELSE substr(slug, 1, 40) END AS slug_40,
  CASE WHEN substr(slug, 1, 80) = '' THEN 'row_' || line_no ELSE substr(slug, 1, 80) END AS slug_80,
  trim(regexp_replace(lower(line), '[^a-z0-9]+', '_', 'g'), '_') AS as_id,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(strip_accents(lower(line))), '[^a-z0-9\\s_]', '', 'g'), '\\s+', '_', 'g'),
    '_+', '_', 'g'), '^_|_$', '', 'g') AS slugify,
  CASE WHEN clean = '' THEN 'unnamed' ELSE clean END AS sanitized
FROM (SELECT *, trim(regexp_replace(strip_accents(lower(line)), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
  substr(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(line)), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'), 1, 80) AS clean
  FROM {LINES})""")
def slug_lines(spark, sf):
    return lines(spark, sf).select(
        "doc_id", "line_no", T.key_slug("line").alias("slug"), T.slug_n("line", 40).alias("slug_40"),
        T.slug_n("line", 80, F.concat(F.lit("row_"), F.col("line_no"))).alias("slug_80"), T.as_id("line").alias("as_id"),
        T.slugify("line").alias("slugify"), T.sanitize_name("line").alias("sanitized"))


@family.query("""
SELECT doc_id, upper(replace(strip_accents(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss')) AS folded,
  regexp_replace(lower(source || '.' || lang || '_-' || source), '[\\s._\\-]+', '', 'g') AS loose,
  translate(regexp_replace(lower(text), '[\\s._\\-]+', '', 'g'), 'áàäéèëíìïóòöúùüñ', 'aaaeeeiiiooouuun') AS loose_text
FROM documents""")
def fold_documents(spark, sf):
    name = F.concat("source", F.lit("."), "lang", F.lit("_-"), "source")
    return read(spark, sf, "documents").select("doc_id", T.fold_upper("text").alias("folded"),
                                               T.name_loose(name, fold_vowels=False).alias("loose"),
                                               T.name_loose("text").alias("loose_text"))


_LEAF = "list_last(string_split(json_name, '.'))"


@family.query(f"""
SELECT ord, form_id,
  regexp_replace(regexp_replace(lower(regexp_replace(leaf, '([A-Z])', '_\\1', 'g')), '^_', ''), '_+', '_', 'g') AS every,
  translate(lower(regexp_replace(regexp_replace(regexp_replace(json_name, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[^a-zA-Z0-9áéíóúñÁÉÍÓÚÑ]+', '_', 'g'), '^_|_$', '', 'g')), 'áéíóúñ', 'aeioun') AS border,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(leaf, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS acronym,
  trim(regexp_replace(regexp_replace(regexp_replace(leaf, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_+', ' ', 'g'), '\\s+', ' ', 'g')) AS human
FROM (SELECT *, {_LEAF} AS leaf FROM {duck(MATRIX)})""")
def case_styles(spark, sf):
    leaf = F.element_at(F.split("json_name", r"\."), -1)
    return spark_table(spark, sf, MATRIX).select(
        "ord", "form_id", T.camel_to_snake(leaf).alias("every"), T.camel_to_snake("json_name", "border").alias("border"),
        T.camel_to_snake(leaf, "acronym").alias("acronym"), T.humanize(leaf).alias("human"))


_STOP = "['y','de','del','la','el','los','las','en','con','que','se','por','para','una','un','al','su','u','o','completo','completa']"


@family.query(f"""
SELECT doc_id, line_no, CASE WHEN len(slug) <= 30 THEN slug WHEN len(array_to_string(kept, '_')) <= 30 THEN coalesce(array_to_string(kept, '_'), '')
    ELSE array_to_string(kept[1:3], '_') END AS short_slug
FROM (SELECT *, list_filter(string_split(slug, '_'), lambda x: NOT list_contains({_STOP}, x)) AS kept
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(strip_accents(lower(line))), '[^a-z0-9\\s_]', '', 'g'), '\\s+', '_', 'g'),
    '_+', '_', 'g'), '^_|_$', '', 'g') AS slug FROM {LINES}))""")
def simplify_slugs(spark, sf):
    return lines(spark, sf).select("doc_id", "line_no", T.simplify_slug(T.slugify("line")).alias("short_slug"))


@family.query(f"""
SELECT ord, title, cleaned,
  CASE WHEN cleaned = upper(cleaned) OR cleaned = lower(cleaned) THEN
    array_to_string(list_transform(string_split(cleaned, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') ELSE cleaned END AS capital
FROM (SELECT ord, array_to_string(list_transform(string_split(replace(replace(pdf_field_name, '_', ' '), '[', ' '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS title,
  trim(replace(regexp_replace(regexp_replace(pdf_field_name || ':', '(?i)_Row_\\d+$', ''), ':_?$', ''), '_', ' ')) AS cleaned
  FROM {duck(MATRIX)})""")
def label_styles(spark, sf):
    cleaned = T.clean_label(F.concat("pdf_field_name", F.lit(":")))
    return spark_table(spark, sf, MATRIX).select(
        "ord", T.title_case(F.translate("pdf_field_name", "[", " ")).alias("title"), cleaned.alias("cleaned"),
        T.capitalize(cleaned).alias("capital"))


_T = "trim(line)"


@family.query(f"""
SELECT doc_id, line_no,
  len({_T}) >= 5 AND len(letters) > 0 AND len(regexp_replace(letters, '[^A-ZÁÉÍÓÚÑÜ]', '', 'g')) / greatest(len(letters), 1) >= 0.7 AS heading,
  len({_T}) >= 10 AND len(blanks) >= 10 AND blanks = upper(blanks) AND len(blanks) > len({_T}) * 0.6 AS header,
  len({_T}) <= 1 OR regexp_matches({_T}, '^[A-ZÁÉÍÓÚÑÜ\\s]{{15,}}$') AS bad_label,
  lower({_T}) IN ('', 'no se llena en pdf', 'no aplica', 'n/a', '-') AS placeholder,
  strip_accents(lower({_T})) IN ('no', 'n/a', '-', 'na', 'no aplica', 'ninguna') AS junk,
  len(slug) >= 35 AND regexp_matches(slug, '_(y|de|del|la|el|que|con|en|los|las|para|una|un|se|por)_|exprese_claramente|nombre_completo_y_el_cargo|desempena_dentro|persona_juridica|datos_personales|declaro_que|acepto_que|autorizo_a') AS noise_name,
  len(slug) > 50 OR regexp_matches(slug, 'exprese_claramente|al_momento|en_caso_de|declaro_que|firma_del|el_cargo|autorizo_a|acepto_las|por_este_medio') AS noise_source,
  {_T} <> '' AND ({_T} IN ('undefined', 'undefine', 'NOTIFICACIONES', 'null', 'NaN') OR {_T} = source OR
    regexp_matches({_T}, '(?i)^Text\\d|^Check\\s*Box|^Combo\\s*Box|^Radio\\s*Button')) AS dirty
FROM (SELECT *, regexp_replace({_T}, '[^a-zA-ZÁÉÍÓÚÑÜ]', '', 'g') AS letters,
  regexp_replace({_T}, '[^A-Za-zÁÉÍÓÚÑÜáéíóúñü\\s]', '', 'g') AS blanks,
  trim(regexp_replace(strip_accents(lower(line)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM {LINES})""")
def text_tests(spark, sf):
    slug = T.key_slug("line")
    return lines(spark, sf).select(
        "doc_id", "line_no", T.looks_like_heading("line").alias("heading"), T.is_section_header("line").alias("header"),
        T.is_bad_label("line").alias("bad_label"), T.is_placeholder("line").alias("placeholder"),
        T.is_junk_value("line").alias("junk"), T.is_noise_name(slug).alias("noise_name"),
        T.is_noise_source(slug).alias("noise_source"), T.is_dirty_value("line", "source").alias("dirty"))


def _bound(word: str) -> str:
    return f"(^|[^A-Za-z0-9_]){word}($|[^A-Za-z0-9_])"


@family.query("""
SELECT p_partkey, CASE WHEN f <> label THEN f END AS fixed, CASE WHEN g <> term THEN g END AS agreed FROM (
SELECT p_partkey, label, term, replace(replace(replace(label, '(Poliza)', '(Póliza)'), ' telefono ', ' teléfono '), 'Numero-', 'Número-') AS f,
  replace(replace(term, 'Genero ', 'Sexo '), ' género.', ' sexo.') AS g
FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN concat('Numero-', p_name) WHEN 1 THEN concat(p_name, ' (Poliza) telefono 2')
  WHEN 2 THEN concat('Polizas telefonoX ', p_name) ELSE p_name END AS label,
  CASE p_size % 3 WHEN 0 THEN concat('Genero ', p_name) WHEN 1 THEN concat(p_name, ' género.') ELSE concat('Generos ', p_name) END AS term FROM part))""")
def vocabulary_fixes(spark, sf):
    part = read(spark, sf, "part")
    k = F.col("p_size") % 4
    label = (F.when(k == 0, F.concat(F.lit("Numero-"), "p_name")).when(k == 1, F.concat("p_name", F.lit(" (Poliza) telefono 2")))
             .when(k == 2, F.concat(F.lit("Polizas telefonoX "), "p_name")).otherwise(F.col("p_name")))
    k = F.col("p_size") % 3
    term = (F.when(k == 0, F.concat(F.lit("Genero "), "p_name")).when(k == 1, F.concat("p_name", F.lit(" género.")))
            .otherwise(F.concat(F.lit("Generos "), "p_name")))
    return part.select("p_partkey", T.spell_fix(label).alias("fixed"), T.term_fix(term).alias("agreed"))


_PAIR = """(SELECT o_orderkey, lower(o_orderpriority) || ' ' || c_name || ' ' || c_mktsegment AS a,
  c_mktsegment || ' ' || o_orderstatus || ' Customer ' || o_orderkey || ' ' || o_orderpriority AS b
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


@family.query(f"""
WITH n AS (SELECT o_orderkey, trim(regexp_replace(lower(a), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(b), '[^a-z0-9]+', ' ', 'g')) AS b FROM {_PAIR}),
ga AS (SELECT o_orderkey, g, count(*) AS n FROM (SELECT o_orderkey, unnest(list_transform(generate_series(1, len(a) - 1), lambda i: substr(a, i, 2))) AS g FROM n) GROUP BY ALL),
gb AS (SELECT o_orderkey, g, count(*) AS n FROM (SELECT o_orderkey, unnest(list_transform(generate_series(1, len(b) - 1), lambda i: substr(b, i, 2))) AS g FROM n) GROUP BY ALL),
s AS (SELECT o_orderkey, sum(least(ga.n, gb.n)) AS shared FROM ga JOIN gb USING (o_orderkey, g) GROUP BY 1)
SELECT n.o_orderkey, round(1 - levenshtein(a, b) / greatest(len(a), len(b)), 6) AS edit,
  CASE WHEN abs(len(a) - len(b)) > 2 THEN 99 ELSE levenshtein(a, b) END AS bounded,
  round(2.0 * coalesce(shared, 0) / (len(a) + len(b) - 2), 6) AS dice,
  round(len(list_filter(string_split(a, ' '), lambda t: list_contains(string_split(b, ' '), t))) / least(len(string_split(a, ' ')), len(string_split(b, ' '))), 6) AS overlap,
  round(len(list_filter(list_distinct(string_split(a, ' ')), lambda t: list_contains(string_split(b, ' '), t))) / least(len(list_distinct(string_split(a, ' '))), len(list_distinct(string_split(b, ' ')))), 6) AS overlap_set,
  len(list_filter(list_filter(string_split(regexp_replace(a, 'ficha|configuracion|matriz|reglas|formulario|solicitud|de|del|la|el', ' ', 'g'), ' '), lambda w: len(w) > 2),
    lambda w: list_contains(list_filter(string_split(regexp_replace(b, 'ficha|configuracion|matriz|reglas|formulario|solicitud|de|del|la|el', ' ', 'g'), ' '), lambda v: len(v) > 2), w))) AS affinity
FROM n LEFT JOIN s USING (o_orderkey)""")
def similarity_scores(spark, sf):
    orders = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    space = F.lit(" ")
    pairs = orders.select("o_orderkey", F.concat(F.lower("o_orderpriority"), space, "c_name", space, "c_mktsegment").alias("a"),
                          F.concat("c_mktsegment", space, "o_orderstatus", F.lit(" Customer "), "o_orderkey", space, "o_orderpriority").alias("b"))
    a, b = T.norm_words("a"), T.norm_words("b")
    return pairs.select(
        "o_orderkey", F.round(T.edit_similarity(a, b), 6).alias("edit"), T.bounded_edit(a, b).alias("bounded"),
        F.round(T.dice_bigrams("a", "b"), 6).alias("dice"), F.round(T.token_overlap("a", "b"), 6).alias("overlap"),
        F.round(T.token_overlap("a", "b", distinct=True), 6).alias("overlap_set"), T.name_affinity(a, b).alias("affinity"))
