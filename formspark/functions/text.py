"""Text normalisation, naming and similarity expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from formspark import constants as K

# White space as the original data uses it: ASCII plus the Unicode spaces.
_SPACES = (" \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
           + "\u2028\u2029\u202f\u205f\u3000\ufeff")
WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def outside(ranges: str, others: str = "") -> str:
    """Class of all characters but those in ``ranges`` ("a-z0-9") and ``others``, written as what it holds. In a
    negated class of three or more parts Java checks a type for each character, which the threads of an
    executor contend for: ten times as long."""
    kept = sorted({c for low, high in zip(ranges[::3], ranges[2::3], strict=True) for c in range(ord(low), ord(high) + 1)} | {*map(ord, others)})
    gaps = [(low + 1, high - 1) for low, high in zip([-1, *kept], [*kept, 0x110000], strict=True) if high - low > 1]
    return "[" + "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in gaps) + "]"


_CAPITALS = "ÁÉÍÓÚÑÜ"


def _accent_table() -> tuple[str, str]:
    """Latin letters that decompose to a base plus combining marks, and the marks."""
    source, target = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all(0x300 <= ord(m) <= 0x36F for m in marks):
            source.append(chr(code))
            target.append(base)
    return "".join(source) + "".join(map(chr, range(0x300, 0x370))), "".join(target)


_FROM, _TO = _accent_table()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def let(value: Column, body) -> Column:
    """Bind a value once; without it a lambda would evaluate the expression per element."""
    return F.transform(F.array(value), body)[0]


def trim(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(_SPACES))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def or_else(*cols: Column) -> Column:
    """The first value that is neither NULL nor empty; '' when there is none."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def strip_accents(c: Column | str) -> Column:
    return F.translate(col(c), _FROM, _TO)


def squeeze(c: Column) -> Column:
    return replace(c, WS + "+", " ")


def fold(c: Column | str) -> Column:
    """lower case, no accents, single spaces, trimmed"""
    return F.trim(squeeze(strip_accents(F.lower(text_or_empty(c)))))


def fold_upper(c: Column | str) -> Column:
    return F.upper(strip_accents(F.trim(squeeze(text_or_empty(c)))))


def _plain(c: Column | str) -> Column:
    return strip_accents(F.lower(text_or_empty(c)))


def norm_words(c: Column | str) -> Column:
    """folded words; anything that is not a letter, digit or space becomes a space"""
    return F.trim(replace(_plain(c), "[^a-z0-9]+", " "))


def norm_compact(c: Column | str) -> Column:
    """folded words; other characters are removed, not turned into spaces"""
    kept = replace(squeeze(_plain(c)), outside("a-z0-9", " ") + "+", "")
    return F.trim(replace(kept, "  +", " "))


def key_slug(c: Column | str, drop_index: bool = False) -> Column:
    plain = _plain(c)
    if drop_index:
        plain = replace(plain, r"\[\d+\]", "")
    return F.btrim(replace(plain, "[^a-z0-9]+", "_"), F.lit("_"))


def slug_n(c: Column | str, size: int | None, default: Column | str = "x") -> Column:
    """key slug, cut to ``size`` characters if one is given"""
    default = F.lit(default) if isinstance(default, str) else default
    slug = key_slug(c) if size is None else F.substring(key_slug(c), 1, size)
    return F.coalesce(F.nullif(slug, F.lit("")), default)


def slugify(c: Column | str) -> Column:
    kept = replace(replace(trim(_plain(c)), WS + "+", "_"), outside("a-z0-9", "_") + "+", "")
    return replace(replace(kept, "__+", "_"), "^_|_$", "")


def name_loose(c: Column | str, fold_vowels: bool = True) -> Column:
    bare = replace(F.lower(text_or_empty(c)), WS[:-1] + r"._\-]+", "")
    return F.translate(bare, "áàäéèëíìïóòöúùüñ", "aaaeeeiiiooouuun") if fold_vowels else bare


def as_id(c: Column | str) -> Column:
    """identifier form; accented letters are *not* folded, they become ``_``"""
    return F.btrim(replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def camel_to_snake(c: Column | str, style: str = "every") -> Column:
    """``every``: each capital starts a word. ``border``: only a lower-upper border does
    (other marks become ``_``). ``acronym``: also ends a run of capitals."""
    c = text_or_empty(c)
    if style == "every":
        return replace(replace(F.lower(replace(c, "([A-Z])", "_$1")), "^_", ""), "_+", "_")
    if style == "border":
        split = replace(replace(c, "([a-z])([A-Z])", "$1_$2"), outside("a-zA-Z0-9", "áéíóúñÁÉÍÓÚÑ") + "+", "_")
        return F.translate(F.lower(replace(split, "^_|_$", "")), "áéíóúñ", "aeioun")
    split = replace(replace(c, "([a-z])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return replace(replace(F.lower(split), "[^a-z0-9]+", "_"), "^_|_$", "")


def simplify_slug(slug: Column, limit: int = K.MAX_SLUG) -> Column:
    """a slug over the limit loses its stop words; still too long, it keeps three words"""
    kept = F.filter(F.split(slug, "_"), lambda w: ~w.isin(*K.SLUG_STOP_WORDS))
    short = let(kept, lambda k: let(F.array_join(k, "_"), lambda j: F.when(F.length(j) <= limit, j).otherwise(
        F.array_join(F.slice(k, 1, 3), "_"))))
    return F.when(F.length(slug) <= limit, slug).otherwise(short)


def sanitize_name(c: Column | str, size: int = 80, default: str = "unnamed") -> Column:
    clean = replace(_plain(c), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.substring(replace(clean, "^_|_$", ""), 1, size), F.lit("")), F.lit(default))


def humanize(c: Column | str) -> Column:
    spaced = replace(replace(text_or_empty(c), "([a-z0-9])([A-Z])", "$1 $2"), "_+", " ")
    return F.trim(squeeze(spaced))


def title_case(c: Column | str) -> Column:
    """show ``_`` as a space; upper-case the first ASCII letter of every word"""
    def cap(w: Column) -> Column:
        lead = F.regexp_extract(w, "^[^A-Za-z0-9_]*", 0)
        rest = F.substring(w, F.length(lead) + 1, F.length(w))
        return F.concat(lead, F.upper(F.substring(rest, 1, 1)), F.lower(F.substring(rest, F.lit(2), F.length(w))))
    return F.array_join(F.transform(F.split(replace(text_or_empty(c), "_", " "), " "), cap), " ")


def clean_label(c: Column | str, drop_number: bool = False) -> Column:
    """drop a row suffix (and a plain number) and a trailing colon, show ``_`` as a space"""
    bare = replace(text_or_empty(c), r"(?i)_Row_\d+$", "")
    if drop_number:
        bare = replace(bare, r"_\d+$", "")
    bare = replace(bare, ":_?$", "")
    return trim(F.translate(bare, "_", " "))


def capitalize(c: Column) -> Column:
    """capitalise the words of a label that is all upper or all lower case; word borders
    are ASCII, so a letter after an accented one also starts a word"""
    chars = F.split(c, "")

    def cap(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.substring(c, i, F.lit(1))).otherwise(F.lit(" "))
        return F.when(x.rlike("[A-Za-z0-9_]") & ~before.rlike("[A-Za-z0-9_]"), F.upper(x)).otherwise(x)

    return F.when((c == F.upper(c)) | (c == F.lower(c)), F.array_join(F.transform(chars, cap), "")).otherwise(c)


# ---- similarity -----------------------------------------------------------------

def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b) / longest)


def bounded_edit(a: Column, b: Column, most: int = 2, over: int = 99) -> Column:
    """edit distance; ``over`` when the lengths already differ by more than ``most``"""
    return F.when(F.abs(F.length(a) - F.length(b)) > most, F.lit(over)).otherwise(F.levenshtein(a, b))


def _bigrams(c: Column) -> Column:
    return F.when(F.length(c) > 1, F.transform(F.sequence(F.lit(1), F.length(c) - 1),
                                               lambda i: F.substring(c, i, F.lit(2)))).otherwise(
        F.array().cast("array<string>"))


def dice_bigrams(a: Column | str, b: Column | str) -> Column:
    """Dice coefficient over bigram multisets of the normalised texts"""
    def count(grams: Column, gram: Column) -> Column:
        return F.size(F.filter(grams, lambda x: x == gram))

    def shared(g: Column) -> Column:
        return F.aggregate(F.array_distinct(g.ga), F.lit(0),
                           lambda acc, x: acc + F.least(count(g.ga, x), count(g.gb, x)))

    def score(n: Column) -> Column:
        grams = F.struct(_bigrams(n.a).alias("ga"), _bigrams(n.b).alias("gb"))
        ratio = let(grams, lambda g: F.lit(2.0) * shared(g) / F.greatest(F.size(g.ga) + F.size(g.gb), F.lit(1)))
        return F.when((n.a == "") | (n.b == ""), F.lit(0.0)).when(n.a == n.b, F.lit(1.0)).otherwise(ratio)

    return let(F.struct(norm_words(a).alias("a"), norm_words(b).alias("b")), score)


def token_overlap(a: Column | str, b: Column | str, distinct: bool = False) -> Column:
    """shared tokens over the shorter token count; repeated tokens count unless distinct"""
    def tokens(c: Column | str) -> Column:
        words = F.filter(F.split(norm_words(c), " "), lambda w: w != "")
        return F.array_distinct(words) if distinct else words

    def score(t: Column) -> Column:
        shared = F.size(F.filter(t.a, lambda x: F.array_contains(t.b, x)))
        return shared / F.greatest(F.least(F.size(t.a), F.size(t.b)), F.lit(1))

    return let(F.struct(tokens(a).alias("a"), tokens(b).alias("b")), score)


def name_words(c: Column | str) -> Column:
    """words of a file name that say something about its subject"""
    bare = replace(trim(_plain(c)), r"\.[a-z0-9]+$", "")
    bare = replace(bare, "|".join(K.FILE_NOISE_WORDS), " ")
    return F.filter(F.split(bare, "[^a-z0-9]+"), lambda w: F.length(w) > 2)


def name_affinity(a: Column | str, b: Column | str) -> Column:
    return let(F.struct(name_words(a).alias("a"), name_words(b).alias("b")),
               lambda w: F.size(F.filter(w.a, lambda x: F.array_contains(w.b, x))))


# ---- vocabulary fixes -------------------------------------------------------------

def _swap(c: Column, words: dict[str, str]) -> Column:
    fixed = c
    for wrong, right in words.items():
        # word borders are ASCII: an accented letter next to the word is a border
        fixed = replace(fixed, f"(?<![A-Za-z0-9_]){wrong}(?![A-Za-z0-9_])", right)
    return F.when(fixed != c, fixed)


def spell_fix(c: Column | str) -> Column:
    """the text with its missing accents, NULL when nothing changes"""
    return _swap(col(c), K.SPELLING)


def term_fix(c: Column | str) -> Column:
    """the text with the agreed terms, NULL when nothing changes"""
    return _swap(col(c), {w: r for w, r in K.TERMS.items()})


# ---- tests on text -------------------------------------------------------------------

def looks_like_heading(c: Column | str) -> Column:
    """at least five characters, at least 70% of its letters upper case"""
    t = trim(col(c))
    letters = replace(t, outside("A-Za-z", _CAPITALS) + "+", "")
    upper = replace(letters, outside("A-Z", _CAPITALS) + "+", "")
    return (F.length(t) >= 5) & (F.length(letters) > 0) & (F.length(upper) / F.greatest(F.length(letters), F.lit(1)) >= 0.7)


def _capitals_only(t: Column, letters: str, least: int, share: float) -> Column:
    """``least`` or more of these letters, more than ``share`` of the text, and none of them lower case: few texts get
    past that, so that letters are counted for few (and in one place, or Spark would count them first for all)"""
    kept = F.length(replace(t, outside("A-Za-z", letters) + "+", ""))
    return (F.length(t) >= least) & ~t.rlike("[a-z" + _CAPITALS.lower() + "]") & (kept > F.greatest(F.lit(least - 1.0), F.length(t) * share))


def is_section_header(c: Column | str) -> Column:
    """ten or more characters, mostly letters and blanks, all upper case"""
    return _capitals_only(trim(col(c)), _CAPITALS + _CAPITALS.lower() + _SPACES, 10, 0.6)


def is_context_heading(c: Column | str) -> Column:
    return _capitals_only(trim(col(c)), _CAPITALS + _CAPITALS.lower(), 5, 0.5)


def is_bad_label(c: Column | str) -> Column:
    t = trim(text_or_empty(c))
    return (F.length(t) <= 1) | t.rlike("^[A-ZÁÉÍÓÚÑÜ" + WS[1:-1] + "]{15,}$")


def is_placeholder(c: Column | str) -> Column:
    return trim(F.lower(text_or_empty(c))).isin("", "no se llena en pdf", "no aplica", "n/a", "-")


def is_junk_value(c: Column | str) -> Column:
    return strip_accents(trim(F.lower(text_or_empty(c)))).isin("no", "n/a", "-", "na", "no aplica", "ninguna")


def is_noise_name(c: Column | str) -> Column:
    """proposed names that are a sentence of the form, not a field"""
    c = text_or_empty(c)
    return (F.length(c) >= 35) & (c.rlike(K.NOISE_CONNECTORS) | c.rlike("|".join(K.NOISE_PHRASES)))


def is_noise_source(c: Column | str) -> Column:
    low = F.lower(text_or_empty(c))
    return (F.length(low) > 50) | low.rlike("|".join(K.SOURCE_NOISE_PHRASES))


def is_dirty_value(value: Column | str, old_name: Column | str) -> Column:
    t = trim(text_or_empty(value))
    return (t != "") & (t.isin(*K.DIRTY_VALUES) | (t == text_or_empty(old_name))
                        | t.rlike(r"(?i)^Text\d|^Check\s*Box|^Combo\s*Box|^Radio\s*Button"))
