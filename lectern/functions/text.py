"""Text functions as column expressions; the JVM evaluates all but Unicode folding and entity decoding."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.columns import as_column

# Fixed patterns.
WORD = r"\p{L}+(?:['’\-]\p{L}+)*"
SENTENCE = r"[.!?]+(?:[\"'”’)}\]]+)?(?=\s|$)"
TAG = r"</?[A-Za-z][\w:.\-]*(?:\s[^<>]*)?>"
TEX_MATH = r"\$[^$]*\\[^$]*\$"
TEX_COMMAND = r"\\[A-Za-z]+"
# Fixed patterns of secret-like values: an assignment to a telling name, two forms of service keys, a private key.
SECRETS = (
    r"(?i)(?:api[_-]?key|access[_-]?token|auth[_-]?token|password|secret)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9_./+=-]{6,}",
    r"\bsk-[A-Za-z0-9_-]{16,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
)


def _accents() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by the decomposition rule."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    kept = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


ACCENTED, PLAIN = _accents()


@F.pandas_udf(T.StringType())
def fold(texts: pd.Series) -> pd.Series:
    """NFKC and casefold, which the JVM has no function for."""
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(T.StringType())
def decode_entities(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else html.unescape(t))


def tokens(c: Column | str) -> Column:
    """Words: letters, with inner apostrophes and hyphens; lower case."""
    return F.regexp_extract_all(F.lower(as_column(c)), F.lit(WORD), F.lit(0))


def sentence_count(c: Column | str) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(as_column(c), F.lit(SENTENCE)))


def syllable_count(ws: Column) -> Column:
    """Vowel groups of each word, accents dropped, a silent final e left out, at least 1 a word; summed."""

    def one(w: Column) -> Column:
        letters = F.regexp_replace(F.translate(w, ACCENTED, PLAIN), r"[^\p{L}]", "")
        groups = F.regexp_count(letters, F.lit("[aeiouy]+"))
        silent = letters.endswith("e") & ~letters.endswith("le") & ~letters.endswith("ye") & (groups > 1)
        return F.greatest(F.lit(1), groups - silent.cast("int"))

    return F.aggregate(ws, F.lit(0), lambda a, w: a + one(w))


def text_syllable_count(c: Column | str) -> Column:
    """The syllables of all words of a text: the same number as ``syllable_count(tokens(c))`` in a few regex passes.

    Vowel groups, plus one for each word without any, less one for each word of several groups that ends in a silent e.
    """
    t = F.regexp_replace(F.translate(F.lower(as_column(c)), ACCENTED, PLAIN), r"(?<=\p{L})['’\-](?=\p{L})", "")
    groups = F.regexp_count(t, F.lit("[aeiouy]+"))
    bare = F.regexp_count(t, F.lit(r"(?<!\p{L})(?:(?![aeiouy])\p{L})++(?!\p{L})"))
    silent = F.regexp_count(t, F.lit(r"(?<!\p{L})(?:(?![aeiouy])\p{L})*+[aeiouy]++(?:(?![aeiouy])\p{L})\p{L}*+(?<![ly]e)(?<=e)"))
    return groups + bare - silent


def flesch_kincaid(words: Column, sentences: Column, syllables: Column) -> Column:
    return F.greatest(F.lit(0.0), 0.39 * (words / sentences) + 11.8 * (syllables / words) - 15.59)


def phrase_count(ws: Column, phrase: str) -> Column:
    """Places at which the words of ``phrase`` follow each other, overlapping ones too."""
    parts = phrase.split()
    if len(parts) == 1:
        return F.size(F.filter(ws, lambda w: w == parts[0]))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ws) - len(parts) + 1, F.lit(1))), lambda i: F.slice(ws, i, len(parts)) == F.array(*map(F.lit, parts)))
    return F.when(F.size(ws) >= len(parts), F.size(places)).otherwise(0)


def strip_markup(c: Column | str, entities: bool = True) -> Column:
    """Tags, TeX with a command in it, TeX commands and entities removed, white space collapsed."""
    t = as_column(c)
    for pattern in (TAG, TEX_MATH, TEX_COMMAND):
        t = F.regexp_replace(t, pattern, " ")
    t = decode_entities(t) if entities else t
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def word_count(c: Column | str) -> Column:
    """Pieces between white space; 0 for blank text."""
    t = F.regexp_replace(as_column(c), r"(?U)^\s+|\s+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"(?U)\s+")))


def doi(c: Column | str) -> Column:
    """A DOI without resolver or scheme, lower case; blank is null."""
    bare = F.regexp_replace(F.lower(F.trim(as_column(c))), r"^(?:https?://[^/]+/|doi:\s*)", "")
    return F.nullif(F.trim(bare), F.lit(""))


def title_key(c: Column | str) -> Column:
    """Letters and digits of a title in lower case, single blanks between words; blank is null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(as_column(c)), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def inverted_index(c: Column | str) -> Column:
    """map word -> positions of a text split at blanks."""
    ws = F.split(as_column(c), " ")
    at = F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    return F.map_from_entries(F.transform(F.array_distinct(ws), lambda w: F.struct(w, F.transform(F.filter(at, lambda x: x["w"] == w), lambda x: x["i"]))))


def text_of_index(index: Column | str) -> Column:
    """The text of an inverted index: an empty map is empty text, null stays null; a position that is negative or taken twice is an error."""
    entries = F.flatten(F.transform(F.map_entries(as_column(index)), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    ordered = F.array_sort(entries)
    positions = F.transform(ordered, lambda x: x["p"])
    bad = (F.size(F.array_distinct(positions)) < F.size(positions)) | F.exists(positions, lambda p: p < 0)
    joined = F.array_join(F.transform(ordered, lambda x: x["w"]), " ")
    return F.when(as_column(index).isNull(), None).when(bad, F.raise_error(F.lit("positions of an inverted index must be unique and not negative"))).otherwise(joined)


def scrub(c: Column, names: Column, mask: str) -> Column:
    """Whole-word names (an array; longest first, any case, optional 's) replaced by ``mask``."""
    longest = F.array_sort(names, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.aggregate(longest, c, lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?iu)(?<!\w)\Q"), n, F.lit(r"\E(?:['’]s)?(?!\w)")), F.lit(mask)))


def any_secret(c: Column | str) -> Column:
    out = F.lit(False)
    for pattern in SECRETS:
        out = out | F.coalesce(as_column(c).rlike(pattern), F.lit(False))
    return out


def json_object(c: Column | str) -> Column:
    """The outermost JSON object in a reply that may have a code fence or prose around it, as a variant; else null."""
    return F.try_parse_json(F.regexp_extract(as_column(c), r"(?s)(\{.*\})", 1))


def landis_koch(kappa: Column) -> Column:
    return F.when(kappa.isNull(), None).when(kappa < 0, "poor").when(kappa < 0.21, "slight").when(kappa < 0.41, "fair").when(kappa < 0.61, "moderate").when(kappa < 0.81, "substantial").otherwise("almost perfect")
