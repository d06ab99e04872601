"""Problem 10: texts that look the same but are written with different characters, brought to one form.

A text is mapped character by character (width forms, spaces, joined letters, look-alike letters, invisible
characters) inside the JVM, after its letters have been parted from their accents (in Python, which has a function for
it): a look-alike letter composed with an accent is mapped as the same two characters are.  Mapped texts are then grouped under the accent- and case-sensitive Unicode
collation in SQL, which treats composed and decomposed accents alike and passes over ignorable characters.  Each
class has one canonical member, chosen by rule, which is joined back to all of its members.

Whole texts aren't shuffled for that: rows are first blocked by a 64-bit hash of what neither canonical equivalence nor
ignorable characters can change (letters without their accents, digits and ASCII of the mapped text, in any script), and
only one copy of each text in blocks with at least two different texts goes on, to have its accents parted and be compared.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.storage import materialize

# Letters that look like a Latin letter in common typefaces.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХЅІЈЁёЇї", "aeopcyxijshdqwABEKMHOPCTYXSIJËëÏï"))
GREEK = dict(zip("ονρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovpABEZHIKMNOPTYX"))
#: Spaces of other widths, with the no-break ones.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Characters without a mark of their own on the page.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufe00\ufe01\ufe02\ufe03\ufe04\ufe05\ufe06\ufe07\ufe08\ufe09\ufe0a\ufe0b\ufe0c\ufe0d\ufe0e\ufe0f\ufeff\uffa0"
#: Full-width and half-width forms, by the rule of the character database; joined letters of its Latin and Armenian blocks and digraphs.
FULL_WIDTH = {c: chr(int(d[1], 16)) for c in map(chr, range(0xFF01, 0xFFEF)) if (d := unicodedata.decomposition(c).split()) and d[0] in ("<wide>", "<narrow>") and c != "\uffa0"}
JOINED = {c: unicodedata.normalize("NFKC", c) for c in map(chr, [0x132, 0x133, *range(0x1C7, 0x1CD), *range(0x1F1, 0x1F4), *range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18)])}
#: Characters canonically equal to an ASCII one (Greek question mark, varia, Kelvin sign).
SINGLETONS = {"\u037e": ";", "\u1fef": "`", "\u212a": "K"}


@F.pandas_udf(T.StringType())
def decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFD", t))


@F.pandas_udf(T.StringType())
def composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def _mapped(c: Column, single: dict[str, str]) -> Column:
    single = single | SINGLETONS
    source, target = "".join(single), "".join(single.values())
    out = F.translate(_parted(c), source + SPACES + INVISIBLE, target + " " * len(SPACES))
    return F.regexp_replace(out, r"^[ \t]+|[ \t]+$", "")


def _parted(c: Column) -> Column:
    """Joined letters as the letters they stand for."""
    out = c
    for joined, letters in JOINED.items():
        out = F.replace(out, F.lit(joined), F.lit(letters))
    return F.when(c.rlike("[" + "".join(JOINED) + "]"), out).otherwise(c)


@lru_cache(maxsize=1)
def _bases() -> tuple[dict[str, str], str]:
    """Every character that is canonically composed to its one base letter, and those of marks alone; Hangul aside."""
    base, none = {}, []
    for c in map(chr, range(0x80, 0x30000)):
        d = unicodedata.decomposition(c)
        if d and d[0] != "<":
            letters = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M"]
            if len(letters) == 1:
                base[c] = letters[0]
            else:
                none.append(c)
    return base, "".join(none)


def skeleton(c: Column | str) -> Column:
    """The text with every look-alike mapped; for comparing, not for reading (Cyrillic words become mixed).

    Letters composed with accents are only mapped in a ``decomposed`` text."""
    return _mapped(F.col(c) if isinstance(c, str) else c, FULL_WIDTH | CYRILLIC | GREEK)


def plain_form(c: Column | str) -> Column:
    """The text with width forms, spaces, joined letters and invisible characters mapped; look-alike letters only in
    texts all of whose Cyrillic and Greek letters are look-alikes beside Latin ones, so that other scripts stay whole.  Letters composed with accents are only mapped in a ``decomposed`` text."""
    c = F.col(c) if isinstance(c, str) else c
    light = _mapped(c, FULL_WIDTH)
    rest = F.regexp_replace(F.translate(light, "".join(CYRILLIC | GREEK), ""), r"\p{M}+", "")
    disguised = ~rest.rlike(r"[\p{IsCyrillic}\p{IsGreek}]{2}") & light.rlike(r"\p{IsLatin}")
    return F.when(disguised, _mapped(light, CYRILLIC | GREEK)).otherwise(light)


def block(c: Column | str) -> Column:
    """Hash of a text's skeleton without anything that composing, decomposing or ignoring characters can change.

    Letters lose their accents by a table of all composed ones, other marks and signs beyond ASCII are dropped, and so
    are Hangul syllables, which decompose into several letters."""
    c = F.col(c) if isinstance(c, str) else c
    base, none = _bases()
    single = FULL_WIDTH | CYRILLIC | GREEK | SINGLETONS
    table = {x: single.get(base.get(y, y), base.get(y, y)) for x, y in (base | single).items()}
    out = F.translate(_parted(c), "".join(table) + SPACES + INVISIBLE + none, "".join(table.values()) + " " * len(SPACES))
    rest = F.regexp_replace(out, r"^[ \t]+|[ \t]+$|[^\x00-\x7f\p{L}\p{N}]+|[\u1100-\u11ff\ua960-\ua97f\uac00-\ud7ff]+", "")
    # Nothing of that happens to ASCII, so texts of nothing else are hashed as they are.
    return F.when(F.octet_length(c) == F.length(c), F.xxhash64(F.btrim(c, F.lit(" \t")))).otherwise(F.xxhash64(rest))


def lookalike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Records whose text looks like another, different text: ``key``, ``text_id``, ``class_id``, ``canonical_key``.

    ``text_id`` tells the exact texts apart, ``class_id`` the classes; ``canonical_key`` is the smallest key of the
    canonical text (the one that is its own mapped form, else the one of smallest key; how accents are composed does
    not count for that).

    Defined results: a null text, or one under a null key, belongs to no class; empty texts, and texts of nothing but invisible characters and
    spaces, look alike and form one class; exact copies have one ``text_id`` and are a class only together with a
    differing text; texts of any length are compared whole; an empty frame gives an empty one; other columns of
    ``df`` are ignored, whatever their names.
    """
    base = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("k").isNotNull() & F.col("t").isNotNull()).withColumn("text_id", F.md5("t"))
    narrow = materialize(base.select("k", "text_id", block("t").alias("b")), "lookalike-blocks")
    several = narrow.groupBy("b").agg(F.min("text_id").alias("lo"), F.max("text_id").alias("hi")).filter("lo <> hi").select("b")
    near_keys = materialize(narrow.join(several, "b", "left_semi").select("k", "text_id").distinct(), "lookalike-near")
    # One copy of each text is mapped and compared, however many there are.
    first = near_keys.groupBy("text_id").agg(F.min("k").alias("k"))
    near = base.join(first, ["k", "text_id"]).withColumn("d", decomposed("t")).withColumn("m", skeleton("d"))
    texts = near.select("text_id", F.col("k").alias("first_key"), composed("m").alias("s"), (F.col("m") == F.col("d")).alias("plain")).dropDuplicates(["text_id"])
    texts = materialize(texts, "lookalike-texts")
    texts.createOrReplaceTempView("lectern_lookalike_texts")
    members = df.sparkSession.sql(
        """
        WITH classes AS (
          SELECT min(s) AS s, min_by(text_id, (NOT plain, first_key)) AS canonical_text, min_by(first_key, (NOT plain, first_key)) AS canonical_key
          FROM lectern_lookalike_texts GROUP BY s COLLATE UNICODE HAVING count(*) > 1)
        SELECT t.text_id, c.canonical_text AS class_id, c.canonical_key
        FROM lectern_lookalike_texts t JOIN classes c ON t.s COLLATE UNICODE = c.s COLLATE UNICODE
        """
    )
    members = materialize(members, "lookalike-members")
    return near_keys.join(members, "text_id").select(F.col("k").alias(key), "text_id", "class_id", "canonical_key")


def lookalike_pairs(members: DataFrame, key: str) -> DataFrame:
    """All pairs of records of one class whose texts differ, smaller key first."""
    a, b = members.select("class_id", F.col(key).alias("a"), F.col("text_id").alias("ta")), members.select("class_id", F.col(key).alias("b"), F.col("text_id").alias("tb"))
    pairs = a.join(b, "class_id").filter((F.col("a") < F.col("b")) & (F.col("ta") != F.col("tb")))
    return pairs.select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"))
