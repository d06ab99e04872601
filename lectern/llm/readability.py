"""Problem 4: reading level by a familiar-word formula on the scale of a given school grade.

The formula is linear in the share of words outside a list of familiar words and the mean sentence length.  The list
holds the words of high document frequency among texts that are graded easy (and not much more frequent among the
others): at rate ``c`` it has at most (mean distinct words per easy text) / c words, so it stays small however large
the corpus is.  Document frequencies cover all graded texts; the three coefficients are fitted, with outlying grades
left out in turn, on a bounded sample of graded rows.  Without graded texts the list is that of the whole corpus and
the coefficients are fixed ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns: words, and the marks that end a sentence.
WORD = r"\p{L}+(?:['’\-]\p{L}+)*"
SENTENCE_END = r"[.!?]+[\"'’”)}\]]*(?=\s|$)"
#: Tags that stand for a paragraph or line of their own.
_BREAK = r"(?i)</?(?:p|br|div|li|ul|ol|tr|h[1-6]|title|sec)\b[^<>]*>"
_TAG = r"</?[A-Za-z][\w:.\-]*(?:\s[^<>]*)?/?>"

FAMILIAR_RATE = 0.01
EASY_GRADE = 8.0
#: Graded rows the coefficients are fitted on at most; word counts have no such bound.
FIT_ROWS = 20_000
#: Used where no text is graded: intercept, share of unfamiliar words, words per sentence.
DEFAULT_FORMULA = (0.0, 15.79, 0.0496)


def lines(text: Column | str) -> Column:
    """Sentence-like lines: markup dropped, broken at paragraph tags and line breaks, blank ones left out."""
    t = F.col(text) if isinstance(text, str) else text
    t = F.regexp_replace(F.regexp_replace(t, _BREAK, "\n"), _TAG, " ")
    return F.filter(F.split(t, r"[\r\n\x0b\x0c\x85  ]+"), lambda x: x.rlike(r"\p{L}"))


def words(text_lines: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.array_join(text_lines, "\n")), F.lit(WORD), F.lit(0))


def sentences(text_lines: Column) -> Column:
    """Sentence ends, the end of every line among them; at least 1."""
    one = lambda x: F.regexp_count(x, F.lit(SENTENCE_END)) + F.when(x.rlike(r"[.!?]+[\"'’”)}\]]*\s*$"), 0).otherwise(1)
    return F.greatest(F.aggregate(F.transform(text_lines, one), F.lit(0), lambda a, b: a + b), F.lit(1))


def text_shape(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``words`` and ``sentences``; rows without any word are dropped."""
    shaped = df.withColumn("__lines", lines(text)).withColumns({"words": words(F.col("__lines")), "sentences": sentences(F.col("__lines"))})
    return shaped.drop("__lines").filter(F.size("words") > 0)


def familiar_words(shaped: DataFrame, grade: str) -> frozenset[str]:
    """Words in at least FAMILIAR_RATE of the texts graded easy, and there at least half as often as in the others."""
    g = F.col(grade)
    side = F.when(g.isNull() | F.isnan(g), None).otherwise(g <= EASY_GRADE)
    flagged = shaped.select("words", side.alias("easy"))
    sizes = flagged.agg(F.count("*").alias("n"), F.count_if("easy").alias("easy"), F.count_if(~F.col("easy")).alias("hard")).first()
    each = flagged.select(F.explode(F.array_distinct("words")).alias("w"), "easy").groupBy("w").agg(F.count("*").alias("n"), F.count_if("easy").alias("easy"), F.count_if(~F.col("easy")).alias("hard"))
    if sizes["easy"]:
        rate = F.col("easy") / F.lit(sizes["easy"])
        kept = each.filter((rate >= FAMILIAR_RATE) & (rate >= 0.5 * F.col("hard") / F.lit(max(1, sizes["hard"]))))
    else:
        kept = each.filter(F.col("n") >= FAMILIAR_RATE * max(1, sizes["n"]))
    return frozenset(r["w"] for r in kept.select("w").collect())


def _shares(familiar, keep: list[str]):
    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sorted(familiar.value), pa.string())
        for b in batches:
            lists = b.column("words")
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)  # rows without words were dropped
            out = ~pc.is_in(lists.flatten(), value_set=known).to_numpy(zero_copy_only=False)
            unfamiliar = np.add.reduceat(out.astype(np.int64), np.cumsum(n) - n) if len(n) else np.zeros(0)
            arrays = [pa.array(n.astype(np.int32)), pa.array(unfamiliar / n), pa.array(n / b.column("sentences").to_numpy())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *arrays], names=[*keep, "n_words", "unfamiliar", "sentence_length"])

    return shares


def formula_features(shaped: DataFrame, familiar: frozenset[str], keep: list[str]) -> DataFrame:
    """``keep`` with ``n_words``, ``unfamiliar`` and ``sentence_length``."""
    held = shaped.sparkSession.sparkContext.broadcast(familiar)
    types = ", ".join(f"`{c}` {shaped.schema[c].dataType.simpleString()}" for c in keep)
    return shaped.select(*dict.fromkeys([*keep, "words", "sentences"])).mapInArrow(_shares(held, keep), f"{types}, n_words int, unfamiliar double, sentence_length double")


def fit_formula(features: DataFrame, grade: str, key: str) -> tuple[tuple[float, float, float], float]:
    """Coefficients and the robust spread of their errors, from at most FIT_ROWS graded rows (smallest key hashes)."""
    g = F.col(grade)
    rows = features.filter(g.isNotNull() & ~F.isnan(g)).orderBy(F.xxhash64(key), key).limit(FIT_ROWS).select("unfamiliar", "sentence_length", g.alias("g")).toPandas()
    if len(rows) < 8:
        return DEFAULT_FORMULA, 3.0
    x = np.column_stack([np.ones(len(rows)), rows["unfamiliar"], rows["sentence_length"]])
    y, used = rows["g"].to_numpy(float), np.ones(len(rows), bool)
    spread = 3.0
    for _ in range(12):
        beta = np.linalg.lstsq(x[used], y[used], rcond=None)[0]
        error = np.abs(y - x @ beta)
        spread = max(1.4826 * float(np.median(error)), 0.25)
        again = error <= 2.5 * spread
        if again.sum() < 8 or (again == used).all():
            break
        used = again
    return (float(beta[0]), float(beta[1]), float(beta[2])), spread


def formula_grade(coefficients: tuple[float, float, float]) -> Column:
    a, b, c = coefficients
    return F.greatest(F.lit(0.0), F.lit(a) + F.lit(b) * F.col("unfamiliar") + F.lit(c) * F.col("sentence_length"))
