"""Problem 5: variant spellings of personal names, linked to the people they stand for.

Names are parsed into given name, initials and family name (titles, order, case, accents, joined or split parts).
Family names are looked up by MinHash banding over padded q-grams.  How many bands a name has follows from the collision
curve: as many as give the wanted recall at the least similarity that the verification still accepts for a name of its
length.  Very short names would need hundreds; those meet exactly, on what is left of both with one letter deleted.
Postings are a band key, a hash of the name and a small signature of its q-grams; nothing else is shuffled, and a bucket
of very many names is split into pairs of blocks.  Candidates are verified by a Monge-Elkan similarity over the tokens
of both names, and linked profiles are clustered by stars: a profile that no better linked neighbour outranks is a
centre, its neighbours go to the centre they resemble most.  Other entries go to the one star they resemble most, or to
none where two fit equally well.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache, reduce
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.blocks import bucket_pairs
from lectern.storage import materialize

# Common short forms of given names (the default of a parameter), and titles.
SHORT_FORMS = {
    "alexander": "alex sasha sandy xander", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny benji", "catherine": "cathy cate",
    "charles": "charlie chuck", "christopher": "chris kit", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "edward": "ed eddie ned ted",
    "elizabeth": "liz lizzie beth betty eliza", "francesca": "fran cesca", "frederick": "fred freddie freddy", "gabriel": "gabe", "james": "jim jimmy jamie",
    "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon", "joseph": "joe joey", "katherine": "kate katie kathy", "lawrence": "larry",
    "margaret": "maggie meg peggy", "matthew": "matt", "michael": "mike mick mickey", "nicholas": "nick nicky", "patricia": "pat patty trish tricia",
    "peter": "pete", "philip": "phil", "rebecca": "becky becca", "richard": "rick dick rich richie", "robert": "rob bob bobby robbie", "ronald": "ron ronnie",
    "samuel": "sam sammy", "stephen": "steve", "steven": "steve", "susan": "sue susie suzy", "theodora": "thea dora", "theodore": "theo ted",
    "thomas": "tom tommy", "victoria": "vicky tori", "william": "will bill billy willy", "bjorn": "bjoern",
}


def full_forms(short_forms: Mapping[str, str]) -> dict[str, str]:
    """Each short form's full form, of a table from full form to its short ones."""
    return {short: full for full, all_short in short_forms.items() for short in all_short.split()}


FULL_FORM = full_forms(SHORT_FORMS)
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame".split())
#: A word in at least this share of the distinct names is taken for a given name; so there are few of them at any size.
GIVEN_RATE = 0.001
#: Recall wanted of banding, rows of a band, letters of a q-gram.
RECALL, ROWS, GRAM = 0.985, 4, 2
#: Letters up to which names are looked up by deletions, and from which two errors are accepted instead of one.
SHORT, TWO_ERRORS = 8, 12
#: Fewest letters of a name in which an error is accepted.
LEAST_LETTERS = 5
#: Names of a bucket that one task compares with each other or with as many others.
BLOCK = 2000
LEAST_MONGE_ELKAN = 0.85


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` rows that let pairs of this similarity meet with this probability: 1 - (1 - s^r)^b >= recall."""
    return max(1, ceil(log(1 - recall) / log(1 - similarity**rows)))


def changed_grams(letters: int) -> int:
    """Q-grams of a name that the accepted errors change at most: a swap, or two other errors in a longer name."""
    return 2 * GRAM if letters >= TWO_ERRORS else GRAM + 1


def least_similarity(letters: int) -> float:
    """Least similarity of the q-gram sets of a name of this length and one accepted as its spelling."""
    grams, changed = letters + GRAM - 1, changed_grams(letters)
    if letters == TWO_ERRORS - 1:  # beside the longer name: one letter more and another changed
        return (grams - changed) / (grams + changed + 1)
    return max(grams - changed, 1) / (grams + changed)


def bands_of_length(letters: int) -> int:
    return bands_for(least_similarity(letters), RECALL, ROWS)


def words_of(name: str) -> list[list[str]]:
    """Folded words before and after the first comma, titles left out."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).casefold().replace("ø", "o").replace("ł", "l")
    return [[w for w in re.findall(r"[^\W\d_]+", part) if w not in TITLES] for part in plain.split(",", 1)]


class GivenNames:
    """Given names met often (with their counts) and listed ones; reads a word as the full form of one."""

    def __init__(self, counts: Mapping[str, int], full: Mapping[str, str] = FULL_FORM) -> None:
        self.counts, self.full = dict(counts), dict(full)
        self.listed = self.full.keys() | set(self.full.values())
        self.known = self.counts.keys() | self.listed
        self.read = lru_cache(maxsize=100_000)(self._read)

    def _read(self, given: str) -> str:
        """The full form; a word that is one typing error away from exactly one known given name is read as that."""
        if given in self.full or given in self.known or len(given) < 4:
            return self.full.get(given, given)
        near = {self.full.get(g, g) for g in self.known if len(g) > 3 and one_error(given, g)}
        return near.pop() if len(near) == 1 else given


def parse_name(name: str, givens: GivenNames) -> tuple[str, str, str, str]:
    """(given name in full form or an initial, initial as typed, further initials, family name); parts may be empty.

    In a name without a comma the given name is a known one (a listed one, then the commonest by its count, then the
    first), else an initial, else the first word.  All other words of more than one letter are the family name, joined.
    """
    parts = words_of(name)
    if len(parts) == 2 and parts[0] and parts[1]:
        given, family, rest = parts[1][0], parts[0], parts[1][1:]
    else:
        words = [w for p in parts for w in p]
        long = [w for w in words if len(w) > 1]
        known = [w for w in long if w in givens.known]
        single = [w for w in words if len(w) == 1]
        if len(long) > 1 and known:
            given = max(known, key=lambda w: (w in givens.listed, givens.counts.get(w, 0)))
        elif single and (len(long) == 1 or words[0] in single):
            given = single[0]
        elif long:
            given = long[0] if len(long) > 1 else ""
        else:
            given = single[0] if single else ""
        left = list(words)
        if given:
            left.remove(given)
        family, rest = [w for w in left if len(w) > 1], [w for w in left if len(w) == 1]
    return givens.read(given), given[:1], "".join(w[0] for w in rest), "".join(family)


def one_error(a: str, b: str) -> bool:
    """At most one letter more, less or different, or two neighbours swapped."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == short[i:]


def family_spellings(family: str) -> list[str]:
    """The name as it is, and with ae, oe, ue and aa written as one letter where it has them (either may be meant)."""
    return list(dict.fromkeys([family, re.sub("([aou])e|aa", lambda m: m[1] or "a", family)]))


def _parse(givens, full: Mapping[str, str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = GivenNames(givens.value, full)
        for f in frames:
            rows = []
            for n in f["name"]:
                given, typed, middle, family = parse_name(n, known)
                rows += [(n, given, typed, middle, spelling) for spelling in family_spellings(family)]
            yield pd.DataFrame(rows, columns=["name", "given", "typed", "middle", "family"], dtype=object)

    return run


def _words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"word": [w for n in f["name"] for p in words_of(n) for w in set(p) if len(w) > 1]}, dtype=object)


def parsed_names(names: DataFrame, short_forms: Mapping[str, str] = SHORT_FORMS) -> DataFrame:
    """(name, given, typed, middle, family, form) of the distinct values of ``names.name``, a row for each spelling of the
    family name; those without one are dropped.  ``short_forms`` has the short forms of given names by their full one."""
    full = FULL_FORM if short_forms is SHORT_FORMS else full_forms(short_forms)
    distinct = materialize(names.select("name").filter("name IS NOT NULL").distinct(), "names-distinct")
    least = max(8, int(GIVEN_RATE * distinct.count()))
    counted = distinct.mapInPandas(_words, "word string").groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    givens = {r["word"]: r["n"] for r in counted.collect()}  # at most words per name / GIVEN_RATE
    parsed = distinct.mapInPandas(_parse(names.sparkSession.sparkContext.broadcast(givens), full), "name string, given string, typed string, middle string, family string")
    return parsed.filter("family <> ''").withColumn("form", F.concat_ws("|", "given", "typed", "middle", "family"))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def _seeds(n: int) -> np.ndarray:
    return _mix(_mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, name, sig) of a batch of (name, family): a row for each band of the family name."""
    for b in batches:
        for part in (b.slice(i, 2048) for i in range(0, b.num_rows, 2048)):
            family = part.column("family").to_pylist()
            name = part.column("name").to_numpy()
            padded = ["#" * (GRAM - 1) + f + "#" * (GRAM - 1) for f in family]
            size = np.array([len(p) - GRAM + 1 for p in padded])
            flat = _mix(np.fromiter((hash_gram(p[i : i + GRAM]) for p in padded for i in range(len(p) - GRAM + 1)), np.uint64, int(size.sum())))
            start = np.cumsum(size) - size
            sig = np.bitwise_or.reduceat(np.uint64(1) << (flat % np.uint64(63)), start).view(np.int64)
            sig[np.array([len(f) >= TWO_ERRORS for f in family])] |= np.int64(-(1 << 63))  # the sign tells long names
            bands = np.array([bands_of_length(len(f)) for f in family])
            order = np.argsort(-bands, kind="stable")  # names of many bands first, so that a band is a prefix of them
            flat = np.concatenate([flat[start[i] : start[i] + size[i]] for i in order])
            start, bands, name, sig = np.cumsum(size[order]) - size[order], bands[order], name[order], sig[order]
            seeds, at = _seeds(int(bands.max()) * ROWS), 0
            for band in range(int(bands.max())):
                n = int((bands > band).sum())
                end = int(start[n]) if n < len(start) else len(flat)
                key = np.full(n, band, np.uint64)
                for row in range(ROWS):
                    key = _mix(key ^ np.minimum.reduceat(_mix(flat[:end] ^ seeds[at + row]), start[:n]))
                at += ROWS
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(name[:n]), pa.array(sig[:n])], names=["key", "name", "sig"])


def hash_gram(s: str) -> int:
    """Letters to a number; the same in every process."""
    return int.from_bytes(s.encode("utf-16-le")[:8], "little")


def _deletions(families: DataFrame) -> DataFrame:
    """(key, name, sig) of names of up to ``SHORT`` letters, by the name and each name with one letter less: names within
    one error, a swap among them, share one.  Their signature lets all pass."""
    less = F.transform(F.sequence(F.lit(1), F.length("family")), lambda i: F.concat(F.substring("family", F.lit(1), i - 1), F.substring(F.col("family"), i + 1, F.length("family"))))
    keys = F.explode(F.array_distinct(F.concat(F.array("family"), less))).alias("rest")
    return families.filter(F.length("family").between(1, SHORT)).select(keys, "name").select(F.xxhash64(F.lit("deletion"), "rest").alias("key"), "name", F.lit(0).cast("long").alias("sig"))


def _near_signatures(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> np.ndarray:
    """Errors change so many grams of either name, and so at most twice as many bits of the signatures."""
    bits = np.bitwise_count((x["sig"] ^ y["sig"]) & np.int64((1 << 63) - 1))
    return bits <= np.where((x["sig"] | y["sig"]) < 0, 2 * changed_grams(TWO_ERRORS), 2 * changed_grams(SHORT))


def similar_families(names: DataFrame) -> DataFrame:
    """(family_a, family_b, s_family) of the distinct values of ``names.family`` that are within the accepted errors, either
    way round; equal ones too.

    Pairs of at most ``SHORT`` letters are all found, longer ones with a probability of ``RECALL`` at least.  Names under
    five letters are only similar to names of five; from ``TWO_ERRORS`` letters on two errors are accepted."""
    families = names.select("family").filter("family <> ''").distinct().withColumn("name", F.xxhash64("family"))
    # In many parts, because a name has dozens of postings.
    families = materialize(families.repartition("name"), "names-distinct-families")
    # Names shorter than SHORT differ by an error from names up to SHORT only, so they need no bands.
    banded = families.filter(F.length("family") >= SHORT).select("name", "family").mapInArrow(_postings, "key long, name long, sig long")
    met = bucket_pairs(banded.unionByName(_deletions(families)), "key", "name", BLOCK, _near_signatures, "names").distinct()
    text = lambda x: families.select(F.col("name").alias(x), F.col("family").alias(f"family_{x}"))
    both = met.join(text("a"), "a").join(text("b"), "b")
    d = F.levenshtein("family_a", "family_b")
    size = F.greatest(F.length("family_a"), F.length("family_b"))
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    swapped = (d == 2) & (letters("family_a") == letters("family_b"))
    near = both.filter((F.abs(F.length("family_a") - F.length("family_b")) <= 1) & (d <= 2) & (size >= LEAST_LETTERS))
    close = near.filter((d == 1) | swapped | ((d == 2) & (size >= TWO_ERRORS))).select("family_a", "family_b", (1 - F.when(swapped, 1).otherwise(d) / size).alias("s_family"))
    close = materialize(close, "names-close")
    same = families.select(F.col("family").alias("family_a"), F.col("family").alias("family_b"), F.lit(1.0).alias("s_family"))
    other = close.select(F.col("family_b").alias("family_a"), F.col("family_a").alias("family_b"), "s_family")
    return close.unionByName(other).unionByName(same)


def monge_elkan(similarity: Sequence[Sequence[Column]]) -> Column:
    """Mean over the tokens of a name of the best match among those of the other, averaged over both directions;
    ``similarity[i][j]`` is that of token i of the one and token j of the other."""

    def one_way(rows: Sequence[Sequence[Column]]) -> Column:
        best = [reduce(F.greatest, row) if len(row) > 1 else row[0] for row in rows]
        return reduce(Column.__add__, best) / len(best)

    return (one_way(similarity) + one_way(list(zip(*similarity)))) / 2


def similar_givens(forms: DataFrame) -> DataFrame:
    """(given_a, given_b, s_given) of full given names: equal 1, one error in names of more than three letters 0.85."""
    g = forms.select("given").filter(F.length("given") > 1).distinct()
    less = F.transform(F.sequence(F.lit(1), F.length("given")), lambda i: F.concat(F.substring("given", F.lit(1), i - 1), F.substring(F.col("given"), i + 1, F.length("given"))))
    keys = g.filter(F.length("given") > 3).select("given", F.explode(F.array_distinct(F.concat(F.array("given"), less))).alias("rest"))
    met = keys.withColumnRenamed("given", "given_a").join(keys.withColumnRenamed("given", "given_b"), "rest")
    near = met.filter((F.col("given_a") != F.col("given_b")) & (F.levenshtein("given_a", "given_b") <= 1)).select("given_a", "given_b").distinct()
    same = g.select(F.col("given").alias("given_a"), F.col("given").alias("given_b"), F.lit(1.0).alias("s_given"))
    return near.withColumn("s_given", F.lit(0.85)).unionByName(same)


def similar_forms(forms: DataFrame) -> DataFrame:
    """(form_a, form_b, score) of verified forms, either way round and each with itself.

    Full given names meet where they are similar too, initials meet all of their family and letter; full forms of a
    family with different given names never meet.
    """
    f = materialize(forms.select("form", "given", "typed", "middle", "family").filter("given <> ''").distinct(), "names-forms")
    families = materialize(similar_families(f), "names-families")
    givens = materialize(similar_givens(f), "names-givens")
    of = lambda df, x: df.select(*[F.col(c).alias(f"{c}_{x}") for c in ("form", "given", "middle", "family")])
    full, short = f.filter(F.length("given") > 1), f.filter(F.length("given") == 1)
    both_full = of(full, "a").join(givens, "given_a").join(families, "family_a").join(of(full, "b"), ["family_b", "given_b"])
    lettered = f.withColumn("letter", F.explode(F.array_distinct(F.array(F.substring("given", 1, 1), "typed"))))
    b = lettered.select(*[F.col(c).alias(f"{c}_b") for c in ("form", "given", "middle", "family")], F.col("letter").alias("given_a"))
    initial = of(short, "a").join(families, "family_a").join(b, ["family_b", "given_a"]).withColumn("s_given", F.lit(0.9))
    met = both_full.unionByName(initial)
    cross = lambda x, y: F.when((F.col(x) == F.col(y)) & (F.length(x) > 1), 1.0).otherwise(0.0)
    alike = monge_elkan([[F.col("s_given"), cross("given_a", "family_b")], [cross("family_a", "given_b"), F.col("s_family")]])
    ma, mb = F.substring("middle_a", 1, 1), F.substring("middle_b", 1, 1)
    agree = F.when((ma == "") | (mb == ""), 0.0).when(ma == mb, 0.02).otherwise(-1.0)
    scored = met.select("form_a", "form_b", F.length("given_b").alias("n_b"), F.col("s_given").alias("s"), F.when((alike >= LEAST_MONGE_ELKAN) & (agree >= 0), alike + agree).alias("score")).filter("score IS NOT NULL")
    back = scored.filter((F.col("s") == 0.9) & (F.col("n_b") > 1)).select(F.col("form_b").alias("form_a"), F.col("form_a").alias("form_b"), "score")
    return scored.select("form_a", "form_b", "score").unionByName(back).groupBy("form_a", "form_b").agg(F.max("score").alias("score"))


def star_clusters(vertices: DataFrame, edges: DataFrame, label: str, rounds: int = 12) -> DataFrame:
    """(id, center) of all ``vertices(id, rank)`` under symmetric ``edges(a, b, score)``.

    Round by round, open vertices that outrank all their open neighbours become centres and their open neighbours go
    to the centre of highest score (then rank).  Equal ranks are settled by the smaller id.  Nearly all vertices close
    in a few rounds; where a long chain of falling ranks is left after ``rounds``, ranks are replaced by a random order
    fixed by the ids, under which what is left closes in a number of rounds that grows with its logarithm.
    """
    ranked = materialize(vertices.select("id", F.struct("rank", F.col("id")).alias("k")), label)
    of = lambda x: ranked.select(F.col("id").alias(x), F.col("k").alias(f"k{x}"))
    e = materialize(edges.join(of("a"), "a").join(of("b"), "b"), label)
    closed_parts, done = [], 0
    while not e.isEmpty():
        chance = done >= rounds
        ka, kb = (F.struct(F.xxhash64("a"), F.col("a")), F.struct(F.xxhash64("b"), F.col("b"))) if chance else (F.col("ka"), F.col("kb"))
        best = e.groupBy("a").agg(F.any_value(ka).alias("own"), F.min(kb).alias("least"))
        centers = best.filter(F.col("own") < F.col("least")).select(F.col("a").alias("center"))
        joined = e.join(centers, e["b"] == centers["center"]).groupBy("a").agg(F.min_by("b", F.struct(-F.col("score"), kb)).alias("center")).select(F.col("a").alias("id"), "center")
        closed = materialize(joined.unionByName(centers.select(F.col("center").alias("id"), "center")), label)
        closed_parts.append(closed)
        gone = closed.select(F.col("id"))
        e = materialize(e.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"), label)
        done += 1
    if not closed_parts:
        return ranked.select("id", F.col("id").alias("center"))
    # A vertex that lost all its neighbours to other centres, or had none, stands alone.
    closed = reduce(DataFrame.unionByName, closed_parts)
    return ranked.select("id").join(closed, "id", "left").select("id", F.coalesce("center", "id").alias("center"))
