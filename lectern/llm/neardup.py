"""Problem 6: near-duplicate token sets by prefix postings and pigeonring filtering.

Jaccard similarity of at least t means that the sets differ in at most ``tau = (1-t)/(1+t) * (|a|+|b|)`` elements, a
Hamming bound.  The join runs in four steps.

1. Every set is read in one global order, rare tokens first.  The order comes from counts of all tokens in a fixed
   number of hash cells, so what the driver sees has a fixed size; any order is exact, a better one only prunes more.
2. Sets meet on a token of their prefixes, and only where it can be their first common token: at least ``t/(1+t) *
   (|a|+|b|)`` tokens must be left from it in either set.
3. Each posting carries a small ring of bit segments, the parities of its set's hashed tokens.  Bit differences of a
   segment never exceed the true differences there.  By the pigeonring principle a pair within ``tau`` has a segment
   from which every chain of l consecutive segments has at most ``l * tau / m`` differences.  Chains of one and two
   segments and the whole ring are tested; pairs that fail are dropped before anything is looked up.
4. What is left gets the full Hamming check on the token sets.

Sets that are equal are one class with one posting per token, however many records have it.  A record never meets
more than the classes that share its rare tokens; no pairs within a bucket are listed before the ring has passed them.
Where very many classes share a token of their prefixes, the bucket is split into pairs of blocks.  A class is told by
two independent 64-bit hashes of its set.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.blocks import bucket_pairs
from lectern.llm.graph import connected_components
from lectern.storage import materialize

#: Cells in which token frequencies are counted: 65,536 numbers reach the driver and the workers, at every size.
CELLS = 1 << 16
#: Classes of a bucket that one task compares with each other or with as many others.
BLOCK = 5000
_TAG = r"</?[A-Za-z][^<>]*>"


def distinct_words(text: Column | str) -> Column:
    """Hashes of the distinct runs of letters or digits, in lower case, markup dropped."""
    return F.array_distinct(F.transform(_words(text), lambda w: F.xxhash64(w)))


def distinct_shingles(text: Column | str, width: int) -> Column:
    """Hashes of the distinct runs of ``width`` words; a text of fewer words has none."""
    # The word array is computed once per row, by going through a one-element array.
    def runs(ws: Column) -> Column:
        n = F.size(ws) - (width - 1)
        return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(width)])))).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(_words(text)), runs), F.lit(0))


def _words(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.regexp_replace(t, _TAG, " ")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (two rounds of multiply and shift)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def _postings(counts, threshold: float, words: int, banded: bool):
    names = ["key", "h", "place", *[f"s{i}" for i in range(words)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = counts.value
        for b in batches:
            lists = b.column("tokens")
            size = np.asarray(lists.value_lengths().fill_null(0))
            keep = size > 0
            if not keep.any():
                continue
            b, size = b.filter(pa.array(keep)), size[keep]
            # Copies of a set in one band are dropped here, before they are shuffled; those of other batches after.
            both = b.column("h").to_numpy().view(np.uint64) ^ _mix(b.column("band").to_numpy().astype(np.int64).view(np.uint64))
            one = np.sort(np.unique(both, return_index=True)[1])
            b, size = b.take(pa.array(one)), size[one]
            flat = b.column("tokens").flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(len(size)), size)
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            order = np.lexsort((flat, cell[(flat & np.uint64(CELLS - 1)).astype(np.int64)], row))
            at = np.arange(len(flat)) - start[row]
            prefix = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
            used = at < prefix[row]
            bits = _mix(flat) % np.uint64(64 * words)
            sketch = [np.bitwise_xor.reduceat(np.where(bits >> np.uint64(6) == w, np.uint64(1) << (bits & np.uint64(63)), np.uint64(0)), start) for w in range(words)]
            token, r, at = flat[order][used], row[used], at[used]
            bands = b.column("band").to_numpy().astype(np.int64).view(np.uint64)[r]
            h = b.column("h").to_numpy()[r]
            for second in (0, 1) if banded else (0,):
                with np.errstate(over="ignore"):
                    key = _mix(token ^ _mix(bands + np.uint64(second) + np.uint64(1))).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(h), pa.array(_packed(size[r], at, second)), *[pa.array(s.view(np.int64)[r]) for s in sketch]], names=names)

    return run, "key long, h long, place long, " + ", ".join(f"s{i} long" for i in range(words))


def _packed(size: np.ndarray, at: np.ndarray, second: int) -> np.ndarray:
    """Size of a set, place of the token in it, and whether it stands for the band before, in one number."""
    return (size.astype(np.int64) << np.int64(32)) | (at.astype(np.int64) << np.int64(1)) | np.int64(second)


def ring_condition(a: Sequence[np.ndarray], b: Sequence[np.ndarray], tau: np.ndarray, parts: int, chains: tuple[int, ...] = (1, 2)) -> np.ndarray:
    """Some segment starts chains of these lengths that differ in at most l * tau / m bits, and so does the whole ring.

    ``a`` and ``b`` are the 64-bit words of both rings; each word is ``parts`` segments, m in all.
    """
    width = 64 // parts
    mask = np.uint64((1 << width) - 1) if width < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)
    differ = [np.bitwise_count((np.bitwise_xor(x, y).view(np.uint64) >> np.uint64(p * width)) & mask).astype(np.int64) for x, y in zip(a, b) for p in range(parts)]
    m = len(differ)
    starts = np.zeros(len(tau), bool)
    for i in range(m):
        chain = np.ones(len(tau), bool)
        for length in chains:
            chain &= sum(differ[(i + j) % m] for j in range(length)) * m <= tau * length
        starts |= chain
    return starts & (sum(differ) <= tau)


def _near(threshold: float, words: int):
    """Whether two postings can be the first common token of sets that are similar enough, by sizes, place and ring."""
    share, distance, parts = threshold / (1 + threshold), (1 - threshold) / (1 + threshold), 4 if words == 1 else 2

    def keep(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> np.ndarray:
        (n, at, second), (m, to, other) = ((p >> 32, (p >> 1) & 0x7FFFFFFF, p & 1) for p in (x["place"], y["place"]))
        ok = (np.minimum(n - at, m - to) >= np.ceil((n + m) * share - 1e-9)) & (second + other < 2)
        some = np.flatnonzero(ok)
        tau = np.floor((n + m)[some] * distance + 1e-9)
        rings = ([v[f"s{i}"][some] for i in range(words)] for v in (x, y))
        ok[some] = ring_condition(*rings, tau, parts)
        return ok

    return keep


def class_postings(records: DataFrame, counts: np.ndarray, threshold: float, words: int, banded: bool) -> DataFrame:
    """Postings by ``key``, one per class (``h``, ``band``) and prefix token of each batch of records."""
    run, schema = _postings(records.sparkSession.sparkContext.broadcast(counts), threshold, words, banded)
    return records.select("h", "band", "tokens").mapInArrow(run, schema)


def similar_classes(records: DataFrame, threshold: float, label: str, words: int, band_width: int | None = None) -> DataFrame:
    """Pairs of different token sets with Jaccard similarity of at least ``threshold``: ``h_a < h_b``.

    ``records`` has ``tokens`` (distinct 64-bit hashes), ``h`` (hash of the sorted tokens) and ``band`` (an integer;
    with ``band_width`` 1 only sets with bands at most 1 apart are compared).  ``words`` is the length of the ring in
    64-bit words.  Empty and null token sets are similar to nothing.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    tokens = records.select(F.explode("tokens").alias("t"))
    cells = tokens.groupBy(F.col("t").bitwiseAND(F.lit(CELLS - 1).cast("long")).cast("int").alias("cell")).agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros(CELLS, np.int64)
    counts[cells["cell"].to_numpy(int)] = cells["n"].to_numpy(np.int64)
    p = class_postings(records, counts, threshold, words, band_width is not None)
    near = bucket_pairs(p, "key", "h", BLOCK, _near(threshold, words), label).select(F.col("a").alias("a_h"), F.col("b").alias("b_h"))
    near = materialize(near.distinct(), f"{label}-candidates")
    wanted = near.select(F.col("a_h").alias("h")).union(near.select("b_h")).distinct()
    sets = materialize(records.select("h", "tokens").join(wanted, "h", "left_semi").groupBy("h").agg(F.any_value("tokens").alias("tokens")), f"{label}-sets")
    full = near.join(sets.select(F.col("h").alias("a_h"), F.col("tokens").alias("ta")), "a_h").join(sets.select(F.col("h").alias("b_h"), F.col("tokens").alias("tb")), "b_h")
    common = F.size(F.array_intersect("ta", "tb"))
    return full.filter(common / (F.size("ta") + F.size("tb") - common) >= F.lit(threshold)).select(F.col("a_h").alias("h_a"), F.col("b_h").alias("h_b"))


def told_apart(records: DataFrame, label: str) -> DataFrame:
    """``records`` with another ``h`` for sets that share ``h`` but not the second hash ``h2`` with some other set.

    Hashes of 64 bits do collide among billions of sets; two independent ones don't.  Few sets do, so few are joined."""
    clash = records.groupBy("h").agg(F.min("h2").alias("lo"), F.max("h2").alias("hi")).filter("lo <> hi").select("h", F.lit(True).alias("clash"))
    marked = records.join(materialize(clash, f"{label}-clashes"), "h", "left")
    return marked.withColumn("h", F.when(F.col("clash"), F.xxhash64("h", "h2")).otherwise(F.col("h"))).select("id", "tokens", "band", "h")


def near_duplicate_classes(df: DataFrame, key: str, tokens: Column, threshold: float, label: str, words: int, band: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``node, id`` of all records with tokens, and ``node_a, node_b`` of similar nodes.

    A node is one token set in one band: its members are equal and similar to each other, so a group of copies of any
    size is one row among the links.  ``band`` (an integer expression) restricts links to bands at most 1 apart;
    records with a null band are left out.
    """
    cut = df.select(F.col(key).alias("id"), tokens.alias("tokens"), (F.lit(0) if band is None else band).cast("long").alias("band"))
    ordered = F.array_sort("tokens")
    records = cut.filter("id IS NOT NULL AND band IS NOT NULL AND size(tokens) > 0").withColumns({"h": F.xxhash64(ordered), "h2": F.xxhash64(F.lit(1), ordered)})
    records = told_apart(materialize(records, f"{label}-records"), label)  # four steps read the token sets
    pairs = similar_classes(records, threshold, label, words, None if band is None else 1)
    node = F.col("h") if band is None else F.xxhash64("h", "band")
    members = records.select(node.alias("node"), "id").distinct()
    nodes = materialize(records.select("h", "band", node.alias("node")).distinct(), f"{label}-nodes")
    a, b = (nodes.select(F.col("h").alias(f"h_{x}"), F.col("band").alias(f"band_{x}"), F.col("node").alias(f"node_{x}")) for x in "ab")
    links = pairs.join(a, "h_a").join(b, "h_b").filter(F.abs(F.col("band_a") - F.col("band_b")) <= 1).select("node_a", "node_b")
    if band is not None:  # the same set one band later
        later = nodes.select("h", (F.col("band") + 1).alias("band"), F.col("node").alias("node_a"))
        links = links.unionByName(nodes.join(later, ["h", "band"]).select("node_a", F.col("node").alias("node_b")))
    return members, materialize(links, f"{label}-links")


def near_duplicate_pairs(df: DataFrame, key: str, tokens: Column, threshold: float, label: str, words: int, band: Column | None = None) -> DataFrame:
    """All pairs of records (``id_a < id_b``) whose token sets are similar, equal sets among them.

    Defined results: records with a null key are left out; a record without tokens (null, empty or too short text)
    has no pair; a key that occurs in several rows counts once per distinct token set and band, and is never paired
    with itself; an empty frame gives no pairs; other columns of ``df`` are ignored, whatever their names.
    """
    members, links = near_duplicate_classes(df, key, tokens, threshold, label, words, band)
    several = members.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("node").alias("node_a"), F.col("node").alias("node_b"))
    every = links.unionByName(several)
    x, y = members.select(F.col("node").alias("node_a"), F.col("id").alias("x")), members.select(F.col("node").alias("node_b"), F.col("id").alias("y"))
    both = every.join(x, "node_a").join(y, "node_b").filter("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_groups(df: DataFrame, key: str, tokens: Column, threshold: float, label: str, words: int, band: Column | None = None) -> DataFrame:
    """(id, group_id, n_links) of every record similar to another: the smallest id of its group, and its partners' number.

    Linear in records and links of classes: copies are counted, never paired.
    """
    members, links = near_duplicate_classes(df, key, tokens, threshold, label, words, band)
    sizes = members.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    both = links.select("node_a", "node_b").union(links.select("node_b", "node_a"))
    around = both.join(sizes.select(F.col("node").alias("node_b"), "n"), "node_b").groupBy(F.col("node_a").alias("node")).agg(F.sum("n").alias("others"))
    linked = sizes.join(around, "node", "left").withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("n") - 1).filter("n_links > 0")
    groups = connected_components(links.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), label).select(F.col("id").alias("node"), "component")
    placed = materialize(linked.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), f"{label}-placed")
    first = placed.groupBy("component").agg(F.min("least").alias("group_id"))
    return members.join(placed.select("node", "component", "n_links"), "node").join(first, "component").select("id", "group_id", "n_links")
