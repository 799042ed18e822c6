"""MinHash near-duplicates with odd sketches.

Each text's shingle set gives 128 MinHash samples. Bands of 4 samples put likely pairs into one bucket (a pair at the threshold of 0.8 misses all
32 bands with a chance of 5e-8). The samples are also folded into a parity bitmap of 512 bits, the odd sketch; the XOR population count of
two sketches estimates how many samples differ, precisely for similar sets, and rules candidates out. What is left is confirmed on full shingle sets.

No bucket is expanded into all its pairs. Texts with equal sets are one node. First each bucket links its members to its smallest one, its centre. Members
of a centre that these links leave in different components are then compared across components, those outside the largest component with all of
similar size: the join tests the sketches and then the exact difference, and only links come out of it. So a group of copies costs a link for each copy. Joins by a
centre that very many members share are plain joins of stored tables, which adaptive execution splits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, LOWER, RollingHash, U, bounded_batches, lean, materialize, mix, named, seeds, slices, small_join, utf8, word_bounds

SAMPLES, ROWS = 128, 4
BITS = 512
#: Sketch words that may differ: a pair at Jaccard 0.8 has 26 +- 4.5 of 128 samples different; 50 is five deviations up.
MAX_DIFFERENT = 50

_XOR, _MUL = seeds(SAMPLES, 1), seeds(SAMPLES, 2) | U(1)
_WORD_KEYS = seeds(16, 3) | U(1)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes by text, each ascending; their number before each text)."""
    starts, stops, per_doc = word_bounds(data, offsets)
    hashes = RollingHash(LOWER[data]).of(starts, stops) if len(starts) else np.empty(0, np.uint64)
    n = len(hashes)
    sh = np.zeros(n, np.uint64)
    if n >= width:
        for k in range(width):
            sh[: n - width + 1] += hashes[k : n - width + 1 + k] * _WORD_KEYS[k]
    sh = mix(sh)
    counts = np.diff(per_doc)
    for d in np.flatnonzero((counts > 0) & (counts < width)):  # too short: the whole sequence is one shingle
        a, b = per_doc[d], per_doc[d + 1]
        sh[a] = mix((hashes[a:b] * _WORD_KEYS[: b - a]).sum(keepdims=True) + U(b - a))[0]
    keep = np.maximum(np.where(counts > 0, 1, 0), counts - width + 1)
    take = np.arange(keep.sum()) + np.repeat(per_doc[:-1] - (np.cumsum(keep) - keep), keep)
    sh = sh[take]
    edges = np.concatenate([[0], np.cumsum(keep)])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        sh[a:b].sort()
    new = np.ones(len(sh), bool)
    new[1:] = sh[1:] != sh[:-1]
    new[edges[:-1][keep > 0]] = True
    total = np.concatenate([[0], np.cumsum(new)])
    return sh[new], total[edges]


def set_hashes(sets: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes (as int64) of each set; of empty ones 0."""
    out = []
    full = np.flatnonzero(np.diff(edges))
    for salt in (0xA5A5, 0x5A5A5A):
        h = np.zeros(len(edges) - 1, np.uint64)
        if len(full):
            h[full] = np.add.reduceat(mix(sets ^ U(salt)), edges[:-1][full])
        out.append(h.view(np.int64))
    return out[0], out[1]


def signatures(sets: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(MinHash samples, odd sketches as 8 words) of sets that are not empty."""
    n = len(edges) - 1
    samples = np.empty((n, SAMPLES), np.uint64)
    begin = edges[:-1]
    for j in range(SAMPLES):
        samples[:, j] = np.minimum.reduceat((sets ^ _XOR[j]) * _MUL[j], begin)
    at = mix(samples ^ _XOR) % U(BITS) + np.arange(n, dtype=np.uint64)[:, None] * U(BITS)
    odd = np.bincount(at.ravel().astype(np.int64), minlength=n * BITS) & 1
    words = np.packbits(odd.astype(np.uint8).reshape(n, BITS), axis=1, bitorder="little").view(np.int64)
    return samples, words


def differing(popcount: int) -> float:
    """The number of differing samples that an XOR population count stands for."""
    return -BITS / 4 * float(np.log(max(1e-9, 1 - 2 * popcount / BITS)))


#: The largest population count that MAX_DIFFERENT differing samples, and four deviations more, can give.
GATE = int(BITS / 2 * (1 - np.exp(-4 * MAX_DIFFERENT / BITS)) + 4 * np.sqrt(BITS) / 4)


def similar_sketch(a: Column, b: Column) -> Column:
    total = sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, BITS // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))
    return total <= GATE


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """row_id, n, hi, lo (a 128-bit hash of the set), bands array<long>, sketch array<long>; the last two null for empty sets."""
    kind = docs.schema["row_id"].dataType.simpleString()
    band_keys = seeds(ROWS, 5) | U(1)
    band_no = seeds(SAMPLES // ROWS, 6)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(1))
            for i, j in slices(offs):
                sets, edges = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
                n = np.diff(edges)
                full = np.flatnonzero(n)
                hi, lo = set_hashes(sets, edges)
                cols = [pa.nulls(j - i, pa.list_(pa.int64()))] * 2
                if len(full):
                    own = np.concatenate([edges[:-1][full], edges[-1:]])
                    samples, words = signatures(sets, own)
                    bands = mix((samples.reshape(len(full), -1, ROWS) * band_keys).sum(2) + band_no).view(np.int64)
                    cols = [_lists(x, full, j - i) for x in (bands, words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(hi), pa.array(lo), *cols], names=["row_id", "n", "hi", "lo", "bands", "sketch"])

    return docs.mapInArrow(run, f"row_id {kind}, n long, hi long, lo long, bands array<long>, sketch array<long>")


def _lists(rows: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """An Arrow list column of n rows that has rows at the given places and null elsewhere."""
    there = np.zeros(n, bool)
    there[at] = True
    offsets = np.concatenate([[0], np.cumsum(there * rows.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()), mask=pa.array(~there))


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """row_id, a 128-bit hash (hi, lo) and the whole shingle set as array<long> of each row."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(1))
            for i, j in slices(offs):
                sets, edges = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
                hi, lo = set_hashes(sets, edges)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(hi), pa.array(lo), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(sets.view(np.int64)))], names=["row_id", "hi", "lo", "shingle"])

    return docs.mapInArrow(run, "row_id long, hi long, lo long, shingle array<long>")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """id, component (the smallest id reachable) of every id in edges (a, b): alternating large and small stars.

    Each round's result is a table in the shared folder; rounds grow with the logarithm of a component's diameter. A centre's edges are not dealt by
    centre: the smallest neighbours, one row for each node, are broadcast where they are few and else met in a join that can be split.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), label)
    edges_left = e.count()
    ends = not edges_left
    while not ends:
        few = 2 * edges_left <= BROADCAST_ROWS  # of which there are at most as many nodes
        met = lambda left, low: left.join(F.broadcast(low) if few else materialize(low, label), "a")  # noqa: B023, E731
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = met(both.where("b > a"), low).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = met(large, low).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        e = materialize(small, label)
        # stars are stable once no centre is itself a leaf and no leaf has two centres
        leaves = e.groupBy("a").agg(F.count("*").alias("k"))
        centres = e.select(F.col("b").alias("a"), F.lit(1).alias("centre")).distinct()
        seen = leaves.join(centres, "a", "left").agg(F.sum("k").alias("edges"), F.max("k").alias("k"), F.max("centre").alias("centre")).first()
        edges_left, ends = seen["edges"] or 0, (seen["k"] or 1) == 1 and seen["centre"] is None
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """id_col, n_shingles, component_id, kept for every row.

    Words are runs without white space, A-Z lower-cased; a set has the distinct shingles of width words, or the whole sequence of a shorter
    text. Two texts are linked at 100 * |A and B| >= percent * |A or B|. component_id is the smallest id reachable; kept marks that
    row. Shingles are compared by 64-bit hashes, sets whole. Texts without words (null, empty) are linked with nothing, very long texts are taken whole.
    Rows that repeat an id are one document; with different texts it is the one with the smallest set, by size and hash. A row whose id is null has no
    component and is kept. Ids must be integers. The samples are chosen for percent of 80 or more; smaller values raise ValueError.
    """
    if percent < 80:
        raise ValueError("the bands are chosen for a similarity of 0.8 or more")
    spark = docs.sparkSession
    bounded_batches(spark)
    text = named(docs, row_id=id_col, text=text_col).withColumn("row_id", F.col("row_id").cast("long"))
    sig = materialize(sketches(text, width), "near-sketches")
    some = sig.where((F.col("n") > 0) & F.col("row_id").isNotNull())
    # a repeated id stands for the one of its texts that is the smallest by size and hash of the set
    repeated = not some.groupBy("row_id").count().where("count > 1").isEmpty()
    if repeated:
        some = materialize(some.groupBy("row_id").agg(F.min(F.struct("n", "hi", "lo", "bands", "sketch")).alias("x")).select("row_id", "x.*"), "near-documents")
    classes = some.groupBy("n", "hi", "lo").agg(F.min("row_id").alias("rep"))
    reps = some.join(classes.select(F.col("rep").alias("row_id")).distinct(), "row_id", "left_semi").select("row_id", "n", "bands", "sketch")
    banded = reps.select("row_id", F.explode("bands").alias("band"))
    centres = banded.groupBy("band").agg(F.min("row_id").alias("centre"), F.count("*").alias("k")).where("k > 1").drop("k")
    shared = materialize(banded.join(centres, "band"), "near-buckets")
    sketch = materialize(reps.join(shared.select("row_id").distinct(), "row_id", "left_semi").select("row_id", "n", "sketch"), "near-members")
    sets = small_join(text.where("row_id IS NOT NULL"), shared.select("row_id").distinct(), "row_id", "left_semi").transform(lambda d: full_sets(d, width))
    if repeated:
        sets = sets.where(F.size("shingle") > 0).groupBy("row_id").agg(F.min(F.struct(F.size("shingle").alias("n"), "hi", "lo", "shingle")).alias("x")).select("row_id", "x.shingle")
    sets = materialize(sets.select("row_id", "shingle"), "near-sets")

    side = lambda k: sketch.select(F.col("row_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))
    set_of = lambda k, x: sets.select(F.col("row_id").alias(k), F.col("shingle").alias(x))
    gate = similar_sketch(F.col("s_a"), F.col("s_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    # each bucket's members and its smallest one
    stars = materialize(shared.where("row_id != centre").select(F.col("row_id").alias("a"), F.col("centre").alias("b")).distinct(), "near-stars")
    likely = stars.join(side("a"), "a").join(side("b"), "b").where(gate).select("a", "b")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    linked = 100 * common >= percent * (F.size("x") + F.size("y") - common)
    links = materialize(likely.join(set_of("a", "x"), "a").join(set_of("b", "y"), "b").where(linked).select("a", "b"), "near-links")

    # members of one centre that are in different components: two texts of one bucket have its centre in common. With D(a) = A xor centre,
    # |A xor B| = |D(a)| + |D(b)| - 2 |D(a) and D(b)| is exact, and D is short for similar texts, so the join itself confirms the links
    first = components(links, "near-components").withColumnRenamed("id", "a")
    labelled = stars.join(first, "a", "left").withColumn("c", F.coalesce("component", "a")).select("a", "b", "c")
    of_centre = labelled.select("b", "c").union(stars.select("b").distinct().join(first.select(F.col("a").alias("b"), "component"), "b", "left").select("b", F.coalesce("component", "b").alias("c")))
    sizes = of_centre.groupBy("b", "c").agg(F.count("*").alias("k"))
    open_ = sizes.groupBy("b").agg(F.max(F.struct("k", (-F.col("c")).alias("c"))).alias("most"), F.count("*").alias("several")).where("several > 1").select("b", (-F.col("most.c")).alias("main"))
    # one narrow row for each such centre, met without dealing its members by centre where the rows are few
    open_ = materialize(open_, "near-spread")
    spread = small_join(labelled, open_, "b", "inner").join(set_of("a", "x"), "a").join(set_of("b", "y"), "b")
    difference = F.concat(F.array_except("x", "y"), F.array_except("y", "x"))
    left = materialize(spread.select("b", "a", "c", "main", difference.alias("d")).join(sketch.select(F.col("row_id").alias("a"), "n", "sketch"), "a"), "near-open")
    one = lambda k: left.select(F.col("b").alias("centre"), "main", F.col("a").alias(k), F.col("c").alias(f"c_{k}"), F.col("d").alias(f"d_{k}"), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))
    far = lambda both: 100 * (F.col("n_a") + F.col("n_b") - both) >= percent * (F.col("n_a") + F.col("n_b") + both)
    apart = (F.size("d_a") + F.size("d_b") - 2 * F.size(F.array_intersect("d_a", "d_b"))).cast("long")
    once = (F.col("c_a") != F.col("c_b")) & ((F.col("c_b") == F.col("main")) | (F.col("a") < F.col("b")))
    # sizes of linked sets differ by the threshold at most: classes of that width meet their own and the next ones only
    width_ = max(math.log(100 / percent), 0.01) * 1.0001
    class_of = lambda k: F.floor(F.log(F.col(f"n_{k}")) / F.lit(width_))
    near = F.explode(F.array(*[class_of("b") + F.lit(k) for k in (-1, 0, 1)]))
    across = one("a").where("c_a != main").withColumn("class", class_of("a")).join(one("b").drop("main").withColumn("class", near), ["centre", "class"]).where(once & far(F.abs(F.size("d_a") - F.size("d_b"))) & gate & far(apart))
    more = materialize(across.select("a", "b").distinct(), "near-links")
    links = links.union(more).union(classes_links(some))
    final = components(links, "near-components")
    return (
        sig.select("row_id", "n").join(final.withColumnRenamed("id", "row_id"), "row_id", "left")
        .select(F.col("row_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "row_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )


def classes_links(some: DataFrame) -> DataFrame:
    """A link from each member of a class of equal sets to its representative; classes of one are left out first."""
    many = some.groupBy("n", "hi", "lo").agg(F.min("row_id").alias("rep"), F.count("*").alias("k")).where("k > 1").drop("k")
    of_class = small_join(some.select("row_id", "n", "hi", "lo"), many, ["n", "hi", "lo"], "inner")
    return of_class.where("row_id != rep").select(F.col("row_id").alias("a"), F.col("rep").alias("b"))
