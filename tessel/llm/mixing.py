"""Mixing sources to target weights by pivotal dependent rounding.

Each document is to be taken target / source size times. The whole part of that is certain; the fractional parts are settled in pairs:
of two documents, one's fraction rises and the other's falls so that the words of both together stay the same, in one of the two
directions at random with the chance that keeps each fraction's expectation, until one of them is 0 or 1. So a group of documents
keeps its expected words exactly and ends with one document unsettled. Groups form a reduction tree: the first level deals each
source's documents to groups of about LEAF, every next level merges FAN groups' residuals, up to one document for each source.

Randomness comes from hashes of doc_id, text and a seed and groups from hashes too, so reruns agree whatever the partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, materialize, mix, named

LEAF = 512
FAN = 256
#: No document is taken more often than this.
CAP = 3

_WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"


def word_count(text: str) -> F.Column:
    return F.coalesce(F.expr(f"regexp_count({text}, '{_WORD}')"), F.lit(0)).cast("long")


def settle(keys: np.ndarray, sizes: np.ndarray, parts: np.ndarray, seed: int) -> np.ndarray:
    """Pivotal rounding of the fractions parts, in the given order; all become 0 or 1 but for one at most."""
    out = parts.astype(float).copy()
    chance = mix(keys.astype(np.int64).view(np.uint64) * U(0x9E3779B97F4A7C15) + U(seed)).astype(float) / 2.0**64
    held = -1
    for k in range(len(out)):
        if out[k] <= 1e-12 or out[k] >= 1 - 1e-12 or not sizes[k]:
            out[k] = round(out[k])
            continue
        if held < 0:
            held = k
            continue
        a, b = float(sizes[held]), float(sizes[k])
        up = min((1 - out[held]) * a, out[k] * b)  # words that can go from k to held
        down = min(out[held] * a, (1 - out[k]) * b)
        moved = up if chance[k] * (up + down) < down else -down
        out[held] += moved / a
        out[k] -= moved / b
        done = [abs(x - round(x)) < 1e-9 for x in (out[held], out[k])]
        for x, d in ((held, done[0]), (k, done[1])):
            if d:
                out[x] = round(out[x])
        held = -1 if all(done) else k if done[0] else held
    return out


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = CAP) -> DataFrame:
    """source, source_size, target from one row (source, source_size) for each source.

    Sources in code point order, null last, have the weights in turn. All words are shared by weight; a source stops at cap times its
    size and the excess goes to the others by weight until none is above. Windows run over one row for each source only.
    """
    named_last = Window.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(named_last) - 1, F.lit(len(weights))) + 1).cast("int")))
    everything = Window.partitionBy(F.lit(0))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumns({"cum": F.sum("source_size").over(upto) - F.col("source_size"), "cum_w": F.sum("w").over(upto) - F.col("w"), "all": F.sum("source_size").over(everything), "all_w": F.sum("w").over(everything)})
    # what a unit of weight gets once all sources before this one have stopped
    s = s.withColumn("level", (F.col("all") - cap * F.col("cum")) / (F.col("all_w") - F.col("cum_w")))
    s = s.withColumn("open", F.col("level") * F.col("w") <= cap * F.col("source_size"))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("open"), F.col("source_size") / F.col("w"))).over(everything))
    return s.select("source", "source_size", F.least(cap * F.col("source_size"), F.coalesce(F.col("level") * F.col("w"), cap * F.col("source_size"))).cast("double").alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), seed: int = 11, cut_last: bool = True, leaf: int = LEAF) -> DataFrame:
    """doc_id, source, row_key, size, source_size, target, copies, taken for every row.

    copies is the whole number of times a document is taken; taken counts its words with repeats. Each source's last unsettled
    document is, with cut_last, taken in part (its words make the source's total equal its target to a word); without, it
    is rounded by chance. Texts without words (or null) have size 0 and are taken 0 times if their source has a target below its size, by chance.
    Groups and random numbers come from row_key, a hash of id and text, so rows whose id is null or repeated are drawn each by itself unless their text is
    the same as well; very long texts are only counted. An empty table gives no rows.
    """
    d = named(docs, id=id_col, text=text_col, source=source_col).select("id", "source", word_count("text").alias("size"), F.xxhash64("id", "text").alias("key"))
    d = materialize(d, "mix-sizes")
    per_source = targets(d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).drop("n"), weights).withColumnRenamed("source", "of_source")
    rows = d.count()
    kind = d.schema["id"].dataType.simpleString()
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(CAP)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    level = (
        d.join(F.broadcast(per_source) if per_source.limit(100_001).count() <= 100_000 else per_source, F.expr("source <=> of_source"))
        .select("id", "key", "source", "size", "source_size", "target", ratio.alias("r"))
        .withColumns({"whole": F.floor("r").cast("int"), "part": F.col("r") - F.floor("r")}).drop("r")
    )
    groups = max(1, -(-rows // leaf))
    level = level.withColumn("grp", F.pmod(F.xxhash64("id", "key"), F.lit(groups)).cast("int"))
    schema = f"id {kind}, key long, source string, size long, source_size long, target double, whole int, part double, grp int"
    settled: DataFrame | None = None
    depth = 0
    while True:
        salt = seed + 7919 * depth

        def run(table: pa.Table) -> pa.Table:
            keys = table.column("key").to_numpy()
            sizes = table.column("size").to_numpy()
            draw = mix(keys.view(np.uint64) + U(salt + 1))
            order = np.lexsort((draw, sizes))
            part = np.empty(len(keys))
            part[order] = settle(keys[order], sizes[order], table.column("part").to_numpy()[order], salt)
            return table.set_column(table.schema.get_field_index("part"), "part", pa.array(part))

        # run is pickled when its job starts, within this round, so it sees this round's salt
        done = materialize(level.groupBy("source", "grp").applyInArrow(run, schema), f"mix-level{depth}")
        open_ = (F.col("part") > 0) & (F.col("part") < 1)
        if groups == 1:
            last = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
            rounded = F.when(open_ & F.lit(not cut_last), (last < F.col("part")).cast("double")).otherwise(F.col("part"))
            done = done.withColumn("part", rounded)
            settled = done if settled is None else settled.unionByName(done)
            break
        closed = done.where(~open_)
        settled = closed if settled is None else settled.unionByName(closed)
        groups = -(-groups // FAN)
        level = done.where(open_).withColumn("grp", F.pmod(F.xxhash64("id", "key"), F.lit(groups)).cast("int"))
        depth += 1
    return settled.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("key").alias("row_key"), "size", "source_size", "target",
        (F.col("whole") + F.floor("part")).cast("long").alias("copies"),
        (F.col("whole") * F.col("size") + F.round(F.col("part") * F.col("size"))).cast("long").alias("taken"),
    )
