"""The registered queries over the benchmark tables, with the SQL each must agree with.

All tables are read whole. Positions are the dense 0-based keys: vec_id and k of embeddings, event_id, o_orderkey, p_partkey, c_custkey.
"""

from __future__ import annotations

import pickle
import uuid
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..functions import grid as G
from ..functions.key import ChunkKey, canonical, key_column
from ..operators import block as B
from ..operators import means
from ..operators.block import Block
from ..operators.cube import Cube, packed, unpacked
from ..operators.threads import thread_map_batches
from ..sources import zarr
from ..sources.shared import shared_dir
from ..sources.template import discover
from .fanout import best_bins, covering_bins, schedule_cost
from .rechunking import ExcessiveIOWarning, count_pieces, grow_chunks, multistage_plan, rechunk_plan, shared_chunks, single_stage_plan, stage_chunks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(name: str) -> F.Column:
    return F.round(F.col(name), 6).alias(name)


def cents(name: str) -> F.Column:
    """An amount of money as a whole number of cents, of which sums and means are exact."""
    return F.round(F.col(name) * 100).cast("bigint").alias(name)


def amount(name: str) -> F.Column:
    return (F.col(name) / 100).alias(name)


#: Labels of a dimension live on the driver; this many at most are looked for in a column.
LABELS = 10_000


def labels_of(df: DataFrame, name: str) -> list:
    """The sorted distinct values of a column, as labels of a dimension; more than LABELS raise ValueError."""
    found = sorted(r[0] for r in df.select(name).distinct().limit(LABELS + 1).collect())
    if len(found) > LABELS:
        raise ValueError(f"{name} has more than {LABELS} values: too many for labels")
    return found


EMB = "e AS (SELECT vec_id, CAST(k - 1 AS BIGINT) AS k, CAST(embedding[k] AS DOUBLE) AS v, label FROM (SELECT vec_id, embedding, label, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings))"


def vectors(spark: SparkSession, sf_dir: str, chunks=None) -> Cube:
    """embeddings as v(vec_id, k)."""
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v")).withColumn("v", F.col("v").cast("double"))
    return Cube.from_dataframe(cells, ["vec_id", "k"], ["v"], chunks=chunks or {"vec_id": 50, "k": -1})


def events(spark: SparkSession, sf_dir: str, chunks=1000) -> Cube:
    """events as value(event_id), user_id(event_id)."""
    return Cube.from_dataframe(table(spark, sf_dir, "events"), ["event_id"], ["value", "user_id"], chunks=chunks)


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events gridded by day, hour and type: total (in cents) and n of the cells that have events."""
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min(F.to_date("ts")).alias("d0"))
    kind = F.array_position(F.array(*map(F.lit, labels_of(e, "event_type"))), F.col("event_type")) - 1
    placed = e.join(F.broadcast(first), F.lit(True)).select(F.datediff(F.to_date("ts"), "d0").cast("long").alias("day"), F.hour("ts").cast("long").alias("hour"), kind.cast("long").alias("kind"), cents("value"))
    return placed.groupBy("day", "hour", "kind").agg(F.sum("value").alias("total"), F.count("*").cast("double").alias("n"))


DAYS = """k AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS kind FROM (SELECT DISTINCT event_type FROM events)),
d AS (SELECT CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS BIGINT) AS day, CAST(hour(ts) AS BIGINT) AS hour, kind,
      CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, CAST(count(*) AS DOUBLE) AS n FROM events JOIN k USING (event_type) GROUP BY 1, 2, 3)"""

# ---- keys and chunk geometry ---------------------------------------------------------------------------------------------------------


@query("SELECT event_id - event_id % 1000 AS event_id_offset, count(*) AS cells FROM events GROUP BY 1")
def chunk_keys_events(spark, sf_dir):
    return events(spark, sf_dir).chunk_table()


@query("SELECT event_id, event_id // 1000 AS chunk FROM events")
def chunk_index(spark, sf_dir):
    return events(spark, sf_dir).df.select("event_id", G.index_of(F.col("event_id"), 1000).alias("chunk"))


@query(f"WITH {EMB}, n AS (SELECT CAST(ceil(max(k + 1) / 8.0) AS BIGINT) AS w FROM e) SELECT (vec_id // 50) * w + k // 8 AS number, count(*) AS cells FROM e, n GROUP BY 1")
def chunk_number_2d(spark, sf_dir):
    c = vectors(spark, sf_dir, {"vec_id": 50, "k": 8})
    return c.df.groupBy(G.number_of({d: F.col(d) for d in ("vec_id", "k")}, c.chunks, c.sizes).alias("number")).agg(F.count("*").alias("cells"))


@query("WITH g AS (SELECT unnest(range(0, (SELECT CAST(max(event_id) + 1 AS BIGINT) FROM events), 1000)) AS o) SELECT o AS event_id_offset, least(1000, (SELECT max(event_id) + 1 FROM events) - o) AS size FROM g")
def expanded_chunks(spark, sf_dir):
    c = events(spark, sf_dir)
    blocks = G.expand_chunks(c.chunks, c.sizes)
    begin = G.block_offsets(blocks)["event_id"]
    return spark.createDataFrame(list(zip(begin, blocks["event_id"], strict=True)), "event_id_offset bigint, size bigint")


@query("SELECT event_id - event_id % 700 AS o, event_id % 700 AS within, value FROM events WHERE event_id >= 700 AND event_id < 1400")
def slice_of_chunk(spark, sf_dir):
    s = G.offsets_to_slices({"event_id": 700}, {"event_id": 700})["event_id"]
    e = events(spark, sf_dir).df.where(G.in_slice(F.col("event_id"), s))
    return e.select(G.offset_of(F.col("event_id"), 700).alias("o"), (F.col("event_id") - s.start).alias("within"), "value")


@query(f"WITH {EMB} SELECT DISTINCT vec_id - vec_id % 50 AS vec_id, k - k % 16 AS k FROM e")
def key_structs(spark, sf_dir):
    c = vectors(spark, sf_dir, {"vec_id": 50, "k": 16}).with_offsets()
    key = key_column(["vec_id", "k"])
    keys = c.select(F.col("vec_id_offset").alias("vec_id"), F.col("k_offset").alias("k")).select(key.alias("key"))
    return keys.groupBy(canonical(F.col("key")).alias("c")).agg(F.first("key").alias("key")).select(F.col("key.offsets")["vec_id"].alias("vec_id"), F.col("key.offsets")["k"].alias("k"))


@query("SELECT greatest(event_id - event_id % 1000, event_id - event_id % 300) AS at, count(*) AS cells FROM events GROUP BY 1")
def split_bounds(spark, sf_dir):
    return events(spark, sf_dir).df.groupBy(G.split_offset_of(F.col("event_id"), 1000, 300).alias("at")).agg(F.count("*").alias("cells"))


@query("WITH p AS (SELECT count(*) AS pieces FROM (SELECT DISTINCT event_id // 5 AS a, event_id // 7 AS b FROM events)) SELECT pieces, pieces AS formula FROM p")
def stage_io_count(spark, sf_dir):
    c = events(spark, sf_dir, 5)
    formula = count_pieces(c.sizes["event_id"], 5, 7)
    pieces = c.df.select(G.index_of(F.col("event_id"), 5).alias("a"), G.index_of(F.col("event_id"), 7).alias("b")).distinct()
    return pieces.agg(F.count("*").alias("pieces")).withColumn("formula", F.lit(formula).cast("long"))


# ---- rechunking, variables ----------------------------------------------------------------------------------------------------------


@query("SELECT event_id - event_id % 1000 AS event_id_offset, count(*) AS cells, round(sum(value), 4) AS total FROM events GROUP BY 1")
def consolidate_floor(spark, sf_dir):
    c = events(spark, sf_dir, 250)["value"].rechunk(1000)
    c = Cube.from_blocks(c.to_blocks(), c.template, c.chunks)
    return c.with_offsets().groupBy("event_id_offset").agg(F.count("*").alias("cells"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {EMB} SELECT vec_id - vec_id % 500 AS vec_id_offset, k - k % 8 AS k_offset, count(*) AS cells, round(sum(v), 6) AS total FROM e GROUP BY 1, 2")
def rechunk_pencil(spark, sf_dir):
    c = vectors(spark, sf_dir).rechunk({"vec_id": 500, "k": 8}, co_locate=True)
    return c.with_offsets().groupBy("vec_id_offset", "k_offset").agg(F.count("*").alias("cells"), F.round(F.sum("v"), 6).alias("total"))


@query("SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def split_vars(spark, sf_dir):
    return parts(spark, sf_dir).split_variables().long()


def parts(spark: SparkSession, sf_dir: str) -> Cube:
    """part as p_size(p_partkey), p_retailprice(p_partkey)."""
    p = table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return Cube.from_dataframe(p, ["p_partkey"], ["p_size", "p_retailprice"], chunks=100)


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part")
def merge_vars(spark, sf_dir):
    c = parts(spark, sf_dir)
    return Cube.from_long(c.split_variables().long(), ["p_partkey"], ["p_size", "p_retailprice"], c.chunks, c.sizes).df


@query("SELECT c_custkey AS i, c_acctbal, s_acctbal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def multi_dataset_aligned(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), "c_acctbal")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), "s_acctbal")
    a = Cube.from_dataframe(c, ["i"], chunks=100)
    return Cube.aligned([a, Cube.from_dataframe(s, ["i"], sizes=a.sizes, chunks=100)]).df


# ---- selection and mapping ------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, value FROM events")
def select_vars(spark, sf_dir):
    return events(spark, sf_dir)["value"].df


@query(f"WITH {EMB} SELECT k, vec_id, v FROM e")
def transpose(spark, sf_dir):
    return vectors(spark, sf_dir).transpose("k", "vec_id").df


@query(f"WITH {EMB} SELECT vec_id, k, v FROM e WHERE vec_id < 7 AND k < 3")
def head_nd(spark, sf_dir):
    return vectors(spark, sf_dir).head(vec_id=7, k=3).df


@query(f"WITH {EMB}, n AS (SELECT max(vec_id) - 4 AS a, max(k) - 2 AS b FROM e) SELECT vec_id - a AS vec_id, k - b AS k, v FROM e, n WHERE vec_id >= a AND k >= b")
def tail_nd(spark, sf_dir):
    return vectors(spark, sf_dir).tail(vec_id=5, k=3).df


@query(f"WITH {EMB} SELECT vec_id, k, 2 * v AS v FROM e")
def map_scale(spark, sf_dir):
    return vectors(spark, sf_dir).map_cells(v=lambda v: 2 * v).df


@query(f"WITH {EMB}, m AS (SELECT vec_id, avg(v) AS m FROM e GROUP BY 1) SELECT vec_id, k, round(v - m, 6) AS v FROM e JOIN m USING (vec_id)")
def map_blocks_centre(spark, sf_dir):
    def centre(b: Block) -> Block:
        return b.map(lambda x: x - x.mean(axis=1, keepdims=True))

    return vectors(spark, sf_dir, {"vec_id": 250, "k": -1}).map_blocks(centre).df.select("vec_id", "k", r6("v"))


@query(f"WITH {EMB} SELECT vec_id, k // 2 AS k, round(avg(v), 6) AS v FROM e GROUP BY 1, 2")
def coarsen_mean(spark, sf_dir):
    return vectors(spark, sf_dir).coarsen(k=2).df.select("vec_id", "k", r6("v"))


@query(f"WITH {EMB} SELECT vec_id, k // 2 AS k, round(avg(v), 6) AS v FROM e GROUP BY 1, 2")
def regrid_blocks(spark, sf_dir):
    return vectors(spark, sf_dir, {"vec_id": 250, "k": 16}).map_blocks(lambda b: b.coarsen(k=2)).df.select("vec_id", "k", r6("v"))


@query(f"WITH {EMB} SELECT k, round(median(v), 6) AS v FROM e GROUP BY 1")
def median_dim(spark, sf_dir):
    return vectors(spark, sf_dir).reduce("median", "vec_id").df.select("k", r6("v"))


@query(f"WITH {EMB} SELECT k, round(median(v), 6) AS v FROM e GROUP BY 1")
def median_blocks(spark, sf_dir):
    c = vectors(spark, sf_dir).rechunk({"vec_id": -1, "k": 4})
    return c.map_blocks(lambda b: b.reduce(np.median, "vec_id")).df.select("k", r6("v"))


# ---- means --------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {EMB} SELECT k, round(avg(v), 6) AS v FROM e GROUP BY 1")
def mean_one_dim(spark, sf_dir):
    return vectors(spark, sf_dir).mean("vec_id").df.select("k", r6("v"))


@query(f"WITH {EMB} SELECT round(avg(v), 6) AS v FROM e")
def mean_all(spark, sf_dir):
    return vectors(spark, sf_dir).mean().df.select(r6("v"))


@query(f"WITH {EMB} SELECT vec_id, k, v FROM e")
def mean_none(spark, sf_dir):
    return vectors(spark, sf_dir).mean([]).df


@query(f"WITH {DAYS} SELECT hour, kind, CAST(sum(total) AS DOUBLE) / count(*) / 100 AS total, round(avg(n), 6) AS n FROM d GROUP BY 1, 2")
def mean_skipna(spark, sf_dir):
    c = Cube.from_dataframe(days(spark, sf_dir), ["day", "hour", "kind"], chunks={"day": 10})
    return c.mean("day").df.select("hour", "kind", amount("total"), r6("n"))


@query(f"WITH {DAYS}, s AS (SELECT max(day) + 1 AS days FROM d) SELECT hour, kind, CASE WHEN count(*) = any_value(days) THEN round(avg(n), 6) END AS n FROM d, s GROUP BY 1, 2")
def mean_no_skipna(spark, sf_dir):
    c = Cube.from_dataframe(days(spark, sf_dir), ["day", "hour", "kind"], chunks={"day": 10})
    return c["n"].mean("day", skipna=False).df.select("hour", "kind", r6("n"))


@query("SELECT event_type, round(avg(CAST(CAST(value AS FLOAT) AS DOUBLE)), 4) AS value FROM events GROUP BY 1")
def mean_dtype_float(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value")
    return means.mean(e, ["event_type"], ["value"], dtype="float").select("event_type", F.round("value", 4).alias("value"))


@query("SELECT event_type, round(avg(value), 6) AS value FROM events GROUP BY 1")
def mean_two_stage(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return means.mean_in_stages(e, ["event_type"], ["value"], G.index_of(F.col("event_id"), 100), (8, 4)).select("event_type", r6("value"))


@query("SELECT event_id % 100 AS position, round(avg(value), 6) AS value FROM events GROUP BY 1")
def mean_globally(spark, sf_dir):
    bags = table(spark, sf_dir, "events").select((F.col("event_id") % 100).alias("position"), "value")
    return means.mean(bags, ["position"], ["value"]).select("position", r6("value"))


@query("SELECT event_type, event_id % 10 AS position, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def mean_per_key(spark, sf_dir):
    bags = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 10).alias("position"), "value")
    return means.mean(bags, ["event_type", "position"], ["value"]).select("event_type", "position", r6("value"))


@query("SELECT event_id - event_id % 1000 AS event_id_offset, round(sum(value), 4) AS value_sum, count(value) AS value_count FROM events GROUP BY 1")
def sum_count_partial(spark, sf_dir):
    e = events(spark, sf_dir).with_offsets()
    return means.partial_means(e, ["event_id_offset"], ["value"]).withColumn("value_sum", F.round("value_sum", 4))


@query("SELECT hour(ts) AS hour, event_type, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def climatology_hour(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    return means.mean_by_label(e, {"hour": F.hour("ts").cast("long")}, ["event_type"], ["value"]).select("hour", "event_type", r6("value"))


@query("SELECT month(o_orderdate) AS month, o_orderpriority, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS o_totalprice FROM orders GROUP BY 1, 2")
def climatology_month(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderpriority", cents("o_totalprice"))
    return means.mean_by_label(o, {"month": F.month("o_orderdate").cast("long")}, ["o_orderpriority"], ["o_totalprice"]).select("month", "o_orderpriority", amount("o_totalprice"))


@query("SELECT month(ts) AS month, hour(ts) AS hour, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def climatology_month_hour(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", "value")
    return means.mean_by_label(e, {"month": F.month("ts").cast("long"), "hour": F.hour("ts").cast("long")}, [], ["value"]).select("month", "hour", r6("value"))


@query("SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) <= 5 THEN 'MAM' WHEN month(o_orderdate) <= 8 THEN 'JJA' ELSE 'SON' END AS season, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS o_totalprice FROM orders GROUP BY 1")
def season_mean(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderdate", cents("o_totalprice"))
    return means.mean_by_label(o, {"season": means.season(F.col("o_orderdate"))}, [], ["o_totalprice"]).select("season", amount("o_totalprice"))


@query("SELECT CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) // 10 AS BIGINT) AS bucket, round(avg(value), 6) AS value FROM events GROUP BY 1")
def resample_10d(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", "value")
    first = F.broadcast(e.agg(F.min("ts").alias("origin")))
    placed = e.join(first, F.lit(True)).select(means.resample_index(F.col("ts"), 10, F.col("origin")).alias("bucket"), "value")
    return means.mean(placed, ["bucket"], ["value"]).select("bucket", r6("value"))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS l_extendedprice FROM lineitem GROUP BY 1, 2")
def grouped_mean_lineitem(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", cents("l_extendedprice"))
    return means.mean(t, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"]).select("l_returnflag", "l_linestatus", r6("l_quantity"), amount("l_extendedprice"))


@query("SELECT 'mean' AS output, round(avg(value), 6) AS value FROM events UNION ALL SELECT 'max', round(max(value), 6) FROM events")
def fan_out(spark, sf_dir):
    both = events(spark, sf_dir)["value"].df.agg(F.avg("value").alias("mean"), F.max("value").alias("max"))
    return both.unpivot([], ["mean", "max"], "output", "value").select("output", r6("value"))


# ---- validation, stores ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {DAYS}, s AS (SELECT max(day) + 1 AS days, max(hour) + 1 AS hours, max(kind) + 1 AS kinds FROM d), c AS (SELECT day - day % 10 AS day_offset, count(*) AS cells FROM d GROUP BY 1) SELECT day_offset, cells, least(10, days - day_offset) * hours * kinds AS expected FROM c, s WHERE cells != least(10, days - day_offset) * hours * kinds")
def validate_complete(spark, sf_dir):
    c = Cube.from_dataframe(days(spark, sf_dir), ["day", "hour", "kind"], chunks={"day": 10})
    return c.validate().select("day_offset", "cells", "expected")


@query(f"WITH {EMB} SELECT max(vec_id) + 1 AS vec_id, max(k) + 1 AS k FROM e")
def discover_template(spark, sf_dir):
    t = discover(vectors(spark, sf_dir).df, ["vec_id", "k"])
    return spark.range(1).select(*[F.lit(n).cast("long").alias(d) for d, n in t.sizes.items()])


@query("SELECT c_custkey, c_acctbal FROM customer")
def range_source(spark, sf_dir):
    from ..sources.ranges import range_source as source

    t = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return source(spark, t.count(), 16).join(t, F.col("index") == F.col("c_custkey")).select("c_custkey", "c_acctbal")


def _store(spark: SparkSession) -> str:
    return f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/zarr-{uuid.uuid4().hex}"


@query(f"WITH {EMB} SELECT vec_id, k, v FROM e")
def zarr_roundtrip(spark, sf_dir):
    path = _store(spark)
    vectors(spark, sf_dir, {"vec_id": 250, "k": 32}).to_zarr(path)
    return Cube.from_zarr(spark, path).df


@query(f"WITH {EMB} SELECT vec_id - 260 AS vec_id, k, v FROM e WHERE vec_id >= 260 AND k < 8")
def zarr_shards_pruned(spark, sf_dir):
    path = _store(spark)
    vectors(spark, sf_dir, {"vec_id": 250, "k": 32}).to_zarr(path, zarr_chunks_per_shard={"k": 4})
    return Cube.from_zarr(spark, path).isel(vec_id=slice(260, None), k=slice(0, 8)).df


@query(f"WITH {EMB} SELECT vec_id - 4 AS vec_id, k, v FROM e WHERE vec_id >= 4 AND vec_id < 9 AND k >= 2 AND k < 40")
def zarr_select_pruned(spark, sf_dir):
    """Bounds and variables keep with a store through selections: one after another, the units outside are never read."""
    path = _store(spark)
    vectors(spark, sf_dir, {"vec_id": 50, "k": 32}).map_cells(w=F.col("v") + 1).to_zarr(path)
    return Cube.from_zarr(spark, path).isel(vec_id=slice(4, 100))["v"].isel(vec_id=slice(0, 5)).df.where("k >= 2 AND k < 40")


@query(f"WITH {EMB} SELECT k, vec_id, v FROM e WHERE vec_id < 7 AND k < 3")
def zarr_transpose_pruned(spark, sf_dir):
    path = _store(spark)
    vectors(spark, sf_dir, {"vec_id": 50, "k": 32}).to_zarr(path, zarr_format=3)
    return Cube.from_zarr(spark, path).transpose("k", "vec_id").head(vec_id=7, k=3).df


@query(f"WITH {EMB}, m AS (SELECT vec_id, avg(v) AS m FROM e GROUP BY 1) SELECT vec_id, k, round(v - m, 6) AS v FROM e JOIN m USING (vec_id)")
def zarr_map_blocks(spark, sf_dir):
    """Read, map and write chunk by chunk: whole stored units go through the function without an exchange."""
    a, b = _store(spark), _store(spark)
    vectors(spark, sf_dir, {"vec_id": 50, "k": 32}).to_zarr(a)
    mapped = Cube.from_zarr(spark, a).rechunk({"vec_id": 100, "k": -1}).map_blocks(lambda x: x.map(lambda v: v - v.mean(axis=1, keepdims=True)))
    mapped.to_zarr(b)
    return Cube.from_zarr(spark, b).df.select("vec_id", "k", r6("v"))


@query(f"WITH {EMB}, n AS (SELECT max(vec_id) + 1 AS n, max(k) + 1 AS m FROM e) SELECT 'vec_id' AS dim, n AS size, 50 AS chunk FROM n UNION ALL SELECT 'k', m, 32 FROM n")
def zarr_open_template(spark, sf_dir):
    path = _store(spark)
    vectors(spark, sf_dir, {"vec_id": 50, "k": 32}).to_zarr(path)
    template, chunks = zarr.open_template(path)
    return spark.createDataFrame([(d, n, chunks[d]) for d, n in template.sizes.items()], "dim string, size bigint, chunk bigint")


@query("SELECT event_id, value FROM events")
def zarr_append(spark, sf_dir):
    """The first part of a dimension is written, then the dimension is made longer and the rest is written behind it."""
    path = _store(spark)
    c = events(spark, sf_dir, 100)["value"]
    n = c.sizes["event_id"]
    half = n // 200 * 100
    c.head(event_id=half).to_zarr(path)
    metas = zarr.extend(path, "event_id", n)
    zarr.write_cells(c.df.where(F.col("event_id") >= half), ["event_id"], metas)
    return Cube.from_zarr(spark, path).df


@query("SELECT CAST(ceil((max(event_id) + 1) / 1000.0) AS BIGINT) AS chunks, max(event_id) + 1 AS cells, round(sum(value), 4) AS total FROM events")
def custom_sink(spark, sf_dir):
    """A sink of one's own, called on every chunk; here it writes each chunk's sum as a file in the shared folder."""
    path = _store(spark)

    def save(key: ChunkKey, block: Block) -> None:
        zarr.put(f"{path}/{key.offsets['event_id']}.txt", f"{block['value'].size} {float(block['value'].sum())!r}".encode())

    chunks = events(spark, sf_dir)["value"].foreach_block(save)
    parts = spark.read.text(f"file://{path}" if path.startswith("/") else path).select(F.split("value", " ").alias("x"))
    return parts.agg(F.lit(chunks).cast("long").alias("chunks"), F.sum(F.col("x")[0].cast("long")).alias("cells"), F.round(F.sum(F.col("x")[1].cast("double")), 4).alias("total"))


@query(f"WITH {EMB} SELECT vec_id, k, v FROM e WHERE vec_id < 20")
def collect_block(spark, sf_dir):
    """A small selection as one block on the driver, and back."""
    b = vectors(spark, sf_dir).head(vec_id=20).collect()
    return Cube.from_block(spark, b, {"vec_id": 5}).df


@query("SELECT event_id // 1000 * 1000 AS at, count(*) AS cells, 'ChunkKey(offsets={''event_id'': ' || CAST(event_id // 1000 * 1000 AS VARCHAR) || '}, vars={''value''})' AS key, true AS same FROM events GROUP BY 1")
def key_objects(spark, sf_dir):
    """Keys as Python objects on the workers: replaced, changed, pickled, hashed, compared and shown."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            keys = [ChunkKey({"event_id": r["at"]}).replace(vars={"value"}).with_offsets(extra=1).with_offsets(extra=None) for r in rows]
            again = [pickle.loads(pickle.dumps(k)) for k in keys]
            same = [a == b and hash(a) == hash(b) and len({a, b}) == 1 and a != a.with_offsets(event_id=-1) for a, b in zip(keys, again, strict=True)]
            yield pa.RecordBatch.from_pydict({"at": [r["at"] for r in rows], "cells": [r["cells"] for r in rows], "key": list(map(repr, again)), "same": same})

    return events(spark, sf_dir).chunk_table().select(F.col("event_id_offset").alias("at"), "cells").mapInArrow(run, "at long, cells long, key string, same boolean")


@query(f"WITH {EMB}, n AS (SELECT max(vec_id) + 1 AS n FROM e) SELECT unnest(range(0, CAST(ceil(n / 50.0) AS BIGINT))) * 50 AS vec_id, 0 AS k FROM n")
def keys_of_blocks(spark, sf_dir):
    """The keys of a grid from block sizes, through regular sizes, offsets and their ordinals."""
    c = vectors(spark, sf_dir)
    blocks = G.expand_chunks(G.finalize_chunks({"vec_id": 50}, c.sizes), c.sizes)
    assert G.regular_chunks(blocks) == c.chunks
    at = G.block_offsets(blocks)
    ordinals = G.offset_ordinals(at)
    keys = [k for k in G.chunk_keys(at) if ordinals["vec_id"][k.offsets["vec_id"]] * 50 == k.offsets["vec_id"]]
    return spark.createDataFrame([(k.offsets["vec_id"], k.offsets["k"]) for k in keys], "vec_id bigint, k bigint")


@query(f"""WITH {EMB}, n AS (SELECT max(vec_id) + 1 AS n, max(k) + 1 AS m FROM e)
SELECT 'given' AS spec, least(50, n) AS vec_id, m AS k FROM n UNION ALL SELECT 'whole', n, m FROM n UNION ALL SELECT 'bytes', least(10, n), m FROM n""")
def chunk_specs(spark, sf_dir):
    """Chunk specs: sizes and whole dimensions, and as many rows as 10 * 64 * 8 bytes hold."""
    c = vectors(spark, sf_dir)
    norm = lambda spec: G.normalize_chunks(spec, c.sizes, c.template.itemsizes(), False, {"vec_id": 1, "k": 1})
    specs = {"given": norm({"vec_id": 50, "k": -1}), "whole": norm(-1), "bytes": norm({"k": -1, "vec_id": f"{10 * c.sizes['k'] * 8}B"})}
    return spark.createDataFrame([(name, g["vec_id"], g["k"]) for name, g in specs.items()], "spec string, vec_id bigint, k bigint")


@query(f"""WITH {EMB}, n AS (SELECT max(vec_id) + 1 AS n, max(k) + 1 AS m FROM e)
SELECT CAST(ceil(n / 50.0) AS BIGINT) AS chunks, CAST(2 * ceil(n / 50.0) AS BIGINT) AS split_chunks, 16 AS itemsize, least(50, n) * m * 16 AS bytes, true AS shown FROM n""")
def cube_metadata(spark, sf_dir):
    c = vectors(spark, sf_dir).map_cells(w=F.col("v") * 2)
    shown = f"{G.human_size(c.bytes_per_chunk)} each, {c.chunk_count} chunks" in repr(c) and "w (vec_id, k) float64" in repr(c)
    return spark.createDataFrame([(c.chunk_count, c.split_variables().chunk_count, c.itemsize, c.bytes_per_chunk, shown)], "chunks bigint, split_chunks bigint, itemsize bigint, bytes bigint, shown boolean")


@query(f"WITH {EMB}, n AS (SELECT max(vec_id) + 1 AS n, max(k) + 1 AS m FROM e) SELECT 'kept' AS template, n AS vec_id, m AS k, CAST(NULL AS BIGINT) AS t FROM n UNION ALL SELECT 'resized', n, 3, NULL FROM n UNION ALL SELECT 'with t', n, m, 4 FROM n UNION ALL SELECT 'without k', n, NULL, NULL FROM n")
def template_dims(spark, sf_dir):
    t = discover(vectors(spark, sf_dir).df, ["vec_id", "k"])
    made = {"kept": t, "resized": t.replace_dims(k=3), "with t": t.add_dims(t=4), "without k": t.drop_dims("k")}
    return spark.createDataFrame([(n, *[x.sizes.get(d) for d in ("vec_id", "k", "t")]) for n, x in made.items()], "template string, vec_id bigint, k bigint, t bigint")


@query(f"WITH {EMB} SELECT vec_id, k, v, 2 * v AS w FROM e")
def block_roundtrip(spark, sf_dir):
    """Blocks rechunked in memory, their variables split and merged again, checked and turned back into cells."""
    c = vectors(spark, sf_dir, {"vec_id": 100, "k": 16}).map_cells(w=F.col("v") * 2)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                key = ChunkKey({d: row[f"{d}_offset"] for d in ("vec_id", "k")})
                parts = list(B.split_chunks(key, unpacked(row["variables"]), {"vec_id": 30, "k": 8}))
                single = [r for k, b in parts for r in B.split_variables(k, b)]
                whole_key, whole = B.consolidate_fully(single)
                merged = dict(B.consolidate_variables(single))
                assert len(merged) == len(parts) and whole_key.offsets == key.offsets
                for k, b in B.rechunk_in_memory([(ChunkKey(whole_key.offsets), whole)], {"vec_id": 50, "k": 8}):
                    B.validate_block(k, b)
                    yield packed(b, {d: k.offsets[d] for d in ("vec_id", "k")}, ["v", "w"])

    blocks = c.to_blocks().mapInArrow(run, c.to_blocks().schema)
    return Cube.from_blocks(blocks, c.template, {"vec_id": 50, "k": 8}).df


@query(f"WITH {EMB}, n AS (SELECT max(vec_id) + 1 AS n FROM e) SELECT CAST(floor(sqrt(n)) AS BIGINT) AS a, 8 AS b, least(10, n) AS grown, 8 AS shared, least(n, 640) AS single_read, 64 AS single_write FROM n")
def stage_grids(spark, sf_dir):
    """Grids of a rechunk plan: the geometric middle between (n, 1) and (1, 64), grown chunks, shared chunks and a single stage's grids."""
    n = vectors(spark, sf_dir).sizes["vec_id"]
    ((a, b),) = stage_chunks((n, 1), (1, 64), 2)
    grown = grow_chunks((n, 64), (1, 8), 8, 10 * 64 * 8)
    shared = shared_chunks((n, 8), (1, 64))
    read, _, write = single_stage_plan((n, 64), (n if n < 640 else 640, 1), (1, 64), 8, 8 * 64 * 10, False, False)
    return spark.createDataFrame([(a, b, grown[0], shared[1], read[0], write[1])], "a bigint, b bigint, grown bigint, shared bigint, single_read bigint, single_write bigint")


@query(f"WITH {EMB}, n AS (SELECT max(vec_id) + 1 AS n FROM e) SELECT 1 AS stages, true AS consolidates, false AS splits, 0 AS equal, true AS warned FROM n")
def rechunk_steps(spark, sf_dir):
    """A plan by dimension names, none for equal grids, and the warning where more stages would not help."""
    sizes = vectors(spark, sf_dir).sizes
    plan = multistage_plan((sizes["vec_id"], 64), (50, 64), (50, 64), 8, 8, 2**30, False, False)
    steps = rechunk_plan(sizes, {"vec_id": 50, "k": 64}, {"vec_id": 100, "k": 64}, 8, 8, 2**20)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        multistage_plan((6, 10), (2, 5), (6, 1), 8, 10**7, 2**30)
    warned = any(issubclass(w.category, ExcessiveIOWarning) for w in seen)
    equal = len(rechunk_plan(sizes, {"vec_id": 50}, {"vec_id": 50}, 8))
    return spark.createDataFrame([(len(plan), steps[0].consolidates, steps[0].splits, equal, warned)], "stages int, consolidates boolean, splits boolean, equal int, warned boolean")


@query("""WITH n AS (SELECT CAST(ceil((max(event_id) + 1) / 100.0) AS BIGINT) AS n FROM events), f AS (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS f FROM n)
SELECT n AS chunks, CASE WHEN (f - 1) * (f - 1) >= n THEN f - 1 ELSE f END AS widest, CASE WHEN (f - 1) * (f - 1) >= n OR f * (f - 1) >= n THEN f - 1 ELSE f END AS narrowest, true AS enough FROM f""")
def fanout_bins(spark, sf_dir):
    """Levels of a tree-shaped mean: the smallest two that have room for all chunks; the cheapest ones have room as well."""
    c = events(spark, sf_dir, 100)
    n = c.chunk_count
    two = covering_bins(int(np.ceil(np.sqrt(n))), 2, n)
    best = best_bins(["event_id"], c.chunks, c.sizes, c.itemsize)
    enough = int(np.prod(best)) >= n and schedule_cost(best, n, c.itemsize, 10_000) <= schedule_cost(two, n, c.itemsize, 10_000)
    return spark.createDataFrame([(n, max(two), min(two), enough)], "chunks bigint, widest bigint, narrowest bigint, enough boolean")


@query("SELECT event_id, 3 * value AS value FROM events")
def thread_maps(spark, sf_dir):
    """A map over batches in threads, in order."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return thread_map_batches(e, lambda p: p.assign(value=p["value"] * 3), "event_id long, value double")


@query("SELECT count(*) AS cells, count(value) AS value_present, count(user_id) AS user_id_present FROM events")
def observed_metrics(spark, sf_dir):
    """Counts observed while another action runs."""
    seen, counts = events(spark, sf_dir).observed("events")
    seen.df.write.format("noop").mode("overwrite").save()
    (o,) = counts.values()
    return spark.createDataFrame([o.get], "cells bigint, value_present bigint, user_id_present bigint")


def timed(spark: SparkSession, sf_dir: str) -> Cube:
    """The mean value (in cents) of each hour that has events, over a time dimension with labels."""
    e = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.sum(F.round(F.col("value") * 100)).alias("cents"))
    hours = labels_of(e, "hour")
    first = F.lit(min(hours))
    place = {h: k for k, h in enumerate(hours)}
    positions = spark.createDataFrame(list(place.items()), "hour timestamp_ntz, time bigint") if "ntz" in e.schema["hour"].dataType.simpleString() else spark.createDataFrame(list(place.items()), "hour timestamp, time bigint")
    cells = e.where(F.col("hour") >= first).join(F.broadcast(positions), "hour").select("time", "cents")
    return Cube.from_dataframe(cells, ["time"], ["cents"], sizes={"time": len(hours)}, chunks=100, labels={"time": np.array(hours, "datetime64[ns]")})


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS h, sum(round(value * 100)) AS cents FROM events GROUP BY 1)
SELECT month(h) - 1 AS month, dense_rank() OVER (ORDER BY hour(h)) - 1 AS hour, avg(cents) AS cents FROM h GROUP BY 1, hour(h)""")
def climatology_program(spark, sf_dir):
    """The climatology program, from store to store; months and hours without data stay missing and are left out here."""
    a, b = _store(spark), _store(spark)
    timed(spark, sf_dir).to_zarr(a)
    cli.climatology(spark, a, b)
    return Cube.from_zarr(spark, b).df.where("NOT isnan(cents)")


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS h, sum(round(value * 100)) AS cents FROM events GROUP BY 1) SELECT row_number() OVER (ORDER BY h) - 1 AS time, cents FROM h""")
def rechunk_program(spark, sf_dir):
    """The rechunk program: another grid, in shards."""
    a, b = _store(spark), _store(spark)
    timed(spark, sf_dir).to_zarr(a)
    cli.rechunk(spark, a, b, cli.parse_chunks("time=8"), cli.parse_chunks("time=64"))
    return Cube.from_zarr(spark, b).df


@query("SELECT o_orderkey AS a, round(o_totalprice, 2) AS price, o_orderkey % 1000 AS b FROM orders WHERE o_orderkey < 1000")
def written_without_template(spark, sf_dir):
    """A table written as it is: its sizes are found in the data."""
    path = _store(spark)
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 1000).cast("double").alias("b"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", FutureWarning)
        zarr.write_dataframe(t, ["a"], path, chunks=500)
    return Cube.from_zarr(spark, path).head(a=1000).df.select("a", F.round("price", 2).alias("price"), F.col("b").cast("long").alias("b"))


@query("SELECT count(*) AS cells, round(sum(2 * l_quantity), 2) AS total FROM (SELECT l_quantity FROM lineitem)")
def map_blocks_many_cells(spark, sf_dir):
    """Blocks of a dataset of over 2^22 cells, most of them absent: the template is found on one chunk whatever the size."""
    t = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), "l_quantity")
    by_line = t.groupBy("line").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("rows"))
    n = max(1 << 23, by_line.agg(F.max("line")).first()[0] + 1)
    c = Cube.from_dataframe(by_line, ["line"], ["quantity", "rows"], sizes={"line": n}, chunks=1 << 16).map_cells(rows=F.col("rows").cast("double"))
    m = c.map_blocks(lambda b: b.map(lambda x: x * 2))
    return m.df.agg(F.round(F.sum(F.nanvl("rows", F.lit(0.0))) / 2, 0).cast("long").alias("cells"), F.round(F.sum(F.nanvl("quantity", F.lit(0.0))), 2).alias("total"))
