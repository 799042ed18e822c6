"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A rule is (host, path, action). It fits a URL whose host is the rule's host or a subdomain of it and whose path
starts with the rule's path. The longest fitting rule (characters of host and path together, then its text) decides.

Only DataFrame functions run here. Each URL yields its candidate keys: every suffix of its host at a label
boundary, joined with every prefix of its path that has the length of some rule's path. The Bloom filter drops the
candidates that no rule has; what passes meets the rules in an exact hash join, so false positives disappear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named

#: The filter has at most this many blocks of 256 bits (1 MB), whatever the list's size; a list too long for that
#: only lets more candidates through to the join.
MAX_BLOCKS = 1 << 15
KEYS_PER_BLOCK = 16
#: Above so many rules the exact join is not hinted as a broadcast.
BROADCAST_RULES = 100_000

_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty for null or without '://'."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _ASCII_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end; empty for null or without '://'."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block_and_mask(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The key's block and, for each of the block's four words, the one bit it sets there."""
    h = F.xxhash64(key)
    bits = F.xxhash64(F.lit(17), key)
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(bits, 6 * i), F.lit(64)).cast("int")) for i in range(4)]
    return F.pmod(h, F.lit(blocks)).cast("int"), masks


def build_bloom(keys: DataFrame, key: str, count: int) -> tuple[list[list[int]], int]:
    """The filter's four word arrays; at most MAX_BLOCKS rows come to the driver."""
    blocks = max(1, min(MAX_BLOCKS, count // KEYS_PER_BLOCK + 1))
    block, masks = _block_and_mask(F.col(key), blocks)
    rows = keys.select(block.alias("b"), *[m.alias(f"w{i}") for i, m in enumerate(masks)]).groupBy("b").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)]).collect()
    words = [[0] * blocks for _ in range(4)]
    for row in rows:
        for i in range(4):
            words[i][row["b"]] = row[f"w{i}"]
    return words, blocks


def might_contain(key: Column, bloom: tuple[list[list[int]], int]) -> Column:
    words, blocks = bloom
    block, masks = _block_and_mask(key, blocks)
    found = F.lit(True)
    for i in range(4):
        table = F.array(*[F.lit(w).cast("long") for w in words[i]]) if blocks < 64 else F.from_json(F.lit(str(words[i])), "array<bigint>")
        found = found & (F.element_at(table, block + 1).bitwiseAND(masks[i]) != 0)
    return found


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row of pages by rules(host, path, action).

    Returns id_col, host, path, rule (host and path of the deciding rule, else null), verdict and possible_hits (the
    candidates that passed the filter). A URL that no rule fits gets the default. Null and malformed URLs have an empty
    host and path and fit no rule; rules with a null or empty host fit nothing; repeated rows are judged alike. Where two equal
    rules differ in action, the smaller action text (allow before block) holds.
    """
    pages = named(pages, row_id=id_col, url=url_col)
    listed = (
        named(rules, host="host", path="path", action="action")
        .where("host IS NOT NULL AND host != ''")
        .select(F.concat(F.translate("host", _UPPER, _ASCII_LOWER), F.lit("\n"), F.coalesce("path", F.lit(""))).alias("key"), F.concat("host", F.coalesce("path", F.lit(""))).alias("rule"), "action", F.length(F.coalesce("path", F.lit(""))).alias("n"))
        .groupBy("key").agg(F.min("rule").alias("rule"), F.min("action").alias("action"), F.min("n").alias("n"))
    )
    lengths = sorted(r[0] for r in listed.select("n").distinct().collect())
    count = listed.count()
    parsed = pages.select("row_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not count:
        return parsed.select(F.col("row_id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(0).alias("possible_hits"))
    bloom = build_bloom(listed, "key", count)
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    candidates = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\n"), p))))
    hits = F.filter(candidates, lambda c: c.isNotNull() & might_contain(c, bloom))
    tested = parsed.withColumn("hits", F.when(F.col("host") != "", hits).otherwise(F.array().cast("array<string>"))).withColumn("uid", F.monotonically_increasing_id())
    looked = tested.select("row_id", "host", "path", "uid", F.size("hits").alias("possible_hits"), F.explode_outer("hits").alias("key"))
    exact = F.broadcast(listed.drop("n")) if count <= BROADCAST_RULES else listed.drop("n")
    rank = F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("action"))
    return (
        looked.join(exact, "key", "left")
        .groupBy("uid", "row_id", "host", "path", "possible_hits")
        .agg(F.max(F.when(F.col("rule").isNotNull(), rank)).alias("best"))
        .select(F.col("row_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"), "possible_hits")
    )
