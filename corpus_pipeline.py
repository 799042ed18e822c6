"""A corpus pipeline of five stages, each applying one operator of tessel.llm to all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm import mixing, near_dup, packing, suffix_dedup, toxicity
from tessel.llm.common import materialize
from tessel.llm.queries import table, tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the grammar learns from labelled rows of docs that are not held out.

    Null and empty texts have no clause and stay, very long ones are read whole, repeated rows share a fate; an empty table stays empty.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the smallest id stays.

    Rows without words (null, empty) and rows with a null id are in no group and stay; rows that repeat an id are one document, which
    stays or goes with all its rows.
    """
    found = near_dup.near_duplicates(docs, width=5)
    return docs.join(found.where(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that occur earlier are cut out; n_chars is counted anew. No row goes.

    A null text stays null, rows with a null id keep their text, rows that repeat id and text keep the same.
    """
    out = suffix_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0 to 3 rows.

    Rows with neither id nor text, or that repeat both, share one hash: the copies that the mix takes of them are dealt among them. A text
    without words (null, empty) has no size and is taken by the whole part of its source's share; null sources are one source.
    """
    mix = mixing.mix_sources(docs, cut_last=False).groupBy("row_key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    keyed = docs.select(F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("doc"), F.xxhash64("doc_id", "text").alias("row_key"))
    own = Window.partitionBy("row_key").orderBy("row_key")
    share = F.expr("int(copies div rows) + int(nth <= copies % rows)")
    taken = keyed.join(mix.where("copies > 0"), "row_key").withColumn("nth", F.row_number().over(own)).withColumn("times", share)
    again = taken.where("times > 0").select("doc", F.explode(F.sequence(F.lit(1), "times")))
    return again.select(*[F.col(f"doc.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 4096 ids. A null or empty text is the closing id alone; every row is packed, repeated ones too."""
    path = tokenizer_path("word_bpe_49k.json")
    return packing.pack(docs, lambda: packing.WordEncoder(path, 2))


STAGES = [("toxicity", toxicity_stage), ("near_dup", near_dup_stage), ("suffix_dedup", suffix_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: None: tokenising, MinHash and the mix's random draws are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
