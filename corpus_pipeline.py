"""A corpus pipeline of five stages; each reads what the one before it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planspark.llm import bpe, decontaminate, lines, near, simhash, toxicity
from planspark.llm.common import table
from planspark.llm.components import components
from planspark.llm.queries import held_out, tokenizer_path
from planspark.session import cut, ensure_checkpoint_dir, shuffled


def toxic_documents_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; the model is fitted on the labelled ones among ``docs``."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    model = toxicity.fit(docs, labels)
    return toxicity.with_score(docs, model).where(F.col("_score") < toxicity.THRESHOLD).select(*docs.columns)


def repeated_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; ``n_chars`` follows the text.

    A document that loses all its lines keeps its row, with an empty text.
    """
    done = lines.dedup_lines(docs)
    new = {"text": F.when(F.size("_runs") == 0, F.col("text")).otherwise(F.col("_kept")).alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = (
            F.when(F.size("_runs") == 0, F.col("n_chars")).otherwise(F.length("_kept").cast("long")).alias("n_chars")
        )
    return done.select(*[new.get(c, F.col(c)) for c in docs.columns])


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each component of near copies: by id, null last, then by the text's key; one row of repeats.

    Rows are linked by ``op8_simhash``, and by the stage's own exact check of five words, similarity 0.8 or
    more, which finds copies that differ in more bits; a component hangs together by links of either kind.
    """
    id_, key, best_id, best_key = (F.col(c) for c in ("doc_id", "text_key", "component_id", "component_key"))
    row = lambda i, k: F.struct(i.isNull().alias("none"), i.alias("id"), k.alias("key"))
    close = near.near_copies(docs).groupBy(row(id_, key).alias("row"), row(best_id, best_key).alias("comp")).agg(F.count(F.lit(1)).alias("n"))
    named = docs.select(row(F.col("doc_id"), F.xxhash64("text")).alias("_row"), "text")
    prints = simhash.near_duplicates(named, id="_row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("print")).distinct()
    both = cut(close.join(prints, "row"))
    # the copies of a print bring their components together; a print that many rows have is one row by then
    pairs = both.select("print", "comp").distinct()
    least = pairs.groupBy("print").agg(F.min("comp").alias("b"))
    links = pairs.join(shuffled(least), "print").select(F.col("comp").alias("a"), "b").where("a <> b").distinct()
    labelled = components(both.select("comp").distinct(), links, id="comp", name="best")
    rows = both.groupBy("row", "comp").agg(F.max("n").alias("n")).join(labelled, "comp").withColumn("first", F.col("row") == F.col("best"))
    # later rows go; a first row that is repeated is taken out and put back once
    out = cut(rows.where("n > 1 OR NOT first").select(F.col("row.id").alias("_id"), F.col("row.key").alias("_key"), "first"))
    on = docs["doc_id"].eqNullSafe(out["_id"]) & (F.xxhash64(docs["text"]) == out["_key"])
    again = docs.join(out.where("first"), on, "left_semi").withColumn("_key", F.xxhash64("text"))
    return docs.join(out, on, "left_anti").unionByName(again.dropDuplicates(["doc_id", "_key"]).drop("_key"))


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of each document."""
    return bpe.digests(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxic_documents_out),
    ("line_dedup", repeated_lines_out),
    ("simhash_near_dedup", near_copies_out),
    ("decontamination", leaks_out),
    ("bpe", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
