"""Text tables: corpora, vocabularies, dictionary tables and the text classifier."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planspark.functions import dictionaries as D
from planspark.functions import text as T
from planspark.operators.ordering import ranked
from planspark.session import cut


def vocabulary(
    texts: DataFrame, column: str = "text", by_word: bool = False, size: int = D.VOCAB_SIZE, min_count: int = 1
) -> DataFrame:
    """(token, count, id): the ``size`` most frequent tokens, ids from 0, ties by token.

    Two rows follow: the unknown and the padding token.
    """
    counts = (
        texts.select(F.explode(T.tokens(F.col(column), by_word)).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("count"))
        .where(F.col("count") >= min_count)
    )
    order = [F.col("count").desc(), F.col("token")]
    top = ranked(counts.orderBy(*order).limit(size), [], order, "id", bounded=True)
    known = top.select("token", "count", (F.col("id") - 1).alias("id"))
    n = known.agg(F.count(F.lit(1)).alias("n"))
    extra = n.select(
        F.inline(
            F.array(
                F.struct(F.lit(D.UNKNOWN).alias("token"), F.lit(None).cast("long").alias("count"), F.col("n").alias("id")),
                F.struct(F.lit(D.PADDING).alias("token"), F.lit(None).cast("long").alias("count"), (F.col("n") + 1).alias("id")),
            )
        )
    )
    return known.unionByName(extra)


def token_ids(
    texts: DataFrame, vocab: DataFrame, key: str, column: str = "text", size: int = D.PAD_SIZE, by_word: bool = False
) -> DataFrame:
    """(key, seq_len, ids): token ids cut or padded to ``size``.

    How the vocabulary meets the tokens is left to the planner; a row is put
    together again from its ``size`` ids.
    """
    rows = texts.select(key, T.tokens(F.col(column), by_word).alias("__t"))
    rows = rows.select(
        key,
        F.least(F.size("__t"), F.lit(size)).alias("seq_len"),
        F.posexplode(T.padded(F.col("__t"), size, F.lit(D.PADDING))).alias("pos", "token"),
    )
    unknown = vocab.where(F.col("token") == D.UNKNOWN).select(F.col("id").alias("__unk"))
    found = rows.join(vocab.select("token", "id"), "token", "left").join(F.broadcast(unknown))
    pair = F.struct("pos", F.coalesce("id", "__unk").alias("id"))
    return found.groupBy(key).agg(
        F.first("seq_len").alias("seq_len"),
        F.transform(F.sort_array(F.collect_list(pair)), lambda p: p["id"]).alias("ids"),
    )


def reclassify(names: DataFrame, text: str, moves: Sequence[tuple[str, list[str], str | None]] = D.RECLASSIFY) -> DataFrame:
    """Move names with given words to other categories; the rest stays 'default'.

    A name may move to more than one category.
    """
    t = F.col(text)
    targets = F.array_compact(
        F.array(
            *[
                F.when(T.contains_any(t, ws) & (F.lit(True) if no is None else ~F.contains(t, F.lit(no))), F.lit(c))
                for c, ws, no in moves
            ]
        )
    )
    kept = F.when(F.size(targets) > 0, targets).otherwise(F.array(F.lit("default")))
    return names.withColumn("category", F.explode(kept))


def catalog_gaps(classes: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: (key, side)."""
    left = classes.select(key).subtract(catalog.select(key)).withColumn("side", F.lit("class"))
    right = catalog.select(key).subtract(classes.select(key)).withColumn("side", F.lit("catalog"))
    return left.union(right)


def subject_table(spark, subjects: Mapping[str, Sequence[str]] = D.LEGEND_SUBJECTS) -> DataFrame:
    """(id, category, subject): class numbers in catalogue order."""
    pairs = [(c, s) for s, cats in subjects.items() for c in cats]
    return spark.createDataFrame(
        [(i, c, s) for i, (c, s) in enumerate(pairs)], "id int, category string, subject string"
    )


def char_ngrams(column: str) -> Column:
    """Runs of one, two and three characters: the text zipped with itself, shifted."""
    # an empty text has no characters, but splits into one empty string
    one = F.when(F.col(column) != "", F.split(column, "")).when(F.col(column) == "", F.array().cast("array<string>"))
    two = F.zip_with(one, F.slice(one, 2, F.greatest(F.size(one) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    three = F.zip_with(two, F.slice(one, 3, F.greatest(F.size(one) - 2, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.array_compact(F.concat(one, two, three))


def text_classifier(train: DataFrame, column: str = "text", label: str = "label", features: int = 1 << 14, max_iter: int = 20):
    """Fit a character n-gram classifier; the model's ``transform`` predicts.

    The texts are read once: their n-gram counts are written out, and the
    weights are fitted on these.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF

    counts = HashingTF(inputCol="__grams", outputCol="__tf", numFeatures=features)
    counted = cut(counts.transform(train.select(label, char_ngrams(column).alias("__grams"))).select(label, "__tf"))
    stages = [
        IDF(inputCol="__tf", outputCol="__x"),
        LogisticRegression(featuresCol="__x", labelCol=label, maxIter=max_iter, regParam=1e-3),
    ]
    return PipelineModel([counts, *Pipeline(stages=stages).fit(counted).stages])


def classify(model, texts: DataFrame, column: str = "text") -> DataFrame:
    scored = model.transform(texts.withColumn("__grams", char_ngrams(column)))
    return scored.select(*texts.columns, F.col("prediction").cast("int").alias("prediction"))
