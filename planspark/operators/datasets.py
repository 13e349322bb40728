"""Dataset building: splits, samples, merges and file-level filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planspark.operators.ordering import ranked


def shuffle_key(id: Column | str, seed: int) -> Column:
    """A reproducible random order: the same rows get the same order everywhere."""
    column = F.col(id) if isinstance(id, str) else id
    return F.md5(F.concat_ws("#", column.cast("string"), F.lit(str(seed))))


def split_exact(
    df: DataFrame, id: str, shares: Sequence[tuple[str, float]], seed: int = 0, name: str = "split"
) -> DataFrame:
    """Random split with exact sizes: floor(n * share) each, the last part takes the rest."""
    order = [shuffle_key(id, seed), F.col(id)]
    numbered = ranked(df, [], order, "__pos")
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    part, upto = None, F.lit(0)
    for label, share in shares[:-1]:
        upto = upto + F.floor(F.col("__n") * F.lit(share))
        test = F.col("__pos") <= upto
        part = F.when(test, label) if part is None else part.when(test, label)
    split = F.lit(shares[-1][0]) if part is None else part.otherwise(shares[-1][0])
    return numbered.join(F.broadcast(total)).withColumn(name, split).drop("__pos", "__n")


THREE_WAY = (("train", 0.8), ("val", 0.1), ("test", 0.1))
TWO_WAY = (("train", 0.8), ("val", 0.2))
CORPUS = (("train", 0.7), ("dev", 0.2), ("test", 0.1))


def corpus(
    texts: DataFrame, classes: Sequence[str], id: str, copies: int = 4, seed: int = 0, split_first: bool = True
) -> DataFrame:
    """Number the classes (unknown ones last), replicate rows and split 70/20/10.

    With ``split_first`` all copies of a text land in one part, so no test row
    was seen in training.
    """
    number = F.coalesce(
        *[F.when(F.col("category") == c, F.lit(i)) for i, c in enumerate(classes)], F.lit(len(classes))
    )
    base = texts.withColumn("label", number)
    every = F.explode(F.sequence(F.lit(1), F.lit(copies)))
    if split_first:
        return split_exact(base, id, CORPUS, seed).withColumn("copy", every)
    rows = base.withColumn("copy", every).withColumn("__row", F.concat_ws("/", F.col(id), F.col("copy")))
    return split_exact(rows, "__row", CORPUS, seed).drop("__row")


def sample_n(df: DataFrame, id: str, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(shuffle_key(id, seed), F.col(id)).limit(n)


def file_states(files: DataFrame, shapes: DataFrame, key: str) -> DataFrame:
    """Per file: number of shapes and the label of the last one."""
    facts = shapes.groupBy(key).agg(
        F.count(F.lit(1)).alias("shapes"), F.max_by("label", "shape_no").alias("last_label")
    )
    return files.join(facts, key, "left").fillna(0, ["shapes"])


def filter_files(files: DataFrame, shapes: DataFrame, key: str, last: str | None = None, drop_last: str = "Delete") -> DataFrame:
    """Files with shapes whose last shape is not ``drop_last`` and, if given, is ``last``."""
    states = file_states(files, shapes, key).where(
        (F.col("shapes") > 0) & (F.coalesce("last_label", F.lit("")) != drop_last)
    )
    return states if last is None else states.where(F.col("last_label") == last)


def orphans(images: DataFrame, labels: DataFrame, key: str, extension: str = ".jpg") -> DataFrame:
    """(key, problem): images without labels, labels without images, wrong image extension.

    ``images`` has ``key`` and ``ext``; both sides may list a key repeatedly.
    """
    i = images.select(key).distinct().withColumn("__i", F.lit(1))
    l = labels.select(key).distinct().withColumn("__l", F.lit(1))
    both = i.join(l, key, "full_outer")
    missing = both.where("__i IS NULL OR __l IS NULL").select(
        key, F.when(F.col("__i").isNull(), "no image").otherwise("no label").alias("problem")
    )
    wrong = images.where(F.col("ext") != extension).select(key).distinct().withColumn("problem", F.lit("extension"))
    return missing.union(wrong)


def union_distinct(frames: Sequence[DataFrame], key: str) -> DataFrame:
    return reduce(DataFrame.union, [f.select(key) for f in frames]).distinct()


def in_both(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_semi")


def corpus_except(lines: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Lines not listed elsewhere; repeated lines stay repeated."""
    return lines.join(listed.select(key).distinct(), key, "left_anti")


def merge_flags(datasets: Sequence[DataFrame], errors: Sequence[DataFrame], key: str, flag: str = "flag") -> DataFrame:
    """Merge 0/1 flags of several datasets into one code per name.

    Names in any error list are left out; a dataset without the name adds no digit.
    """
    rows = reduce(
        DataFrame.union, [d.select(key, flag, F.lit(i).alias("__d")) for i, d in enumerate(datasets)]
    )
    bad = union_distinct(errors, key)
    digits = [F.max(F.when(F.col("__d") == i, F.col(flag).cast("string"))).alias(f"__{i}") for i in range(len(datasets))]
    kept = rows.join(bad, key, "left_anti").groupBy(key).agg(*digits)
    return kept.select(key, F.concat_ws("", *[f"__{i}" for i in range(len(datasets))]).alias("code"))


def merge_annotations(docs: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """Shapes of several documents of one image in document order, renumbered per image."""
    rows = reduce(DataFrame.unionByName, [d.withColumn("doc", F.lit(i)) for i, d in enumerate(docs)])
    return ranked(rows, [key], [F.col("doc"), F.col(order)], "shape_pos")
