"""Result and annotation documents.

A document is one part of a drawing or image: items are numbered, and part k
holds the items from k times ``part_items``. The part length belongs to the
format and is stated by whoever writes; no row grows with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planspark.operators.ordering import ranked


def documents(items: DataFrame, keys: Sequence[str], order: Sequence[str], item: Column, name: str, part_items: int) -> DataFrame:
    """(keys, part, name): ordered item arrays of ``part_items`` items each, the last one shorter."""
    keys = list(keys)
    numbered = ranked(items.withColumn("__item", item), keys, [F.col(c) for c in order], "__n", bounded=False)
    part = F.floor((F.col("__n") - 1) / part_items).alias("part")
    lists = numbered.groupBy(*keys, part).agg(F.array_sort(F.collect_list(F.struct("__n", "__item"))).alias("l"))
    return lists.select(*keys, "part", F.transform("l", lambda p: p["__item"]).alias(name))


def result_json(items: DataFrame, keys: Sequence[str], kind: str, fields: Sequence[str], part_items: int) -> DataFrame:
    """(keys, part, json): ``{kind: [[field values], ...]}`` per drawing."""
    docs = documents(items, keys, ["id"], F.array(*fields), kind, part_items)
    return docs.select(*keys, "part", F.to_json(F.struct(*keys, kind)).alias("json"))


def labelme_json(shapes: DataFrame, key: str, width: Column, height: Column, part_items: int) -> DataFrame:
    """(key, part, json) from (key, shape_no, label, points, shape_type, description)."""
    shape = F.struct("label", "points", F.lit(None).cast("string").alias("group_id"), "description", "shape_type")
    docs = documents(shapes, [key], ["shape_no"], shape, "shapes", part_items)
    body = F.struct(
        F.lit("5.5.0").alias("version"), F.col(key).cast("string").alias("imagePath"), height.alias("imageHeight"), width.alias("imageWidth"), "shapes"
    )
    return docs.select(key, "part", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def yolo_lines(boxes: DataFrame, key: str) -> DataFrame:
    """(key, box_no, line): 'cls cx cy w h' with six decimals."""
    numbers = [F.format_string("%.6f", F.col(c).cast("double")) for c in ("cx", "cy", "w", "h")]
    return boxes.select(key, "box_no", F.concat_ws(" ", F.col("cls").cast("string"), *numbers).alias("line"))


def coco_images(images: DataFrame, key: str) -> DataFrame:
    """Images with ids 1..n in name order."""
    return ranked(images, [], [F.col(key)], "id")


def coco_annotations(boxes: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """Annotations with ids 1..n: image_id, category_id (cls + 1), bbox, area, iscrowd."""
    from planspark.functions.boxes import yolo_to_coco

    numbered = ranked(boxes, [], [F.col(key), F.col("box_no")], "id")
    ids = images.select(key, F.col("id").alias("image_no"), "width", "height")
    c = yolo_to_coco(*[F.col(n) for n in ("cx", "cy", "w", "h", "width", "height")])
    return numbered.join(ids, key).select(
        "id", F.col("image_no").alias("image_id"), (F.col("cls") + 1).alias("category_id"),
        *[v.alias(n) for n, v in c.items()], F.lit(0).alias("iscrowd"),
    )


def write_documents(docs: DataFrame, path: str, by: Sequence[str], buckets: int) -> None:
    """The documents as rows (key columns, json) in ``buckets`` folders by the hash of the key."""
    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets)).alias("bucket")
    docs.select(bucket, *by, "json").repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(path)
