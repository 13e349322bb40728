"""Dataset building, set operations and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from planspark.catalog.bindings import cte, table, view
from planspark.catalog.registry import query
from planspark.catalog.scalars import r6
from planspark.operators import datasets as S
from planspark.operators import metrics as M

_KEY = "md5(doc_id || '#' || '7')"


def _split_sql(shares, rest):
    whens = " ".join(f"WHEN pos <= {upto} THEN '{n}'" for n, upto in shares)
    return (
        f"SELECT doc_id, CASE {whens} ELSE '{rest}' END AS split FROM (SELECT doc_id, row_number() OVER"
        f" (ORDER BY {_KEY}, doc_id) AS pos, count(*) OVER () AS n FROM documents)"
    )


@query(
    "split_train_val_test",
    _split_sql([("train", "floor(n * 0.8)"), ("val", "floor(n * 0.8) + floor(n * 0.1)")], "test"),
)
def split_train_val_test(spark, d):
    return S.split_exact(table(spark, d, "documents").select("doc_id"), "doc_id", S.THREE_WAY, 7)


@query("split_train_val", _split_sql([("train", "floor(n * 0.8)")], "val"))
def split_train_val(spark, d):
    return S.split_exact(table(spark, d, "documents").select("doc_id"), "doc_id", S.TWO_WAY, 7)


@query(
    "corpus_build",
    f"""WITH b AS (SELECT doc_id, lang, row_number() OVER (ORDER BY {_KEY}, doc_id) AS pos, count(*) OVER () AS n
    FROM documents) SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS label, c AS copy,
    CASE WHEN pos <= floor(n * 0.7) THEN 'train' WHEN pos <= floor(n * 0.7) + floor(n * 0.2) THEN 'dev' ELSE 'test' END
    AS split FROM b, (SELECT unnest([1, 2, 3, 4]) AS c)""",
)
def corpus_build(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("category"))
    return S.corpus(docs, ["en", "de"], "doc_id", 4, 7).select("doc_id", "label", "copy", "split")


@query("sample_n", f"SELECT doc_id FROM documents ORDER BY {_KEY}, doc_id LIMIT 200")
def sample_n(spark, d):
    return S.sample_n(table(spark, d, "documents").select("doc_id"), "doc_id", 200, 7)


_SHAPES = """WITH s AS (SELECT l_orderkey AS image, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS shape_no,
  CASE l_suppkey % 3 WHEN 0 THEN 'Delete' WHEN 1 THEN 'WallArea1' ELSE 'Door' END AS label FROM lineitem),
  k AS (SELECT image, count(*) AS shapes, arg_max(label, shape_no) AS last_label FROM s GROUP BY 1) """


def _shapes(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image"),
        F.expr("l_linenumber * 1000000000000L + l_partkey * 1000000L + l_suppkey").alias("shape_no"),
        F.expr("CASE l_suppkey % 3 WHEN 0 THEN 'Delete' WHEN 1 THEN 'WallArea1' ELSE 'Door' END").alias("label"),
    )


@query(
    "filter_dataset",
    _SHAPES + "SELECT o_orderkey AS image, shapes, last_label FROM orders JOIN k ON image = o_orderkey WHERE last_label <> 'Delete'",
)
def filter_dataset(spark, d):
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("image"))
    return S.filter_files(images, _shapes(spark, d), "image")


@query(
    "merge_annotations",
    """SELECT image, doc, shape_no, row_number() OVER (PARTITION BY image ORDER BY doc, shape_no) AS shape_pos FROM (
    SELECT o_orderkey AS image, 0 AS doc, o_custkey AS shape_no FROM orders UNION ALL
    SELECT l_orderkey, 1, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey FROM lineitem)""",
)
def merge_annotations(spark, d):
    first = table(spark, d, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_custkey").alias("shape_no"))
    second = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image"),
        F.expr("l_linenumber * 1000000000000L + l_partkey * 1000000L + l_suppkey").alias("shape_no"),
    )
    return S.merge_annotations([first, second], "image", "shape_no")


@query(
    "orphan_check",
    """SELECT o_orderkey AS image, 'no label' AS problem FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT DISTINCT l_orderkey, 'no image' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT o_orderkey, 'extension' FROM orders WHERE o_orderstatus = 'P'""",
)
def orphan_check(spark, d):
    images = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("image"), F.expr("CASE o_orderstatus WHEN 'P' THEN '.png' ELSE '.jpg' END").alias("ext")
    )
    return S.orphans(images, _shapes(spark, d), "image")


@query("corpus_except", "SELECT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def corpus_except(spark, d):
    lines = table(spark, d, "orders").select("o_custkey")
    listed = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return S.corpus_except(lines, listed, "o_custkey")


@query(
    "name_union_distinct",
    "SELECT p_name AS name FROM part UNION SELECT p_brand FROM part UNION SELECT c_mktsegment FROM customer",
)
def name_union_distinct(spark, d):
    part, customer = table(spark, d, "part"), table(spark, d, "customer")
    frames = [part.select(F.col("p_name").alias("name")), part.select(F.col("p_brand").alias("name")),
              customer.select(F.col("c_mktsegment").alias("name"))]
    return S.union_distinct(frames, "name")


@query("name_intersect", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def name_intersect(spark, d):
    return S.in_both(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query(
    "dataset_merge_excluding",
    """WITH e AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority = '5-LOW')
    SELECT o_orderkey AS name, (o_custkey % 2) || '' || coalesce(l.f || '', '') || (o_orderkey % 3 // 2) AS code
    FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber % 2) AS f FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
    WHERE o_orderkey NOT IN (SELECT k FROM e)""",
)
def dataset_merge_excluding(spark, d):
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    one = orders.select(F.col("o_orderkey").alias("name"), F.expr("o_custkey % 2").alias("flag"))
    two = items.select(F.col("l_orderkey").alias("name"), F.expr("CAST(l_linenumber % 2 AS BIGINT)").alias("flag"))
    three = orders.select(F.col("o_orderkey").alias("name"), F.expr("o_orderkey % 3 div 2").alias("flag"))
    bad = orders.where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("name"))
    return S.merge_flags([one, two, three], [bad], "name")


@query(
    "structure_union",
    f"""WITH {cte('arcs', 'rects', 'hexagons', 'door_rects')} SELECT 'slide' AS kind, dwg_id, id, x1, y1, x2, y2 FROM door_rects UNION ALL
    SELECT 'arc' AS kind, dwg_id, id, x1, y1, x2, y2 FROM arcs UNION ALL
    SELECT 'window', dwg_id, id, x1, y1, x2, y2 FROM rects UNION ALL
    SELECT 'wall', dwg_id, id, ox, oy, ox + w, oy + h FROM hexagons""",
)
def structure_union(spark, d):
    from planspark.operators.rooms import structure_union as union

    walls = view(spark, d, "hexagons").selectExpr("dwg_id", "id", "ox AS x1", "oy AS y1", "ox + w AS x2", "oy + h AS y2")
    layers = union({"slide": view(spark, d, "door_rects"), "arc": view(spark, d, "arcs"), "window": view(spark, d, "rects"), "wall": walls}, ["dwg_id", "id", "x1", "y1", "x2", "y2"])
    return layers


# --- statistics -----------------------------------------------------------------

_PRED = "CASE WHEN l_quantity > 25 THEN l_returnflag WHEN l_linestatus = 'F' THEN 'A' ELSE 'N' END"
_CM = f"WITH c AS (SELECT l_returnflag AS t, {_PRED} AS p FROM lineitem) "


def _predictions(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("t"), F.expr(_PRED).alias("p"))


@query(
    "label_counts",
    f"WITH {cte('boxes')} SELECT cls, CAST(count(*) AS BIGINT) AS boxes, count(DISTINCT image_id) AS files FROM boxes GROUP BY 1",
)
def label_counts(spark, d):
    return M.label_counts(view(spark, d, "boxes"), "image_id", "cls")


_LOG = """CASE o_orderkey % 4 WHEN 0 THEN ' finish' WHEN 1 THEN ' Get legend failed.' WHEN 2 THEN ' Get viewport failed.'
  ELSE ' stopped' END"""


@query(
    "log_status_counts",
    f"""WITH l AS (SELECT o_orderkey || {_LOG} AS line FROM orders) SELECT count(*) AS total,
    count(*) FILTER (WHERE line LIKE '%finish') AS valid, count(*) FILTER (WHERE line LIKE '%Get legend failed.') AS legend_err,
    count(*) FILTER (WHERE line LIKE '%Get viewport failed.') AS vp_err FROM l""",
)
def log_status_counts(spark, d):
    lines = table(spark, d, "orders").select(F.concat(F.col("o_orderkey"), F.expr(_LOG)).alias("line"))
    return M.log_status_counts(lines)


@query(
    "area_diff_stats",
    """SELECT round(avg(abs(m - w)), 6) AS mean_diff, round(avg(abs(m - w) / m * 100), 6) AS mean_pct,
    round(sum(abs(m - w)), 4) AS total_diff, round(sum(abs(m - w)) / sum(m), 6) AS ratio
    FROM (SELECT l_extendedprice + 1 AS m, l_extendedprice + l_discount * 100 - 3 AS w FROM lineitem)""",
)
def area_diff_stats(spark, d):
    rooms = table(spark, d, "lineitem").selectExpr(
        "l_extendedprice + 1 AS measured", "l_extendedprice + l_discount * 100 - 3 AS drawn"
    )
    s = M.area_diff_stats(rooms)
    return s.select(r6(F.col("mean_diff")).alias("mean_diff"), r6(F.col("mean_pct")).alias("mean_pct"),
                    F.round("total_diff", 4).alias("total_diff"), r6(F.col("ratio")).alias("ratio"))


@query(
    "classification_report",
    _CM + """, k AS (SELECT t, p, count(*) AS n FROM c GROUP BY 1, 2),
    s AS (SELECT t AS label, sum(n) AS support, sum(n) FILTER (WHERE t = p) AS tp FROM k GROUP BY 1),
    m AS (SELECT p AS label, sum(n) AS named FROM k GROUP BY 1),
    r AS (SELECT label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
      coalesce(coalesce(tp, 0) / nullif(coalesce(named, 0), 0), 0) AS precision,
      coalesce(coalesce(tp, 0) / nullif(coalesce(support, 0), 0), 0) AS recall FROM s FULL JOIN m USING (label)),
    f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r)
    SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f
    UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
      round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""",
)
def classification_report(spark, d):
    report = M.classification_report(M.confusion_counts(_predictions(spark, d), "t", "p"))
    return report.select("label", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "confusion_matrix",
    _CM + """SELECT t AS truth, count(*) FILTER (WHERE p = 'A') AS "A", count(*) FILTER (WHERE p = 'N') AS "N",
    count(*) FILTER (WHERE p = 'R') AS "R" FROM c GROUP BY 1""",
)
def confusion_matrix(spark, d):
    return M.confusion_matrix(_predictions(spark, d), "t", "p", ["A", "N", "R"])


@query(
    "mismatch_report",
    f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag AS t, {_PRED} AS p FROM lineitem),
    s AS (SELECT count(*) AS total, count(*) FILTER (WHERE t <> p) AS errors FROM c)
    SELECT l_orderkey, l_linenumber, t, p, total, errors FROM c, s WHERE t <> p""",
)
def mismatch_report(spark, d):
    """The rows that differ, with the totals beside them."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("t"), F.expr(_PRED).alias("p"))
    return M.mismatches(rows, "t", "p").join(F.broadcast(M.mismatch_totals(rows, "t", "p")))
