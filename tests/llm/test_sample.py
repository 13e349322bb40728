"""The labelled sample of the toxicity model."""

from planspark.llm import toxicity


def test_one_text_of_each_labelled_id(spark):
    docs = spark.createDataFrame([(1, "same")] * 50 + [(1, "other"), (2, "two"), (3, None), (4, "no label")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic", 10).collect()
    assert sorted((r["text"] or "", r["y"]) for r in got)[::2] == [("", 0), ("two", 0)]
    assert len(got) == 3 and {r["text"] for r in got if r["y"]} < {"same", "other"}
    assert len(toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic", 1).collect()) == 1
