"""The classifier: held-out accuracy, held-out rows without influence, odd rows."""

from fieldloom.llm.classifier import classify, fit, keep_good, op6

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op6(spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(labels) > 30 and sum(got[r.doc_id].predicted == r.quality for r in labels) >= 0.95 * len(labels)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F

    from fieldloom.llm.classifier import fold

    other = labels.withColumn("quality", F.when(fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = fit(docs, labels), fit(docs, other)
    assert (a.v == b.v).all() and (a.labels == b.labels).all()


def test_odd_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = fit(docs, labels)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "word", "x"), (4, "word", "x"), (5, "the of and " * 50000, "x")], "doc_id long, text string, score string")
    rows = classify(odd, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows) and [r.score for r in rows if r.doc_id < 4] == [0.0] * 3
    assert keep_good(odd, model).columns == odd.columns
    empty = odd.filter("doc_id < 0")
    assert classify(empty, model).count() == 0
    assert {r.score for r in classify(odd, fit(docs, labels.filter("false"))).collect()} == {0.5}
