import zlib

from pyspark.sql import functions as F

from hearthline.llm import quality as Q


def rows(n):
    good = "The cat sat on the mat and looked out over the quiet garden where leaves fell number {}."
    bad = "BUY!! NOW!! $$$ WIN ### BUY!! NOW!! {} %%%"
    return [(k, (good if k % 3 else bad).format(k) * (1 + k % 4)) for k in range(n)]


def test_learns_and_scores_every_row(spark, documents):
    docs = documents([*rows(300), (None, None), (300, ""), (301, "word " * 50_000), (1, "The same id again, with words.")])
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = Q.fit(docs, labels)
    assert model.rules
    scored = Q.score_documents(docs.withColumn("score", F.lit("x")), model)
    found = {(r.doc_id, r.text): r.score for r in scored.collect()}
    assert len(found) == 304 and all(0 <= x <= 1 for x in found.values())
    right = sum((found[(k, t)] >= 0.7) == (k % 3 > 0) for k, t in rows(300))
    assert right >= 290


def test_held_out_rows_never_teach(spark, documents):
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 == 2]
    labels = spark.createDataFrame([(k, 1, 0) for k in ids], "doc_id long, quality int, toxic int")
    assert Q.fit(documents(rows(200)), labels) == Q.RuleModel(0.0, ())


def test_one_label_and_no_rows(spark, documents):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    model = Q.fit(documents(rows(20)), labels)
    assert not model.rules and model.intercept > 0
    assert Q.score_documents(documents([]), model).count() == 0


def test_statistics_of_odd_texts():
    assert Q.describe(None) == Q.describe("") == Q.describe(" \n") == (0.0,) * len(Q.STATISTICS)
    assert all(x == x for x in Q.describe("$") + Q.describe("é" * 10))
