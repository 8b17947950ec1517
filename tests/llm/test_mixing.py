import numpy as np
from pyspark.sql import functions as F

from hearthline.llm import mixing as M


def fixture(spark, documents):
    rows = [(k, ("the house and the garden stood there " if k % 3 else "das haus und der garten standen dort ") * (1 + k % 5)) for k in range(300)]
    labelled = spark.createDataFrame([(k, "en" if k % 3 else "de") for k in range(0, 300, 2)] + [(None, "en"), (1, None)], "doc_id long, domain string")
    return documents([*rows, (None, None), (300, ""), (5, rows[5][1])]), labelled


def totals(rows, domains):
    p = np.array([list(r._posterior) for r in rows]) / domains.grid
    t = np.array([r._tokens for r in rows])
    rate = np.array([r._rate for r in rows])
    return (p * t[:, None]).sum(axis=0), (p * (t * rate)[:, None]).sum(axis=0)


def test_expected_tokens_meet_given_targets(spark, documents):
    docs, labelled = fixture(spark, documents)
    names = ("de", "en")
    domains, rates = M.fit_mixing(docs, labelled, lambda t: M.given_targets(t, names, {"de": 3, "en": 1}))
    assert domains.names == names
    rows = M.rated(docs, domains, rates).collect()
    before, after = totals(rows, domains)
    assert np.abs(after / before.sum() - [0.75, 0.25]).max() < 2e-3 and min(r._rate for r in rows) >= 0
    right = sum((r._posterior[0] > r._posterior[1]) == (r.doc_id % 3 == 0) for r in rows if r.doc_id is not None and r.doc_id < 300)
    assert right >= 295


def test_default_targets_lose_nothing(spark, documents):
    docs, labelled = fixture(spark, documents)
    docs = docs.withColumn("_copy", F.lit(9))
    mixed = M.mix(docs, labelled)
    assert mixed.columns == docs.columns
    ids = {r.doc_id for r in mixed.select("doc_id").collect()}
    assert ids == {None, *range(301)}


def test_unreachable_targets_and_small_tables(spark, documents):
    docs, labelled = fixture(spark, documents)
    domains, rates = M.fit_mixing(docs, labelled, lambda t: M.given_targets(t, ("de", "en"), {"de": 1}))
    rows = M.rated(docs, domains, rates).collect()
    assert min(r._rate for r in rows) == 0
    assert M.mix(documents([]), labelled).count() == 0
    alone = M.mix(documents([(1, "x")]), labelled.limit(0)).collect()
    assert {r.doc_id for r in alone} == {1}


def cell_totals(cells, rates):
    rows = cells.withColumn("rate", rates.of(F.col("posterior"))).collect()
    p, t = np.array([r.posterior for r in rows]) / rates.grid, np.array([r.tokens for r in rows], float)
    return p.T @ t, p.T @ (t * np.array([r.rate for r in rows])), min(r.rate for r in rows)


def test_rare_domains_reach_their_targets(spark):
    hard = [([50 * (a == k) for a in range(7)], s) for k, s in enumerate((800_000, 100_000, 50_000, 30_000, 10_000, 5_000, 2_000))]
    mixed = [([47, 1, 1, 1, 0, 0, 0], 9_000), ([0, 0, 0, 0, 0, 40, 10], 900), ([30, 0, 0, 0, 0, 0, 20], 300)]
    for least, rows in ((0.0, hard), (0.0, hard + mixed), (1.0, hard)):
        cells = spark.createDataFrame(rows, "posterior array<long>, tokens long")
        rates = M.fit_rates(cells, 7, 50, M.smoothed_targets, least=least)
        before, after, lowest = cell_totals(cells, rates)
        assert np.abs(after / M.smoothed_targets(before) - 1).max() <= 1e-3 and max(rates.missed) <= 1e-3 and lowest >= least


def test_targets_out_of_reach_are_reported(spark, caplog):
    cells = spark.createDataFrame([([25, 25], 1000), ([50, 0], 1000)], "posterior array<long>, tokens long")
    rates = M.fit_rates(cells, 2, 50, lambda t: np.array([0.0, 1000.0]))
    assert max(rates.missed) > 1e-3 and "missed" in caplog.text
