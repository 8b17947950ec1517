from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline as P
from hearthline.llm import registry
from hearthline.llm.common import stage, table

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")


def test_operators_and_pipeline_are_registered():
    names = entry_points.queries()
    assert {n for n in names if n.startswith("op")} == set(registry.QUERIES) and len(registry.QUERIES) == 13 and "pipeline" in names


def test_stages_one_after_another(spark):
    docs = table(spark, SF, "documents")
    columns, labels = docs.columns, {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {}
    for name, step in P.STAGES:
        docs = stage(step(spark, docs, SF), name)
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if name != "sharding":
            assert docs.columns == columns
    assert not [i for i in kept["quality"] if labels.get(i) == 0]
    assert set(kept["near_duplicates"]) <= set(kept["quality"]) and len(set(kept["near_duplicates"])) == len(kept["near_duplicates"])
    assert set(kept["mixing"]) == set(kept["decontamination"]) and sorted(kept["sharding"]) == sorted(kept["mixing"])
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    left = {r.doc_id: r.text for r in table(spark, SF, "documents").collect() if r.doc_id in set(kept["decontamination"])}
    assert not [i for i, t in left.items() if any(x in t for x in items)]


CLASHING = ("score", "stats", "text_hash", "_hash", "fp", "tid", "row", "col", "_m", "_tokens", "_posterior", "_rate", "_copies")


@pytest.fixture
def odd(spark):
    """The documents with null, empty, long and repeated rows, and columns named like the operators' own."""
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    more = [(9001, None), (9002, ""), (None, "An id is missing here, but the words of this line are as good as any others."), (None, None),
            (9003, "The river rose in the night and the lower fields stood under water. " * 3000)]
    more = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in more], docs.schema)
    docs = docs.unionByName(more).unionByName(more.where("doc_id = 9003"))
    return docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for c in CLASHING})


@pytest.mark.parametrize("name, step", P.STAGES)
def test_odd_rows_and_clashing_columns(spark, odd, name, step):
    rows = step(spark, odd, SF).collect()
    assert rows
    if name != "sharding":
        assert rows[0].__fields__ == odd.columns
        # every column still says what it said
        assert all(r[c] == f"{c}{'?' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHING)
    own = [r.doc_id for r in rows]
    expected = {"near_duplicates": [1], "decontamination": [2], "mixing": range(2, 99), "sharding": [2]}
    if name in expected:
        assert own.count(9003) in expected[name]
    if name in ("mixing", "sharding"):
        assert set(own) == {r.doc_id for r in odd.select("doc_id").collect()}


@pytest.mark.parametrize("name, step", P.STAGES)
def test_empty_table(spark, odd, name, step):
    assert step(spark, odd.limit(0), SF).count() == 0
