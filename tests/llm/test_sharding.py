import zlib

import pytest
from pyspark.sql import functions as F

from hearthline.llm import sharding as S


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000])
def test_permutation_is_one_and_has_an_inverse(spark, n):
    perm = S.permutation(spark, n)
    rows = spark.range(n).select("id", perm.position(F.col("id")).alias("p")).select("id", "p", perm.number(F.col("p")).alias("back")).collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_shards_are_even_gapless_and_reproducible(spark, documents):
    rows = [(k, f"text {k} é") for k in range(100)] + [(5, "text 5 é"), (None, None), (101, ""), (102, "x" * 200_000)]
    found = S.shard_documents(documents(rows).withColumn("shard", F.lit(-1))).collect()
    again = S.shard_documents(documents(rows[::-1]).repartition(3)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    by_shard = {}
    for r in found:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert set(by_shard) == set(range(16)) and all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    texts = dict(rows)
    for r in found:
        text = texts[r.doc_id]
        assert r.size == len((text or "").encode()) + 1
        assert r.text_crc32 == (None if text is None else zlib.crc32(text.encode()))


def test_no_rows(documents):
    assert S.shard_documents(documents([])).count() == 0
