import random
from collections import Counter, defaultdict
from math import log2

import numpy as np
import pytest

from hearthline.llm import language as L

ROWS = "lang string, text string, score string"
WORDS = {
    "en": "the house and garden with this that from there which would about people water".split(),
    "de": "das haus und garten mit diese dass von dort welche würde über leute wasser".split(),
    "fr": "la maison et jardin avec cette que depuis là quelle serait environ gens eau été".split(),
}


def sample(lang, rng, n=30):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


def plain_code_length(text, counts, order):
    """PPM with escape C and exclusion, byte by byte; counts: context -> Counter of bytes."""
    data, bits = bytes(order) + text.lower().encode(), 0.0
    for i in range(order, len(data)):
        gone = set()
        for k in range(order, -1, -1):
            below = {b: n for b, n in counts.get(data[i - k:i], {}).items() if b not in gone}
            if not below:
                continue
            whole = sum(below.values()) + len(below)
            if data[i] in below:
                bits -= log2(below[data[i]] / whole)
                break
            bits -= log2(len(below) / whole)
            gone |= set(below)
        else:
            bits += log2(256 - len(gone))
    return bits


def plain_counts(texts, order):
    counts = defaultdict(Counter)
    for t in texts:
        data = bytes(order) + t.lower().encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts[data[i - k:i]][data[i]] += 1
    return counts


@pytest.mark.parametrize("order", [0, 2, 4])
def test_code_lengths_equal_a_plain_coder(spark, order):
    rng = random.Random(order)
    rows = [(lang, sample(lang, rng)) for lang in WORDS for _ in range(8)]
    model = L.fit(spark.createDataFrame([(*r, "x") for r in rows], ROWS).repartition(3), order)
    assert model.names == ("de", "en", "fr")
    texts = [sample("en", rng), sample("fr", rng), "", "x", "§ß 12 zzz", "the " * 50, "ÄÖÜ\nthe\x00\x01"]
    for size in (1 << 20, 37):  # pieces cut texts without a trace
        bits = model.code_lengths(texts, size)
        for k, lang in enumerate(model.names):
            counts = plain_counts([t for la, t in rows if la == lang], order)
            assert np.allclose(bits[:, k], [plain_code_length(t, counts, order) for t in texts], atol=1e-6)


def test_probabilities_add_up_to_one_in_pruned_trees(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([("en", sample("en", rng), "x") for _ in range(20)] + [("de", sample("de", rng), "x") for _ in range(60)], ROWS)
    nodes = L.count_nodes(rows.select("lang", "text"), 3)
    total = nodes.count()
    kept, names = L.frequent(nodes, total // 3, 10)
    kept = kept.collect()
    assert names == ("de", "en")
    assert 0 < len(kept) <= total // 3
    held = {(r.lang, r.depth, r.node) for r in kept}
    assert all((a, d - 1, n & (1 << 8 * d) - 1) in held for a, d, n in held if d)
    model = L.fit(rows, 3, total // 3)
    for tree in model.trees():
        for context in (b"the", b"d w", b"\x00\x00\x00", b"xyz", b" un"):
            base = int.from_bytes(context, "big") << 8
            p = np.exp2(-tree.code_lengths(np.arange(base, base + 256, dtype=np.uint64)))
            assert p.sum() == pytest.approx(1, abs=1e-9) and p.min() > 0


def test_only_languages_of_most_bytes(spark):
    rows = spark.createDataFrame([("a", "xx" * 9, ""), ("b", "yy" * 50, ""), ("c", "zz" * 20, "")], ROWS)
    assert L.fit(rows, max_languages=2).names == ("b", "c")


def test_held_out_accuracy_and_edge_cases(spark, tmp_path):
    rng = random.Random(3)
    docs = [(k, sample(lang, rng, rng.randint(2, 40)), lang) for k, lang in enumerate(rng.choices(list(WORDS), k=400))]
    docs += [(1000, None, "en"), (1001, "", "en"), (1002, " 12 §$ \n", "de"), (None, sample("de", rng), "de"), (1003, "the " * 300_000, None)]
    docs += [(5, docs[5][1], docs[5][2]), (1004, sample("fr", rng), None)]
    frame = spark.createDataFrame([(*d, "src", "clash", 0.0) for d in docs], "doc_id long, text string, lang string, source string, lang_pred string, score double")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = L.query(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002, None, 1003, 1004)] == ["und", "und", "und", "de", "en", "fr"]
    assert by_id[None].held_out and all(0 <= r.score <= 1 for r in got)
    held = [(by_id[i].lang_pred, lang) for i, _, lang in docs[:400] if by_id[i].held_out]
    assert 90 < len(held) < 180 and sum(a == b for a, b in held) >= 0.97 * len(held)


def test_without_training_rows_and_clashing_column(spark):
    empty = spark.createDataFrame([], ROWS)
    model = L.fit(empty)
    docs = spark.createDataFrame([("a text",), (None,)], "text string")
    assert [tuple(r.language) for r in L.identify(docs, model).collect()] == [("und", 0.0)] * 2
    with pytest.raises(ValueError):
        L.identify(docs.withColumnRenamed("text", "Language"), model)
