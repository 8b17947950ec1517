import random

from hearthline.llm import decontamination as D

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ter", "sun") for b in ("ra", "ve", "don", "li") for c in ("n", "st", "mo", "el", "ux")]


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def fixture():
    rng = random.Random(5)
    items = [(k, sentence(rng, 20) + " " + sentence(rng, 8)) for k in range(10)] + [(98, None), (99, "")]
    clean = [(k, " ".join(sentence(rng, 15) for _ in range(rng.randrange(1, 30)))) for k in range(60)]
    leaked = [(100 + k, f"{sentence(rng, 30)} {items[k][1].upper() if k % 2 else items[k][1]} {sentence(rng, 200)}") for k in range(10)]
    words = items[4][1].split()
    paraphrase = " ".join(w for k, w in enumerate(words) if k % 4 or k > 19)
    return items, clean, leaked, [(200, f"{sentence(rng, 40)} {paraphrase} {sentence(rng, 40)}"), (201, None), (202, ""), (None, leaked[0][1])]


def test_leaks_are_found_and_clean_documents_left(spark, documents):
    items, clean, leaked, others = fixture()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents([*clean, *leaked, leaked[0], *others]).withColumnRenamed("source", "tid")
    found = D.contaminated(docs, benchmark).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert pairs == {(100 + k, k) for k in range(10)} | {(200, 4), (None, 0)}
    assert sum(r.doc_id == 100 for r in found) == 2
    kept = D.without_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in clean} | {201, 202}
    blocked = D.contaminated(docs, benchmark, block_items=3).collect()
    assert {(r.doc_id, r.item_id) for r in blocked} == pairs


def test_nothing_to_look_for(spark, documents):
    _, clean, _, _ = fixture()
    empty = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(documents(clean), empty).count() == 0
    items = spark.createDataFrame([(1, "some words to look for here")], "item_id long, text string")
    assert D.contaminated(documents([]), items).count() == 0


def test_longest_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for k, y in enumerate(b):
                row[k + 1] = before[k] + 1 if x == y else max(row[k], before[k + 1])
        return row[-1]

    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(12))] for _ in range(2))
        assert D.common_subsequence(tuple(a), b) == plain(a, b)
