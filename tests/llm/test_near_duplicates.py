import random

import numpy as np
import xxhash

import corpus_pipeline as P
from hearthline.llm import near_duplicates as N
from hearthline.llm.graph import connected_components


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[k:k + 4]) for k in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= 4:
                parent[find(i)] = find(j)
    return [find(k) for k in range(len(prints))]


def test_fingerprint_follows_its_definition():
    for text in [None, "", "  \n", "one", "A b\tC", "a b c d e f g", "É é ÉTÉ été x y z", "w " * 5000, "x" * 100_000]:
        assert N.fingerprint(text) == plain_fingerprint(text)


def test_components_equal_brute_force(spark, documents):
    rng = random.Random(1)
    base = [" ".join(rng.choice("ab cd ef gh ij kl mn".split()) + str(rng.randrange(99)) for _ in range(200)) for _ in range(20)]
    rows = []
    for text in base:
        for _ in range(rng.randrange(1, 6)):
            words = text.split()
            words[rng.randrange(200)] = "changed"
            rows.append((len(rows), " ".join(words)))
    rows += [(900, None), (901, ""), (902, " "), (903, rows[0][1]), (903, rows[0][1]), (None, rows[0][1]), (904, "long " * 20000)]
    found = N.near_duplicates(documents(rows)).collect()
    assert len(found) == len(rows)
    prints = [N.fingerprint(t) for _, t in rows]
    groups = components(prints)
    least = {g: min(i for (i, _), x in zip(rows, groups) if x == g and i is not None) for g in set(groups)}
    expected = sorted((i if i is not None else -1, least[g]) for (i, _), g in zip(rows, groups))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in found) == expected


def test_split_groups_lose_no_link(spark):
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    prints = {int(s ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 6, replace=False)))) for s in seeds for _ in range(60)}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    roots = connected_components(N.links(df, group_rows=8))
    found = {}
    for r in roots.collect():
        found.setdefault(r.root, set()).add(r.node & ((1 << 64) - 1))
    order = sorted(prints)
    groups = {}
    for x, g in zip(order, components(order)):
        groups.setdefault(g, set()).add(x)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_forest_spans_what_all_pairs_link():
    rng = np.random.default_rng(3)
    center = np.uint64(0x0F0F_1234_5678_9ABC)
    prints = np.unique(np.array([center ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 5, replace=False))) for _ in range(300)], np.uint64))
    edges = N.forest(prints)
    assert all(np.bitwise_count(prints[a] ^ prints[b]) <= 4 for a, b in edges)
    groups = components([int(x) for x in prints])
    assert len(edges) == len(prints) - len(set(groups))


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(41)) and all(found[k] == 100 for k in range(100, 160)) and len(found) == 101


def test_keep_one_and_empty_table(spark, documents):
    docs = documents([(3, "same text here now"), (1, "same text here now"), (1, "same text here now"), (2, "other words entirely there")])
    docs = docs.withColumn("_copy", docs.doc_id)
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert N.keep_one(documents([])).count() == 0


def jaccard(a, b):
    a, b = (set(zip(*[x.split()[k:] for k in range(5)])) for x in (a, b))
    return len(a & b) / len(a | b)


def test_pipeline_stage_finds_near_copies_from_similarity_0_8(spark, documents):
    rng = random.Random(9)
    rows, far = [], []
    for k in range(40):
        words = [f"w{rng.randrange(10_000)}" for _ in range(400)]
        other = words[:]
        for at in range(7, 400, 400 // (3 + k % 6)):
            other[at] = f"changed{at}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    for k in range(5):
        words = rows[2 * k][1].split()
        words[::30] = ["x"] * len(words[::30])
        far.append((100 + k, " ".join(words)))
    similar = [jaccard(rows[k][1], rows[k + 1][1]) for k in range(0, 80, 2)]
    assert min(similar) < 0.83 and min(similar) >= 0.8 and max(similar) > 0.9
    assert all(jaccard(x[1], y[1]) < 0.8 for x in far for y in rows)
    docs = documents([*rows, *far, (0, rows[0][1]), (90, None), (91, " "), (92, "Two Words"), (93, "two  words")])
    kept = sorted(r.doc_id for r in P.keep_one_of_each(spark, docs, "").collect())
    assert kept == [*range(0, 80, 2), 90, 92, *range(100, 105)]
    assert P.keep_one_of_each(spark, documents([]), "").count() == 0


def test_pieces_of_a_pool_lose_no_link(spark, documents):
    rng = random.Random(10)
    words, rows = [f"w{k}" for k in range(300)], []
    for k in range(60):  # a drift: neighbours are alike, the ends aren't
        words[rng.randrange(300)] = f"new{k}"
        rows.append((k, " ".join(words)))
    found = N.similar_documents(documents(rows), piece_rows=7).collect()
    assert {r.component_id for r in found} == {0} and jaccard(rows[0][1], rows[-1][1]) < 0.8
