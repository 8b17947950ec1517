import math
from collections import defaultdict
from itertools import permutations

import pytest

from hearthline.llm import filter_audit as A

LABELS = "doc_id long, quality int, toxic int"
FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def run(spark, docs, labels):
    frame = spark.createDataFrame([(*d, "kept") for d in docs], "doc_id long, text string, source string, part string")
    counts = A.failures(frame, spark.createDataFrame(labels, LABELS))
    return A.audit(counts, A.FILTERS, ("good", "toxic")).withColumnsRenamed({"lost_good": "good_lost", "lost_toxic": "toxic_lost"}).collect()


def brute(docs, labels):
    """Every order walked over every document."""
    def words(text):
        for c in "\t\n\x0b\x0c\r":
            text = text.replace(c, " ")
        return [w for w in text.split(" ") if w]

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = defaultdict(list)
    for i, text, source in docs:
        t = text or ""
        w = words(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in t for c in "#$%&*|"), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        rows[source or ""].append((i, {f for f in fails if fails[f]}))
    found = {}
    for part, members in rows.items():
        shapley = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                gone = [(i, s) for i, s in members if s & set(order[:k])]
                here = [(i, s) for i, s in members if f in s and not s & set(order[:k])]
                shapley[f] += len(here)
                found[part, order, k + 1] = [
                    len(members) - len(gone) - len(here), len(here), sum(f in s for _, s in gone), sum(s == {f} for _, s in members),
                    sum(i in good for i, _ in here), sum(i in toxic for i, _ in here),
                ]
        for (p, order, k), row in found.items():
            if p == part:
                row.append(shapley[order[k - 1]])
    return found


def check(spark, docs, labels):
    rows = run(spark, docs, labels)
    got = {(r.part, r.filter_order, r.step): [r[f] for f in (*FIELDS, "shapley")] for r in rows}
    assert len(got) == len(rows)
    assert got == brute(docs, labels)


def prose(k, n=220):
    return " ".join(f"wort{k}x{j}" for j in range(n))


def test_against_every_order_walked(spark):
    docs = [(k, prose(k), f"s{k % 3}") for k in range(12)]
    docs += [(20 + k, "the same words " * 100, "s0") for k in range(40)]
    docs += [(70, "A B C D", "s1"), (71, "a # b", "s1"), (72, prose(0) + " 5%", "s2"), (73, prose(3), "s2"), (74, prose(3).upper(), "s1")]
    docs += [(75, "x y " * 300, "s1"), (76, "x\x0by\x1cz", "s1"), (77, "ÄÖ" * 10, "s1"), (78, "word " * 60_000 + "#", "s2")]
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 80, 3)] + [(3, 0, 1), (3, 0, None), (None, 1, 1), (999, 1, 1)]
    check(spark, docs, labels)


def test_nulls_empty_texts_repeated_rows_and_ids(spark):
    docs = [(None, None, None), (None, "", "s"), (1, "", None), (2, None, "s"), (2, None, "s"), (2, "", "t"), (3, "", "s")]
    docs += [(None, "twin", "s"), (None, "twin", "s"), (5, "twin", "s"), (5, "twin", "u"), (5, "twin", "u"), (6, "twin", ""), (5, "other", "s")]
    check(spark, docs, [(2, 1, 1), (2, 1, 1), (5, None, 1), (1, None, None)])


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    check(spark, [(1, "a b", "s")], [])


@pytest.mark.parametrize("size", [1, 2, 5, 6])
def test_path_counts(size):
    grid = A.lattice(size)
    for state in range(1 << size):
        done = state.bit_count()
        assert grid.reaching[state] == math.factorial(done) and grid.leaving[state] == math.factorial(size - done)
    taken = [edge for _, edges in grid.paths() for edge in edges]
    assert [taken.count(k) for k in range(len(grid.edges))] == [e.orders for e in grid.edges]


def test_general_filters(spark):
    counts = spark.createDataFrame([("p", 0, 5), ("p", 1, 2), ("p", 3, 4), ("p", 1, 1)], "part string, failed int, n long")
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in A.audit(counts, ["long", "odd"]).collect()}
    assert rows == {
        ("longodd", 1): (5, 7, 0, 3, 10), ("longodd", 2): (5, 0, 4, 0, 4), ("oddlong", 1): (8, 4, 0, 0, 4), ("oddlong", 2): (5, 3, 4, 3, 10),
    }
    with pytest.raises(ValueError):
        A.audit(counts, [])
