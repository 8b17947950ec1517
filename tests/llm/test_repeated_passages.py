import hashlib
import random

import pytest

from hearthline.llm import repeated_passages as R


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for k, d in enumerate(data):
        for p in range(len(d) - length + 1):
            seen.setdefault(d[p:p + length], []).append((k, p))
    gone = [bytearray(len(d)) for d in data]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                gone[k][p:p + length] = b"\1" * length
    out = []
    for d, g in zip(data, gone):
        kept = bytes(b for b, x in zip(d, g) if not x)
        spans = sum(1 for k, x in enumerate(g) if x and (k == 0 or not g[k - 1]))
        out.append((len(d), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11, 13, 17])
def test_difference_sets(q):
    v, found = q * q + q + 1, R.difference_set(q)
    assert len(found) == q + 1 and {(a - b) % v for a in found for b in found} == set(range(v))


@pytest.mark.parametrize("length, range_rows", [(400, 1_000_000), (40, 300), (9, 50)])
def test_equals_brute_force(spark, documents, length, range_rows):
    rng = random.Random(length)

    def noise(n):
        return "".join(rng.choice("abcdé fgh\n") for _ in range(n))

    shared = [noise(length + rng.randrange(-3, 3 * length)) for _ in range(4)]
    texts = [noise(rng.randrange(length)) + rng.choice(shared) + noise(rng.randrange(length)) + rng.choice(shared) for _ in range(25)]
    texts += [None, "", "x", "ab" * length, noise(length), texts[0], texts[0], shared[0] * 2, noise(60 * length)]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    found = R.remove_repeats(documents(rows), length, range_rows).collect()
    expected = [(i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], length))]
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == sorted(expected)


def test_no_rows(documents):
    assert R.remove_repeats(documents([])).count() == 0
