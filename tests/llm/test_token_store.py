import zlib

import numpy as np
import pytest

from hearthline.llm import token_store as T

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

ODD = [
    "It's Ünïcode, naïve!! don't <|endoftext|> x<|endoftext|>y", "x́y a b\x1cz İstanbul ΣΑΣ µm ºC 123abc tab\there ée", None, "", " \n ",
    "½ a½b 中文字 😀ok ''s 'S THEY'RE A'b", "word... (paren) a/b-c_d foo@bar.com +1 (578) 555", "lang " * 30_000, "x" * 5_000,
]


@pytest.fixture(scope="module")
def tokenizer_json():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def test_store_round_trip(spark, documents, tokenizer_json, tmp_path):
    rows = [*enumerate(ODD), (3, "the third"), (3, "the third"), (None, "no id")]
    whole = tokenizers.Tokenizer.from_str(tokenizer_json)
    ids = [(i, whole.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]
    path = T.write_store(documents(rows), str(tmp_path / "store"), tokenizer_json)
    found = sorted(T.read_digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id is not None for r in found] == [False] + [True] * (len(rows) - 1)
    assert [r.doc_id for r in found[1:]] == sorted(r.doc_id for r in found[1:])
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    digest = lambda x: (len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in found), key=key) == sorted(((i, *digest(x)) for i, x in ids), key=key)
    one = T.read_documents(spark, path, [0, 7]).collect()
    assert {r.doc_id: list(r.ids) for r in one} == {i: x for i, x in ids if i in (0, 7)}


def test_no_rows(spark, documents, tokenizer_json, tmp_path):
    path = T.write_store(documents([]), str(tmp_path / "store"), tokenizer_json)
    assert T.read_digests(spark, path).count() == 0


def test_wrong_dictionary_is_noticed(tokenizer_json):
    row = {"dictionary": "other", "payload": b"", "offsets": [0], "doc_ids": []}
    with pytest.raises(ValueError):
        list(T._reader(b"", "this")(row))
