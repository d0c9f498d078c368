import hashlib
import random

import pytest
from tokenizers import Tokenizer

from hustings.llm import bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def test_random_texts_as_the_library(library):
    rnd = random.Random(1)
    codec = bpe.Codec(bpe.default_vocabulary())
    signs = "abc the  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 éèßñ'sll've 0123½² €漢字👍<|endoftext|>​ 　́\x00"
    for k in range(4000):
        text = "".join(rnd.choices(signs, k=rnd.randint(0, 30)))
        if k % 5 == 0:
            text = f"{text[:5]}<|endoftext|>{text[5:]}"
        ids = codec.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_query_as_the_library(spark, library):
    rows = {r.doc_id: r for r in bpe.op8_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(rows[d.doc_id])[1:] == (len(ids), digest(",".join(map(str, ids))), digest(back))


def test_cut_words_decode_to_replacement_signs(library):
    codec = bpe.Codec(bpe.default_vocabulary())
    ids = codec.encode("漢字é👍")
    for k in range(len(ids) + 1):
        assert codec.decode(ids[:k]) == library.decode(ids[:k], skip_special_tokens=False)


def test_odd_rows(spark, monkeypatch, library):
    text = "long text, " * 50_000
    rows = [(1, None), (2, ""), (None, "x"), (3, text), (3, text)]
    df = spark.createDataFrame([(*r, "i") for r in rows], "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids, r.decoded) for r in bpe.encode_texts(df, bpe.default_vocabulary()).collect()]
    assert [g[0] for g in got] == [r[0] for r in rows]
    assert all(g[2] == (r[1] or "") and g[1] == library.encode(r[1] or "", add_special_tokens=False).ids for g, r in zip(got, rows))
    assert bpe.token_digests(df.limit(0), bpe.default_vocabulary()).count() == 0
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    codec = bpe.Codec(bpe.default_vocabulary())
    many = " ".join(f"word{i % 11}" for i in range(200))
    assert codec.encode(many) == library.encode(many, add_special_tokens=False).ids and len(codec.new) <= 3
