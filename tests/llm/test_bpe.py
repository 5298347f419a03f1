"""Decoding starts from the packed ids."""

import hashlib

import numpy as np
import pyarrow as pa

from plumbline.llm import bpe, shingles

TEXTS = ["It's 12 words <|endoftext|> twice", "naïve café Σας, again and again", "", None]


class Rows:
    """Stands for a table: mapInArrow gives the function itself, to be called here."""

    sparkSession = None

    def selectExpr(self, *_):
        return self

    def mapInArrow(self, function, _):
        return function


def rows(monkeypatch, **more):
    monkeypatch.setattr(bpe, "ship", lambda _: None)
    run = bpe.encode_decode(Rows(), bpe.tokenizer_path(), ids=True, **more)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS)), pa.int64()), pa.array(TEXTS, pa.string())], names=["doc_id", "text"])
    return pa.Table.from_batches(run(iter([batch]))).to_pylist()


def test_decoded_hash_is_of_the_packed_ids(monkeypatch):
    v = bpe.vocabulary(bpe.tokenizer_path())
    for r in rows(monkeypatch):
        text = " ".join(v.string[i] for i in np.frombuffer(r["ids"], "<u4").tolist())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) // 4


def test_query_decodes(monkeypatch):
    seen, decode = [], bpe.Vocabulary.decode
    monkeypatch.setattr(bpe.Vocabulary, "decode", lambda self, ids: (seen.append(ids), decode(self, ids) + "!")[1])
    got = rows(monkeypatch)
    assert seen == [r["ids"] for r in got]
    v = bpe.vocabulary(bpe.tokenizer_path())
    assert [r["decoded_sha256"] for r in got] == [hashlib.sha256((decode(v, r["ids"]) + "!").encode()).hexdigest() for r in got]


def test_vocabulary_goes_when_another_operator_reads_texts():
    bpe.vocabulary(bpe.tokenizer_path())
    batch = pa.RecordBatch.from_arrays([pa.array(["one text"])], names=["text"])
    assert [texts for _, texts in shingles.in_chunks([batch], 0)] == [[b"one text"]]
    assert bpe.vocabulary.cache_info().currsize == 0
    assert bpe.vocabulary(bpe.tokenizer_path()).ids("one text")
