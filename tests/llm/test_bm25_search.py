"""Search against BM25 written apart, with enough documents that blocks are pruned."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import bm25_search

DOCS, TOPICS, K = 2400, 12, 5


def corpus():
    """Documents by topic, so that blocks differ; all share common words."""
    r, out = random.Random(3), []
    for i in range(DOCS):
        topic = i * TOPICS // DOCS
        words = [f"t{topic}w{int(r.paretovariate(1))}" if r.random() < 0.4 else f"c{r.randint(0, 30)}" for _ in range(r.randint(0, 60))]
        out.append((i, " ".join(words) if words else None))
    return out


def scores(docs, query):
    """BM25 of every document that has a word of the query."""
    split = [(t or "").lower().split() for _, t in docs]
    mean = sum(map(len, split)) / len(split)
    df = collections.Counter(w for s in split for w in set(s))
    out = {}
    for (i, _), s in zip(docs, split, strict=True):
        tf = collections.Counter(s)
        x = [n * math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(s) / mean)) for w, n in collections.Counter((query or "").lower().split()).items() if tf[w]]
        if x:
            out[i] = math.fsum(x)
    return out


@pytest.mark.parametrize("shard", [700, 8192])
def test_search_equals_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(bm25_search, "SHARD_ROWS", shard)
    monkeypatch.setattr(bm25_search, "BATCH_TERMS", 5 * shard)
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in sorted(bm25_search.search(df, df.filter("doc_id % 60 = 7"), K).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.doc_id, r.score))
    for q, text in docs[7::60]:
        want = scores(docs, text)
        assert [s for _, s in got[q]] == pytest.approx(sorted(want.values(), reverse=True)[:K], abs=2e-6)
        assert [s for _, s in got[q]] == pytest.approx([want[d] for d, _ in got[q]], abs=2e-6)
        assert len({d for d, _ in got[q]}) == len(got[q])


def test_postings_of_pruned_blocks_are_not_read():
    docs = corpus()
    got = bm25_search.term_counts([(t or "").encode() for _, t in docs])
    lengths = np.array([int(c.sum()) for _, c in got])
    frequency = collections.Counter(int(t) for ts, _ in got for t in ts)
    asked = [q for q in range(7, DOCS, 60) if len(got[q][0])]
    weights = [np.array([c * math.log(1 + (DOCS - frequency[int(t)] + 0.5) / (frequency[int(t)] + 0.5)) for t, c in zip(*got[q], strict=True)]) for q in asked]
    queries = bm25_search.Queries([got[q][0] for q in asked], weights)
    vectors = pa.record_batch([pa.array(range(DOCS)), pa.array(lengths), pa.array([t.tobytes() for t, _ in got]), pa.array([c.astype("<u4").tobytes() for _, c in got])], names=["doc_id", "n", "terms", "counts"])
    ((ids, *postings),) = bm25_search.shards_of(iter([vectors]), queries)
    index = bm25_search.Index(*postings, float(lengths.mean()), queries)
    bounds = index.bounds(0, len(asked))
    for i, q in enumerate(asked):
        found, score = index.search(i, bounds[i], K)
        want = scores(docs, docs[q][1])
        assert list(score) == pytest.approx([want[d] for d in ids[found]])
        assert sorted(score, reverse=True)[:K] == pytest.approx(sorted(want.values(), reverse=True)[:K])
        place = ids
        best = np.zeros(index.blocks)
        np.maximum.at(best, np.arange(len(ids)) // bm25_search.BLOCK_ROWS, [want.get(d, 0.0) for d in place])
        assert (bounds[i] >= best).all() and (np.diff(postings[0]) >= 0).all()
    assert 0 < index.read < 0.7 * index.held
    assert index.held == sum(frequency[int(t)] for q in asked for t in got[q][0])


def test_few_documents_are_read_beyond_the_best():
    """Bounds are so near to the scores that hardly more documents are read than are found."""
    docs = corpus()
    got = bm25_search.term_counts([(t or "").encode() for _, t in docs])
    lengths = np.array([int(c.sum()) for _, c in got])
    asked = [q for q in range(7, DOCS, 60) if len(got[q][0])]
    queries = bm25_search.Queries([got[q][0] for q in asked], [got[q][1] * 1.0 for q in asked])
    vectors = pa.record_batch([pa.array(range(DOCS)), pa.array(lengths), pa.array([t.tobytes() for t, _ in got]), pa.array([c.astype("<u4").tobytes() for _, c in got])], names=["doc_id", "n", "terms", "counts"])
    ((_, *postings),) = bm25_search.shards_of(iter([vectors]), queries)
    index = bm25_search.Index(*postings, float(lengths.mean()), queries)
    bounds = index.bounds(0, len(asked))
    found = [index.search(i, bounds[i], K)[0] for i in range(len(asked))]
    held = sum(int(postings[1][f].sum()) for f in found)
    print("read", index.read, "of documents found", held, "held", index.held)
    assert 0 < index.read <= 3 * held


def test_odd_rows_and_many_batches(spark, monkeypatch):
    monkeypatch.setattr(bm25_search, "BATCH_TERMS", 7)
    docs = [(1, "a b c d"), (2, "a b c d"), (2, "A\tB"), (None, "a b"), (None, None), (3, ""), (4, "x " * 2_500_000), (5, "c d e"), (5, "c d e"), (6, "z y x w v u t s r q")]
    df = spark.createDataFrame([(*d, 7, "n") for d in docs], "doc_id long, text string, score int, terms string")
    got = collections.Counter((r.query_id, r.rank, r.doc_id, r.score) for r in bm25_search.search(df, df, 3).collect())
    want = collections.Counter()
    numbered = [(i, t) for i, (_, t) in enumerate(docs)]
    for q, text in docs:
        best = sorted(((-round(s, 6), -1 if docs[i][0] is None else docs[i][0]) for i, s in scores(numbered, text).items()))[:3]
        want.update((q, rank, None if d < 0 else d, -s) for rank, (s, d) in enumerate(best, 1))
    assert got == want
    none = df.filter("false")
    assert bm25_search.search(none, df, 3).count() == bm25_search.search(df, none, 3).count() == 0
