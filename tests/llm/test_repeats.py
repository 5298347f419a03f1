"""Block sorting against plain sorting, and the whole operator against brute force on whole tables and on odd texts."""

import random

import numpy as np
import pytest

from plumbline.llm import repeats

from test_llm import documents, repeats_brute


def test_cover_ranks_order_strings():
    r = random.Random(4)
    data = bytes(r.choice(b"ab") for _ in range(3000)) + b"ab" * 600 + bytes(r.choice(b"ab") for _ in range(500))
    ranks = repeats.CoverRanks(np.frombuffer(data, np.uint8))
    cover, v = set(ranks.cover), ranks.V
    assert all(any((d + k) % v in cover and k % v in cover for k in range(v)) for d in range(v))
    places = [i for i in range(len(data) - 400) if i % v in cover]
    order = sorted(places, key=lambda i: data[i : i + ranks.depth])
    got = ranks.at(np.array(order))
    assert (np.diff(got) >= 0).all()
    assert [a == b for a, b in zip(got, got[1:])] == [data[a : a + ranks.depth] == data[b : b + ranks.depth] for a, b in zip(order, order[1:])]
    some = r.sample(range(len(data) - 400), 300) + list(range(3000, 3300))
    i, j = np.array([(a, b) for a in some for b in r.sample(some, 20)]).T
    assert list(ranks.same(i, j)) == [data[a : a + 400] == data[b : b + 400] for a, b in zip(i.tolist(), j.tolist())]


@pytest.mark.parametrize("seed", range(6))
def test_sorted_blocks_equal_brute_force(seed):
    r = random.Random(seed)
    words = [bytes(r.choice(b"xy") for _ in range(r.choice((3, 90, 380)))) for _ in range(6)]
    lead, items = [], []
    for _ in range(60):
        left = b"".join(r.choices(words, k=4))[-r.randint(0, 368) :]
        right = b"".join(r.choices(words, k=30))
        lead.append(len(left))
        items.append((left + right)[: len(left) + max(401 - len(left), 40) + r.randint(0, 300)][: len(left) + 400])
    bucket = np.array([r.randint(1, 3) for _ in items])
    got = repeats.sort_block(bucket, np.array(lead), items)
    seen = {}
    for b, n, item in zip(bucket.tolist(), lead, items, strict=True):
        for k in range(len(item) - 399):
            seen[b, n - k, item[k : k + 400]] = seen.get((b, n - k, item[k : k + 400]), 0) + 1
    for b, n, item, flags in zip(bucket.tolist(), lead, items, got, strict=True):
        assert list(flags) == [seen[b, n - k, item[k : k + 400]] > 1 for k in range(max(0, len(item) - 399))]


@pytest.mark.parametrize("block", [2, 1024])
def test_one_passage_in_many_surroundings(spark, monkeypatch, block):
    """A hot bucket: 150 texts quote a passage, or parts of it, within different words."""
    monkeypatch.setattr(repeats, "BLOCK", block)
    r = random.Random(9)
    passage = "".join(r.choice("abcdefgh ") for _ in range(900))
    docs = []
    for i in range(150):
        lo = r.choice((0, 0, 100, 450))
        docs.append((i, "".join(r.choice("qrstuvw ") for _ in range(r.randint(0, 300))) + passage[lo : r.choice((900, 900, 860, 520))] + "".join(r.choice("mnop ") for _ in range(r.randint(0, 300)))))
    docs += [(200, passage * 3), (201, "z" * 5000), (202, None), (202, passage)]
    got = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(x[0]), *x[1:]) for x in got) == repeats_brute(docs)


def test_whole_table_equals_brute_force(spark):
    docs = documents(spark)
    got = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(x[0]), *x[1:]) for x in got) == repeats_brute(docs)
