"""6. Suffix-array dedup: bytes covered by a long string that also starts elsewhere are removed.

A string of LENGTH (400) bytes counts when it starts at another place too, of any document,
overlaps included. Instead of the suffix array of all bytes at once, suffixes are sorted in
blocks, one bucket at a time:

1. Buckets. Every window of 400 bytes is assigned the least hash among its 32-byte strings
   (the leftmost of equals), its anchor: equal windows get equal anchors at equal offsets, so each
   bucket of windows with one anchor can be sorted alone. Neighbouring windows share an anchor and
   form a segment, some 5 for each 1000 bytes. Anchors that occur once are dropped (counted
   with partial sums).
2. Copies. Segments of one anchor with one digest are copies and repeat whole; one of each kind
   goes on, with the number it stands for. An anchor whose segments are all of one kind is done.
3. Blocks. Whole buckets of up to BLOCK kinds are sorted at a time: the windows of a bucket by the
   offset of their anchor, then lexicographically, by their first 32 bytes and then, where these tie, by
   the precomputed ranks of a difference-cover sample of the block (`CoverRanks`), never by
   walking along the strings. Neighbours in that order that agree for 400 bytes repeat.
4. A bucket with more kinds (a passage that a third of all documents quote within different
   surroundings) is split first, until its parts are such blocks: into ranges of 48 windows of one offset,
   then 6, then 1, and each by the bytes that all windows of the range have in common. A part of one
   window has one string only.

Spans lead to removals per document; texts travel only for documents with a repeat (a Bloom
filter of fixed size spares the others, see `common.key_filter`). Joins on anchors deal hot ones to salts.

Defined results: null text has no bytes; texts under 400 bytes lose nothing; very long texts are
scanned whole, one at a time; repeated rows are each other's repeats; an empty table gives an empty
result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, hot_join, identified, key_filter, may_hold, new_dir, parallelism, release, ship
from plumbline.llm.shingles import in_chunks, mix64

LENGTH = 400
GRAM = 32
#: Different segments of one anchor that are sorted as one block at most.
BLOCK = 1024
_U = np.uint64
_K = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
SEGMENTS = "rf long, rr long, ah long, sd long, lo long, hi long, at long"


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number; the end is padded with zeros."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(len(data), _U)
    for k in range(8):
        part = padded[k : k + (len(data) - k + 7) // 8 * 8] if len(data) > k else padded[:0]
        out[k::8] = part[: len(part) // 8 * 8].view(_U)[: len(out[k::8])]
    return out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each position on."""
    w = words_at(np.concatenate([data, np.zeros(24, np.uint8)]))
    n = len(data)
    return mix64(sum((w[8 * k : 8 * k + n] * _K[k] for k in range(4)), np.zeros(n, _U)))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of the `width` values from each position on, where there are so many."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(_U).max, _U)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, ah, sd, lo, hi, at): for each run of windows with one anchor its text, the anchor's hash, the
    segment's digest, first and last window and anchor, as positions in the text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    starts = np.concatenate([[0], ends[:-1]]) if len(texts) else ends
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    h = gram_hashes(data)
    places = _U(max(1, int(len(data)).bit_length()))
    packed = (h >> places << places) | np.arange(len(data), dtype=_U)
    anchor = (sliding_least(packed, length - GRAM + 1) & ((_U(1) << places) - _U(1))).astype(np.int64)
    owner = np.searchsorted(ends, np.arange(len(anchor)), "right")
    valid = np.arange(len(anchor)) + length <= ends[owner]
    p = np.flatnonzero(valid)
    if not len(p):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    a, o = anchor[p], owner[p]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (o[1:] != o[:-1])])
    lo, hi = p[new], p[np.concatenate([new[1:], [True]])]
    at, doc = a[new], o[new]
    view = memoryview(data.tobytes())
    digest = xxhash.xxh3_64_intdigest
    sd = np.array([digest(view[s : e + length], d) for s, e, d in zip(lo.tolist(), hi.tolist(), (at - lo).tolist(), strict=True)], _U)
    base = starts[doc]
    return doc, h[at].view(np.int64), sd.view(np.int64), lo - base, hi - base, at - base


def ranked(x: np.ndarray) -> np.ndarray:
    """The rank of each value among the different ones."""
    order = np.argsort(x)
    new = np.zeros(len(x), np.int64)
    new[1:] = x[order][1:] != x[order][:-1]
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(new)
    return out


def ranked_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of the pairs of two ranks; b may be -1."""
    return ranked((a << np.int64(32)) | (b + 1))


@lru_cache(maxsize=4)
def difference_cover(v: int) -> tuple[tuple[int, ...], np.ndarray]:
    """(residues modulo v whose differences are all of 0..v-1, table of a d for which i + d and j + d are residues)."""
    cover: list[int] = [0]
    missing = set(range(1, v))
    while missing:
        gain = lambda r: len({(r - c) % v for c in cover} & missing) + len({(c - r) % v for c in cover} & missing)
        best = max(range(v), key=lambda r: (gain(r), -r))
        missing -= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
        cover.append(best)
    cover.sort()
    table = np.zeros((v, v), np.int64)
    for i in range(v):
        for j in range(v):
            table[i, j] = next(d for d in range(v) if (i + d) % v in cover and (j + d) % v in cover)
    return tuple(cover), table


class CoverRanks:
    """Lexicographic ranks of the strings at a difference-cover sample's positions, by doubling within the sample.

    Windows with one residue modulo V order by their first V bytes, then by the ranks at one common
    distance (`at`), then by what is left of their LENGTH bytes. Two windows of LENGTH bytes are equal when their first and last bytes are, which a few
    words show, and the sample positions at one common distance from their starts have one
    rank. Memory is a rank for each sample position: under a third of the positions for v = 32.
    """

    V = 32

    def __init__(self, data: np.ndarray, length: int = LENGTH):
        v = self.V
        self.length = length
        self.cover, self.table = difference_cover(v)
        rows = -(-len(data) // v) + length // v + 2
        data = np.concatenate([data, np.zeros(rows * v - len(data) + 64, np.uint8)])
        self.words = words_at(data).byteswap()  # as numbers they compare like their bytes
        self.depth = (length - v) // v * v - v  # a multiple of v; what it leaves uncovered at the end is compared by words
        self.depth = max(v, self.depth)
        at = (np.arange(rows)[:, None] * v + np.array(self.cover)).reshape(-1)
        w = [ranked(self.words[at + k]) for k in range(0, v, 8)]
        rank = ranked_pairs(ranked_pairs(w[0], w[1]), ranked_pairs(w[2], w[3]))
        ranks = {v: rank}
        size = v
        while 2 * size <= self.depth:
            rank = ranked_pairs(rank, self._ahead(rank, size))
            size *= 2
            ranks[size] = rank
        if size < self.depth:
            rank = ranked_pairs(rank, self._ahead(rank, self.depth - size))
        self.rank = rank
        self.index = np.full(v, -1)
        self.index[list(self.cover)] = np.arange(len(self.cover))

    def _ahead(self, rank: np.ndarray, by: int) -> np.ndarray:
        k = by // self.V * len(self.cover)
        return np.concatenate([rank[k:], np.full(k, -1, rank.dtype)])

    def at(self, i: np.ndarray) -> np.ndarray:
        """The rank at the first sample position from each of the positions on."""
        p = i + self.table[i % self.V, i % self.V]
        return self.rank[(p // self.V) * len(self.cover) + self.index[p % self.V]]

    def same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the windows from i and from j are equal."""
        v, w = self.V, self.words
        d = self.table[i % v, j % v]
        s = lambda p: self.rank[(p // v) * len(self.cover) + self.index[p % v]]
        out = s(i + d) == s(j + d)
        for k in range(0, v, 8):
            out &= w[i + k] == w[j + k]
        for k in [*range(self.depth, self.length - 8, 8), self.length - 8]:
            out &= w[i + k] == w[j + k]
        return out


def _tied(x: np.ndarray) -> np.ndarray:
    """Which values come more than once."""
    order = np.argsort(x)
    same = x[order][1:] == x[order][:-1]
    out = np.zeros(len(x), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _refined(some: np.ndarray, group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, groups) in the order of group and key, without those that no other window ties with."""
    rank = ranked_pairs(group, ranked(key))
    order = np.argsort(rank, kind="stable")
    tied = np.bincount(rank)[rank[order]] > 1
    return some[order][tied], rank[order][tied]


class Layout:
    """Segments laid out with their anchors at multiples of CoverRanks.V, so windows that are compared have one residue."""

    def __init__(self, lead: np.ndarray, items: list[bytes], length: int):
        v = CoverRanks.V
        self.sizes = np.fromiter(map(len, items), np.int64, len(items))
        slots = (self.sizes + 2 * v - 1) // v * v
        self.begin = np.cumsum(slots) - slots + (-lead) % v
        self.data = np.zeros(int(slots.sum()) + length, np.uint8)
        for at, item in zip(self.begin.tolist(), items, strict=True):
            self.data[at : at + len(item)] = np.frombuffer(item, np.uint8)
        self.words = words_at(self.data).byteswap()


def sort_block(bucket: np.ndarray, lead: np.ndarray, items: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment of a block which of its windows are equal to another's at the same offset from the anchor.

    bucket: numbers of the segments' buckets; lead: offset of the anchor from the segment's start. Windows whose
    offset, bucket and bytes at some places have a mix that comes once tie with none and are left out of the sort.
    """
    counts = np.maximum(0, np.fromiter(map(len, items), np.int64, len(items)) - length + 1)
    out = np.zeros(int(counts.sum()), bool)
    member = np.repeat(np.arange(len(items)), counts)
    inner = np.arange(len(member)) - np.repeat(np.cumsum(counts) - counts, counts)
    laid = Layout(lead, items, length)
    start = laid.begin[member] + inner
    offset, own = lead[member] - inner, ranked(bucket)[member]
    mix = (own * (length + 1) + offset).astype(_U)
    for k in (0, length // 4, length // 2, 3 * length // 4, length - 8):
        mix = mix64(mix + laid.words[start + k])
    some = np.flatnonzero(_tied(mix))
    if len(some):
        kept, place = np.unique(member[some], return_inverse=True)
        laid = Layout(lead[kept], [items[i] for i in kept.tolist()], length)
        start = np.zeros(len(member), np.int64)
        start[some] = laid.begin[place] + inner[some]
        group = own * (length + 1) + offset
        some, group = _refined(some, group[some] * 0, group[some])
        for k in range(0, CoverRanks.V, 8):
            some, group = _refined(some, group, laid.words[start[some] + k])
    if len(some):
        ranks = CoverRanks(laid.data, length)
        some, group = _refined(some, group, ranks.at(start[some]))
        for k in [*range(ranks.depth, length - 8, 8), length - 8]:
            some, group = _refined(some, group, laid.words[start[some] + k])
    if len(some):
        next_to = np.flatnonzero(group[1:] == group[:-1])
        same = ranks.same(start[some[next_to]], start[some[next_to + 1]])
        out[some[next_to[same]]] = True
        out[some[next_to[same] + 1]] = True
    return np.split(out, np.cumsum(counts)[:-1])


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(s), int(e) - 1) for s, e in zip(edge[0::2], edge[1::2], strict=True)]


def _batch(schema: str, *cols) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)


def find_segments(rows: DataFrame) -> DataFrame:
    """SEGMENTS of all texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in in_chunks(batches, 2, 1 << 20):
            doc, ah, sd, lo, hi, at = segments(texts)
            rf, rr = part.column(0).to_numpy(), part.column(1).to_numpy()
            yield _batch(SEGMENTS, rf[doc], rr[doc], ah, sd, lo, hi, at)

    return rows.select("_rf", "_rr", "text").mapInArrow(scan, SEGMENTS)


def _texts_with(rows: DataFrame, spans: DataFrame, schema: str, work) -> DataFrame:
    """Runs work(texts, lists of span structs, batch) over the documents that have spans (columns rf, rr, spans)."""
    wanted = key_filter(spans.select(F.xxhash64("rf", "rr").alias("k")))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(may_hold(batch.column(3).to_numpy().view(_U), wanted.value)))
            yield some.select([0, 1, 2]).rename_columns(["rf", "rr", "text"])

    texts = rows.select("_rf", "_rr", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("_rf", "_rr").alias("k")).mapInArrow(needed, "rf long, rr long, text string")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield work([t.encode("utf-8", "replace") for t in part.column(2).to_pylist()], part.column(3).to_pylist(), part)

    return texts.join(spans, ["rf", "rr"]).select("rf", "rr", "text", "spans").mapInArrow(apply, schema)


ITEMS = "rf long, rr long, bucket long, lo long, lead long, n long, item binary"
SPANS = "rf long, rr long, s long, e long"


def sorted_spans(items: DataFrame) -> DataFrame:
    """SPANS of the windows that repeat among the kinds of a bucket (ITEMS: at most BLOCK a bucket); kinds with copies are whole already."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []
        for batch in batches:
            table = pa.concat_tables([*rest, pa.Table.from_batches([batch])])
            bucket = table.column("bucket").to_numpy()
            last = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0  # the last bucket may go on in the next batch
            yield from blocks(table.slice(0, last))
            rest = [table.slice(last)]
        if rest:
            yield from blocks(rest[0])

    def blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole buckets, until they have BLOCK kinds."""
        bucket = table.column("bucket").to_numpy()
        first = [*np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist(), len(bucket)] if len(bucket) else [0]
        lo = 0
        for k in range(1, len(first)):
            if first[k] - first[lo] >= BLOCK or k == len(first) - 1:
                part = table.slice(first[lo], first[k] - first[lo])
                flags = sort_block(part.column("bucket").to_numpy(), part.column("lead").to_numpy(), part.column("item").to_pylist())
                rf, rr, at = (part.column(c).to_numpy() for c in ("rf", "rr", "lo"))
                n = part.column("n").to_numpy()
                got = [(rf[i], rr[i], at[i] + s, at[i] + e + LENGTH) for i, f in enumerate(flags) if n[i] == 1 for s, e in runs(f)]
                if got:
                    yield _batch(SPANS, *[np.array(c, np.int64) for c in zip(*got, strict=True)])
                lo = k

    return items.repartition(4 * parallelism(items.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(sort, SPANS)


def repeated_spans(rows: DataFrame) -> DataFrame:
    """SPANS of the rows' texts that are to go; they may overlap."""
    spark = rows.sparkSession
    ship(spark)
    at = new_dir(spark, "repeats")
    find_segments(rows).write.parquet(f"{at}/segments")
    all_segments = spark.read.schema(SEGMENTS).parquet(f"{at}/segments")
    anchors = all_segments.groupBy("ah").agg(F.count("*").alias("m"), F.min("sd").alias("x"), F.max("sd").alias("y")).filter("m > 1")
    anchors = cut(anchors.select("ah", "m", (F.col("x") != F.col("y")).alias("mixed")))
    total = anchors.agg(F.sum("m")).first()[0] or 1
    wanted = key_filter(anchors.select("ah"))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(batch.column(2).to_numpy().view(_U), wanted.value)))

    identity = ["rf", "rr", "lo"]
    common = hot_join(all_segments.mapInArrow(shared, SEGMENTS), anchors, ["ah"], "m", total, identity).drop("m")
    common.write.parquet(f"{at}/common")
    release(spark)
    common = spark.read.schema(common.schema).parquet(f"{at}/common")
    whole = lambda df: df.select("rf", "rr", F.col("lo").alias("s"), (F.col("hi") + LENGTH).alias("e"))

    mixed = common.filter("mixed")
    place = F.struct("rf", "rr", "lo", "hi", "at")
    kinds = cut(mixed.groupBy("ah", "sd").agg(F.count("*").alias("n"), F.min(place).alias("one")))
    copies = hot_join(mixed, kinds.filter("n > 1").select("ah", "sd", "n"), ["ah", "sd"], "n", total, identity)
    sizes = cut(kinds.groupBy("ah").agg(F.count("*").alias("c")))
    single = hot_join(kinds, sizes, ["ah"], "c", total, ["sd"]).select("ah", "n", "c", "one.*")

    spans = single.groupBy("rf", "rr").agg(F.collect_list(F.struct("ah", "lo", "hi", "at", "n", (F.col("c") > BLOCK).alias("big"))).alias("spans"))
    cut_schema = f"{ITEMS}, big boolean"

    def pick(texts, lists, part) -> pa.RecordBatch:
        rf, rr = part.column(0).to_pylist(), part.column(1).to_pylist()
        got = [(rf[i], rr[i], x["ah"], x["lo"], x["at"] - x["lo"], x["n"], texts[i][x["lo"] : x["hi"] + LENGTH], x["big"]) for i, xs in enumerate(lists) for x in xs]
        cols = list(zip(*got, strict=True)) if got else [()] * 8
        kinds_ = [pa.int64()] * 6 + [pa.binary(), pa.bool_()]
        return _batch(cut_schema, *[pa.array(c, k) for c, k in zip(cols, kinds_, strict=True)])

    _texts_with(rows, cut(spans), cut_schema, pick).write.parquet(f"{at}/items")
    release(spark)
    items = spark.read.schema(cut_schema).parquet(f"{at}/items")
    out = whole(common.filter("not mixed")).unionByName(whole(copies)).unionByName(sorted_spans(items.filter("not big").drop("big")))
    big = items.filter("big").drop("big")
    return out if big.isEmpty() else out.unionByName(_split_buckets(big, total))


def _split_buckets(big: DataFrame, total: int) -> DataFrame:
    """SPANS of buckets of over BLOCK kinds (ITEMS), which are split until their parts are blocks to sort.

    Ranges of 48 windows, then 6, then 1, are aligned to their offset from the anchor. Equal ranges are copies
    (compared by their bytes) and repeat whole. Of the others one of each kind goes on, in parts that share the bytes
    common to all windows of a range. Counts have partial sums, so no group is gathered.
    """
    digest = xxhash.xxh3_64_intdigest
    schema = "ah long, c long, g long, lead long, rf long, rr long, lo long, n long, item binary"
    spans, todo = None, big.withColumnRenamed("bucket", "ah")
    for width in (48, 6, 1):

        def split(batches: Iterator[pa.RecordBatch], width: int = width) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = []
                for x in batch.to_pylist():
                    lead, item, k, most = x["lead"], x["item"], 0, len(x["item"]) - LENGTH
                    while k <= most:
                        c = (lead - k) // width  # offsets fall as windows advance
                        end = min(most, lead - c * width)
                        first, last = lead - (c * width + width - 1), lead - c * width  # windows of the whole range
                        got.append((x["ah"], c, digest(item[last : first + LENGTH]), lead - k, x["rf"], x["rr"], x["lo"] + k, x["n"], item[k : end + LENGTH]))
                        k = end + 1
                if got:
                    cols = list(zip(*got, strict=True))
                    yield _batch(schema, *[pa.array(v, pa.binary()) if i == 8 else np.array(v, _U).view(np.int64) if i == 2 else np.array(v, np.int64) for i, v in enumerate(cols)])

        keys = ["ah", "c", "g", "lead", "item"]
        rows = cut(todo.select("ah", "lead", "item", "rf", "rr", "lo", "n").mapInArrow(split, schema))
        kinds = cut(rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("m"), F.min(F.struct("rf", "rr", "lo")).alias("one")))
        again = kinds.filter("n > 1").select(*keys, "m").withColumn("h", F.xxhash64(*keys))
        found = hot_join(rows.filter("n = 1").drop("n").withColumn("h", F.xxhash64(*keys)), cut(again), ["h", *keys], "m", total, ["rf", "rr", "lo"])
        found = found.select("rf", "rr", F.col("lo").alias("s"), (F.col("lo") + F.octet_length("item")).cast("long").alias("e"))
        spans = found if spans is None else spans.unionByName(found)
        parts = cut(kinds.groupBy("ah", "c", "g").agg(F.count("*").alias("k")).filter("k > 1"))
        near = hot_join(kinds, parts, ["ah", "c", "g"], "k", total, ["lead", "item"]).select("ah", "c", "g", "lead", "item", "n", "k", "one.*")
        fit = near.filter(F.col("k") <= BLOCK).select("rf", "rr", F.xxhash64("ah", "c", "g").alias("bucket"), "lo", "lead", "n", "item")
        spans = spans.unionByName(sorted_spans(fit))
        todo = near.filter(F.col("k") > BLOCK).select("rf", "rr", "ah", "lo", "lead", "n", "item")
    return spans


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with texts the kept bytes."""
    rows = identified(docs).select("doc_id", "text")
    spans = repeated_spans(rows).groupBy("rf", "rr").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    schema = "rf long, rr long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts

    def drop(contents, lists, part) -> pa.RecordBatch:
        out = []
        for data, spans in zip(contents, lists, strict=True):
            merged: list[list[int]] = []
            for s, e in sorted((x["s"], x["e"]) for x in spans):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            at, kept = 0, []
            for s, e in merged:
                kept.append(data[at:s])
                at = e
            kept = b"".join([*kept, data[at:]])
            out.append((len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*out, strict=True)) if out else [()] * 4
        made = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
        return _batch(schema, part.column(0), part.column(1), *made[: 3 + texts])

    changed = _texts_with(rows, cut(spans), schema, drop)
    text = F.coalesce("text", F.lit(""))
    own = [F.encode(text, "UTF-8").alias("_kept")] if texts else []
    base = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_rf").alias("rf"), F.col("_rr").alias("rr"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("_sha"), *own)
    both = base.join(changed, ["rf", "rr"], "left")
    out = [F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "_sha").alias("kept_sha256")]
    return both.select("doc_id", "n_bytes", *out, *([F.coalesce("kept", "_kept").alias("kept")] if texts else []))


def op6_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
