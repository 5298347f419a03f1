"""10. N-gram Jaccard join: a grouped prefix join over five-word shingles, exact at 0.75.

Two documents link when their shingle sets' Jaccard similarity is at least 0.75. Under any
one order of all shingles, two such sets share a shingle among the first
n - ceil(0.75 n) + 1 of each (the prefix). The order here is by length in bytes, longest
first, then by hash: long shingles are rare. Frequent shingles come last, by frequency, so
that a passage in a third of all documents stays out of prefixes.

1. Scan A finds the frequent shingles: a chunk of some hundred documents reports those that it has
   twice or more, and the reports are summed. The sums are lower bounds: a shingle evenly spread
   over little more than 1 / FREQUENT of the documents can be missed and then stays in prefixes.
   Which shingles are found changes the work, not the result; HOT_MOST bounds the broadcast.
2. Scan B collapses documents with identical prefix and size into one group and deals the
   groups' prefixes out by shingle, packed. Shingles with several groups of fitting size
   become buckets, one for all shingles with the same groups. So does a group with several
   different sets.
3. Scan C keeps bitmaps of the sets of groups in buckets (a Bloom filter of fixed size, see
   `common.key_filter`, spares the rest; the buckets decide).
4. Groups are expanded to their different sets (classes; copies are never expanded) and
   verified in rounds. First each class against one partner, the most connected of the
   buckets they share; then, in buckets that still hold several components, each
   component's nearest pair across components by parity bitmaps, for as long as that finds
   a tenth of the links of the round before; last, all pairs across components that pass the bitmaps' exact bound: the bits in
   which two bitmaps differ are at most the elements in which the sets differ. A component
   of thousands of near copies so costs a few checks per member, not one per pair. A bucket of over
   BUCKET members is dealt to several tasks.
5. Components come from alternating star steps; only counts reach the driver.

Defined results: null text is empty text; documents without words have no shingle, no link
and are their own component; a document with fewer than five words has its whole sequence
as one shingle; rows that repeat a doc_id are separate documents (of them stays the least by what
it holds, see `common.ties_of`, and last by its place);
a null doc_id never is a component's id unless it is alone; an empty table gives an empty
result; very long texts have all their shingles; extra columns, whatever their names, are ignored by
`components_of` and kept by `one_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Identified, components, cut, delete_dir, hot_join, identified, key_filter, may_hold, new_dir, parallelism, release, ship
from plumbline.llm.shingles import in_chunks, mix64, shingle_sets

PERCENT = 75
FREQUENT = 1000
HOT_LEAST = 50
HOT_MOST = 1_000_000
#: Bytes of text whose shingles are made at once, or one longer text; arrays of some ten times as much come with it.
CHUNK = 1 << 20
#: Members of a bucket that one task compares with all of it, about.
BUCKET = 2000
#: Rounds of nearest pairs end when one finds less than this part of the links of the one before.
FEWER = 10
#: Sizes fit when one is at least PERCENT of the other; sizes in postings are rounded logarithms.
_LOG = 4096
_FIT = round(-math.log(PERCENT / 100) * _LOG) + 2
_U = np.uint64
#: Least bits of the bitmaps that buckets compare; verification first compares wider ones.
SMALL_BITS = 1024
#: What scan C writes. node: the row's place, 16 bytes.
DOCUMENTS = "rf long, rr long, doc_id long, ta long, tb long, node binary, n long, cls binary, g long, bm binary, wide binary"


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def log_size(n: int) -> int:
    return min(65534, round(math.log(n) * _LOG))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(_U).view(np.int64)


class Order:
    """The order of shingles: ascending (see shingle_sets), frequent ones last by frequency."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by = np.argsort(tokens)
        self.tokens, self.counts = tokens[by], counts[by]

    def prefix(self, s: np.ndarray) -> np.ndarray:
        p = prefix_length(len(s))
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
            hot = self.tokens[at] == s
            if hot.any():
                rare = s[~hot]
                if len(rare) >= p:
                    return rare[:p]
                often = s[hot][np.argsort(self.counts[at[hot]], kind="stable")]
                return np.concatenate([rare, often[: p - len(rare)]])
        return s[:p]


def group_of(s: np.ndarray, prefix: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(prefix.tobytes(), seed=len(s))


def frequent_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(shingles, counts, number of rows): those whose reports add up to 1 / FREQUENT of the rows and HOT_LEAST."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in in_chunks(batches, 0, 2 * CHUNK):
            sets = [s for s in shingle_sets(texts) if len(s)]
            tokens, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, _U), np.zeros(0, int))
            own = counts >= max(2, part.num_rows // FREQUENT)
            yield pa.RecordBatch.from_arrays([pa.array(signed(tokens[own])), pa.array(counts[own].astype(np.int64)), pa.array(np.zeros(own.sum(), np.int64))], names=["token", "n", "rows"])
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([part.num_rows])], names=["token", "n", "rows"])

    told = cut(rows.select("text").mapInArrow(report, "token long, n long, rows long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")))
    total = told.agg(F.sum("rows")).first()[0] or 0
    hot = told.filter(F.col("n") >= max(HOT_LEAST, total // FREQUENT)).select("token", "n").orderBy(F.desc("n"), "token").limit(HOT_MOST).toArrow()
    return hot.column("token").to_numpy().view(_U), hot.column("n").to_numpy(), total


def _deal(rows: DataFrame, order, parts: int) -> DataFrame:
    """Packed postings: p, blob; a posting has 48 bits of its shingle, the group (or class) and the size's logarithm."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = order.value
        for _, texts in in_chunks(batches, 0, CHUNK):
            seen, tokens, owners, sizes = set(), [], [], []
            for s in shingle_sets(texts):
                if not len(s):
                    continue
                prefix = known.prefix(s)
                g, c = group_of(s, prefix), xxhash.xxh3_64_intdigest(s.tobytes())
                if (g, c) in seen:
                    continue
                if g not in seen:
                    tokens.append(prefix)
                    owners.append(np.full(len(prefix), g, _U))
                    sizes.append(np.full(len(prefix), log_size(len(s)), np.uint16))
                seen |= {g, (g, c)}
                # the group's own bucket, of its classes: size 65535 marks it
                tokens.append(mix64(np.array([g], _U)))
                owners.append(np.array([c], _U))
                sizes.append(np.array([65535], np.uint16))
            if not tokens:
                continue
            t, o, z = np.concatenate(tokens), np.concatenate(owners), np.concatenate(sizes)
            p = (t % _U(parts)).astype(np.int32)
            by = np.argsort(p, kind="stable")
            t, o, z = t[by], o[by], z[by]
            keys, at = np.unique(p[by], return_index=True)
            blobs = [pack(t[lo:hi], o[lo:hi], z[lo:hi]) for lo, hi in zip(at, [*at[1:], len(t)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(blobs, pa.binary())], names=["p", "blob"])

    return rows.select("text").mapInArrow(deal, "p int, blob binary")


def pack(t: np.ndarray, owner: np.ndarray, size: np.ndarray) -> bytes:
    return (t >> _U(32)).astype("<u4").tobytes() + ((t >> _U(16)) & _U(0xFFFF)).astype("<u2").tobytes() + owner.astype("<u8").tobytes() + size.astype("<u2").tobytes()


def unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out = []
    for b in blobs:
        n = len(b) // 16
        high, low = np.frombuffer(b, "<u4", n), np.frombuffer(b, "<u2", n, 4 * n)
        out.append(((high.astype(_U) << _U(16)) | low, np.frombuffer(b, "<u8", n, 6 * n), np.frombuffer(b, "<u2", n, 14 * n)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def buckets_of(t: np.ndarray, owner: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, owner, weight, own) of the postings that have another owner of fitting size.

    Buckets with the same members are one: a bucket is known by its members' digest and weighs as many
    shingles as it stands for. own marks groups' own buckets, whose owners are classes.
    """
    by = np.lexsort((owner, size, t))
    t, owner, size = t[by], owner[by], size[by]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (owner[1:] != owner[:-1]) | (size[1:] != size[:-1])
    t, owner, size = t[new], owner[new], size[new].astype(np.int64)
    start = np.ones(len(t), bool)
    start[1:] = (t[1:] != t[:-1]) | (size[1:] - size[:-1] > _FIT)
    run = np.cumsum(start) - 1
    count = np.bincount(run, minlength=0)
    kept = count[run] > 1
    t, owner, size, run = t[kept], owner[kept], size[kept], run[kept]
    if not len(t):
        return t, owner, size, np.zeros(0, bool)
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    last = np.append(first[1:], len(run))
    own = size == 65535
    names = np.array([xxhash.xxh3_64_intdigest(owner[lo:hi].tobytes(), seed=int(own[lo])) for lo, hi in zip(first.tolist(), last.tolist(), strict=True)], _U)
    names, at, weight = np.unique(names, return_index=True, return_counts=True)
    n = last[at] - first[at]
    rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at], n)
    return np.repeat(names, n), owner[rows], np.repeat(weight, n), own[rows]


def _bucket_rows(dealt: DataFrame, parts: int) -> DataFrame:
    """b, g, own, w: members of buckets, and how many shingles have that bucket."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for batch in batches for x in batch.column(1).to_pylist()]
        if blobs:
            b, g, w, own = buckets_of(*unpack(blobs))
            for lo in range(0, len(b), 100_000):
                cols = [signed(x[lo : lo + 100_000]) for x in (b, g)] + [w[lo : lo + 100_000].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(own[lo : lo + 100_000])], names=["b", "g", "w", "own"])

    return dealt.repartition(parts, "p").mapInArrow(collect, "b long, g long, w long, own boolean").groupBy("b", "g", "own").agg(F.sum("w").alias("w"))


def bitmap(s: np.ndarray) -> bytes:
    """Parity bitmap, 4 to 8 bits for each element: bit i is set when an odd number of elements fall on i."""
    bits = max(SMALL_BITS, 1 << (4 * len(s) - 1).bit_length())
    odd = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def small_bytes(n: int) -> int:
    """Bytes of the bitmap that buckets compare, 0.75 to 1.5 bits for each of n elements: enough to tell different sets of any size apart."""
    return max(SMALL_BITS, 1 << (3 * n // 4).bit_length()) // 8


def fold(bm, size: int) -> np.ndarray:
    """A bitmap narrowed to so many bytes: parities of the bits with equal low places."""
    return np.bitwise_xor.reduce(np.frombuffer(bm, np.uint8).reshape(-1, size), axis=0)


def describe(rows: DataFrame, order, wanted) -> DataFrame:
    """Scan C: rf, rr, doc_id, n, cls, g, and where the group or class is wanted its bitmaps."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = order.value
        for part, texts in in_chunks(batches, 5, CHUNK):
            sets = shingle_sets(texts)
            place = np.stack([part.column(0).to_numpy(), part.column(1).to_numpy()], axis=1)
            node = [x.tobytes() for x in place]
            cls = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            g = np.array([group_of(s, known.prefix(s)) if len(s) else 0 for s in sets], _U)
            c = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], _U)
            held = may_hold(g, wanted.value) | may_hold(c, wanted.value)
            wide = [bitmap(s) if h and len(s) else None for s, h in zip(sets, held, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[:5], pa.array(node, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()), pa.array(signed(g)),
                    pa.array([fold(w, small_bytes(len(s))).tobytes() if w else None for s, w in zip(sets, wide, strict=True)], pa.binary()), pa.array(wide, pa.binary()),
                ],
                names=DOCUMENTS.replace(",", "").split(" ")[::2],
            )

    return rows.select("_rf", "_rr", F.col("doc_id").cast("long").alias("doc_id"), "_ta", "_tb", "text").mapInArrow(scan, DOCUMENTS)


def links_among(pairs: DataFrame, docs: DataFrame, rows: DataFrame, compared: bool) -> DataFrame:
    """The pairs (a, b: nodes) whose sets link: by bitmaps, small ones first unless the pairs were
    compared by them, then by the sets of what is left, made again from the texts."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                differ = np.zeros(batch.num_rows, np.int64)
                for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                    x, y = x.as_buffer(), y.as_buffer()
                    size = min(len(x), len(y))
                    differ[i] = np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()
                near = differ * (100 + PERCENT) <= (m + n) * (100 - PERCENT)
                near &= 100 * np.minimum(m, n) >= PERCENT * np.maximum(m, n)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near))

    near = pairs
    for bits in ["wide"] if compared else ["bm", "wide"]:
        maps = docs.filter("wide is not null").select("node", "n", bits)
        left = near.join(maps.toDF("a", "m", "x"), "a").join(maps.toDF("b", "n", "y"), "b")
        near = cut(left.select("a", "b", "m", "n", "x", "y").mapInArrow(bounded, "a binary, b binary"))
    docs = docs.select("rf", "rr", "node")
    ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = cut(ends.join(docs, "node").select(F.xxhash64("rf", "rr").alias("k")))
    wanted = key_filter(ends)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(may_hold(batch.column(3).to_numpy().view(_U), wanted.value)))
            for part, texts in in_chunks([some], 2, CHUNK):
                place = np.stack([part.column(0).to_numpy(), part.column(1).to_numpy()], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in place], pa.binary()), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], names=["node", "items"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                good.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    sets = rows.select("_rf", "_rr", "text", F.xxhash64("_rf", "_rr").alias("k")).mapInArrow(needed, "node binary, items binary")
    both = near.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(verify, "a binary, b binary")


class Maps:
    """The bitmaps of one bucket's members, in ascending order of size, so that equal widths lie together."""

    def __init__(self, maps: list[bytes]):
        self.maps, widths = maps, np.array([len(m) for m in maps])
        edge = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), len(maps)]
        self.blocks = [(lo, hi, {len(maps[lo]): np.frombuffer(b"".join(maps[lo:hi]), _U).reshape(hi - lo, -1)}) for lo, hi in zip(edge[:-1], edge[1:], strict=True)]

    def differ(self, i: int, lo: int, hi: int) -> np.ndarray:
        """In how many bits member i differs from each of the members lo to hi, at the narrower of both widths."""
        out = np.zeros(hi - lo, np.int64)
        for first, last, levels in self.blocks:
            a, z = max(lo, first), min(hi, last)
            if a < z:
                size = min(len(self.maps[i]), len(self.maps[first]))
                if size not in levels:
                    levels[size] = np.bitwise_xor.reduce(levels[len(self.maps[first])].reshape(last - first, -1, size // 8), axis=1)
                own = fold(self.maps[i], size).view(_U)
                out[a - lo : z - lo] = np.bitwise_count(levels[size][a - first : z - first] ^ own).sum(axis=1, dtype=np.int64)
        return out


def bucket_pairs(n: np.ndarray, comp: np.ndarray, maps: Maps, best_only: bool, mine: np.ndarray) -> list[tuple[int, int, float]]:
    """(i, j, distance) in one bucket: pairs of different components within the size and bitmap bounds.

    With best_only the nearest such pair of each component. Members are in ascending order
    of n. Only members outside the largest component are compared, with all; of these only
    `mine`, as the others are another task's.
    """
    main = np.bincount(comp).argmax()
    out: list[tuple[int, int, float]] = []
    best: dict[int, tuple[float, int, int]] = {}
    for i in np.flatnonzero((comp != main) & mine).tolist():
        lo, hi = np.searchsorted(n, -(-PERCENT * n[i] // 100)), np.searchsorted(n, 100 * n[i] // PERCENT, "right")
        size = n[lo:hi] + n[i]
        differ = maps.differ(i, int(lo), int(hi))
        near = (differ * (100 + PERCENT) <= size * (100 - PERCENT)) & (comp[lo:hi] != comp[i])  # |A - B| + |B - A| <= (1 - t) / (1 + t) (|A| + |B|)
        near = np.flatnonzero(near)
        if not len(near):
            continue
        far = differ[near] / size[near]
        if best_only:
            k = int(far.argmin())
            pair = (float(far[k]), i, int(lo + near[k]))
            for c in (int(comp[i]), int(comp[pair[2]])):
                if c not in best or pair < best[c]:
                    best[c] = pair
        else:
            # a pair outside the largest component comes up from both sides
            out += [(i, j, d) for j, d in zip((lo + near).tolist(), far.tolist(), strict=True) if comp[j] == main or i < j]
    return [(i, j, d) for d, i, j in best.values()] if best_only else out


def _pairs_across(members: DataFrame, best_only: bool) -> DataFrame:
    """a, b: pairs of nodes of one bucket and different components; with best_only the nearest for each component in a task."""

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []
        best: dict[bytes, tuple[float, bytes, bytes]] = {}
        for batch in batches:
            table = pa.concat_tables([*rest, pa.Table.from_batches([batch])])
            b, salt = table.column("b").to_numpy(), table.column("salt").to_numpy()
            last = int(np.argmax((b == b[-1]) & (salt == salt[-1]))) if len(b) else 0  # the last bucket may go on in the next batch
            yield from emit(table.slice(0, last), best)
            rest = [table.slice(last)]
        if rest:
            yield from emit(rest[0], best)
        if best:
            yield rows({(x, y) for _, x, y in best.values()})

    def rows(pairs) -> pa.RecordBatch:
        pairs = sorted(pairs)
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["a", "b"])

    def emit(table: pa.Table, best) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        table = table.sort_by([("b", "ascending"), ("salt", "ascending"), ("n", "ascending")])
        b, n, salt, mine = (table.column(c).to_numpy() for c in ("b", "n", "salt", "mine"))
        names, node, bm = (table.column(c).to_pylist() for c in ("comp", "node", "bm"))
        ids = {c: i for i, c in enumerate(dict.fromkeys(names))}
        comp = np.array([ids[c] for c in names])
        first = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (salt[1:] != salt[:-1])]))
        found = set()
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(b)], strict=True):
            if hi - lo < 2 or (comp[lo:hi] == comp[lo]).all():
                continue
            local = np.unique(comp[lo:hi], return_inverse=True)[1]
            for i, j, d in bucket_pairs(n[lo:hi], local, Maps(bm[lo:hi]), best_only, mine[lo:hi]):
                x, y = sorted((node[lo + i], node[lo + j]))
                if best_only:
                    for c in (names[lo + i], names[lo + j]):
                        if c not in best or (d, x, y) < best[c]:
                            best[c] = (d, x, y)
                else:
                    found.add((x, y))
        if found:
            yield rows(found)

    return members.mapInArrow(across, "a binary, b binary").distinct()


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """g, node, comp after links between nodes joined their components."""
    ends = links.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a").join(comp.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b")
    roots = components(ends.select("x", "y"), "x", "y").withColumnsRenamed({"node": "comp", "root": "_root"})
    return cut(comp.join(roots, "comp", "left").select("g", "node", F.coalesce("_root", "comp").alias("comp")))


def linked_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(documents: rf, rr, doc_id, ta, tb, n, cls; cls, root of classes with links; number of rows)."""
    spark = rows.sparkSession
    ship(spark)
    sc = spark.sparkContext
    tokens, counts, total = frequent_shingles(rows)
    order = sc.broadcast(Order(tokens, counts))
    parts = 4 * parallelism(spark)
    at = new_dir(spark, "jaccard")
    _bucket_rows(_deal(rows, order, parts), parts).write.parquet(f"{at}/buckets")
    release(spark)
    buckets = spark.read.schema("b long, g long, own boolean, w long").parquet(f"{at}/buckets")
    shared = buckets.filter("not own").select("b", "g", "w")
    wanted = key_filter(buckets.select("g").distinct())  # groups, and for groups' own buckets their classes
    describe(rows, order, wanted).write.parquet(f"{at}/documents")
    docs = spark.read.schema(DOCUMENTS).parquet(f"{at}/documents")
    # a class is known by its first row's node; n and g are the same in all its rows
    names = docs.filter("bm is not null").groupBy("cls", "g", "n").agg(F.min("node").alias("node"))
    names = cut(names)

    heads = cut(names.groupBy("g").agg(F.min("node").alias("head"), F.count("*").alias("k")))
    within = names.join(heads.filter("k > 1"), "g").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    # the first round's partner: of the bucket-mates it could link with, the one in the most and largest buckets
    sizes = shared.groupBy("b").agg(F.count("*").alias("k"))
    fame = cut(shared.join(sizes, "b").groupBy("g").agg(F.sum(F.col("k") * F.col("w")).alias("fame")))
    hubs = shared.join(fame, "g").groupBy("b").agg(F.max(F.struct("fame", "g")).alias("m")).select("b", F.col("m.g").alias("hub"))
    often = shared.join(hubs, "b").filter("g <> hub").groupBy("g", "hub").agg(F.sum("w").alias("k"))
    best = often.groupBy("g").agg(F.max(F.struct("k", "hub")).alias("m")).select("g", F.col("m.hub").alias("hub"))
    first = best.join(heads.select("g", F.col("head").alias("b")), "g").join(heads.select(F.col("g").alias("hub"), F.col("head").alias("a")), "hub").select("a", "b")
    comp = names.select("g", "node", F.col("node").alias("comp"))
    links = cut(links_among(within.unionByName(first), docs, rows, False))
    comp, found = _merged(comp, links), links.count()
    maps = docs.filter("bm is not null").select("node", "n", "bm")
    best_only = True
    while True:
        release(spark)
        listed = shared.select("b", "g").join(comp, "g").select("b", "node", "comp").unionByName(comp.select(F.col("g").alias("b"), "node", "comp"))
        spread = cut(listed.groupBy("b").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k")).filter("lo <> hi").select("b", "k"))
        # of a bucket of over BUCKET members each of several tasks compares its share with all
        salts = F.ceil(F.col("k") / F.lit(BUCKET)).cast("int")
        mixed = hot_join(listed, spread, ["b"], "k", total, ["node"]).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        mixed = mixed.withColumn("mine", (F.pmod(F.xxhash64("node"), salts) == F.col("salt")).cast("int")).drop("k")
        mixed = mixed.join(maps, "node").select("b", "salt", "mine", "node", "comp", "n", "bm")
        mixed = mixed.repartition(parallelism(spark), "b", "salt").sortWithinPartitions("b", "salt")
        links = cut(links_among(_pairs_across(mixed, best_only), docs, rows, True))
        before, found = found, links.count()
        if found:
            comp = _merged(comp, links)
        if not best_only:
            break
        best_only = found * FEWER > before  # where nearest pairs seldom link any more all others are looked at once
    by_class = cut(comp.join(names.select("node", "cls"), "node").select("cls", F.col("comp").alias("root")))
    delete_dir(spark, f"{at}/buckets")
    release(spark)
    return docs.select("rf", "rr", "doc_id", "ta", "tb", "n", "cls"), by_class, total


def components_of(rows: DataFrame) -> DataFrame:
    """rf, rr, doc_id, n_shingles, component_id, keep (the first row of its component) for rows with identities."""
    docs, labels, total = linked_classes(rows)
    named = docs.withColumn("cls", F.when(F.col("n") > 0, F.col("cls")).otherwise(F.concat(F.lit("-").cast("binary"), F.col("rf").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("rr").cast("string").cast("binary"))))
    own = named.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "ta", "tb", "rf", "rr")).alias("first"), F.count("*").alias("m"))
    roots = own.join(labels, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    roots = cut(roots.select("cls", "root", "first", "m"))
    best = cut(roots.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("k")))
    where = cut(hot_join(roots, best, ["root"], "k", total, ["cls"]).select("cls", "best", "m"))
    out = hot_join(named, where, ["cls"], "m", total, ["rf", "rr"])
    return out.select(
        "rf", "rr", "doc_id", F.col("n").alias("n_shingles"), F.col("best.doc_id").alias("component_id"), (F.expr("best.rf = rf and best.rr = rr")).alias("keep")
    )


def _rows(rows: Identified) -> DataFrame:
    """_rf, _rr, _ta, _tb, doc_id, text."""
    return rows.df.select("_rf", "_rr", *rows.ties(), rows.col("doc_id").alias("doc_id"), rows.col("text").alias("text"))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return components_of(_rows(identified(docs))).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component (the one with the smallest doc_id), all columns as they were."""
    rows = identified(docs)
    gone = components_of(_rows(rows)).filter("not keep").select(F.col("rf").alias("_rf"), F.col("rr").alias("_rr"))
    return rows.restore(rows.df.join(gone, ["_rf", "_rr"], "left_anti"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
