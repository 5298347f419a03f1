"""2. BPE encoding and decoding.

A word's symbols form a doubly linked list; a priority queue holds the ranks of the merges
of neighbours. The least rank (then the leftmost) is popped, skipped when the list has moved
on since it was pushed, and applied; the new neighbours are pushed. Decoding concatenates
the vocabulary's strings.

Tokenizer files are in the JSON format of the public `tokenizers` library: BPE models with
an end-of-word suffix whose normalizer is NFC, white space and lower case, as described by
`Vocabulary.from_json`. A worker keeps encoded words in a cache of bounded size.

Letters and digits are those of the installed `regex` library's Unicode version; code points
that only one of two versions assigns may be grouped otherwise than by `tokenizers`.

Defined results: null text is empty text with no tokens; special tokens' strings within a
text become their ids; texts are encoded whole; repeated rows get a row each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import ship
from plumbline.llm.shingles import KEPT, give_back

#: Words per generation of a worker's cache; two generations are held.
CACHE_WORDS = 60_000
#: Words longer than this are not cached.
CACHE_CHARS = 64


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where printable, else one from 256 upward, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Vocabulary strings and merges of one tokenizer file."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str, special: dict[str, int], pattern: str):
        self.suffix, self.special = suffix, special
        self.string = {i: s for s, i in [*vocab.items(), *special.items()]}
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        letters = byte_alphabet()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + suffix] for c in letters]
        # the file's white space is Unicode's
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.specials = re.compile("|".join(map(re.escape, special))) if special else None
        self.fresh: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def from_json(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        model = spec["model"]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or spec.get("decoder") is not None:
            raise ValueError(f"{path}: a tokenizer of another kind")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {s: i for s, i in model["vocab"].items() if s not in special}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        return cls(vocab, merges, model["end_of_word_suffix"], special, pattern)

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, by merging along a linked list in the order of ranks."""
        data = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in data[:-1]]
        ids.append(self.final[data[-1]])
        n = len(ids)
        if n == 1:
            return ids
        merge = self.merge
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for at in range(n - 1):
            found = merge.get((ids[at], ids[at + 1]))
            if found:
                queue.append((found[0], at, found[1]))
        heapq.heapify(queue)
        while queue:
            _, at, new = heapq.heappop(queue)
            nxt = after[at]
            if ids[at] < 0 or nxt >= n:
                continue
            found = merge.get((ids[at], ids[nxt]))
            if not found or found[1] != new:
                continue  # stale: a neighbour was merged since
            ids[at], ids[nxt] = new, -1
            nxt = after[at] = after[nxt]
            if nxt < n:
                before[nxt] = at
                found = merge.get((new, ids[nxt]))
                if found:
                    heapq.heappush(queue, (found[0], at, found[1]))
            prev = before[at]
            if prev >= 0:
                found = merge.get((ids[prev], new))
                if found:
                    heapq.heappush(queue, (found[0], prev, found[1]))
        return [i for i in ids if i >= 0]

    def _word(self, word: str) -> bytes:
        hit = self.old.get(word)
        if hit is None:
            hit = np.array(self.encode_word(word), "<u4").tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self.fresh) >= CACHE_WORDS:
                self.old, self.fresh = self.fresh, {}
            self.fresh[word] = hit
        return hit

    def _pieces(self, text: str) -> list[bytes]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each capital alone, without its place in a word
        words = self.split.findall(text.lower())
        get, word = self.fresh.get, self._word
        out = []
        for w in words:
            hit = get(w)
            if hit is None:
                hit = word(w)
                get = self.fresh.get
            out.append(hit)
        return out

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.specials is None or not self.specials.search(text):
            return b"".join(self._pieces(text))
        got, at = [], 0
        for m in self.specials.finditer(text):
            got += self._pieces(text[at : m.start()])
            got.append(np.array([self.special[m[0]]], "<u4").tobytes())
            at = m.end()
        return b"".join(got + self._pieces(text[at:]))

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids, the text decoded from them)."""
        ids = self.ids(text)
        return ids, self.decode(ids)

    def decode(self, ids: bytes) -> str:
        """The vocabulary's strings of the ids, joined by spaces as the file has no decoder."""
        return " ".join(map(self.string.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker; its cache lives until the worker or another operator's scan in it."""
    return Vocabulary.from_json(path)


KEPT.append(vocabulary.cache_clear)


def encode_decode(docs: DataFrame, tokenizer: str, texts: bool = False, ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with ids the tokens (binary), with texts the decoded text.

    The tokenizer file has to be at the same path on every executor.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(tokenizer)
        for batch in rows:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                got = [v.ids(t or "") for t in part.column(1).to_pylist()]
                decoded = [v.decode(a) for a in got]
                cols = [part.column(0), [len(a) // 4 for a in got], [hashlib.sha256(a).hexdigest() for a in got]]
                cols.append([hashlib.sha256(s.encode()).hexdigest() for s in decoded])
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
                if ids:
                    cols.append(got)
                    kinds.append(pa.binary())
                if texts:
                    cols.append(decoded)
                    kinds.append(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, list) else c for c, k in zip(cols, kinds, strict=True)], names=names)
        give_back()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids + ", decoded string" * texts
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    ship(docs.sparkSession)
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(batches, schema)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
