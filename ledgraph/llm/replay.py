"""Encoding with a public byte-level BPE by replaying merges over a vocabulary of words.

The words that a partition of the corpus needs are gathered, each once; an inverted index from token pair to the
places where it stands then applies the merges in rank order and touches only the neighbours of each merged pair.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The place of the public vocabulary and its word pattern.
VOCABULARY = os.environ.get("LEDGRAPH_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SPACED = re.compile(r"\s\s")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
_LOADED: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Replay:
    """Token ids of texts; keeps the units met so far, at most `keep` of them."""

    def __init__(self, ranks: dict[bytes, int], keep: int = 400_000, longest: int = 48):
        import regex

        self.ranks, self.keep, self.longest = ranks, keep, longest
        self.words_of = regex.compile(PATTERN).findall
        self.units: dict[str, array] = {}
        self.word_ids: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.bytes_of = {v: k for k, v in ranks.items()}

    def pair_rank(self, a: int, b: int) -> int:
        """The id of the merge of two tokens, or -1."""
        r = self.pairs.get((a, b))
        if r is None:
            r = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
            if len(self.pairs) < 2_000_000:
                self.pairs[(a, b)] = r
        return r

    def merge(self, words: list[str]) -> None:
        """Fill word_ids for `words`: all of them are merged together, rank by rank."""
        ranks, single, pair_rank = self.ranks, self.single, self.pair_rank
        sym: list[int] = []
        nxt: list[int] = []
        prv: list[int] = []
        starts: list[tuple[str, int]] = []
        for w in words:
            b = w.encode("utf-8", "surrogatepass")
            whole = ranks.get(b)
            if whole is not None:
                self.word_ids[w] = [whole]
                continue
            at, n = len(sym), len(b)
            starts.append((w, at))
            sym.extend([single[x] for x in b])
            nxt.extend(range(at + 1, at + n))
            nxt.append(-1)
            prv.append(-1)
            prv.extend(range(at, at + n - 1))
        where: dict[int, list[int]] = {}
        for i, j in enumerate(nxt):
            if j >= 0:
                r = pair_rank(sym[i], sym[j])
                if r >= 0:
                    where.setdefault(r, []).append(i)
        heap = list(where)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            places = where.pop(r, None)
            if places is None:
                continue
            places.sort()
            for i in places:
                j = nxt[i]
                if j < 0 or sym[i] < 0 or pair_rank(sym[i], sym[j]) != r:
                    continue
                k = nxt[j]
                sym[i], sym[j], nxt[i] = r, -1, k
                nxt[j] = -1
                if k >= 0:
                    prv[k] = i
                    q = pair_rank(r, sym[k])
                    if q >= 0:
                        if q not in where:
                            where[q] = []
                            heapq.heappush(heap, q)
                        where[q].append(i)
                h = prv[i]
                if h >= 0:
                    q = pair_rank(sym[h], r)
                    if q >= 0:
                        if q not in where:
                            where[q] = []
                            heapq.heappush(heap, q)
                        where[q].append(h)
        for w, at in starts:
            ids = []
            while at >= 0:
                ids.append(sym[at])
                at = nxt[at]
            self.word_ids[w] = ids

    def split(self, text: str) -> list[str]:
        """Units whose encodings join up to the text's: cut before single spaces between other characters."""
        if _SPACED.search(text) is None and not text.startswith(" ") and not text.endswith(" "):
            parts = text.split(" ")
        else:
            parts = _SINGLE.split(text)
        return [parts[0], *[" " + p for p in parts[1:]]]

    def encode(self, texts: list[str | None]) -> list[array]:
        known = self.units
        split = [self.split(t) if t else [] for t in texts]
        new = {u for units in split for u in units if u not in known}
        if new:
            if len(known) + len(new) > self.keep:
                known.clear()
                self.word_ids.clear()
                new = {u for units in split for u in units}
            need = {u: self.words_of(u) for u in new}
            ids = self.word_ids
            self.merge(list({w for words in need.values() for w in words if w not in ids}))
            for u, words in need.items():
                a = array("i")
                for w in words:
                    a.extend(ids[w])
                known[u] = a
        out = []
        for units in split:
            a = array("i")
            for u in units:
                a += known[u]
            out.append(a)
        if len(new) > 20_000:  # long tails of pasted data aren't kept
            for u in new:
                if len(u) > self.longest:
                    del known[u]
        return out


def loaded(raw: bytes) -> Replay:
    """One Replay for each Python worker and vocabulary."""
    key = hashlib.sha256(raw).digest()
    r = _LOADED.get(key)
    if r is None:
        r = _LOADED[key] = Replay({base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x.strip())})
    return r


def _lists(ids: list[array]) -> pa.Array:
    offsets, flat = array("i", [0]), array("i")
    for a in ids:
        flat += a
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(memoryview(offsets), pa.int32()), pa.array(memoryview(flat), pa.int32()))


def token_ids(docs: DataFrame, id_col: str, text_col: str, path: str | None = None, out: str = "ids") -> DataFrame:
    """(`id_col`, `out` array<int>) of each row, without special tokens; null and empty texts give an empty list.

    Text that looks like a special token is plain text. Rows aren't shuffled: each partition replays the merges
    over its own words. The vocabulary (under 1 MB, a fixed file) goes to the executors as a broadcast variable.
    """
    spark = docs.sparkSession
    with open(path or VOCABULARY, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType

    def run(batches):
        replay = loaded(raw.value)
        for b in batches:
            texts = b.column(1)
            for lo in range(0, b.num_rows, 2000):
                part = texts.slice(lo, 2000)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 2000), _lists(replay.encode(part.to_pylist()))], names=[id_col, out])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind.simpleString()}, {out} array<int>")
