"""Splitting oversized texts at natural boundaries by merging atoms over their weakest boundaries."""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode white space, and marks after which a text may be cut without white space.
SPACE = "\t-\r \x85\xa0  -     　"
MARKS = "。！？"
_SENTENCE = re.compile(f"[^{SPACE}{MARKS}]*(?:[{MARKS}]|[{SPACE}]+|$)")
_ATOM = re.compile(f"[{SPACE}]|[^{SPACE}{MARKS}]*[{MARKS}]|[^{SPACE}{MARKS}]+")
_BREAK = re.compile(f"(?:\r\n|[\n\r\x0b\x0c\x85  ])[{SPACE}]*|(?<=[.!?])[{SPACE}]+|(?<=[.!?][\"')\\]»”’])[{SPACE}]+|(?<=[{MARKS}])[{SPACE}]*")


def atoms(text: str, limit: int, overlap: int = 0) -> tuple[list[int], list[int], bool]:
    """Starts of the atoms, the strength of the boundary before each, and whether a word is longer than `limit`.

    Strengths: 4 blank line, 3 line, 2 sentence, 1 word, 0 none. An atom leaves room for the overlap in its piece
    (the first one needs none): longer sentences fall apart into words, longer words into stretches.
    """
    room = lambda at: limit - (overlap if at else 0)
    cuts, forced = [(0, 4)], False
    for m in _BREAK.finditer(text):
        if 0 < m.end() < len(text):
            lines = len(re.findall("\r\n|[\n\r\x0b\x0c\x85  ]", m.group()))
            cuts.append((m.end(), 4 if lines > 1 else 3 if lines else 2))
    starts, strength = [], []
    for (lo, s), (hi, _) in zip(cuts, [*cuts[1:], (len(text), 0)]):
        if hi <= lo:
            continue
        starts.append(lo)
        strength.append(s)
        if hi - lo <= room(lo):
            continue
        for w in _ATOM.finditer(text, lo, hi):
            a, b = w.span()
            if a > lo:
                starts.append(a)
                strength.append(1)
            forced = forced or b - a > limit
            for x in range(a + room(a), b, limit - overlap):
                starts.append(x)
                strength.append(0)
    return starts, strength, forced


def pieces(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, int]], bool]:
    """(start, first new character, end) of each piece in order, and whether a word is longer than `limit`.

    Adjacent runs of atoms wait in a heap by the strength of the boundary between them, then by their common size;
    the weakest boundary goes first while both runs and the overlap fit in `limit`. A piece after the first begins
    about `overlap` characters (three quarters at least) before its first new one, at a natural boundary where there
    is one near, or with all of the piece before if that is shorter. So a word of more than `limit - overlap` is cut.
    """
    starts, strength, forced = atoms(text, limit, overlap)
    n = len(starts)
    ends = [*starts[1:], len(text)]
    nxt, prv, end, alive, stamp = [*range(1, n), -1], list(range(-1, n - 1)), ends, [True] * n, [0] * n
    heap: list[tuple] = []

    def offer(i, j):
        size = end[j] - starts[i]
        if size + (overlap if i else 0) <= limit:
            heapq.heappush(heap, (strength[j], size, i, j, stamp[i], stamp[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, _, i, j, a, b = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or stamp[i] != a or stamp[j] != b:
            continue
        alive[j] = False
        end[i] = end[j]
        stamp[i] += 1
        k = nxt[i] = nxt[j]
        if k >= 0:
            prv[k] = i
            offer(i, k)
        if prv[i] >= 0:
            offer(prv[i], i)
    out, i = [], 0
    while i >= 0:
        lo, hi = starts[i], end[i]
        begin = lo
        if lo:
            begin = max(lo - overlap, out[-1][0])
            window = [m.end() for m in _ATOM.finditer(text, begin, lo) if m.end() - begin <= overlap // 4]
            if begin and window:
                begin = window[0] if text[begin - 1] not in " \n" else begin
        out.append((begin, lo, hi))
        i = nxt[i]
    return out, forced


PIECE = "item_kind string, item_id string, piece_no int, start_char int, new_char int, end_char int, forced boolean"


def split_items(items: DataFrame, with_text: bool = True) -> DataFrame:
    """Pieces of items (item_kind, item_id, text, max_chars, overlap_chars) longer than their max_chars.

    Each piece has at most max_chars code points; new_char is where it goes beyond the one before, so the parts
    from new_char to end_char join up to the whole text. `forced` tells of each piece whether its item has a
    stretch of more than max_chars without a natural boundary. Null and empty texts, and items without a limit,
    give no rows. Only oversized texts reach Python; nothing is shuffled.
    """
    big = items.where(F.length("text") > F.col("max_chars"))
    spec = PIECE + (", text string" if with_text else "")
    names = [x.split()[0] for x in spec.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()][: len(names)]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for kind, item, text, limit, overlap in zip(*(b.column(c).to_pylist() for c in ("item_kind", "item_id", "text", "max_chars", "overlap_chars"))):
                got, forced = pieces(text, limit, min(overlap or 0, limit - 1))
                for no, (lo, new, hi) in enumerate(got):
                    for c, v in zip(cols, (kind, item, no, lo, new, hi, forced, text[lo:hi])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], schema=schema)

    return big.select("item_kind", "item_id", "text", "max_chars", "overlap_chars").mapInArrow(run, spec)
