"""Sentences, chunks and spans of texts, with offsets in code points."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

_END = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n+")


def spans(text: str) -> list[tuple[int, int]]:
    """Half-open spans of the sentences, without the space around them."""
    out, at = [], 0
    for m in [*_END.finditer(text), None]:
        lo, hi = at, len(text) if m is None else m.start()
        at = hi if m is None else m.end()
        piece = text[lo:hi]
        lo, hi = lo + len(piece) - len(piece.lstrip()), hi - (len(piece) - len(piece.rstrip()))
        if hi > lo:
            out.append((lo, hi))
    return out


def chunk(text: str, least: int = 12, most: int = 55, tail: int = 6) -> list[str]:
    """Sentences merged forward until they have `least` words and never past `most`, unless one alone is longer; a rest of under `tail` words is dropped."""
    out: list[str] = []
    held: list[str] = []
    n = 0
    for lo, hi in spans(text):
        s = text[lo:hi]
        k = len(s.split())
        if held and n + k > most:
            out.append(" ".join(held))
            held, n = [], 0
        held.append(s)
        n += k
        if n >= least:
            out.append(" ".join(held))
            held, n = [], 0
    if n >= tail:
        out.append(" ".join(held))
    return out


def sentences(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, unit_no, unit_start, unit_end) of each sentence; null and blank texts have none."""
    schema = pa.schema([("doc_id", pa.int64()), ("unit_no", pa.int32()), ("unit_start", pa.int32()), ("unit_end", pa.int32())])

    def run(batches):
        for b in batches:
            rows = [(d, i, lo, hi) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for i, (lo, hi) in enumerate(spans(t))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(id_col, text).mapInArrow(run, "doc_id long, unit_no int, unit_start int, unit_end int")


def sentence_chunks(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    schema = pa.schema([("chunk_id", pa.string()), ("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        for b in batches:
            rows = [(f"{d}c{i:02d}", d, c) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for i, c in enumerate(chunk(t))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(id_col, text).mapInArrow(run, "chunk_id string, doc_id long, text string")


def first_json(answer: str):
    """The first balanced JSON value of a model's answer, fences or words around it or not; None if there is none."""
    start = re.search(r"[\[{]", answer)
    while start:
        try:
            return json.JSONDecoder().raw_decode(answer[start.start() :])[0]
        except ValueError:
            start = re.compile(r"[\[{]").search(answer, start.start() + 1)
    return None


def snap(text: str, phrase: str) -> tuple[int, int] | None:
    """Where a phrase stands in a text, dropping its first words, then its last, while it doesn't."""
    parts = phrase.split()
    for drop in range(len(parts)):
        for cand in (" ".join(parts[drop:]), " ".join(parts[: len(parts) - drop])):
            i = text.find(cand)
            if cand and i >= 0:
                return i, i + len(cand)
    return None
