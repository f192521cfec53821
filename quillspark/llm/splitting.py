"""Splitting oversized texts at natural boundaries, by agglomerative merging."""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of boundary, strongest first, each with the pattern whose end is the boundary.
BOUNDARIES = (
    (5, re.compile(r"\n[ \t]*\n\s*")),
    (4, re.compile(r"\n")),
    (3, re.compile(r"[.!?…。！？]['\"”’)\]]*\s+")),
    (2, re.compile(r"[;:,，；]\s+")),
    (1, re.compile(r"\s+")),
)


def _atoms(text: str, start: int, end: int, room: int, kind: int = 0) -> Iterator[tuple[int, int]]:
    """(end, strength) of consecutive atomic segments of text[start:end], each of at most `room` code points.

    Paragraphs, lines and sentences are always atoms; clauses, words and code points only within a longer one.
    """
    if kind == 0:
        cuts: dict[int, int] = {}
        for strength, pattern in BOUNDARIES[:3]:
            for m in pattern.finditer(text, start, end):
                cuts[m.end()] = max(strength, cuts.get(m.end(), 0))
        cuts[end] = 6
    elif kind < 3:
        strength, pattern = BOUNDARIES[2 + kind]
        cuts = {m.end(): strength for m in pattern.finditer(text, start, end)} | {end: 6}
    else:
        at, cuts = start, {}
        while end - at > room:
            stop = at + room
            while stop > at + room // 2 and unicodedata.combining(text[stop]):
                stop -= 1
            cuts[stop] = 0
            at = stop
        cuts[end] = 6
    at = start
    for cut in sorted(cuts):
        if cut - at > room:
            inner = list(_atoms(text, at, cut, room, kind + 1))
            yield from inner[:-1]
        if cut > at:
            yield cut, cuts[cut]
        at = cut


def segments(text: str, limit: int, overlap: int) -> list[int]:
    """Ends of the segments that `text` is cut into.

    Adjacent segments wait in a heap by the strength of the boundary between them (ties: the smaller sum, then the
    earlier) and are merged, weakest first, while their sum and the overlap fit in the limit; the first piece has none.
    """
    room = limit - overlap
    atoms = list(_atoms(text, 0, len(text), room))
    ends, strength = [a[0] for a in atoms], [a[1] for a in atoms]
    n = len(ends)
    starts = [0, *ends[:-1]]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (size := ends[j] - starts[i]) <= (limit if starts[i] == 0 else room):
            heapq.heappush(heap, (strength[i], size, i, j))

    for i in range(n):
        offer(i)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or ends[j] - starts[i] != size:
            continue
        alive[j] = False
        ends[i], strength[i], after[i] = ends[j], strength[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ends[i] for i in range(n) if alive[i]]


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of each piece; each after the first starts `overlap` code points before the end of the one before."""
    ends = segments(text, limit, overlap)
    return [(max(0, before - overlap) if k else 0, end) for k, (before, end) in enumerate(zip([0, *ends], ends))]


def split_oversized(df: DataFrame, key: str = "chunk_uid", text: str = "text", start: str = "char_start", end: str = "char_end", section: str = "section_path", limit: int = 1800, overlap: int = 120) -> DataFrame:
    """Pieces of the texts longer than `limit` code points: key, piece, n_pieces, piece_start, piece_end (offsets in the
    text), char_start, char_end (in the document), section_path, text.

    Document offsets count from the row's own start where its span fits its text, else they are the offsets in the
    text. Null, empty and shorter texts give no rows; repeated rows of a key and text give the pieces of one of them (the
    smallest start, null last). Rows of a null key are split too. Other columns are not read.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and less than half of the limit")
    schema = df.select(F.col(key).alias("key")).schema
    kind = schema["key"].dataType.simpleString()
    arrow_kind = pa.string() if kind == "string" else pa.int64()
    names = ["key", "piece", "n_pieces", "piece_start", "piece_end", "char_start", "char_end", "section_path", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for k, t, s, e, path in zip(*(c.to_pylist() for c in batch.columns)):
                cut = pieces(t, limit, overlap)
                base = s if s is not None and e is not None and e - s == len(t) else 0
                for n, (a, b) in enumerate(cut):
                    for column, value in zip(out, (k, n, len(cut), a, b, base + a, base + b, path, t[a:b])):
                        column.append(value)
            kinds = [arrow_kind, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e"), F.col(section).alias("path")).where(F.length("text") > limit)
    one = rows.groupBy("key", F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.min_by(F.struct("text", "s", "e", "path"), F.struct(F.isnull("s"), "s")).alias("r"))
    return one.select("key", "r.text", "r.s", "r.e", "r.path").mapInArrow(run, f"key {kind}, piece int, n_pieces int, piece_start int, piece_end int, char_start long, char_end long, section_path string, text string").withColumnRenamed("key", key)
