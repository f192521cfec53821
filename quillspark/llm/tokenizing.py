"""Encoding of a corpus with a public byte-level tokenizer, by overlapping chunks.

A text longer than a chunk is cut into overlapping chunks, which are pre-tokenised on their own. Two neighbouring chunks are
stitched at the first boundary of pre-tokens that both find in their overlap: a pre-token depends only on what follows its
start, so from a shared boundary on both chains are one. A chunk without a stitch joins the piece before it up to its first
place that is a boundary wherever a chain begins (a letter or digit before a space or line feed), or wholly where it has none.
The pieces between are encoded and their ids concatenated. Texts of many chunks have them spread over tasks; the same
functions stitch them there.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.storage import written

#: Fixed value: the pattern of pre-tokens that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A boundary counts only where so many characters follow it in its chunk: a cut-off end cannot have changed it.
MARGIN = 16


@dataclass(frozen=True)
class Tokenizer:
    #: The vocabulary's file as ranks; it must be at this path on every executor.
    path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = PATTERN
    #: Code points of a chunk and of what it shares with the next.
    chunk: int = 4_096
    overlap: int = 512
    #: Chunks of a text from which on they are spread over tasks.
    spread: int = 16

    def chunks(self, length: int) -> int:
        return -(-max(1, length - self.overlap) // self.chunk)

    def slice(self, text: str, k: int) -> str:
        return text[k * self.chunk :] if k == self.chunks(len(text)) - 1 else text[k * self.chunk : (k + 1) * self.chunk + self.overlap]


@lru_cache(maxsize=4)
def encoding(how: Tokenizer):
    import tiktoken

    with open(how.path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=how.pattern, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, how: Tokenizer) -> list[int]:
    """Ends of the pre-tokens of `text`."""
    import regex

    return [m.end() for m in regex.finditer(how.pattern, text)]


def stitches(chunk: str, is_last: bool, how: Tokenizer) -> tuple[list[int], list[int], int | None]:
    """Offsets at which a chunk may be stitched to the one before and to the one after (there counted from that one's start), and
    its first sure boundary before the next chunk starts.

    Only boundaries after a character that is no white space: a piece that ends there encodes as within the text.
    """
    import regex

    ends = boundaries(chunk, how)
    safe = [e for e in ends if e <= len(chunk) - (0 if is_last else MARGIN) and not chunk[e - 1].isspace()]
    sure = regex.search(r"[\p{L}\p{N}](?=[ \n])", chunk, endpos=min(len(chunk), how.chunk))
    return [e for e in safe if e < how.overlap], [e - how.chunk for e in safe if how.chunk <= e < how.chunk + how.overlap] if not is_last else [], sure.end() if sure else None


def pieces(found: list[tuple[list[int], list[int], int | None]]) -> list[tuple[int, int]]:
    """(piece, offset of its cut) of each chunk, from its stitches; the cut is 0 where a chunk joins the piece before wholly.

    A chunk's chain is the text's from its cut on. So it may be stitched to the next only if it has a cut.
    """
    out = [(0, 0)]
    known, piece = True, 0
    for (_, before, _), (head, _, sure) in zip(found, found[1:]):
        shared = set(before) if known else set()
        cut = next((e for e in head if e in shared), sure)
        known = cut is not None
        piece += known
        out.append((piece, cut or 0))
    return out


def encoded(text: str, how: Tokenizer) -> list[int]:
    """The ids of one text, chunk by chunk in this task."""
    enc, n = encoding(how), how.chunks(len(text))
    if n == 1:
        return enc.encode_ordinary(text)
    plan = pieces([stitches(how.slice(text, k), k == n - 1, how) for k in range(n)])
    cuts = [k * how.chunk + cut for k, (piece, cut) in enumerate(plan) if not k or piece > plan[k - 1][0]]
    return [i for a, b in zip(cuts, [*cuts[1:], len(text)]) for i in enc.encode_ordinary(text[a:b])]


def _id_lists(ids: list[list[int]]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", how: Tokenizer = Tokenizer()) -> DataFrame:
    """(key, ids) for each row of `df`, repeated rows included; a null or empty text gives an empty list. Strings of special
    tokens are ordinary text. Other columns are not read."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    arrow_kind = pa.string() if kind == "string" else pa.int64()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encoded(t, how) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow_kind), _id_lists(ids)], names=["key", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tag, t in zip(*(c.to_pylist() for c in batch.columns)):
                n = how.chunks(len(t))
                for at in range(0, n, 64):
                    ks = range(at, min(n, at + 64))
                    yield pa.RecordBatch.from_arrays([pa.array([tag] * len(ks), pa.string()), pa.array(list(ks), pa.int32()), pa.array([k == n - 1 for k in ks]), pa.array([how.slice(t, k) for k in ks], pa.string())], names=["tag", "k", "is_last", "slice"])

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stitches(t, last, how) for last, t in zip(batch.column("is_last").to_pylist(), batch.column("slice").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("tag"), batch.column("k"), _id_lists([f[0] for f in found]), _id_lists([f[1] for f in found]), pa.array([f[2] for f in found], pa.int32())], names=["tag", "k", "head", "tail", "sure"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tag, ends in zip(batch.column("tag").to_pylist(), batch.column("ends").to_pylist()):
                plan = pieces([(e["head"], e["tail"], e["sure"]) for e in ends])
                yield pa.RecordBatch.from_arrays([pa.array([tag] * len(plan), pa.string()), pa.array(range(len(plan)), pa.int32()), pa.array([p for p, _ in plan], pa.int32()), pa.array([c for _, c in plan], pa.int32())], names=["tag", "k", "piece", "cut"])

    def join_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(how)
        for batch in batches:
            ids = [enc.encode_ordinary("".join(p["part"] for p in parts)) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("tag"), batch.column("piece"), _id_lists(ids)], names=["tag", "piece", "ids"])

    one_task = how.spread * how.chunk + how.overlap
    short = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= one_task).mapInArrow(encode, f"key {kind}, ids array<int>")
    # rows of one key and text are encoded once; their tag is made of both, so it is the same when a task is repeated
    long = rows.where(F.length("text") > one_task).groupBy("key", "text").agg(F.count("*").alias("n"))
    long = written(long.select(F.sha2(F.concat_ws("\x1f", F.col("key").cast("string"), F.col("key").isNull().cast("string"), "text"), 256).alias("tag"), "key", "n", "text"), "long")
    slices = written(long.select("tag", "text").mapInArrow(cut, "tag string, k int, is_last boolean, slice string").repartition("tag", "k"), "slices")
    ends = slices.mapInArrow(pretokenise, "tag string, k int, head array<int>, tail array<int>, sure int")
    by_text = ends.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("k", "head", "tail", "sure"))).alias("ends"))
    plan = written(by_text.mapInArrow(stitch, "tag string, k int, piece int, cut int"), "plan")
    # what a chunk gives to the piece before it, up to its cut, and to its own: each reaches as far as the next chunk starts
    parts = slices.join(plan, ["tag", "k"])
    opens = (F.col("k") == 0) | (F.col("cut") > 0)
    own = F.struct("piece", "k", F.lit(1).alias("half"), F.expr(f"substring(slice, cut + 1, CASE WHEN is_last THEN length(slice) ELSE {how.chunk} - cut END)").alias("part"))
    before = F.when(opens & (F.col("k") > 0), F.struct((F.col("piece") - 1).alias("piece"), F.col("k"), F.lit(0).alias("half"), F.expr("substring(slice, 1, cut)").alias("part")))
    halves = parts.select("tag", F.explode(F.array_compact(F.array(before, own))).alias("p")).select("tag", "p.*")
    whole = halves.groupBy("tag", "piece").agg(F.array_sort(F.collect_list(F.struct("k", "half", "part"))).alias("parts"))
    encoded_pieces = whole.mapInArrow(join_slices, "tag string, piece int, ids array<int>")
    stitched = encoded_pieces.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    stitched = long.select("tag", "key", "n").join(stitched, "tag").select("key", F.flatten("p.ids").alias("ids"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).select("key", "ids")
    return short.unionByName(stitched).withColumnRenamed("key", key)


def decoded(ids: list[int], how: Tokenizer = Tokenizer()) -> str:
    """The text of ids: their raw bytes concatenated, then decoded once."""
    return encoding(how).decode_bytes(ids).decode("utf-8")
