"""Version resolution and near-duplicate chunks: shingles, minhash bands, exact check, earliest parent, roots."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillspark.functions.ids import base_id_lenient, version
from quillspark.storage import dropped, written


def folded(text: Column) -> Column:
    """Lower case with the German sharp s written out, as casefolding does."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(words: Column, size: int) -> Column:
    """Distinct runs of `size` words; empty where there are fewer. `words` should be a plain column: it is used for each run."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - size + 1)), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when(n >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def shingle_sets(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, shingles): the distinct shingles of each text that has any, hashed to 64 bits, in order. Tokens are one column of
    their own, so that the pattern runs once a text and not once a shingle."""
    words = df.select(F.col(key).alias("key"), tokens(F.col(text)).alias("w")).where(F.size("w") >= size)
    runs = F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(size)]))
    return words.select("key", F.sort_array(F.array_distinct(runs)).alias("shingles"))


#: Constants of xxHash64, and hashes worked on at a time, which a core's cache holds.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SLAB = 16_384


def _turned(x: np.ndarray, by: int, spare: np.ndarray) -> None:
    np.left_shift(x, np.uint64(by), out=spare)
    np.right_shift(x, np.uint64(64 - by), out=x)
    np.bitwise_or(x, spare, out=x)


def _mixed(x: np.ndarray, spare: np.ndarray) -> None:
    for by, times in ((33, _P2), (29, _P3), (32, None)):
        np.right_shift(x, np.uint64(by), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if times is not None:
            np.multiply(x, times, out=x)


def _hashed(h: np.ndarray) -> np.ndarray:
    """xxhash64 of 64-bit numbers as Spark has it, with the summand of a following 32-bit one: what xxhash64(h, k) is continued from."""
    x, spare = h.view(np.uint64) * _P2, np.empty(len(h), np.uint64)
    _turned(x, 31, spare)
    x *= _P1
    x ^= np.uint64(42) + _P5 + np.uint64(8)
    _turned(x, 27, spare)
    x *= _P1
    x += _P4
    _mixed(x, spare)
    x += _P5 + np.uint64(4)
    return x


def minima_of(values: np.ndarray, starts: np.ndarray, minima: int) -> np.ndarray:
    """[k, row]: the least xxhash64(h, k) over the numbers h of each row, which has those from its start to the next; no row is empty."""
    out = np.empty((minima, len(starts)), np.int64)
    ends = np.append(starts[1:], len(values))
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _SLAB, "right")))
        seeds = _hashed(values[starts[first] : ends[last - 1]])
        x, spare, at = np.empty_like(seeds), np.empty_like(seeds), starts[first:last] - starts[first]
        for k in range(minima):
            np.bitwise_xor(seeds, np.uint64(k * int(_P1) % 2**64), out=x)
            _turned(x, 23, spare)
            np.multiply(x, _P2, out=x)
            np.add(x, _P3, out=x)
            _mixed(x, spare)
            np.minimum.reduceat(x.view(np.int64), at, out=out[k, first:last])
        first = last
    return out


def minhash(sets: DataFrame, minima: int = 128) -> DataFrame:
    """(key, n, m0..): the minima of xxhash64(h, 0), xxhash64(h, 1).. over the shingles of the sets (key, shingles) of a key.

    A set's minima are taken where its text is, by arrays and without a row for each shingle; a key of several texts has theirs merged.
    """
    columns = [f"m{k}" for k in range(minima)]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(b.column("shingles").offsets.to_numpy())
            b, sizes = b.filter(pa.array(sizes > 0)), sizes[sizes > 0]
            if len(sizes):
                values = b.column("shingles").flatten().to_numpy()
                found = minima_of(values, np.cumsum(sizes) - sizes, minima)
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(sizes.astype(np.int64)), *map(pa.array, found)], ["key", "n", *columns])

    shape = StructType([sets.schema["key"], *[StructField(c, LongType()) for c in ("n", *columns)]])
    rows = sets.select("key", "shingles").mapInArrow(signed, shape)
    return rows.groupBy("key").agg(F.sum("n").alias("n"), *[F.min(c).alias(c) for c in columns])


def candidates(sets: DataFrame, threshold: float = 0.85, minima: int = 64, rows: int = 4, hot: int = 400) -> DataFrame:
    """(a, b), a < b: sets (key, shingles) that share a band of `rows` minima. The sets of a band that more than `hot` share are
    joined by rare shingles instead (crowded_pairs, which `threshold` is for)."""
    buckets = written(buckets_of(minhash(sets, minima), minima, rows), "buckets")
    heavy = written(buckets.groupBy("bucket").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("bucket"), "hot")
    if heavy.isEmpty():
        return bucket_pairs(buckets)
    crowded = written(buckets.join(heavy, "bucket", "left_semi").select(F.col("key").alias("klass"), "bucket"), "crowded")
    chosen = sets.join(crowded.select(F.col("klass").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("klass"), "shingles")
    more = crowded_pairs(written(chosen, "sets"), crowded, threshold, hot).select(F.col("klass_a").alias("a"), F.col("klass_b").alias("b"))
    return bucket_pairs(buckets.join(heavy, "bucket", "left_anti")).unionByName(more).distinct()


def buckets_of(signatures: DataFrame, minima: int = 64, rows: int = 4) -> DataFrame:
    bands = F.array(*[F.xxhash64(*[f"m{r}" for r in range(b, b + rows)], F.lit(b)) for b in range(0, minima, rows)])
    return signatures.select("key", F.explode(bands).alias("bucket"))


def bucket_pairs(buckets: DataFrame) -> DataFrame:
    left, right = buckets.select(F.col("key").alias("a"), "bucket"), buckets.select(F.col("key").alias("b"), "bucket")
    return left.join(right, "bucket").where("a < b").select("a", "b").distinct()


def crowded_pairs(sets: DataFrame, buckets: DataFrame, threshold: float, hot: int, salts: int = 16) -> DataFrame:
    """(klass_a, klass_b): pairs of crowded sets that can reach the threshold t.

    sets: klass, shingles (array of distinct hashes), the sets that share a hot key, one of very many sets (long
    boilerplate), whose pairs a join on keys would all emit. buckets: klass, bucket of the hot keys.

    A shingle of more than `hot` classes is common. Two sets of sizes n_a <= n_b alike share at least t/(1+t) (n_a+n_b)
    shingles, so at least 2t/(1+t) n_a. Where a has fewer common ones than that, both share `need` rare shingles or more,
    and so one of the first (rare - need + 1) of a in one order of shingles. Otherwise they may share any rare one, so all
    of a's are looked up, or none. So every pair alike that shares a rare shingle is found exactly. Without one, both sets must
    be common to t of the larger: those few keep their hot keys, nearly all of their pairs are pairs alike, and they are
    found with the recall of the keys. A hot key is split into `salts` parts by the set on one side, so no task has all its pairs.
    """
    t = threshold - 1e-9
    rows = written(sets.select("klass", F.size("shingles").alias("n"), F.explode("shingles").alias("s")), "crowded")
    seen = rows.groupBy("s").agg(F.count("*").alias("df"))
    rare = rows.join(seen.where(F.col("df") <= hot), "s")
    counted = rare.groupBy("klass", "n").agg(F.count("*").alias("r"), F.array_sort(F.collect_list(F.when(F.col("df") > 1, F.struct("df", "s")))).alias("p"))
    whole = sets.select("klass", F.size("shingles").alias("n"))
    profile = written(whole.join(counted.drop("n"), "klass", "left").select("klass", "n", (F.col("n") - F.coalesce("r", F.lit(0))).alias("f"), "r", "p"), "profiles")
    need = F.ceil(F.lit(2 * t / (1 + t)) * F.col("n")) - F.col("f")
    # of the rare shingles those of this class alone come first in the order and need no row
    head = F.slice("p", F.lit(1), F.greatest(F.lit(0), F.size("p") - F.greatest(need, F.lit(1)) + 1).cast("int"))
    a = profile.where(F.col("p").isNotNull()).select(F.col("klass").alias("x"), F.col("n").alias("nx"), F.explode(head).alias("e")).select("x", "nx", "e.s")
    b = profile.where(F.col("p").isNotNull()).select(F.col("klass").alias("y"), F.col("n").alias("ny"), F.explode("p").alias("e")).select("y", "ny", "e.s")
    able = (F.col("x") != F.col("y")) & (F.col("ny") >= F.col("nx")) & (F.col("nx") >= F.lit(t) * F.col("ny"))
    by_rare = a.join(b, "s").where(able).select("x", "y")
    most = profile.where(need < 1).select(F.col("klass").alias("x"), F.col("n").alias("nx"))
    much = profile.where(F.col("f") >= F.lit(t) * F.col("n")).select(F.col("klass").alias("y"), F.col("n").alias("ny"))
    keyed = lambda side, c: buckets.withColumnRenamed("klass", c).join(side, c)
    parted = keyed(most, "x").withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(salts)))
    by_key = parted.join(keyed(much, "y").withColumn("salt", F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(salts)]))), ["bucket", "salt"]).where(able).select("x", "y")
    return by_rare.unionByName(by_key).select(F.least("x", "y").alias("klass_a"), F.greatest("x", "y").alias("klass_b")).distinct()


@dataclass(frozen=True)
class Alike:
    """members: key, klass (the smallest key of equal shingle sets). links: a < b, jaccard of two classes alike."""

    members: DataFrame
    links: DataFrame


def near_duplicates(df: DataFrame, key: str, text: str, size: int = 5, threshold: float = 0.85, minima: int = 64, rows: int = 4, hot: int = 400) -> Alike:
    """Texts whose distinct shingles have a similarity of `threshold` or more, as classes and links between them.

    Sixteen bands of four minima find a pair at 0.85 with 0.99997, at 0.8 with 0.9998; candidates are verified on the whole
    sets, so nothing below the threshold comes out. Texts of equal sets are one class, told by two hashes of 64 bits, so a
    group of copies costs one row a copy. Texts of fewer words than a shingle, and rows without key or text, are in no class.
    """
    known = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    told = F.xxhash64("text").alias("told")
    hashes = shingle_sets(known.select(F.struct("key", told).alias("key"), "text"), "key", "text", size)
    keyed = written(hashes.select("key.key", "key.told", F.xxhash64("shingles").alias("h1"), F.xxhash64(F.lit(1), "shingles").alias("h2")), "keyed")
    first = written(keyed.groupBy("h1", "h2").agg(F.min(F.struct("key", "told")).alias("first")).select("h1", "h2", F.col("first.key").alias("klass"), "first.told"), "classes")
    members = keyed.join(first.select("h1", "h2", "klass"), ["h1", "h2"]).select("key", "klass").distinct()
    shown = known.select("key", told, "text").join(first.select(F.col("klass").alias("key"), "told"), ["key", "told"], "left_semi")
    sets = written(shingle_sets(shown.dropDuplicates(["key", "told"]), "key", "text", size), "sets")
    found = written(candidates(sets, threshold, minima, rows, hot), "candidates")
    one = lambda c: sets.select(F.col("key").alias(c), F.col("shingles").alias(f"s_{c}"))
    common = F.size(F.array_intersect("s_a", "s_b"))
    links = found.join(one("a"), "a").join(one("b"), "b").select("a", "b", (common / (F.size("s_a") + F.size("s_b") - common)).alias("jaccard"))
    return Alike(members, links.where(F.col("jaccard") >= threshold))


def direct_parents(alike: Alike, positions: DataFrame) -> DataFrame:
    """(key, parent): of the keys alike that come earlier, the earliest. positions: key, pos.

    That is the first key of the key's own class or of those linked to it, whichever is first: one minimum a class.
    """
    placed = written(alike.members.join(positions.select("key", "pos"), "key").select("klass", F.struct("pos", "key").alias("at")), "placed")
    first = placed.groupBy("klass").agg(F.min("at").alias("first"))
    both = alike.links.select("a", "b").unionByName(alike.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(first.withColumnRenamed("klass", "b"), "b").groupBy("a").agg(F.min("first").alias("other")).withColumnRenamed("a", "klass")
    lowest = first.join(linked, "klass", "left").select("klass", F.least("first", F.coalesce("other", "first")).alias("low"))
    return placed.join(lowest, "klass").where("low < at").groupBy("at.key").agg(F.min("low").alias("low")).select("key", F.col("low.key").alias("parent"))


def roots(parents: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(key, root): where a chain of parents ends, by doubling pointers; one pointer a key, so this is no component."""
    now = held = written(parents.select("key", F.col("parent").alias("root")), "roots")
    for _ in range(most_rounds):
        hop = now.select(F.col("key").alias("root"), F.col("root").alias("next"))
        joined = written(now.join(hop, "root", "left").select("key", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(held)
        now, held = joined.select("key", "root"), joined
        if joined.where("moved").isEmpty():
            return now
    raise ValueError("parents form a cycle")


def resolved_versions(records: DataFrame, raw: str, pos: str, payload: str) -> DataFrame:
    """base_id, version, versions_seen, raw_id, payload, first_pos: of each paper the highest version (none is lowest; of
    equal ones the first), every version seen, in order of first appearance. Spellings of no paper stand for themselves."""
    rows = records.where(F.col(raw).isNotNull()).select(base_id_lenient(F.col(raw)).alias("base_id"), version(F.col(raw)).alias("version"), F.col(raw).alias("raw_id"), F.col(pos).alias("pos"), F.col(payload).alias("payload"))
    best = F.max_by(F.struct("version", "raw_id", "payload"), F.struct(F.col("version"), -F.col("pos"))).alias("best")
    out = rows.groupBy("base_id").agg(best, F.array_sort(F.collect_set("version")).alias("versions_seen"), F.min("pos").alias("first_pos"))
    return out.select("base_id", "best.version", "versions_seen", "best.raw_id", "best.payload", "first_pos")


def in_document_order(chunks: DataFrame, key: str = "chunk_uid") -> DataFrame:
    """key, pos of chunks by document, then start, then key. Positions are sums of counts of documents and places
    within one, so that no task sorts all chunks."""
    rows = chunks.groupBy(key).agg(F.min("doc_id").alias("doc_id"), F.min("char_start").alias("start"))
    return rows.select(F.col(key).alias("key"), F.struct(F.coalesce("doc_id", F.lit("")), F.coalesce("start", F.lit(-1)), key).alias("pos"))


def unique_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur with more than one text, which an index of chunks must refuse."""
    return df.groupBy(key).agg(F.count_distinct("text").alias("n_texts"), F.count("*").alias("n")).where("n > 1")


