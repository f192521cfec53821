"""Near-duplicate texts by tensored banding.

Two small collections of band hashes, A (bands of `rows_a` minima) and B (bands of `rows_b`), are computed for each
distinct shingle set; the key of table (i, j) joins A_i with B_j. So bands_a * bands_b tables of rows_a + rows_b
minima each come from only bands_a * rows_a + bands_b * rows_b minima, about the square root of what separate tables need.
A pair of similarity s shares a key with probability (1-(1-s^rows_a)^bands_a) * (1-(1-s^rows_b)^bands_b).
Candidates are thinned by a sketch of the minima and verified exactly on the shingle sets.

Exact copies (equal shingle sets) become one class before any key is formed, so a group of copies costs one row however
large it is. A key that very many classes share (long boilerplate) would pair them all; the classes of such keys are
instead joined by rare shingles, which finds every pair alike that shares one. Those that share none keep the hot keys.
Nothing is capped or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.words import WordHashes, mixed, shingle_hashes, words
from quillspark.operators.dedup import crowded_pairs
from quillspark.storage import partitions_for, written


@dataclass(frozen=True)
class Banding:
    shingle: int = 5
    threshold: float = 0.8
    bands_a: int = 5
    rows_a: int = 2
    bands_b: int = 8
    rows_b: int = 3
    #: Two-bit lanes in the sketch; minima beyond those of the bands are added up to this number.
    lanes: int = 64
    #: Standard deviations below the expected agreement at the threshold at which a candidate is still verified.
    slack: float = 4.0
    #: Classes that share a key from which on the key counts as hot (estimated from the classes of one hash in `sampled`).
    hot: int = 400
    sampled: int = 16
    #: Hashes of keys (8 bytes each, so 16 MB in the join's table) up to which texts are picked by a broadcast semi-join; beyond, by
    #: a shuffled one.
    broadcast_ids: int = 1_000_000

    @property
    def minima(self) -> int:
        return max(self.lanes, self.bands_a * self.rows_a + self.bands_b * self.rows_b)

    @property
    def least_lanes(self) -> int:
        p = self.threshold + (1 - self.threshold) / 4
        return int(self.lanes * p - self.slack * (self.lanes * p * (1 - p)) ** 0.5)

    def recall(self, s: float) -> float:
        return (1 - (1 - s**self.rows_a) ** self.bands_a) * (1 - (1 - s**self.rows_b) ** self.bands_b)


def _distinct_shingles(text: str | None, size: int, known: WordHashes) -> np.ndarray:
    return np.unique(shingle_hashes(known.array(words(text)), size))


def _classes(flat: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set of distinct shingles, equal for equal sets: the class, and its proof. Classes whose sets
    differ in their proof have met by chance and are told apart afterwards (apart)."""
    proof = np.add.reduceat(mixed(flat ^ np.uint64(0x94D049BB133111EB)), starts)
    return mixed(np.add.reduceat(flat, starts) + mixed(np.bitwise_xor.reduceat(flat, starts))) ^ sizes.astype(np.uint64), mixed(proof)


def apart(df: DataFrame, met: DataFrame | None) -> DataFrame:
    """df (klass, proof, ...) without proof: of the classes in `met` (klass, low: the lowest proof) those of another proof get a
    class of their own, so that it takes 128 equal bits for two different sets to be one."""
    if met is None:
        return df.drop("proof")
    own = F.when(F.col("low") != F.col("proof"), F.xxhash64("klass", "proof")).otherwise(F.col("klass"))
    return df.join(met, "klass", "left").withColumn("klass", own).drop("proof", "low")


def _signatures(how: Banding, key_type: pa.DataType):
    """Of each text: class (hash of the shingle set), number of shingles, band hashes, sketch."""
    multipliers = mixed(np.arange(1, how.minima + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            sets = [_distinct_shingles(t, how.shingle, known) for t in texts]
            kept = [k for k, s in enumerate(sets) if len(s)]
            if not kept:
                continue
            flat = np.concatenate([sets[k] for k in kept])
            sizes = np.array([len(sets[k]) for k in kept])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            klass, proof = _classes(flat, sizes, starts)
            minima = np.empty((how.minima, len(kept)), dtype=np.uint32)
            for k, m in enumerate(multipliers):
                minima[k] = np.minimum.reduceat(((flat * m) >> np.uint64(32)).astype(np.uint32), starts)
            bands, at = [], 0
            for count, rows in ((how.bands_a, how.rows_a), (how.bands_b, how.rows_b)):
                for _ in range(count):
                    h = np.full(len(kept), at + 1, dtype=np.uint64)
                    for r in range(rows):
                        h = mixed(h + minima[at + r].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    bands.append(h.view(np.int64))
                    at += rows
            lanes = mixed(minima[: how.lanes].astype(np.uint64)) & np.uint64(3)
            sketch = []
            for w in range(0, how.lanes, 32):
                word = np.zeros(len(kept), dtype=np.uint64)
                for k, lane in enumerate(lanes[w : w + 32]):
                    word |= lane << np.uint64(2 * k)
                sketch.append(word.view(np.int64))
            lists = lambda columns: pa.ListArray.from_arrays(pa.array(np.arange(0, len(kept) * len(columns) + 1, len(columns)), pa.int32()), pa.array(np.stack(columns, axis=1).ravel()))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(kept)).cast(key_type), pa.array(klass.view(np.int64)), pa.array(proof.view(np.int64)), pa.array(sizes.astype(np.int32)), lists(bands), lists(sketch)], names=["key", "klass", "proof", "n", "bands", "sketch"])

    return run


def _shingle_rows(size: int, key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sets = [_distinct_shingles(t, size, known) for t in batch.column(1).to_pylist()]
            kept = [k for k, s in enumerate(sets) if len(s)]
            if not kept:
                continue
            flat, sizes = np.concatenate([sets[k] for k in kept]), np.array([len(sets[k]) for k in kept])
            ends = np.cumsum(sizes)
            klass, proof = _classes(flat, sizes, np.concatenate([[0], ends[:-1]]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)).cast(key_type), pa.array(klass.view(np.int64)), pa.array(proof.view(np.int64)), lists], names=["key", "klass", "proof", "shingles"])

    return run


@dataclass(frozen=True)
class NearDuplicates:
    """members: key, klass. links: klass_a < klass_b, jaccard; one row for each pair of different classes alike."""

    members: DataFrame
    links: DataFrame


def near_duplicates(df: DataFrame, key: str, text: str, how: Banding = Banding()) -> NearDuplicates:
    """Texts of `df` whose sets of `how.shingle` consecutive words have a Jaccard similarity of how.threshold or more.

    Null and empty texts, and texts of fewer words than a shingle, are in no class. Rows of a null key are left out.
    A key that occurs again with an equal text is one member; with another text it is a member of each class.
    Other columns of `df`, whatever their names, are not read. Very long texts are processed whole.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull())
    kind = rows.schema["key"].dataType
    sql_kind, arrow_kind = kind.simpleString(), pa.string() if kind.simpleString() == "string" else pa.int64()

    def shingled(chosen: DataFrame) -> DataFrame:
        """(klass, shingles) of chosen classes (klass, key), from their representatives' texts."""
        shown = written(chosen, "representatives")
        wanted = shown.select(F.xxhash64("key").alias("hash")).distinct()
        near = F.broadcast(wanted) if shown.count() <= how.broadcast_ids else wanted
        picked = rows.withColumn("hash", F.xxhash64("key")).join(near, "hash", "left_semi").select("key", "text")
        sets = apart(picked.mapInArrow(_shingle_rows(how.shingle, arrow_kind), f"key {sql_kind}, klass long, proof long, shingles array<long>"), met)
        return sets.join(shown, ["key", "klass"]).groupBy("klass").agg(F.first("shingles").alias("shingles"))

    signed = written(
        rows.where(F.col("text").isNotNull()).mapInArrow(_signatures(how, arrow_kind), f"key {sql_kind}, klass long, proof long, n int, bands array<long>, sketch array<long>"), "signatures"
    )
    met = written(signed.groupBy("klass").agg(F.min("proof").alias("low"), F.max("proof").alias("high")).where("low <> high").select("klass", "low"), "met")
    met = None if met.isEmpty() else met
    signed = apart(signed, met) if met is None else written(apart(signed, met), "signatures")
    classes = signed.groupBy("klass").agg(F.first(F.struct("n", "bands", "sketch")).alias("s")).select("klass", "s.*")
    a, b = F.slice("bands", 1, how.bands_a), F.slice("bands", how.bands_a + 1, how.bands_b)
    keys = classes.select("klass", F.explode(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.xxhash64(x, y))))).alias("bucket"))
    heavy = written(keys.where(F.pmod("klass", F.lit(how.sampled)) == 0).groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") * how.sampled >= how.hot).select("bucket"), "hot")
    hot = not heavy.isEmpty()
    cool = keys.join(heavy, "bucket", "left_anti") if hot else keys
    # as many partitions as the keys need at the session's advised size: adaptive execution joins partitions but splits only skewed ones
    cool = cool.repartition(partitions_for(rows.sparkSession, signed.count() * how.bands_a * how.bands_b * 24), "bucket")
    right = cool.select(F.col("klass").alias("klass_b"), "bucket")
    pairs = cool.withColumnRenamed("klass", "klass_a").join(right, "bucket").where("klass_a < klass_b").select("klass_a", "klass_b").distinct()
    representatives = signed.groupBy("klass").agg(F.min("key").alias("key"))
    if hot:
        crowded = written(keys.join(heavy, "bucket", "left_semi"), "crowded")
        chosen = representatives.join(crowded.select("klass").distinct(), "klass", "left_semi")
        pairs = pairs.unionByName(crowded_pairs(written(shingled(chosen), "crowded"), crowded, how.threshold, how.hot)).distinct()
    side = lambda c: signed.select(F.col("klass").alias(f"klass_{c}"), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")).dropDuplicates([f"klass_{c}"])
    differs = lambda w: F.expr(f"bit_count(((sketch_a[{w}] ^ sketch_b[{w}]) | shiftrightunsigned(sketch_a[{w}] ^ sketch_b[{w}], 1)) & 6148914691236517205L)")
    differing = sum((differs(w) for w in range(1, (how.lanes + 31) // 32)), differs(0))
    likely = written(
        pairs.join(side("a"), "klass_a").join(side("b"), "klass_b")
        .where(F.least("n_a", "n_b") >= F.lit(how.threshold - 1e-9) * F.greatest("n_a", "n_b"))
        .where(differing <= how.lanes - how.least_lanes).select("klass_a", "klass_b", "n_a", "n_b"), "candidates"
    )
    touched = likely.select(F.explode(F.array("klass_a", "klass_b")).alias("klass")).distinct()
    sets = written(shingled(representatives.join(touched, "klass", "left_semi")), "shingles")
    one = lambda c: sets.select(F.col("klass").alias(f"klass_{c}"), F.col("shingles").alias(f"shingles_{c}"))
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    links = (
        likely.join(one("a"), "klass_a").join(one("b"), "klass_b")
        .select("klass_a", "klass_b", (common / (F.size("shingles_a") + F.size("shingles_b") - common)).alias("jaccard"))
        .where(F.col("jaccard") >= how.threshold - 1e-12)
    )
    return NearDuplicates(signed.select("key", "klass").distinct(), links)


def found_pairs(result: NearDuplicates) -> DataFrame:
    """key_a < key_b for every two keys alike: those of linked classes, and those within one class."""
    a = result.members.select(F.col("key").alias("x"), F.col("klass").alias("klass_a"))
    b = result.members.select(F.col("key").alias("y"), F.col("klass").alias("klass_b"))
    across = result.links.join(a, "klass_a").join(b, "klass_b").select("x", "y")
    shared = result.members.groupBy("klass").count().where("count > 1").select("klass")
    within = result.members.join(shared, "klass", "left_semi")
    same = within.select("klass", F.col("key").alias("x")).join(within.select("klass", F.col("key").alias("y")), "klass").where("x < y").select("x", "y")
    return across.where("x <> y").unionByName(same).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()
