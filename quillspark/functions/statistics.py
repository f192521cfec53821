"""Paired comparison of runs: resampling, randomisation, effect sizes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.storage import spread, written


def norm_ppf(p: float) -> float:
    """The quantile of the standard normal distribution, by bisection on erfc: exact to the last bits, no table."""
    if not 0 < p < 1:
        raise ValueError("a probability lies between 0 and 1")
    low, high = -40.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2
        if 0.5 * math.erfc(-middle / math.sqrt(2)) < p:
            low = middle
        else:
            high = middle
    return round((low + high) / 2, 12) + 0.0  # never -0.0


def min_detectable_effect(sd: Column, n: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    return F.lit(norm_ppf(1 - alpha / 2) + norm_ppf(power)) * sd / F.sqrt(n)


def required_n(sd: Column, effect: float, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Pairs needed to see `effect`; at least 1."""
    z = norm_ppf(1 - alpha / 2) + norm_ppf(power)
    return F.greatest(F.lit(1), F.ceil(F.pow(F.lit(z) * sd / F.lit(effect), F.lit(2)))).cast("bigint")


def checked(a: list[float], b: list[float]) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    if x.ndim != 1 or x.shape != y.shape or not len(x) or np.isnan(x).any() or np.isnan(y).any():
        raise ValueError("need two lists of numbers of one length, not empty and without NaN")
    return x, y


def bootstrap(a: list[float], b: list[float], times: int = 10_000, seed: int = 0, ci: float = 0.95) -> dict[str, float]:
    """Mean of b - a, its percentile interval and the share of resamples above 0."""
    x, y = checked(a, b)
    d = y - x
    means = d[np.random.default_rng(seed).integers(0, len(d), (times, len(d)))].mean(axis=1)
    low, high = np.quantile(means, [(1 - ci) / 2, (1 + ci) / 2])
    return {"delta": float(d.mean()), "low": float(low), "high": float(high), "above": float((means > 0).mean())}


def randomization(a: list[float], b: list[float], times: int = 10_000, seed: int = 0) -> float:
    """Two-sided p of the mean difference under random signs: (as extreme + 1) / (times + 1)."""
    x, y = checked(a, b)
    d = y - x
    signs = np.random.default_rng(seed).integers(0, 2, (times, len(d))) * 2 - 1
    return float(((np.abs((signs * d).mean(axis=1)) >= abs(d.mean()) - 1e-15).sum() + 1) / (times + 1))


def numbered(pairs: DataFrame) -> DataFrame:
    """pairs with d = b - a and i, its place from 0 in order of query_id; n is the number of pairs."""
    from quillspark.operators import numbering

    rows = numbering.numbered(pairs.select("query_id", (F.col("b") - F.col("a")).alias("d")), "query_id")
    return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))  # one row beside each pair


#: Pairs up to which every task has all differences and draws by arrays; beyond, draws are rows and joined to them by a shuffle.
_NEAR = 1_000_000
#: Draws worked on at a time.
_SLAB = 16_384


#: Prime and multipliers of the draws.
_PRIME, _STEPS = 2147483647, (1103515245, 48271, 1078318381, 69621, 2027812808, 16807)


def draw(t: Column, i: Column) -> Column:
    """A number below 2^31 for each (t, place): steps of multiplying modulo a prime and folding, which other engines can repeat."""
    x = (t.cast("bigint") + 1) * _STEPS[0] % _PRIME
    for k, step in enumerate(_STEPS[1:]):
        x = (x.bitwiseXOR(F.shiftright(x, 14)) * step + ((i.cast("bigint") + 1) * _STEPS[0] if not k else 0)) % _PRIME
    return x


def draw_sql(t: str, i: str) -> str:
    x = f"((CAST({t} AS BIGINT) + 1) * {_STEPS[0]} % {_PRIME})"
    for k, step in enumerate(_STEPS[1:]):
        x = f"((xor({x}, {x} >> 14) * {step}{f' + (CAST({i} AS BIGINT) + 1) * {_STEPS[0]}' if not k else ''}) % {_PRIME})"
    return x


def draws(t: np.ndarray, i: np.ndarray) -> np.ndarray:
    """[t, place]: what draw gives, by arrays. A remainder by the prime is the sum of the low 31 bits and the rest, less the prime where it reaches it."""
    prime, fold, bits = (np.uint64(k) for k in (_PRIME, 31, 14))
    first, places = (x.astype(np.uint64) * np.uint64(_STEPS[0]) % prime for x in (t + 1, (i + 1) % _PRIME))
    x = np.add(((first ^ first >> bits) * np.uint64(_STEPS[1]))[:, None], places)
    spare = np.empty_like(x)
    for k, step in enumerate(_STEPS[1:]):
        if k:
            np.right_shift(x, bits, out=spare)
            np.bitwise_xor(x, spare, out=x)
            np.multiply(x, np.uint64(step), out=x)
        np.bitwise_and(x, prime, out=spare)
        np.right_shift(x, fold, out=x)
        np.add(x, spare, out=x)
        np.subtract(x, prime, out=spare)  # past zero this is large
        np.minimum(x, spare, out=x)
    return x


def picked(x: np.ndarray, d: np.ndarray, places: slice) -> np.ndarray:
    """Sums of the differences that draws x pick with replacement."""
    low, n = x.astype(np.uint32), np.uint32(len(d))
    return d[low - low // n * n].sum(axis=1)


def flipped(x: np.ndarray, d: np.ndarray, places: slice) -> np.ndarray:
    """Sums of the differences, those of odd draws with the other sign."""
    return d[places].sum() - 2 * np.einsum("ti,i->t", (x & np.uint64(1)).astype(float), d[places])


def _means(rows: DataFrame, times: int, sums: Callable) -> DataFrame:
    """(t, mean) over `times` sets of draws, from rows (i, d) of which every task has all."""
    spark = rows.sparkSession
    held = rows.select("i", "d").toArrow()
    d = np.empty(held.num_rows)
    d[held.column("i").to_numpy()] = held.column("d").to_numpy()
    shared = spark.sparkContext.broadcast(d)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        for b in batches:
            t, mean = b.column("t").to_numpy(), np.zeros(b.num_rows)
            step = max(1, _SLAB // len(d))
            for first in range(0, len(t), step):
                for at in range(0, len(d), _SLAB):
                    places = np.arange(at, min(at + _SLAB, len(d)))
                    mean[first : first + step] += sums(draws(t[first : first + step], places), d, slice(at, at + _SLAB))
            yield pa.RecordBatch.from_arrays([b.column("t"), pa.array(mean / len(d))], ["t", "mean"])

    return spark.range(0, times, 1, 4 * spark.sparkContext.defaultParallelism).withColumnRenamed("id", "t").mapInArrow(drawn, "t long, mean double")


def _repeated(rows: DataFrame, times: int) -> DataFrame:
    """rows `times` over, with t from 0 and the draw of (t, i)."""
    return spread(rows).select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("t")).withColumn("draw", draw(F.col("t"), F.col("i")))


def resampled_means(pairs: DataFrame, times: int) -> DataFrame:
    """(t, mean) of `times` resamples with replacement, drawn by a hash of (t, place): the same on every cluster."""
    rows = written(numbered(pairs), "numbered")
    if 0 < rows.count() <= _NEAR:
        return _means(rows, times, picked)
    picks = _repeated(rows.select("i", "n"), times).select("t", F.pmod("draw", "n").alias("i"))
    return picks.join(rows.select("i", "d"), "i").groupBy("t").agg(F.avg("d").alias("mean"))


def flipped_means(pairs: DataFrame, times: int) -> DataFrame:
    """(t, mean) of `times` random choices of signs, drawn likewise."""
    rows = written(numbered(pairs), "numbered")
    if 0 < rows.count() <= _NEAR:
        return _means(rows, times, flipped)
    sign = F.when(F.pmod("draw", F.lit(2)) == 0, 1).otherwise(-1)
    return _repeated(rows.select("i", "d"), times).select("t", (F.col("d") * sign).alias("d")).groupBy("t").agg(F.avg("d").alias("mean"))


def bootstrap_table(pairs: DataFrame, times: int = 10_000, ci: float = 0.95) -> DataFrame:
    means = resampled_means(pairs, times).agg(F.percentile("mean", (1 - ci) / 2).alias("low"), F.percentile("mean", (1 + ci) / 2).alias("high"), F.avg((F.col("mean") > 0).cast("double")).alias("above"))
    return pairs.agg(F.count("*").alias("n"), F.avg(F.col("b") - F.col("a")).alias("delta")).crossJoin(F.broadcast(means))  # one row each


def randomization_table(pairs: DataFrame, times: int = 10_000) -> DataFrame:
    seen = pairs.agg(F.avg(F.col("b") - F.col("a")).alias("delta"))
    return flipped_means(pairs, times).crossJoin(F.broadcast(seen)).agg(F.max("delta").alias("delta"), ((F.count_if(F.abs("mean") >= F.abs("delta") - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))  # one row beside each mean
