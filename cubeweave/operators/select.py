"""Selection of transform coefficients: ranking, minimal prefixes, sparse encodings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeweave.functions.codes import byte_of, quantize


def ranked(coefficients: DataFrame, bin_: float) -> DataFrame:
    """(pid, k, c) with q, p = c**2 and rank: largest first, ties by k. Windows are over the terms of one vector."""
    w = Window.partitionBy("pid").orderBy(F.desc("p"), "k")
    return coefficients.withColumn("p", F.col("c") * F.col("c")).withColumn("q", quantize(F.col("c"), bin_)).withColumn("rank", F.row_number().over(w))


def minimal_prefix(coefficients: DataFrame, bin_: float, bound: float) -> DataFrame:
    """The coefficients kept of each vector: the shortest prefix, by size, that leaves an error up to bound.

    A coefficient is kept while the error before it is over the bound; those quantised to 0 are dropped then.
    """
    rows = ranked(coefficients, bin_)
    gain = F.col("p") - F.pow(F.col("c") - F.col("q") * bin_, 2)
    w = Window.partitionBy("pid").orderBy("rank")
    whole = F.sum("p").over(Window.partitionBy("pid"))
    before = whole - F.coalesce(F.sum(gain).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("before", before).filter((F.col("before") > bound * bound) & (F.col("q") != 0)).select("pid", "k", "c", "q", "rank")


def dictionary(kept: DataFrame) -> DataFrame:
    """(q, code): distinct values in order, numbered from 0. Distinct quantised values are few: they are bounded by range / bin."""
    values = kept.select("q").distinct()
    return values.select("q", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("q")) - 1).cast("long").alias("code"))


def with_codes(kept: DataFrame) -> DataFrame:
    """Adds the dictionary code of q."""
    return kept.join(dictionary(kept), "q")


def prefix_lengths(flags: DataFrame, n: int) -> DataFrame:
    """(pid, last, bits) of a table (pid, k) of set flags among pids with n places: up to the last set flag.

    A vector without flags isn't in the result; its length counts as -1.
    """
    found = flags.groupBy("pid").agg(F.max("k").alias("last"), F.array_sort(F.collect_set("k")).alias("__set"))
    bits = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long")), lambda i: F.array_contains("__set", i).cast("int"))
    return found.select("pid", F.col("last").cast("long"), bits.alias("bits"))


def flags_from_prefix(rows: DataFrame) -> DataFrame:
    """The inverse of prefix_lengths: (pid, k) of set flags."""
    return rows.select("pid", F.posexplode("bits").alias("k", "bit")).filter("bit = 1").select("pid", F.col("k").cast("long"))


def pack(bits: DataFrame, keys: Sequence[str], *, msb_first: bool = True) -> DataFrame:
    """(keys, byte_no, byte) of rows (keys, i, bit); the last byte is filled with zeros."""
    return bits.groupBy(*keys, F.floor(F.col("i") / 8).cast("long").alias("byte_no")).agg(F.sum(byte_of(F.col("bit"), F.col("i"), msb_first)).alias("byte"))


def unpack(packed: DataFrame, keys: Sequence[str], *, msb_first: bool = True) -> DataFrame:
    """The inverse of pack, with the filling bits."""
    place = F.explode(F.sequence(F.lit(0), F.lit(7)))
    e = packed.select(*keys, "byte_no", "byte", place.alias("j"))
    shift = 7 - F.col("j") if msb_first else F.col("j")
    return e.select(*keys, (F.col("byte_no") * 8 + F.col("j")).alias("i"), F.getbit("byte", shift).cast("long").alias("bit"))


def scatter_codes(all_ids: DataFrame, kept: DataFrame, n: int) -> DataFrame:
    """Dense (pid, k, value): the kept values, and 0 elsewhere."""
    grid = all_ids.select("pid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("k"))
    return grid.join(kept.select("pid", F.col("k").cast("long"), F.col("q").alias("value")), ["pid", "k"], "left").fillna({"value": 0})


def cosine_schedule(steps: int, s: float = 0.008) -> list[float]:
    """Noise variances of a cosine schedule."""
    a = [math.cos((t / steps + s) / (1 + s) * math.pi / 2) ** 2 for t in range(steps + 1)]
    return [min(max(1 - a[t + 1] / a[t], 0.0), 0.9999) for t in range(steps)]


def linear_schedule(steps: int) -> list[float]:
    low, high = 1e-4 * 1000 / steps, 0.02 * 1000 / steps
    return [low + (high - low) * t / max(1, steps - 1) for t in range(steps)]


def cumulative(betas: DataFrame) -> DataFrame:
    """(t, beta) with abar, the product of 1 - beta up to t; a schedule is a short table."""
    w = Window.partitionBy(F.lit(0)).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return betas.withColumn("abar", F.exp(F.sum(F.log(1 - F.col("beta"))).over(w)))
