"""Aggregates over cells: constant blocks, normalisation, error metrics, block statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = ("v", "s", "k")
TINY = 1e-12


def constant_blocks(samples: DataFrame, keys: Sequence[str] = SAMPLE) -> DataFrame:
    """Keys and value of blocks whose cells are all equal. A block with NaN is never constant, though SQL holds NaN equal to NaN."""
    found = samples.groupBy(*keys).agg(F.min("x").alias("value"), F.max("x").alias("__max"), F.count("x").alias("__n"), F.count("*").alias("__all"))
    return found.filter((F.col("value") == F.col("__max")) & ~F.isnan("__max") & (F.col("__n") == F.col("__all"))).select(*keys, "value")


def offsets(cells: DataFrame, keys: Sequence[str], mode: str) -> DataFrame:
    """Keys, offset and scale of each group.

    mean_range: mean and range; min_max: centre and half range; std: mean and population deviation. A range below
    TINY counts as TINY. NaN spreads to its group.
    """
    spread = F.max("x") - F.min("x")
    offset, scale = {"mean_range": (F.avg("x"), spread), "min_max": ((F.max("x") + F.min("x")) / 2, spread / 2), "std": (F.avg("x"), F.stddev_pop("x"))}[mode]
    return cells.groupBy(*keys).agg(offset.alias("offset"), F.greatest(scale, F.lit(TINY)).alias("scale"))


def normalize(cells: DataFrame, keys: Sequence[str], mode: str = "mean_range") -> DataFrame:
    """Adds offset and scale of each group and y = (x - offset) / scale: an aggregate joined back, small beside the cells."""
    found = offsets(cells, keys, mode)
    return cells.join(found, list(keys)).withColumn("y", (F.col("x") - F.col("offset")) / F.col("scale"))


def normalize_with(cells: DataFrame, params: DataFrame, keys: Sequence[str]) -> DataFrame:
    """normalize with given offsets and scales; a scale of 0 is an error."""
    sure = F.when(F.col("scale") == 0, F.raise_error(F.lit("scale is zero"))).otherwise(F.col("scale"))
    return cells.join(params.select(*keys, "offset", "scale"), list(keys)).withColumn("y", (F.col("x") - F.col("offset")) / sure)


def denormalize(rows: DataFrame) -> DataFrame:
    """x = y * scale + offset."""
    return rows.withColumn("x", F.col("y") * F.col("scale") + F.col("offset"))


def latent_range(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """y in [-1, 1]: scale (max - min + 1e-8) / 2, offset min + scale."""
    found = cells.groupBy(*keys).agg(((F.max("x") - F.min("x") + 1e-8) / 2).alias("scale"), F.min("x").alias("__min"))
    return cells.join(found, list(keys)).withColumn("offset", F.col("__min") + F.col("scale")).drop("__min").withColumn("y", (F.col("x") - F.col("offset")) / F.col("scale"))


def global_stats(cells: DataFrame) -> DataFrame:
    """One row: n, max, min, mean, range."""
    return cells.agg(F.count("x").alias("n"), F.max("x").alias("max"), F.min("x").alias("min"), F.avg("x").alias("mean"), (F.max("x") - F.min("x")).alias("range"))


def norm2(vec: Column) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))


def residual_norms(pairs: DataFrame, keys: Sequence[str], bound: float) -> DataFrame:
    """Keys, norm of x - y and whether it exceeds bound."""
    found = pairs.groupBy(*keys).agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("y"), 2))).alias("norm"))
    return found.withColumn("violates", F.col("norm") > bound)


def errors(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """mse, rmse, nrmse and psnr of y against x: nrmse is over the range of x, psnr infinite without error."""
    d2 = F.pow(F.col("x") - F.col("y"), 2)
    found = pairs.groupBy(*keys).agg(F.avg(d2).alias("mse"), (F.max("x") - F.min("x")).alias("range"))
    psnr = F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(20 * F.log10("range") - 10 * F.log10("mse"))
    return found.select(*keys, "mse", F.sqrt("mse").alias("rmse"), (F.sqrt("mse") / F.col("range")).alias("nrmse"), psnr.alias("psnr"))


def step_errors(pairs: DataFrame, steps: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Squared error of each block for each candidate step: keys, step, sse, and zero_sse without correction.

    A step is one more column of each cell, aggregated within the task before the shuffle.
    """
    r = F.col("x") - F.col("y")
    one = lambda st: F.struct(F.lit(float(st)).alias("step"), F.pow(r - F.rint(r / st) * st, 2).alias("e"))
    spread = pairs.select(*keys, F.pow(r, 2).alias("z"), F.explode(F.array(*map(one, steps))).alias("c"))
    return spread.groupBy(*keys, F.col("c.step").alias("step")).agg(F.sum("c.e").alias("sse"), F.sum("z").alias("zero_sse"), F.count("*").alias("n"))


def largest_step(errors_: DataFrame, keys: Sequence[str], target: float) -> DataFrame:
    """The largest candidate step whose error fits target**2 * n; 1 where no correction is needed, null where none fits."""
    fits = F.max(F.when(F.col("sse") <= target * target * F.col("n"), F.col("step")))
    return errors_.groupBy(*keys).agg(F.when(F.max("zero_sse") <= target * target * F.max("n"), F.lit(1.0)).otherwise(fits).alias("step"))


def compression_ratio(streams: DataFrame, raw_bytes: Column, meta_bytes: Column) -> DataFrame:
    """Bytes and ratios with and without the header of a table with a column payload."""
    total = streams.agg(F.sum(F.length("payload")).alias("payload_bytes"))
    both = total.select("payload_bytes", raw_bytes.cast("long").alias("raw_bytes"), meta_bytes.cast("long").alias("meta_bytes"))
    return both.select("*", (F.col("raw_bytes") / F.col("payload_bytes")).alias("cr"), (F.col("raw_bytes") / (F.col("payload_bytes") + F.col("meta_bytes"))).alias("cr_with_meta"))


def context_scales(codes: DataFrame, order: Sequence[str], block: Sequence[str]) -> DataFrame:
    """Scales of contexts: mean |q| and mean |q - previous q|, one at least."""
    w = Window.partitionBy(*block).orderBy(*order)
    d = codes.withColumn("d", F.col("q") - F.lag("q", 1, 0).over(w))
    return d.agg(F.greatest(F.lit(1.0), F.avg(F.abs("q"))).alias("q_scale"), F.greatest(F.lit(1.0), F.avg(F.abs("d"))).alias("d_scale"))


def block_stats(deltas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least and largest difference, sum of sizes and number of zeros of each block."""
    return deltas.groupBy(*keys).agg(F.min("d").alias("d_min"), F.max("d").alias("d_max"), F.sum(F.abs("d")).alias("d_abs"), F.count_if(F.col("d") == 0).alias("zeros"))


def rate_bits(symbols: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bits of each group under the empirical probabilities of its channel: columns channel, symbol."""
    counts = symbols.groupBy(*keys, "channel", "symbol").count()
    model = symbols.groupBy("channel", "symbol").agg(F.count("*").alias("__n"))
    total = symbols.groupBy("channel").agg(F.count("*").alias("__all"))
    p = model.join(total, "channel").select("channel", "symbol", (-F.log2(F.col("__n") / F.col("__all"))).alias("__bits"))
    return counts.join(p, ["channel", "symbol"]).groupBy(*keys).agg(F.sum(F.col("count") * F.col("__bits")).alias("bits"), F.sum("count").alias("n"))


def running_stats(blocks: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds run_min, run_max, run_abs, run_zeros and run_bytes, over the blocks up to each one, to rows of block_stats with payload bytes."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    of = {"run_min": F.min("d_min"), "run_max": F.max("d_max"), "run_abs": F.sum("d_abs"), "run_zeros": F.sum("zeros"), "run_bytes": F.sum("bytes")}
    return blocks.select("*", *[f.over(w).alias(c) for c, f in of.items()])


def moving_average(rows: DataFrame, keys: Sequence[str], order: str, beta: float) -> DataFrame:
    """keys and the exponential moving average of x in order of a column: average * beta + (1 - beta) * x, beginning with the first."""
    series = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "x"))), lambda e: e["x"]).alias("__xs"))
    later = F.slice("__xs", 2, F.size("__xs"))
    return series.select(*keys, F.aggregate(later, F.get("__xs", F.lit(0)).cast("double"), lambda a, x: a * beta + (1 - beta) * x).alias("average"))


def bound_check(pairs: DataFrame, keys: Sequence[str], patch: str, eps: float, n: int) -> DataFrame:
    """keys, patches, violating and nrmse: how many patches of n cells are further than eps * sqrt(n) * range from what
    predicts them, and the NRMSE, both over the range of all x, which is a scalar of the plan."""
    span = pairs.agg((F.max("x") - F.min("x")).alias("r"))
    r = span.scalar()
    per = pairs.groupBy(*keys, patch).agg(F.sum(F.pow(F.col("x") - F.col("y"), 2)).alias("e"))
    return per.groupBy(*keys).agg(F.count("*").alias("patches"), F.count_if(F.sqrt("e") > eps * n**0.5 * r).alias("violating"), (F.sqrt(F.sum("e") / (n * F.count("*"))) / F.max(r)).alias("nrmse"))


def member_bytes(sizes: DataFrame, keys: Sequence[str], members: Mapping[str, Column]) -> DataFrame:
    """Rows (keys, member, bytes): the bytes of every member of an archive's blocks, added up."""
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("member"), c.cast("long").alias("bytes")) for m, c in members.items()]))
    return sizes.select(*keys, one.alias("__m")).groupBy(*keys, F.col("__m.member").alias("member")).agg(F.sum("__m.bytes").alias("bytes"))
