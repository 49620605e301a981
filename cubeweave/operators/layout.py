"""Shape, slicing and re-indexing of cells: projections, filters and small explodes, no shuffle unless stated."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeweave.functions.index import div, linear, pad_sides, reflect, tail_pad, unravel
from cubeweave.ranking import rank_in_groups

AXES = ("v", "s", "t", "h", "w")


def cells_from_vectors(df: DataFrame, vec: str, width: int, *, v: Column, t: Column, s: Column | None = None) -> DataFrame:
    """One row for each element of a row-major patch: element k goes to h = k div width, w = k mod width."""
    base = df.select(v.cast("long").alias("v"), (s if s is not None else F.lit(0)).cast("long").alias("s"), t.cast("long").alias("t"), F.posexplode(vec).alias("k", "x"))
    return base.select("v", "s", "t", div(F.col("k"), width).alias("h"), (F.col("k") % width).cast("long").alias("w"), F.col("x").cast("double").alias("x"))


def vectors_from_cells(cells: DataFrame, width: int, keys: Sequence[str] = ("v", "s", "t")) -> DataFrame:
    """The inverse: one row a key with column vec. A shuffle on the keys, unless the cells lie by them."""
    k = F.col("h") * width + F.col("w")
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), "x"))), lambda e: e["x"]).alias("vec"))


def patches(cells: DataFrame, height: int, width: int) -> DataFrame:
    """Patch vectors (v, s, t, pw, ph, vec): row-major patches of height x width."""
    k = (F.col("h") % height) * width + F.col("w") % width
    return cells.groupBy("v", "s", "t", div(F.col("w"), width).alias("pw"), div(F.col("h"), height).alias("ph")).agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), "x"))), lambda e: e["x"]).alias("vec"))


def unpatch(rows: DataFrame, height: int, width: int) -> DataFrame:
    """Cells of patch vectors."""
    e = rows.select("v", "s", "t", "pw", "ph", F.posexplode("vec").alias("k", "x"))
    return e.select("v", "s", "t", (F.col("ph") * height + div(F.col("k"), width)).alias("h"), (F.col("pw") * width + F.col("k") % width).cast("long").alias("w"), "x")


def to_5d(flat: DataFrame, n: int, height: int, width: int) -> DataFrame:
    """Cells (0, 0, t, h, w) of rows (i, x), zero-padded to whole frames of height x width."""
    frame = height * width
    pads = flat.sparkSession.range(n, -(-n // frame) * frame).select(F.col("id").alias("i"), F.lit(0.0).alias("x"))
    t, h, w = unravel(F.col("i"), [1 << 40, height, width])
    return flat.select("i", "x").unionAll(pads).select(F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("s"), t.alias("t"), h.alias("h"), w.alias("w"), "x")


def restore_flat(cells: DataFrame, n: int, height: int, width: int) -> DataFrame:
    """The inverse of to_5d: rows (i, x) without the padding."""
    i = linear([(F.col("t"), 1), (F.col("h"), height), (F.col("w"), width)])
    return cells.select(i.alias("i"), "x").filter(F.col("i") < n)


def fits_5d(shape: Sequence[int], force: bool = False) -> bool:
    """Whether an array of this shape needs no padding: rank 3 to 5 and at least 8 x 2 x 2 at its end."""
    return not force and 3 <= len(shape) <= 5 and shape[-3] >= 8 and shape[-2] >= 2 and shape[-1] >= 2


def slice_cells(cells: DataFrame, *, variable: int | None = None, section: tuple[int, int] | None = None, frames: tuple[int, int] | None = None) -> DataFrame:
    """One variable and half-open ranges of sections and frames, counted from 0 again. Predicates reach the scan."""
    for axis, span in (("v", None if variable is None else (variable, variable + 1)), ("s", section), ("t", frames)):
        if span:
            cells = cells.filter((F.col(axis) >= span[0]) & (F.col(axis) < span[1])).withColumn(axis, F.col(axis) - span[0])
    return cells


def center_crop(cells: DataFrame, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """The middle to[0] x to[1] of frames of the given size."""
    for axis, have, want in (("h", size[0], to[0]), ("w", size[1], to[1])):
        low = (have - want) // 2
        cells = cells.filter((F.col(axis) >= low) & (F.col(axis) < low + want)).withColumn(axis, F.col(axis) - low)
    return cells


def tail_reflect(cells: DataFrame, window: int, overlap: int = 0) -> DataFrame:
    """Append mirrored frames, the last one first, until windows fill the time axis of each (v, s).

    An axis shorter than its padding is mirrored again and again, with period 2T.
    """
    sizes = cells.groupBy("v", "s").agg((F.max("t") + 1).alias("__frames"))
    step = window - overlap
    samples = F.greatest(F.ceil((F.col("__frames") - window) / step), F.lit(0)) + 1
    pads = sizes.select("v", "s", "__frames", ((samples - 1) * step + window).alias("end"))
    joined = cells.join(pads, ["v", "s"])
    # frame t also stands at 2kT - 1 - t and 2kT + t
    last = F.col("end") - 1
    turn = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("end") / (2 * F.col("__frames"))))
    at = F.filter(F.flatten(F.transform(turn, lambda k: F.array(2 * k * F.col("__frames") + F.col("t"), 2 * k * F.col("__frames") - 1 - F.col("t")))), lambda p: (p >= 0) & (p <= last))
    return joined.select("v", "s", F.explode(at).alias("t"), "h", "w", "x")


def tail_trim(cells: DataFrame, frames: int | Column) -> DataFrame:
    """Only frames before the given one."""
    return cells.filter(F.col("t") < frames)


def pad_zero(cells: DataFrame, size: tuple[int, int], multiple: tuple[int, int]) -> DataFrame:
    """Frames padded with zeros, centred, to multiples of a size; the pad cells are made for each frame, not joined."""
    (top, down), (left, right) = pad_sides(size[0], multiple[0]), pad_sides(size[1], multiple[1])
    moved = cells.withColumn("h", F.col("h") + top).withColumn("w", F.col("w") + left)
    height, width = size[0] + top + down, size[1] + left + right
    outside = [(h, w) for h in range(height) for w in range(width) if not (top <= h < top + size[0] and left <= w < left + size[1])]
    if not outside:
        return moved
    grid = F.explode(F.array(*[F.struct(F.lit(h).cast("long").alias("h"), F.lit(w).cast("long").alias("w")) for h, w in outside]))
    pads = cells.select("v", "s", "t").distinct().select("v", "s", "t", grid.alias("p")).select("v", "s", "t", "p.h", "p.w", F.lit(0.0).alias("x"))
    return moved.select(*AXES, "x").unionByName(pads)


def unpad(cells: DataFrame, size: tuple[int, int], multiple: tuple[int, int]) -> DataFrame:
    """Undo pad_zero, or the reflecting padding of block_split."""
    for axis, have, m in (("h", size[0], multiple[0]), ("w", size[1], multiple[1])):
        low = pad_sides(have, m)[0]
        cells = cells.filter((F.col(axis) >= low) & (F.col(axis) < low + have)).withColumn(axis, F.col(axis) - low)
    return cells


def _copies(axis: Column, size: int, block: int) -> Column:
    """All places on a padded axis at which a source index stands, as an array."""
    before, after = pad_sides(size, block)
    at = [axis + before]
    if before:
        at.append(F.when((axis >= 1) & (axis <= before), before - axis))
    if after:
        at.append(F.when((axis >= size - 1 - after) & (axis <= size - 2), 2 * (size - 1) - axis + before))
    return F.array_compact(F.array(*[a.cast("long") for a in at]))


def block_split(cells: DataFrame, size: tuple[int, int], block: tuple[int, int]) -> DataFrame:
    """Blocks of frames, after reflecting padding to multiples of the block: the grid is folded into s.

    Where the padding is as large as the axis, zeros are put around it first, as many as are needed.
    """
    size, cells = _widen(cells, size, block)
    rows = -(-size[0] // block[0])
    cols = -(-size[1] // block[1])
    spread = cells.select("v", "s", "t", F.explode(_copies(F.col("h"), size[0], block[0])).alias("h"), "w", "x").select("v", "s", "t", "h", F.explode(_copies(F.col("w"), size[1], block[1])).alias("w"), "x")
    folded = (F.col("s") * rows + div(F.col("h"), block[0])) * cols + div(F.col("w"), block[1])
    return spread.select("v", folded.alias("s"), "t", (F.col("h") % block[0]).alias("h"), (F.col("w") % block[1]).alias("w"), "x")


def widened(size: tuple[int, int], block: tuple[int, int]) -> tuple[int, int, int, int]:
    """(height, width, zeros above, zeros left) before reflecting padding."""
    pre = [max(max(pad_sides(n, b)) - n + 1, 0) for n, b in zip(size, block, strict=True)]
    return size[0] + 2 * pre[0], size[1] + 2 * pre[1], pre[0], pre[1]


def _widen(cells: DataFrame, size: tuple[int, int], block: tuple[int, int]) -> tuple[tuple[int, int], DataFrame]:
    height, width, top, left = widened(size, block)
    if (height, width) == tuple(size):
        return size, cells
    frames = cells.select("v", "s", "t").distinct()
    moved = cells.select("v", "s", "t", (F.col("h") + top).alias("h"), (F.col("w") + left).alias("w"), "x")
    grid = frames.select("v", "s", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long"))).alias("h")).select("v", "s", "t", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("w"))
    inside = F.col("h").between(top, top + size[0] - 1) & F.col("w").between(left, left + size[1] - 1)
    return (height, width), moved.unionByName(grid.filter(~inside).withColumn("x", F.lit(0.0)))


def block_merge(blocks: DataFrame, size: tuple[int, int], block: tuple[int, int]) -> DataFrame:
    """The inverse of block_split: frames without padding."""
    height, width, top0, left0 = widened(size, block)
    rows, cols = -(-height // block[0]), -(-width // block[1])
    (top, _), (left, _) = pad_sides(height, block[0]), pad_sides(width, block[1])
    bw, bh = F.col("s") % cols, div(F.col("s"), cols) % rows
    out = blocks.select("v", div(F.col("s"), rows * cols).alias("s"), "t", (bh * block[0] + F.col("h") - top - top0).alias("h"), (bw * block[1] + F.col("w") - left - left0).alias("w"), "x")
    return out.filter(F.col("h").between(0, size[0] - 1) & F.col("w").between(0, size[1] - 1))


def windows(cells: DataFrame, window: int, overlap: int = 0, *, samples: int | Column | None = None) -> DataFrame:
    """Samples of consecutive frames: a frame goes to every window [k step, k step + window) that holds it."""
    step = window - overlap
    low = F.greatest(F.ceil((F.col("t") - window + 1) / step), F.lit(0))
    high = F.floor(F.col("t") / step)
    ks = F.sequence(low.cast("long"), high.cast("long"))
    out = cells.select("*", F.explode(ks).alias("k")).withColumn("j", F.col("t") - F.col("k") * step)
    return out if samples is None else out.filter(F.col("k") < samples)


def scatter(samples: DataFrame, window: int, overlap: int = 0) -> DataFrame:
    """Frames of samples back in place; where windows overlap, the later one counts."""
    step = window - overlap
    cells = samples.withColumn("t", F.col("k") * step + F.col("j"))
    return cells.groupBy("v", "s", "t", "h", "w").agg(F.max_by("x", "k").alias("x"))


def renumber(ids: DataFrame, drop: DataFrame, key: str = "label") -> DataFrame:
    """(new, old): ids without the dropped ones, renumbered from 0 in order. Ranks come from a range partitioning."""
    kept = ids.join(drop.select(key).distinct(), key, "left_anti").withColumn("__all", F.lit(0))
    return rank_in_groups(kept, ["__all"], [key], name="new").select("new", F.col(key).alias("old"))


def fill_constants(cells: DataFrame, constants: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Constant blocks, one value a key, over the cells of those keys."""
    return cells.join(constants.select(*keys, F.col("value").alias("__value")), list(keys), "left").withColumn("x", F.coalesce("__value", "x")).drop("__value")


def fold_batch(cells: DataFrame, frames: int) -> DataFrame:
    """(b, t) to one axis b * frames + t, as 2-D networks take it."""
    return cells.select((F.col("v") * frames + F.col("t")).alias("b"), "h", "w", "x")


def unfold_batch(cells: DataFrame, frames: int) -> DataFrame:
    return cells.select(div(F.col("b"), frames).alias("v"), (F.col("b") % frames).alias("t"), "h", "w", "x")


def decimate(cells: DataFrame, step: int, axis: str = "w") -> DataFrame:
    """Every step-th place of an axis."""
    return cells.filter(F.col(axis) % step == 0).withColumn(axis, div(F.col(axis), step))


def drawn(seed: int, axis: int, n: int | Column, keys: Sequence[str] = ("v", "s", "t")) -> Column:
    """A number below n for each key and axis: a multiplicative hash that any SQL can compute, so draws can be repeated anywhere."""
    mixed = sum((F.pmod(F.col(k), F.lit(1000003)) * m for k, m in zip(keys, (73856093, 19349663, 83492791), strict=False)), F.lit(axis * 2971215073 + seed * 433494437))
    return F.pmod(F.pmod(mixed, F.lit(2147483647)), n if isinstance(n, Column) else F.lit(n)).cast("long")


def decimate_randomly(cells: DataFrame, steps: Sequence[int], seed: int, axis: str = "w") -> DataFrame:
    """decimate with a step drawn for each (v, s, t)."""
    step = F.element_at(F.array(*map(F.lit, steps)), (drawn(seed, 2, len(steps)) + 1).cast("int"))
    return cells.withColumn("__step", step).filter(F.col(axis) % F.col("__step") == 0).withColumn(axis, div(F.col(axis), F.col("__step"))).drop("__step")


def random_crop(cells: DataFrame, size: tuple[int, int], to: tuple[int, int], seed: int, pad: str = "zero") -> DataFrame:
    """A crop per (v, s, t) whose corner is drawn from its key and the seed; smaller frames are padded, centred, with zeros or by reflection."""
    if to[0] > size[0] or to[1] > size[1]:
        if pad == "zero":
            return pad_zero(cells, size, to)
        block = tuple(max(a, b) for a, b in zip(to, size, strict=True))
        return block_split(cells, size, block).select(*AXES, "x")
    y, x = drawn(seed, 0, size[0] - to[0] + 1), drawn(seed, 1, size[1] - to[1] + 1)
    moved = cells.withColumn("h", F.col("h") - y).withColumn("w", F.col("w") - x)
    return moved.filter(F.col("h").between(0, to[0] - 1) & F.col("w").between(0, to[1] - 1))


def weights(have: int, want: int, kind: str = "linear") -> list[tuple[int, int, float]]:
    """(source place, place, weight) for resampling an axis, with half-pixel centres and edges that repeat; cubic is Keys' kernel with a = -0.75."""
    def cubic(d: float, a: float = -0.75) -> float:
        d = abs(d)
        return (a + 2) * d**3 - (a + 3) * d**2 + 1 if d <= 1 else a * (d**3 - 5 * d**2 + 8 * d - 4) if d < 2 else 0.0

    found: dict[tuple[int, int], float] = {}
    for o in range(want):
        c = (o + 0.5) * have / want - 0.5
        c = min(max(c, 0.0), have - 1.0) if kind == "linear" else c
        i = math.floor(c)
        for k in (0, 1) if kind == "linear" else (-1, 0, 1, 2):
            wt = max(0.0, 1 - abs(c - i - k)) if kind == "linear" else cubic(c - i - k)
            at = (min(max(i + k, 0), have - 1), o)
            found[at] = found.get(at, 0.0) + wt
    return [(i, o, wt) for (i, o), wt in found.items() if wt]


def _from(axis: str):
    return lambda r: r["i"] == F.col(axis)


def resample(cells: DataFrame, size: Sequence[int], to: Sequence[int], kind: str = "linear") -> DataFrame:
    """Resampling of (h, w), or of (t, h, w) where three sizes are given: every source cell gives weighted parts to the
    places it reaches, which are added up within the task before the shuffle. kind: linear or cubic."""
    axes = ("t", "h", "w")[-len(size) :]
    spread = cells
    for axis, have, want in zip(axes, size, to, strict=True):
        parts = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(o).cast("long").alias("o"), F.lit(wt).alias("wt")) for i, o, wt in weights(have, want, kind)])
        spread = spread.withColumn("__p", F.explode(F.filter(parts, _from(axis)))).withColumn("x", F.col("x") * F.col("__p.wt")).withColumn(axis, F.col("__p.o")).drop("__p")
    return spread.groupBy(*AXES).agg(F.sum("x").alias("x"))


def coarse_means(cells: DataFrame, k: int) -> DataFrame:
    """Means over k x k cells of each frame."""
    return cells.groupBy("v", "s", "t", div(F.col("h"), k).alias("h"), div(F.col("w"), k).alias("w")).agg(F.avg("x").alias("x"))


def recover_input(blocks: DataFrame, params: DataFrame, size: tuple[int, int], block: tuple[int, int], frames: int | Column | None = None) -> DataFrame:
    """Frames as they were given, of normalised blocks (v, s, t, h, w, x): un-blocked, with offset and scale of each
    variable put back, and cut to so many frames if a number is given."""
    merged = block_merge(blocks, size, block).join(params.select("v", "offset", "scale"), "v")
    whole = merged.select("v", "s", "t", "h", "w", (F.col("x") * F.col("scale") + F.col("offset")).alias("x"))
    return whole if frames is None else tail_trim(whole, frames)


def slice_grid(shape: tuple[int, int, int], block: tuple[int, int, int]) -> list[tuple[int, ...]]:
    """(t0, t1, h0, h1, w0, w1) of all blocks, ragged at the edges."""
    spans = [[(a, min(a + b, n)) for a in range(0, n, b)] for n, b in zip(shape, block, strict=True)]
    return [(*t, *h, *w) for t in spans[0] for h in spans[1] for w in spans[2]]


def ragged_blocks(cells: DataFrame, block: tuple[int, int, int]) -> DataFrame:
    """Adds the block (bt, bh, bw) of each cell."""
    for axis, name, size in (("t", "bt", block[0]), ("h", "bh", block[1]), ("w", "bw", block[2])):
        cells = cells.withColumn(name, div(F.col(axis), size))
    return cells


def same_shape_runs(blocks: DataFrame, order: Sequence[str], shape: Sequence[str], most: int, partition: Sequence[str] = ()) -> DataFrame:
    """Adds run: consecutive blocks of one shape, at most so many (gaps and islands within a partition)."""
    w = Window.partitionBy(*partition).orderBy(*order)
    same = F.lit(True)
    for c in shape:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    marked = blocks.withColumn("__new", F.when(same & (F.row_number().over(w) > 1), 0).otherwise(1))
    islands = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*partition, "__island").orderBy(*order)
    return islands.withColumn("run", F.struct("__island", div(F.row_number().over(inner) - 1, most))).drop("__new", "__island")


def wavefront(cells: DataFrame) -> DataFrame:
    """Adds front = t + h + w: cells of one front depend only on fronts before it."""
    return cells.withColumn("front", F.col("t") + F.col("h") + F.col("w"))


def keyframes(cells: DataFrame, step: int = 3) -> DataFrame:
    return cells.filter(F.col("t") % step == 0)


def between_keyframes(cells: DataFrame, step: int = 3) -> DataFrame:
    return cells.filter(F.col("t") % step != 0)


def n_samples(sections: int, variables: int, frames: int, window: int, overlap: int = 0, constant: int = 0) -> int:
    """Samples of an array that are not constant."""
    return variables * sections * tail_pad(frames, window, overlap)[0] - constant


__all__ = [n for n, o in list(globals().items()) if callable(o) and getattr(o, "__module__", "") == __name__] + ["reflect"]
