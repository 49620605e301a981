"""K-d tree sharding: documents are split at distributed weighted medians until leaves reach a target size.

A node is split along its widest metadata dimension (the one whose range covers most of the whole range)
at the weighted median of (dimension, id): half the bytes go to either side, to within one row. Medians are
found by histograms that are refined together for up to NODES nodes, so a pass sends BUCKETS rows to the driver
whatever the input. Only the narrow metadata table is read by these passes. What the driver knows of up to SPAN nodes
stands in the plan as arrays that a row's node is an index of, more is joined; after every level but the last the table
is written anew with the nodes its rows have come to, so no pass repeats the splits of the levels above.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeweave.ranking import rank_in_groups, values
from cubeweave.scratch import drop_table, materialize, new_path

#: Histogram rows of one pass over the nodes that are searched together: what the driver gets at once.
BUCKETS, NODES = 1 << 14, 1 << 12
#: Nodes, and labels, of which the plan holds arrays.
SPAN = 256
#: Rows of a table of labels, or of splits, up to which it is broadcast (at about 60 bytes); beyond, it is joined by shuffle.
BROADCAST_ROWS = 1 << 17
DIMS = ("d_size", "d_lang", "d_source", "d_id")
LEAST = -(1 << 63)


def metadata(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One narrow row a document, written: shard (0, to be stored: as a constant it would turn joins on it into cross
    joins), rid (unique), doc_id, size, text_crc32 and the dimensions of the tree.

    Labels are coordinates by their dense rank among the distinct ones, in the order of their bytes; null is -1.
    Null ids are the least number.
    """
    size = F.coalesce(F.octet_length(F.col(text_col)).cast("long"), F.lit(0).cast("long")) + 1
    rows = materialize(documents.select(
        F.lit(0).cast("long").alias("shard"), F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), size.alias("size"),
        F.coalesce(F.crc32(F.encode(F.col(text_col), "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        size.alias("d_size"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("d_id"),
    ), "shard-rows")
    labels = F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).alias("label")) for c in ("lang", "source")]))
    known = rows.select("lang", "source").distinct().select(labels.alias("l")).select("l.dim", "l.label").filter("label IS NOT NULL").distinct()
    found = known.limit(SPAN + 1).collect()
    placed = rows
    if len(found) <= SPAN:
        for c in ("lang", "source"):
            own = sorted((r["label"] for r in found if r["dim"] == c), key=lambda x: x.encode("utf-8", "surrogatepass"))
            placed = placed.withColumn(f"d_{c}", F.coalesce(F.array_position(F.array(*map(F.lit, own)).cast("array<string>"), F.col(c)) - 1, F.lit(-1).cast("long")))
        return placed.select("shard", "rid", "doc_id", "size", "text_crc32", *DIMS)
    known = materialize(rank_in_groups(known, ["dim"], ["label"], name="place"), "shard-labels")
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    for c in ("lang", "source"):
        own = known.filter(F.col("dim") == c).select(F.col("label").alias(c), F.col("place").alias(f"d_{c}"))
        placed = placed.join(F.broadcast(own) if small else own, c, "left").withColumn(f"d_{c}", F.coalesce(f"d_{c}", F.lit(-1).cast("long")))
    out = materialize(placed.select("shard", "rid", "doc_id", "size", "text_crc32", *DIMS), "shard-meta")
    drop_table(rows)
    return out


@dataclass
class _Search:
    """The search for the row at which a node is split: keys are (dimension, id, rid), taken in turn."""

    node: int
    dim: int
    goal: int  # twice the bytes that are to go left
    lo: int
    hi: int
    before: int = 0  # bytes of rows before [lo, hi]
    fixed: list[int] = field(default_factory=list)  # values of the keys that are decided
    found: tuple | None = None

    def grid(self, buckets: int) -> tuple[int, int, int]:
        """(shift, lowest bucket, width): a value falls in bucket ((value >> shift) - lowest) div width. The shift
        keeps differences within a long wherever in its range the values are."""
        shift = 0 if self.hi - self.lo < 1 << 62 else 2
        low = self.lo >> shift
        return shift, low, max(1, -(-((self.hi >> shift) - low + 1) // buckets))


def kd_tree(meta: DataFrame, leaves: int | None = None, *, target_bytes: int | None = None) -> DataFrame:
    """Assign rows of metadata() to leaves of near-equal bytes by column shard, from 0.

    Give the number of leaves, a power of two, or the bytes that a leaf may have: then each node is split until it is
    within them or a single row, which alone may be larger. Empty input gives an empty result. Rows that tie in a
    dimension are ordered by id, then by rid, so ties and repeated rows are split like others.
    """
    if (leaves is None) == (target_bytes is None):
        raise ValueError("give either leaves or target_bytes")
    if leaves is not None and (leaves < 1 or leaves & (leaves - 1)):
        raise ValueError("leaves must be a power of two")
    if target_bytes is not None and target_bytes < 1:
        raise ValueError("target_bytes must be positive")
    placed = written = meta
    whole, depth = [], 0
    while leaves is None or depth < leaves.bit_length() - 1:
        measures = [f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]
        nodes = placed.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *measures)
        ranges = (nodes if target_bytes is None else nodes.filter((F.col("bytes") > target_bytes) & (F.col("n") > 1))).collect()
        if not ranges:
            break
        if depth > 60:
            raise ValueError("the tree is too deep: sizes are too unequal for this target")
        if not whole:
            whole = [max(1, ranges[0][f"hi_{d}"] - ranges[0][f"lo_{d}"]) for d in DIMS]
        tasks = []
        for r in ranges:
            widths = [(r[f"hi_{d}"] - r[f"lo_{d}"]) / w for d, w in zip(DIMS, whole, strict=True)]
            dim = widths.index(max(widths))
            tasks.append(_Search(r["shard"], dim, r["bytes"], r[f"lo_{DIMS[dim]}"], r[f"hi_{DIMS[dim]}"]))
        for at in range(0, len(tasks), NODES):
            _find(placed, tasks[at : at + NODES])
        placed, depth = _split(placed, tasks), depth + 1
        if depth + 1 != (leaves or 0).bit_length():
            after = materialize(placed, "shard-level")
            if written is not meta:
                drop_table(written)
            placed = written = after
    if leaves is not None:  # all leaves stand in one row of the tree
        return placed.withColumn("shard", F.col("shard") - (leaves - 1))
    leaf = rank_in_groups(placed.select("shard").distinct().withColumn("one", F.col("shard") * 0), ["one"], ["shard"], name="leaf")
    leaf = materialize(leaf.select(F.col("shard").alias("__node"), "leaf"), "shard-leaves")
    joined = placed.join(_small(leaf), F.col("shard") == F.col("__node"))
    return joined.select(*[F.col("leaf").alias("shard") if c == "shard" else F.col(c) for c in placed.columns])


def _small(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has no more than BROADCAST_ROWS rows."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _numbers(spark: SparkSession, rows: Sequence[Sequence[int | bool]], names: Sequence[str]) -> DataFrame:
    """values(), written in parts where they are many."""
    if len(rows) <= NODES:
        return F.broadcast(values(spark, rows, names))
    path = new_path(spark, "shard-splits")
    for at in range(0, len(rows), NODES):
        values(spark, rows[at : at + NODES], names).coalesce(1).write.mode("append").parquet(path)
    return _small(spark.read.parquet(path))


def _value(dim: Column) -> Column:
    return F.element_at(F.array(*DIMS), dim.cast("int") + 1)


def _with(rows: DataFrame, params: Sequence[Sequence[int | bool]], names: Sequence[str]) -> DataFrame:
    """Rows with what params say of their shards: the first of each is the shard, the others go by names; null elsewhere."""
    low, high = min(p[0] for p in params), max(p[0] for p in params)
    if high - low >= SPAN:
        known = _numbers(rows.sparkSession, params, ("__n", *names))
        return rows.join(known, F.col("shard") == F.col("__n"), "left").drop("__n")
    of = {p[0]: p for p in params}
    cell = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else f"{x}L"
    kind = lambda k: "array<boolean>" if isinstance(params[0][k], bool) else "array<bigint>"
    listed = lambda k: ",".join(cell(of[n][k] if n in of else None) for n in range(low, high + 1))
    columns = [F.expr(f"get(cast(array({listed(k)}) AS {kind(k)}), cast(shard - {low} AS int))").alias(name) for k, name in enumerate(names, 1)]
    return rows.select("*", *columns)


def _find(rows: DataFrame, tasks: list[_Search]) -> None:
    """Refine histograms until every task has found its row."""
    while open_ := [t for t in tasks if t.found is None]:
        params = [(t.node, t.dim, len(t.fixed), *(t.fixed + [0, 0])[:2], t.lo, t.hi, *t.grid(max(4, BUCKETS // len(open_)))) for t in open_]
        held = _with(rows, params, ("dim", "level", "f0", "f1", "lo", "hi", "shift", "low", "width")).filter("dim IS NOT NULL")
        value = _value(F.col("dim"))
        at = F.when(F.col("level") == 0, value).when(F.col("level") == 1, F.col("d_id")).otherwise(F.col("rid"))
        fits = ((F.col("level") < 1) | (value == F.col("f0"))) & ((F.col("level") < 2) | (F.col("d_id") == F.col("f1")))
        held = held.filter(fits).withColumn("at", at).filter(F.col("at").between(F.col("lo"), F.col("hi")))
        bucket = F.expr("(shiftright(at, cast(shift AS int)) - low) div width").alias("bucket")
        ends = [f(c).alias(f"{n}{i}") for i, c in enumerate(("at", "d_id", "rid")) for n, f in (("a", F.min), ("b", F.max))]
        counts = held.groupBy("shard", bucket).agg(F.sum("size").alias("w"), F.count("*").alias("n"), *ends).collect()
        by_node: dict[int, list] = {}
        for r in counts:
            by_node.setdefault(r["shard"], []).append(r)
        for t in open_:
            _narrow(t, sorted(by_node[t.node], key=lambda r: r["bucket"]))


def _narrow(t: _Search, buckets: list) -> None:
    """Go to the bucket that holds the first row whose middle is not left of the goal."""
    for r in buckets:
        if 2 * (t.before + r["w"]) > t.goal or r is buckets[-1]:
            break
        t.before += r["w"]
    if r["a0"] < r["b0"]:
        t.lo, t.hi = r["a0"], r["b0"]
        return
    if r["n"] == 1:
        t.found = (*t.fixed, r["a0"]), 2 * t.before + r["w"] <= t.goal
        return
    t.fixed.append(r["a0"])
    if len(t.fixed) == 1:
        t.lo, t.hi = r["a1"], r["b1"]
        if t.lo < t.hi:
            return
        t.fixed.append(t.lo)
    t.lo, t.hi = r["a2"], r["b2"]


def _split(rows: DataFrame, tasks: list[_Search]) -> DataFrame:
    """Rows go to child 2n + 1 or 2n + 2 by comparison with the found row, which goes left if its middle does; other nodes stay."""
    params = []
    for t in tasks:
        (keys, left) = t.found
        params.append((t.node, t.dim, len(keys), *(list(keys) + [0, 0])[:3], left))
    known = _with(rows, params, ("dim", "level", "k0", "k1", "k2", "at_left"))
    later = [(_value(F.col("dim")), "k0"), (F.col("d_id"), "k1"), (F.col("rid"), "k2")]
    right = ~F.col("at_left")
    for depth, (c, k) in reversed(list(enumerate(later))):
        right = F.when(F.col("level") <= depth, right).when(c == F.col(k), right).otherwise(c > F.col(k))
    child = F.when(F.col("dim").isNull(), F.col("shard")).otherwise(F.col("shard") * 2 + 1 + right.cast("long"))
    return known.select(*[child.alias("shard") if c == "shard" else F.col(c) for c in rows.columns])


def shard_documents(documents: DataFrame, *, leaves: int | None = None, target_bytes: int | None = None, **columns: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of documents.

    Law `bytes`: leaves differ by little more than the largest row. Give the number of leaves, or the bytes
    that a leaf may have at most; a row that is larger than that is a leaf of its own. Null texts count as empty
    (size 1, CRC 0), null ids and labels sort first and keep their rows; ids may be any longs; repeated rows each get
    a slot; extra columns are ignored; an empty table gives no rows.
    """
    placed = kd_tree(metadata(documents, **columns), leaves, target_bytes=target_bytes)
    placed = rank_in_groups(placed, ["shard"], ["d_id", "rid"], name="slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
