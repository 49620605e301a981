"""Mixing sources to target weights by Pfair scheduling.

A source with weight a/T gets its block k released at floor(k T / a) and due at ceil((k + 1) T / a); the
earliest deadline first among released blocks keeps every source within one block of its share at any
time. With whole-number tickets the schedule repeats after T slots, so only one period is worked out on the
driver however long the mixture is. When a source runs out, a new phase begins, in which the weights of the
others keep their proportions: no document is dropped or repeated.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeweave.ranking import rank_in_groups
from cubeweave.rowkeys import with_row_keys
from cubeweave.scratch import materialize

#: Sources, and slots of a period, at most: what the driver works out.
MAX_SOURCES, MAX_PERIOD = 4096, 1 << 16
BLOCK_ROWS = 64
#: Files of a mixture up to which their offsets are broadcast, at some 150 bytes each; beyond, they are joined by shuffle.
BROADCAST_FILES = 100_000


def period(tickets: Mapping[str, int], blocks: Mapping[str, int] | None = None) -> dict[str, list[int]]:
    """Slots of one period that each source gets: earliest deadline first among released blocks; ties by name.

    With blocks the period ends early, at the slot in which a source gets the last of its blocks.
    """
    total = sum(tickets.values())
    waiting = [(0, s, 0) for s in sorted(tickets)]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []  # deadline, source, block
    slots: dict[str, list[int]] = {s: [] for s in tickets}
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // tickets[s]), s, k))
        _, s, k = heapq.heappop(ready)
        slots[s].append(t)
        if blocks and k + 1 == blocks[s]:
            break
        if k + 1 < tickets[s]:
            heapq.heappush(waiting, ((k + 1) * total // tickets[s], s, k + 1))
    return slots


def phases(blocks: Mapping[str, int], tickets: Mapping[str, int]) -> list[tuple[str, int, int, int, int, int, list[int]]]:
    """(source, first block, end block, first slot, period, tickets, slots of the period) of each phase.

    Only sources that get blocks in a phase have a row, and of a phase that is shorter than its period only the slots
    that it has are worked out and given: so the slots of all rows are no more than the blocks, nor than a period a phase.
    """
    done = dict.fromkeys(blocks, 0)
    left = {s: tickets[s] for s in blocks if blocks[s]}
    start, out = 0, []
    while left:
        total, rest = sum(left.values()), {s: blocks[s] - done[s] for s in left}
        slots = period(left, rest)
        last = lambda s: (rest[s] - 1) // left[s] * total + slots[s][(rest[s] - 1) % left[s]]
        end = min(last(s) for s in left if len(slots[s]) > (rest[s] - 1) % left[s]) + 1
        for s in left:
            if took := end // total * left[s] + bisect_right(slots[s], end % total - 1):
                out.append((s, done[s], done[s] + took, start, total, left[s], slots[s]))
                done[s] += took
        start += end
        left = {s: a for s, a in left.items() if done[s] < blocks[s]}
    return out


def source_key(c: Column) -> Column:
    """Sources by name; null is a source of its own."""
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), c.cast("string")))


def shuffle_key(doc_id: Column) -> Column:
    """A number below 2**31 that spreads ids without order: a multiplicative hash that any SQL can compute."""
    return F.pmod(F.pmod(doc_id, F.lit(2147483647)) * F.lit(1103515245), F.lit(2147483648))


def mix(documents: DataFrame, tickets: Mapping[str, int] | None = None, *, default_tickets: int = 1, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source", keys: tuple[str, ...] = ()) -> DataFrame:
    """The place of every row in the mixture: doc_id, source, block, slot, place, release, deadline, and keys.

    tickets are whole numbers in proportion to the target weights; other sources get default_tickets. Sources are
    cut into blocks of block_rows in the order of a hash of doc_id, then of doc_id; slot numbers the blocks of the
    mixture without gaps, and place the rows of a block. Release and deadline are slots of the block's phase.
    Every row is placed once: null sources form a source, null and repeated ids are ordered arbitrarily but
    kept; the text is not read, so it may be null or of any length. Columns that are not named are ignored, whatever
    they are called. An empty table gives no rows.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), source_key(F.col(source_col)).alias("__s"), shuffle_key(F.col(id_col).cast("long")).alias("__h"), F.monotonically_increasing_id().alias("__rid"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    ranked = rank_in_groups(rows, ["__s"], ["__h", "doc_id", "__rid"], name="__rank")
    counts = {r[0]: r[1] for r in ranked.groupBy("__s").count().limit(MAX_SOURCES + 1).collect()}
    shares = {s: (tickets or {}).get(s[1:] if s != "null" else None, default_tickets) for s in counts}
    if len(counts) > MAX_SOURCES or sum(shares.values()) > MAX_PERIOD or min(shares.values(), default=1) < 1:
        raise ValueError("too many sources or tickets, or a source without any")
    plan = phases({s: -(-n // block_rows) for s, n in counts.items()}, shares)
    known = spark.createDataFrame(plan, "__s string, k0 long, k1 long, slot0 long, total long, a int, slots array<int>")
    blocks = known.select("*", F.explode(F.sequence("k0", F.col("k1") - 1)).alias("block")).withColumn("k", F.col("block") - F.col("k0"))
    blocks = blocks.select(
        "__s", "block", F.expr("slot0 + (k div a) * total + element_at(slots, cast(k % a as int) + 1)").alias("slot"),
        F.expr("slot0 + (k * total) div a").alias("release"), F.expr("slot0 + ((k + 1) * total + a - 1) div a").alias("deadline"),
    )
    placed = ranked.withColumn("block", F.expr(f"__rank div {block_rows}")).join(blocks, ["__s", "block"])
    return placed.select("doc_id", "source", "block", "slot", (F.col("__rank") % block_rows).alias("place"), "release", "deadline", *[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)])


def mixed(documents: DataFrame, tickets: Mapping[str, int] | None = None, **options) -> DataFrame:
    """The rows of documents in the order of the mixture, with all their columns.

    Rows are found again by file and row number, so that the text moves only twice: to its place in the mixture
    and into order. Tables that aren't read from files are written once. Null and repeated ids, null sources, and
    columns of any names are as in mix(): every row is in the result once. An empty table gives an empty one.
    """
    names = documents.columns
    keyed = with_row_keys(documents)
    columns = {k: f"c{names.index(options.pop(k, d))}" for k, d in (("id_col", "doc_id"), ("source_col", "source"))}
    places = mix(keyed, tickets, keys=("__file", "__row"), **columns, **options).select("__file", "__row", "slot", "place")
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.join(places, ["__file", "__row"]).repartitionByRange(n, "slot", "place").sortWithinPartitions("slot", "place")
    return ordered.select(*keyed.columns[: len(names)]).toDF(*names)


def with_places(ordered: DataFrame, name: str = "place") -> DataFrame:
    """A table that mixed() gave, written and read again, with the place of every row in the mixture: 0, 1, ...

    The order is that of the files and of the rows in them, so it survives however Spark splits the files. An
    empty table gives no rows; a column of that name is replaced.
    """
    names = ordered.columns
    keyed = with_row_keys(ordered)
    files = keyed.groupBy("__file").agg((F.max("__row") + 1).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = materialize(files.select("__file", F.coalesce(before, F.lit(0)).alias("__before")), "file-offsets")  # a row a file
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST_FILES else offsets
    placed = keyed.join(offsets, "__file").withColumn("__place", (F.col("__before") + F.col("__row")).cast("long"))
    return placed.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c != name], F.col("__place").alias(name))
