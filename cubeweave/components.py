"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeweave.scratch import drop_table, materialize

ROUNDS = 60
#: Links up to which the driver finds the components (at 16 bytes a link); beyond, rounds of joins do.
DRIVER_LINKS = 100_000


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of the component of each) of the links u, v."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(node))
    while True:
        x, y, before = root[a], root[b], root.copy()
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if (root == before).all():
            return node, node[root]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link in links(a, b): root is the smallest node of its component.

    Alternating large-star and small-star rounds: each node's neighbours are linked to its smallest one, until
    all components are stars. A round is two aggregates and two joins on nodes; it is written and its predecessor
    dropped, so lineage stays short. Self-links and repeated links do no harm. Up to DRIVER_LINKS links are united by
    the driver instead, as rounds over so few rows are nothing but plans and short tasks.
    """
    now = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    if 0 < now.count() <= DRIVER_LINKS:
        known = now.toArrow()
        drop_table(now)
        found = smallest(known["u"].to_numpy(), known["v"].to_numpy())
        table = pa.table({"node": pa.array(found[0], pa.int64()), "root": pa.array(found[1], pa.int64())})
        return materialize(links.sparkSession.createDataFrame(table), "roots")
    seen = None
    for _ in range(ROUNDS):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("m", "n").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("n"))
        pairs = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        after = materialize(small.select(pairs.alias("p")).select("p.u", "p.v").filter("u <> v").distinct(), "links")
        sums = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(now)
        now = after
        if tuple(sums) == seen:
            break
        seen = tuple(sums)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
