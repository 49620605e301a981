"""The registered queries for the array operators, and their SQL for DuckDB.

Cube E: table embeddings as an array: v = label, t = rank of vec_id in its label, 8 x 8 cells of each vector.
Cube V: table events: v = event type, t = day since 2024-01-01, x = mean value of the day, scaled.
Cube N: table lineitem: v = return flag, t = month of shipment, h = supplier, x = number of lines, in eights.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeweave.functions.codes import bit, planes, quantize, zigzag
from cubeweave.functions.index import div, linear
from cubeweave.operators import corrector, entropy, layout, lorenzo, predict, residual_codec, select, stats
from cubeweave.ranking import rank_in_groups

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rank_in_groups(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), ["label"], ["vec_id"], name="t")
    return layout.cells_from_vectors(ranked, "embedding", 8, v=F.col("label"), t=F.col("t"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements (pid, label, k, x) of the vectors."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), "label", F.posexplode("embedding").alias("k", "x"))
    return rows.select("pid", "label", F.col("k").cast("long"), F.col("x").cast("double").alias("x"))


def cube_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    mean = F.round(F.avg("value"), 6)
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("v"), day.alias("t")).agg(mean.alias("x"))


def cube_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("v"), F.floor(F.col("l_suppkey") / 5).cast("long").alias("s"), month.alias("t"), (F.col("l_suppkey") % 5).cast("long").alias("h")).agg(F.floor(F.count("*") / 8).cast("double").alias("x"))


E = """e AS (SELECT CAST(label AS BIGINT) AS v, CAST(0 AS BIGINT) AS s, CAST(t AS BIGINT) AS t, CAST((i - 1) // 8 AS BIGINT) AS h, CAST((i - 1) % 8 AS BIGINT) AS w, CAST(embedding[i] AS DOUBLE) AS x
    FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, unnest(range(1, 65)) AS i FROM embeddings))"""
P = """p AS (SELECT vec_id AS pid, label, CAST(i - 1 AS BIGINT) AS k, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings))"""
V = """c AS (SELECT event_type AS v, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS t, round(avg(value), 6) AS x FROM events GROUP BY 1, 2)"""
N = """n AS (SELECT l_returnflag AS v, CAST(l_suppkey // 5 AS BIGINT) AS s, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS t, CAST(l_suppkey % 5 AS BIGINT) AS h, CAST(count(*) // 8 AS DOUBLE) AS x FROM lineitem GROUP BY 1, 2, 3, 4)"""


# layout


@query(f"WITH {E} SELECT * FROM e")
def cells_from_arrays(spark, d):
    return cube_e(spark, d)


@query(f"WITH {E} SELECT v, s, t, list(x ORDER BY h * 8 + w) AS vec FROM e GROUP BY 1, 2, 3")
def arrays_from_cells(spark, d):
    return layout.vectors_from_cells(cube_e(spark, d), 8)


@query(f"WITH {E} SELECT v, s, t, w // 4 AS pw, h // 4 AS ph, list(x ORDER BY (h % 4) * 4 + w % 4) AS vec FROM e GROUP BY ALL")
def patchify(spark, d):
    return layout.patches(cube_e(spark, d), 4, 4)


@query(f"WITH {E} SELECT v, s, t, h, w, x FROM e")
def patchify_inverse(spark, d):
    return layout.unpatch(layout.patches(cube_e(spark, d), 4, 4), 4, 4)


def _flat(spark, d):
    e = vectors(spark, d)
    return e.select((F.col("pid") * 64 + F.col("k")).alias("i"), "x")


@query(f"""WITH {P}, f AS (SELECT pid * 64 + k AS i, x FROM p), n AS (SELECT count(*) AS n FROM f),
    a AS (SELECT * FROM f UNION ALL SELECT unnest(range(n, (n + 143) // 144 * 144)), 0.0 FROM n)
    SELECT CAST(0 AS BIGINT) AS v, CAST(0 AS BIGINT) AS s, i // 144 AS t, i // 12 % 12 AS h, i % 12 AS w, x FROM a""")
def flatten_to_5d(spark, d):
    flat = _flat(spark, d)
    return layout.to_5d(flat, table(spark, d, "embeddings").count() * 64, 12, 12)


@query(f"WITH {P} SELECT pid * 64 + k AS i, x FROM p")
def restore_5d(spark, d):
    n = table(spark, d, "embeddings").count() * 64
    return layout.restore_flat(layout.to_5d(_flat(spark, d), n, 12, 12), n, 12, 12)


TAIL = f"""{E}, z AS (SELECT v, s, max(t) + 1 AS len FROM e GROUP BY 1, 2), y AS (SELECT *, greatest(ceil((len - 8) / 8.0), 0) * 8 + 8 AS stop FROM z)"""


@query(f"""WITH {TAIL} SELECT e.v, e.s, e.t, h, w, x FROM e UNION ALL SELECT e.v, e.s, 2 * len - 1 - e.t, h, w, x FROM e JOIN y ON e.v = y.v AND e.s = y.s WHERE 2 * len - 1 - e.t < stop""")
def tail_reflect(spark, d):
    return layout.tail_reflect(cube_e(spark, d), 8)


@query(f"WITH {E} SELECT * FROM e WHERE t < 20")
def tail_trim(spark, d):
    return layout.tail_trim(cube_e(spark, d), 20)


@query(f"WITH {E} SELECT v, (s * 2 + h // 4) * 2 + w // 4 AS s, t, h % 4 AS h, w % 4 AS w, x FROM e")
def block_split4(spark, d):
    return layout.block_split(cube_e(spark, d), (8, 8), (4, 4))


R5 = """(SELECT q, CASE WHEN q - 1 < 0 THEN 1 - q WHEN q - 1 >= 8 THEN 15 - q ELSE q - 1 END AS src FROM (SELECT unnest(range(0, 10)) AS q))"""


@query(f"WITH {E} SELECT v, (s * 2 + a.q // 5) * 2 + b.q // 5 AS s, t, a.q % 5 AS h, b.q % 5 AS w, x FROM e JOIN {R5} a ON a.src = e.h JOIN {R5} b ON b.src = e.w")
def block_reflect5(spark, d):
    return layout.block_split(cube_e(spark, d), (8, 8), (5, 5))


@query(f"WITH {E} SELECT * FROM e")
def block_merge(spark, d):
    return layout.block_merge(layout.block_split(cube_e(spark, d), (8, 8), (5, 5)), (8, 8), (5, 5))


@query(f"WITH {E} SELECT * FROM e")
def block_merge_zero_padded(spark, d):
    """A block that is far larger than the frame: zeros first, then reflection, and back."""
    few = layout.slice_cells(cube_e(spark, d), frames=None)
    return layout.block_merge(layout.block_split(few, (8, 8), (30, 30)), (8, 8), (30, 30))


@query(f"WITH {E} SELECT v, s, t, h - 2 AS h, w - 1 AS w, x FROM e WHERE h BETWEEN 2 AND 4 AND w BETWEEN 1 AND 5")
def center_crop(spark, d):
    return layout.center_crop(cube_e(spark, d), (8, 8), (3, 5))


@query(f"WITH {E}, g AS (SELECT DISTINCT v, s, t FROM e), a AS (SELECT g.*, unnest(range(0, 9)) AS h FROM g), b AS (SELECT a.*, unnest(range(0, 10)) AS w FROM a) SELECT b.v, b.s, b.t, b.h, b.w, coalesce(e.x, 0.0) AS x FROM b LEFT JOIN e ON e.v = b.v AND e.t = b.t AND e.h = b.h AND e.w = b.w - 1")
def pad_multiple(spark, d):
    return layout.pad_zero(cube_e(spark, d), (8, 8), (3, 5))


@query(f"WITH {E} SELECT * FROM e")
def unpad(spark, d):
    return layout.unpad(layout.pad_zero(cube_e(spark, d), (8, 8), (3, 5)), (8, 8), (3, 5))


@query(f"WITH {V} SELECT v, t, x, k, t - k * 5 AS j FROM (SELECT *, unnest(range(greatest(CAST(ceil((t - 7) / 5.0) AS BIGINT), 0), t // 5 + 1)) AS k FROM c)")
def frame_windows_overlap(spark, d):
    return layout.windows(cube_v(spark, d), 8, 3)


@query(f"WITH {E} SELECT * FROM e")
def scatter_samples(spark, d):
    return layout.scatter(layout.windows(cube_e(spark, d), 8, 2), 8, 2)


@query(f"WITH {E} SELECT v - 3 AS v, s, t - 4 AS t, h, w, x FROM e WHERE v = 3 AND t >= 4 AND t < 9")
def array_slice(spark, d):
    return layout.slice_cells(cube_e(spark, d), variable=3, frames=(4, 9))


@query(f"WITH {E} SELECT v * 100000 + t AS b, h, w, x FROM e")
def fold_batch(spark, d):
    return layout.fold_batch(cube_e(spark, d), 100000)


@query(f"WITH {E} SELECT v, t, h, w, x FROM e")
def unfold_batch(spark, d):
    return layout.unfold_batch(layout.fold_batch(cube_e(spark, d), 100000), 100000)


@query(f"WITH {E} SELECT v, s, t, h, w // 3 AS w, x FROM e WHERE w % 3 = 0")
def decimate(spark, d):
    return layout.decimate(cube_e(spark, d), 3)


@query(f"WITH {E}, m AS (SELECT * FROM (VALUES (0, 0, 0.5), (1, 0, 0.5), (2, 1, 0.5), (3, 1, 0.5), (4, 2, 0.5), (5, 2, 0.5), (6, 3, 0.5), (7, 3, 0.5)) AS m(i, o, wt)) SELECT v, s, t, CAST(a.o AS BIGINT) AS h, CAST(b.o AS BIGINT) AS w, round(CAST(sum(x * a.wt * b.wt) AS DOUBLE), 9) AS x FROM e JOIN m a ON a.i = h JOIN m b ON b.i = w GROUP BY ALL")
def resample_half(spark, d):
    return layout.resample(cube_e(spark, d), (8, 8), (4, 4)).withColumn("x", F.round("x", 9))


@query(f"WITH {E} SELECT *, t // 5 AS bt, h // 3 AS bh, w // 3 AS bw FROM e")
def ragged_blocks(spark, d):
    return layout.ragged_blocks(cube_e(spark, d), (5, 3, 3))


@query(f"WITH {E}, b AS (SELECT v, t // 7 AS bt, count(*) AS n FROM e GROUP BY 1, 2), g AS (SELECT *, CASE WHEN n IS NOT DISTINCT FROM lag(n) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS f FROM b WINDOW w AS (PARTITION BY v ORDER BY bt)), i AS (SELECT *, sum(f) OVER (PARTITION BY v ORDER BY bt) AS g FROM g) SELECT v, bt, n, CAST(g AS BIGINT) AS island, (row_number() OVER (PARTITION BY v, g ORDER BY bt) - 1) // 3 AS part FROM i")
def same_shape_batches(spark, d):
    blocks = cube_e(spark, d).groupBy("v", div(F.col("t"), 7).alias("bt")).agg(F.count("*").alias("n"))
    return layout.same_shape_runs(blocks, ["bt"], ["n"], 3, ["v"]).select("v", "bt", "n", F.col("run.__island").cast("long").alias("island"), F.col("run.col2").alias("part"))


@query(f"WITH {E} SELECT v, t + h + w AS front, count(*) AS n FROM e GROUP BY 1, 2")
def wavefront_sizes(spark, d):
    return layout.wavefront(cube_e(spark, d)).groupBy("v", "front").agg(F.count("*").alias("n"))


@query(f"WITH {V} SELECT v, t, CASE WHEN t % 3 = 0 THEN 'key' ELSE 'between' END AS kind FROM c")
def keyframe_split(spark, d):
    c = cube_v(spark, d)
    return layout.keyframes(c).select("v", "t", F.lit("key").alias("kind")).unionAll(layout.between_keyframes(c).select("v", "t", F.lit("between").alias("kind")))


# statistics and normalisation

CONST = f"{N}, b AS (SELECT v, s, t // 2 AS k, min(x) AS value FROM n GROUP BY 1, 2, 3 HAVING min(x) = max(x) AND NOT isnan(max(x)))"


def _blocks_n(spark, d):
    return cube_n(spark, d).withColumn("k", div(F.col("t"), 2))


@query(f"WITH {CONST} SELECT * FROM b")
def const_blocks(spark, d):
    return stats.constant_blocks(_blocks_n(spark, d))


@query(f"WITH {CONST}, i AS (SELECT DISTINCT v || '/' || s || '/' || t // 2 AS label FROM n), a AS (SELECT label FROM i WHERE label NOT IN (SELECT v || '/' || s || '/' || k FROM b)) SELECT row_number() OVER (ORDER BY label) - 1 AS new, label AS old FROM a")
def reverse_id_map(spark, d):
    blocks = _blocks_n(spark, d)
    name = F.concat_ws("/", "v", F.col("s").cast("string"), F.col("k").cast("string"))
    return layout.renumber(blocks.select(name.alias("label")).distinct(), stats.constant_blocks(blocks).select(name.alias("label")))


@query(f"WITH {CONST} SELECT n.v, n.s, n.t, n.h, coalesce(b.value, 0.5 * x) AS x FROM n LEFT JOIN b ON n.v = b.v AND n.s = b.s AND n.t // 2 = b.k")
def fill_const(spark, d):
    blocks = _blocks_n(spark, d)
    return layout.fill_constants(blocks.withColumn("x", F.col("x") * 0.5), stats.constant_blocks(blocks), ["v", "s", "k"]).select("v", "s", "t", "h", "x")


@query(f"WITH {V} SELECT v, t // 8 AS k, t, round((x - avg(x) OVER w) / greatest(max(x) OVER w - min(x) OVER w, 1e-12), 6) AS y FROM c WINDOW w AS (PARTITION BY v, t // 8)")
def inst_norm(spark, d):
    return stats.normalize(cube_v(spark, d).withColumn("k", div(F.col("t"), 8)), ["v", "k"]).select("v", "k", "t", F.round("y", 6).alias("y"))


@query(f"WITH {V} SELECT v, t // 8 AS k, t, round((x - (max(x) OVER w + min(x) OVER w) / 2) / greatest((max(x) OVER w - min(x) OVER w) / 2, 1e-12), 6) AS y FROM c WINDOW w AS (PARTITION BY v, t // 8)")
def inst_norm_minmax(spark, d):
    return stats.normalize(cube_v(spark, d).withColumn("k", div(F.col("t"), 8)), ["v", "k"], "min_max").select("v", "k", "t", F.round("y", 6).alias("y"))


@query(f"WITH {E} SELECT v, t, h, w, round((x - avg(x) OVER f) / greatest(max(x) OVER f - min(x) OVER f, 1e-12), 6) AS y FROM e WINDOW f AS (PARTITION BY v, t)")
def inst_norm_hw(spark, d):
    return stats.normalize(cube_e(spark, d), ["v", "t"]).select("v", "t", "h", "w", F.round("y", 6).alias("y"))


@query(f"WITH {E} SELECT v, t, h, w, round((x - avg(x) OVER f) / greatest(stddev_pop(x) OVER f, 1e-12), 6) AS y FROM e WINDOW f AS (PARTITION BY v)")
def var_norm_std(spark, d):
    return stats.normalize(cube_e(spark, d), ["v"], "std").select("v", "t", "h", "w", F.round("y", 6).alias("y"))


@query(f"WITH {E} SELECT v, s, t, h, w, round(x, 9) AS x FROM e")
def denorm_roundtrip(spark, d):
    return stats.denormalize(stats.normalize(cube_e(spark, d), ["v", "t"])).select("v", "s", "t", "h", "w", F.round("x", 9).alias("x"))


@query(f"WITH {E}, p AS (SELECT v, (max(x) - min(x)) / 2 AS scale, (max(x) + min(x)) / 2 AS o FROM e GROUP BY 1) SELECT e.v, t, h, w, round((x - o) / scale, 5) + 0.0 AS y FROM e JOIN p ON e.v = p.v")
def norm_with_params(spark, d):
    c = cube_e(spark, d)
    return stats.normalize_with(c, stats.offsets(c, ["v"], "min_max"), ["v"]).select("v", "t", "h", "w", (F.round("y", 5) + 0.0).alias("y"))


@query(f"WITH {E}, p AS (SELECT v, t, (max(x) - min(x) + 1e-8) / 2 AS scale, min(x) AS m FROM e GROUP BY 1, 2) SELECT e.v, e.t, h, w, round((x - (m + scale)) / scale, 6) AS y FROM e JOIN p ON e.v = p.v AND e.t = p.t")
def latent_norm(spark, d):
    return stats.latent_range(cube_e(spark, d), ["v", "t"]).select("v", "t", "h", "w", F.round("y", 6).alias("y"))


@query(f"WITH {P} SELECT count(x) AS n, max(x) AS max, min(x) AS min, round(avg(x), 9) AS mean, max(x) - min(x) AS range FROM p")
def global_stats(spark, d):
    return stats.global_stats(vectors(spark, d)).withColumn("mean", F.round("mean", 9))


PAIR = f"{P}, m AS (SELECT label, k, avg(x) AS y FROM p GROUP BY 1, 2), q AS (SELECT p.*, m.y FROM p JOIN m ON p.label = m.label AND p.k = m.k)"


def _pairs(spark, d):
    """Elements with what the mean of their label predicts."""
    p = vectors(spark, d)
    return p.join(p.groupBy("label", "k").agg(F.avg("x").alias("y")), ["label", "k"])


@query(f"WITH {PAIR} SELECT pid, round(sqrt(sum(pow(x - y, 2))), 6) AS norm, sqrt(sum(pow(x - y, 2))) > 0.8 AS violates FROM q GROUP BY 1")
def residual_mask(spark, d):
    return stats.residual_norms(_pairs(spark, d), ["pid"], 0.8).withColumn("norm", F.round("norm", 6))


@query("SELECT vec_id AS pid, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("pid"), F.round(stats.norm2(F.col("embedding").cast("array<double>")), 6).alias("norm"))


@query(f"WITH {PAIR}, n AS (SELECT label, pid, sqrt(sum(pow(x - y, 2))) AS norm, sum(pow(x - y, 2)) AS e FROM q GROUP BY 1, 2), g AS (SELECT max(x) - min(x) AS r FROM p) SELECT label, count(*) AS patches, count(*) FILTER (norm > 0.1325 * 8 * r) AS violating, round(sqrt(sum(e) / (64 * count(*))) / any_value(r), 6) AS nrmse FROM n, g GROUP BY 1")
def bound_check_by_label(spark, d):
    """For each label, how many patches break a relative bound of 0.1325 under the mean of the label, and the NRMSE."""
    return stats.bound_check(_pairs(spark, d), ["label"], "pid", 0.1325, 64).withColumn("nrmse", F.round("nrmse", 6))


@query(f"WITH {P} SELECT a.k AS i, b.k AS j, round(covar_samp(a.x, b.x), 8) AS cov FROM p a JOIN p b ON a.pid = b.pid AND a.k <= b.k GROUP BY 1, 2")
def covariance(spark, d):
    """Sample covariance of the vectors' elements: every task adds up its own products, and sends n (n + 1) + 1 sums."""
    rows = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("orig"), F.array_repeat(F.lit(0.0), 64).alias("recon"))
    found = corrector.covariance(rows, 64)
    return spark.createDataFrame([(i, j, round(float(found[i, j]), 8)) for i in range(64) for j in range(i, 64)], "i long, j long, cov double")


@query(f"WITH {PAIR}, g AS (SELECT label, avg(pow(x - y, 2)) AS mse, max(x) - min(x) AS r FROM q GROUP BY 1) SELECT label, round(mse, 8) AS mse, round(sqrt(mse), 8) AS rmse, round(sqrt(mse) / r, 8) AS nrmse, round(20 * log10(r) - 10 * log10(mse), 6) AS psnr FROM g")
def metrics_nrmse_psnr(spark, d):
    found = stats.errors(_pairs(spark, d), ["label"])
    return found.select("label", *[F.round(c, 8).alias(c) for c in ("mse", "rmse", "nrmse")], F.round("psnr", 6).alias("psnr"))


STEPS = [0.01 * 2**i for i in range(8)]
SE = f"""{PAIR}, s AS (SELECT unnest([{', '.join(map(repr, STEPS))}])::DOUBLE AS step), f AS (SELECT label, step, sum(pow((x - y) - round_even((x - y) / step, 0) * step, 2)) AS sse, sum(pow(x - y, 2)) AS zero_sse, count(*) AS n FROM q, s GROUP BY 1, 2)"""


@query(f"WITH {SE} SELECT label, step, round(sse, 6) AS sse, round(zero_sse, 6) AS zero_sse, n FROM f")
def step_candidates(spark, d):
    return stats.step_errors(_pairs(spark, d), STEPS, ["label"]).select("label", "step", F.round("sse", 6).alias("sse"), F.round("zero_sse", 6).alias("zero_sse"), "n")


@query(f"WITH {SE} SELECT label, CASE WHEN max(zero_sse) <= 0.0025 * max(n) THEN 1.0::DOUBLE ELSE max(step) FILTER (sse <= 0.0025 * n) END AS step FROM f GROUP BY 1")
def largest_step(spark, d):
    return stats.largest_step(stats.step_errors(_pairs(spark, d), STEPS, ["label"]), ["label"], 0.05)


# coefficients

COEF = f"""{P}, r AS (SELECT *, x * x AS pw, CAST(round_even(x / 0.1, 0) AS BIGINT) AS q, row_number() OVER (PARTITION BY pid ORDER BY x * x DESC, k) AS rank FROM p),
    b AS (SELECT *, sum(pw) OVER (PARTITION BY pid) - coalesce(sum(pw - pow(x - q * 0.1, 2)) OVER (PARTITION BY pid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
    f AS (SELECT pid, k, x AS c, q, rank FROM b WHERE before > 0.16 AND q <> 0)"""


def _kept(spark, d):
    """Coefficients under the unit basis for a bound of 0.05 * 8."""
    return select.minimal_prefix(vectors(spark, d).select("pid", "k", F.col("x").alias("c")), 0.1, 0.4)


@query(f"WITH {COEF} SELECT pid, k, c, q, CAST(rank AS INTEGER) AS rank FROM f")
def coef_prefix_identity_basis(spark, d):
    return _kept(spark, d)


@query(f"WITH {COEF} SELECT pid, k, f.q, code FROM f JOIN (SELECT q, dense_rank() OVER (ORDER BY q) - 1 AS code FROM (SELECT DISTINCT q FROM f)) USING (q)")
def coef_dictionary(spark, d):
    return select.with_codes(_kept(spark, d)).select("pid", "k", "q", "code")


@query(f"WITH {COEF} SELECT pid, max(k) AS last, list_transform(range(0, max(k) + 1), lambda i: CAST(list_contains(list(k), i) AS INTEGER)) AS bits FROM f GROUP BY 1")
def coef_prefix_bits(spark, d):
    return select.prefix_lengths(_kept(spark, d), 64)


@query(f"WITH {COEF} SELECT pid, k FROM f")
def coef_prefix_bits_inverse(spark, d):
    return select.flags_from_prefix(select.prefix_lengths(_kept(spark, d), 64))


@query(f"WITH {COEF} SELECT p.pid, p.k, coalesce(f.q, 0) AS value FROM p LEFT JOIN f ON p.pid = f.pid AND p.k = f.k")
def coef_scatter(spark, d):
    return select.scatter_codes(table(spark, d, "embeddings").select(F.col("vec_id").alias("pid")), _kept(spark, d), 64)


BITS = f"{P}, i AS (SELECT pid, k AS i, CAST(x > 0 AS BIGINT) AS bit FROM p)"


def _bits(spark, d):
    return vectors(spark, d).select("pid", F.col("k").alias("i"), (F.col("x") > 0).cast("long").alias("bit"))


@query(f"WITH {BITS} SELECT pid, i // 8 AS byte_no, CAST(sum(bit << CAST(7 - i % 8 AS INTEGER)) AS BIGINT) AS byte FROM i GROUP BY 1, 2")
def pack_bits_msb(spark, d):
    return select.pack(_bits(spark, d), ["pid"])


@query(f"WITH {BITS} SELECT pid, i // 8 AS byte_no, CAST(sum(bit << CAST(i % 8 AS INTEGER)) AS BIGINT) AS byte FROM i GROUP BY 1, 2")
def pack_bits_lsb(spark, d):
    return select.pack(_bits(spark, d), ["pid"], msb_first=False)


@query(f"WITH {BITS} SELECT pid, i, bit FROM i")
def unpack_bits(spark, d):
    return select.unpack(select.pack(_bits(spark, d), ["pid"]), ["pid"])


@query("SELECT CAST(t AS BIGINT) AS t, round(exp(sum(ln(1 - (0.002 + 0.398 * t / 49.0))) OVER (ORDER BY t)), 8) AS abar FROM range(50) r(t)")
def noise_schedule(spark, d):
    betas = spark.createDataFrame(list(enumerate(select.linear_schedule(50))), "t long, beta double")
    return select.cumulative(betas).select("t", F.round("abar", 8).alias("abar"))


# differences and codes

CODES = f"{E}, q AS (SELECT v, t // 8 AS b, t % 8 AS t, h, w, CAST(round_even(x / 0.05, 0) AS BIGINT) AS q FROM e)"


def _codes(spark, d):
    return cube_e(spark, d).select("v", div(F.col("t"), 8).alias("b"), (F.col("t") % 8).cast("long").alias("t"), "h", "w", quantize(F.col("x"), 0.05).alias("q"))


LORENZO = f"""{CODES}, d1 AS (SELECT *, q - lag(q, 1, 0) OVER (PARTITION BY v, b, h, w ORDER BY t) AS d FROM q),
    d2 AS (SELECT v, b, t, h, w, q, d - lag(d, 1, 0) OVER (PARTITION BY v, b, t, w ORDER BY h) AS d FROM d1),
    d3 AS (SELECT v, b, t, h, w, q, d - lag(d, 1, 0) OVER (PARTITION BY v, b, t, h ORDER BY w) AS d FROM d2)"""


@query(f"WITH {V} SELECT v, t, CAST(round_even(x / 0.5, 0) AS BIGINT) AS q FROM c")
def quantize_half_even(spark, d):
    return cube_v(spark, d).select("v", "t", quantize(F.col("x"), 0.5).alias("q"))


@query(f"WITH {LORENZO} SELECT v, b, t, h, w, q, CAST(d AS BIGINT) AS d FROM d3")
def lorenzo_delta(spark, d):
    return lorenzo.lorenzo(_codes(spark, d), ["v", "b"])


@query(f"WITH {CODES} SELECT v, b, t, h, w, q FROM q")
def lorenzo_inverse(spark, d):
    return lorenzo.inverse_lorenzo(lorenzo.lorenzo(_codes(spark, d), ["v", "b"]).drop("q"), ["v", "b"]).drop("d")


@query(f"WITH {LORENZO} SELECT v, b, t, h, w, CAST(CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS BIGINT) AS z FROM d3")
def zigzag_codes(spark, d):
    return lorenzo.lorenzo(_codes(spark, d), ["v", "b"]).select("v", "b", "t", "h", "w", zigzag(F.col("d")).alias("z"))


@query(f"WITH {LORENZO}, z AS (SELECT v, b, max(CAST(CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS BIGINT)) AS m FROM d3 GROUP BY 1, 2) SELECT v, b, CAST(greatest(1, length(bin(m))) AS BIGINT) AS planes FROM z")
def bitplane_counts(spark, d):
    z = lorenzo.lorenzo(_codes(spark, d), ["v", "b"]).groupBy("v", "b").agg(F.max(zigzag(F.col("d"))).alias("m"))
    return z.select("v", "b", planes(F.col("m")).alias("planes"))


@query(f"""WITH {LORENZO}, z AS (SELECT v, b, (t * 8 + h) * 8 + w AS i, CAST(CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS BIGINT) AS z FROM d3), y AS (SELECT *, unnest(range(0, 4)) AS plane FROM z)
    SELECT v, b, plane, i // 8 AS byte_no, CAST(sum(((z >> CAST(plane AS INTEGER)) & 1) << CAST(i % 8 AS INTEGER)) AS BIGINT) AS byte FROM y GROUP BY ALL""")
def bitplane_pack(spark, d):
    z = lorenzo.lorenzo(_codes(spark, d), ["v", "b"]).select("v", "b", linear([(F.col("t"), 8), (F.col("h"), 8), (F.col("w"), 8)]).alias("i"), zigzag(F.col("d")).alias("z"))
    e = z.select("v", "b", "i", "z", F.explode(F.array(*[F.lit(p).cast("long") for p in range(4)])).alias("plane"))
    return select.pack(e.select("v", "b", "plane", "i", bit(F.col("z"), F.col("plane")).alias("bit")), ["v", "b", "plane"], msb_first=False)


@query(f"""WITH {LORENZO}, z AS (SELECT v, b, (t * 8 + h) * 8 + w AS i, CAST(CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS BIGINT) AS z FROM d3), m AS (SELECT *, max(z) OVER (PARTITION BY v, b) AS m FROM z), y AS (SELECT *, unnest(range(0, CAST(greatest(1, length(bin(m))) AS BIGINT))) AS plane FROM m)
    SELECT v, b, plane, i // 8 AS byte_no, CAST(sum(((z >> CAST(plane AS INTEGER)) & 1) << CAST(i % 8 AS INTEGER)) AS BIGINT) AS byte FROM y GROUP BY ALL""")
def bitplane_pack_all(spark, d):
    """Every plane that the largest code of a block needs; bitplane_pack has the lowest four."""
    z = lorenzo.lorenzo(_codes(spark, d), ["v", "b"]).select("v", "b", linear([(F.col("t"), 8), (F.col("h"), 8), (F.col("w"), 8)]).alias("i"), zigzag(F.col("d")).alias("z"))
    z = z.join(z.groupBy("v", "b").agg(planes(F.max("z")).alias("n")), ["v", "b"])
    e = z.select("v", "b", "i", "z", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("plane"))
    return select.pack(e.select("v", "b", "plane", "i", bit(F.col("z"), F.col("plane").cast("int")).alias("bit")), ["v", "b", "plane"], msb_first=False)


@query(f"""WITH {CODES} SELECT c.v, c.b, c.t, c.h, c.w, c.q, {', '.join(f"coalesce(n_{n}.q, 0) AS n_{n}" for n in ('t', 'h', 'th', 'w', 'tw', 'hw', 'thw'))},
    coalesce(n_t.q, 0) + coalesce(n_h.q, 0) + coalesce(n_w.q, 0) + coalesce(n_thw.q, 0) - coalesce(n_th.q, 0) - coalesce(n_tw.q, 0) - coalesce(n_hw.q, 0) AS pred
    FROM q c {' '.join(f"LEFT JOIN q n_{n} ON n_{n}.v = c.v AND n_{n}.b = c.b AND n_{n}.t = c.t - {int('t' in n)} AND n_{n}.h = c.h - {int('h' in n)} AND n_{n}.w = c.w - {int('w' in n)}" for n in ('t', 'h', 'th', 'w', 'tw', 'hw', 'thw'))}""")
def causal_context(spark, d):
    return lorenzo.context(_codes(spark, d), ["v", "b"])


@query(f"WITH {E}, g AS (SELECT v, s, t, h, w, x - lag(x, 1, x) OVER (PARTITION BY v, h, w ORDER BY t) AS g_t, x - lag(x, 1, x) OVER (PARTITION BY v, t, w ORDER BY h) AS g_h, x - lag(x, 1, x) OVER (PARTITION BY v, t, h ORDER BY w) AS g_w FROM e) SELECT v, t, h, w, g_t, g_h, g_w, abs(g_t) AS a_t, abs(g_h) AS a_h, abs(g_w) AS a_w FROM g")
def recon_gradients(spark, d):
    return lorenzo.gradients(cube_e(spark, d), ["v"]).drop("s", "x")


@query(f"WITH {LORENZO}, l AS (SELECT *, q - lag(q, 1, 0) OVER (PARTITION BY v, b ORDER BY t, h, w) AS dd FROM d3) SELECT round(greatest(1.0::DOUBLE, avg(abs(q))), 6) AS q_scale, round(greatest(1.0::DOUBLE, avg(abs(dd))), 6) AS d_scale FROM l")
def context_scales(spark, d):
    return stats.context_scales(_codes(spark, d), ["t", "h", "w"], ["v", "b"]).select(F.round("q_scale", 6).alias("q_scale"), F.round("d_scale", 6).alias("d_scale"))


@query(f"WITH {LORENZO} SELECT v, b, CAST(min(d) AS BIGINT) AS d_min, CAST(max(d) AS BIGINT) AS d_max, CAST(sum(abs(d)) AS BIGINT) AS d_abs, count(*) FILTER (d = 0) AS zeros FROM d3 GROUP BY 1, 2")
def delta_block_stats(spark, d):
    return stats.block_stats(lorenzo.lorenzo(_codes(spark, d), ["v", "b"]), ["v", "b"])


@query(f"WITH {V}, k AS (SELECT v, t, x FROM c WHERE t % 3 = 0), j AS (SELECT c.v, c.t, c.x, max(k.t) FILTER (k.t <= c.t) AS a, min(k.t) FILTER (k.t >= c.t) AS b FROM c JOIN k ON k.v = c.v AND abs(k.t - c.t) < 6 GROUP BY 1, 2, 3) SELECT j.v, j.t, round(coalesce(CASE WHEN a = b THEN ka.x ELSE ka.x + (kb.x - ka.x) * (j.t - a) / (b - a) END, ka.x, kb.x), 6) AS y FROM j LEFT JOIN k ka ON ka.v = j.v AND ka.t = a LEFT JOIN k kb ON kb.v = j.v AND kb.t = b")
def keyframe_interp(spark, d):
    """Every third day kept, the others from the kept ones beside them, linearly."""
    return predict.interpolated(cube_v(spark, d), 3).withColumn("y", F.round("y", 6))


@query(f"WITH {E} SELECT v, t, h // 4 AS h, w // 4 AS w, round(avg(x), 9) AS x FROM e GROUP BY ALL")
def coarse_predict(spark, d):
    return layout.coarse_means(cube_e(spark, d), 4).select("v", "t", "h", "w", F.round("x", 9).alias("x"))


# entropy

SYM = f"{V}, y AS (SELECT v AS channel, CAST(round_even(x / 2.0, 0) AS BIGINT) AS symbol, t FROM c)"


def _symbols(spark, d):
    return cube_v(spark, d).select(F.col("v").alias("channel"), quantize(F.col("x"), 2.0).alias("symbol"), "t")


@query(f"""WITH {SYM}, n AS (SELECT channel, symbol, count(*) AS n FROM y GROUP BY 1, 2), f AS (SELECT channel, symbol, CAST(floor(sum(n) OVER o * (65536 - count(*) OVER a) / sum(n) OVER a) AS BIGINT) + row_number() OVER o AS high FROM n WINDOW o AS (PARTITION BY channel ORDER BY symbol), a AS (PARTITION BY channel))
    SELECT channel, symbol, CAST(coalesce(lag(high) OVER (PARTITION BY channel ORDER BY symbol), 0) AS BIGINT) AS low, CAST(high AS BIGINT) AS high FROM f""")
def symbol_cdf(spark, d):
    return entropy.empirical_cdf(_symbols(spark, d))


@query(f"WITH {SYM}, n AS (SELECT channel, symbol, count(*) AS n, sum(count(*)) OVER (PARTITION BY channel) AS a FROM y GROUP BY 1, 2) SELECT channel, round(sum(-n * log2(n / a)), 5) AS bits, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY 1")
def rate_bits(spark, d):
    return stats.rate_bits(_symbols(spark, d).withColumn("g", F.col("channel")), ["g"]).select(F.col("g").alias("channel"), F.round("bits", 5).alias("bits"), "n")


@query(f"WITH {E} SELECT v AS sid, count(*) AS n, CAST(0 AS BIGINT) AS wrong, true AS shorter FROM e GROUP BY 1")
def rans_roundtrip(spark, d):
    """Codes of each label through rANS and back: symbols, mismatches, and whether the stream is below 32 bits a symbol."""
    sym = cube_e(spark, d).select(F.col("v").alias("sid"), linear([(F.col("t"), 1), (F.col("h"), 8), (F.col("w"), 8)]).alias("i"), quantize(F.col("x"), 0.05).alias("q"), F.col("w").alias("channel"))
    model = entropy.empirical_cdf(sym.select("channel", F.col("q").alias("symbol")))
    rows, tables, first = entropy.tables_of(model)
    row_of = F.create_map(*[F.lit(x) for c, r in rows.items() for x in (c, r)])
    packed = sym.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("i", "q", row_of[F.col("channel")].alias("r")))).alias("e"))
    streams = packed.select("sid", F.transform("e", lambda e: e["q"]).alias("sym"), F.transform("e", lambda e: e["r"].cast("long")).alias("idx"))
    coded = entropy.encode_streams(streams, tables, first)
    back = entropy.decode_streams(coded.join(streams.select("sid", "idx"), "sid"), tables, first).withColumnRenamed("sym", "back")
    wrong = F.size(F.filter(F.zip_with("sym", "back", lambda a, b: a.eqNullSafe(b)), lambda x: ~x))
    both = streams.join(back, "sid").join(coded, "sid")
    return both.select("sid", F.size("sym").cast("long").alias("n"), wrong.cast("long").alias("wrong"), (F.length("payload") < 4 * F.size("sym")).alias("shorter"))


# codecs

BOUND = "SELECT count(*) AS patches, CAST(0 AS BIGINT) AS violating, true AS changed FROM embeddings"


def _class_pairs(spark, d):
    """(id, label, orig, recon): vectors and the means of their labels."""
    base = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("orig"))
    mean = vectors(spark, d).groupBy("label", "k").agg(F.avg("x").alias("y")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "y"))), lambda e: e["y"]).alias("recon"))
    return base.join(mean, "label")


@query(BOUND)
def corrector_bound_ok(spark, d):
    rows = _class_pairs(spark, d)
    basis = corrector.fit(rows, 0.02)
    back = corrector.decompress(rows.join(corrector.compress(rows, basis), "id"), basis)
    met = rows.join(back, "id")
    far = F.sqrt(F.aggregate(F.zip_with("orig", "fixed", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    return met.agg(F.count("*").alias("patches"), F.count_if(far > 0.02 * 8 * (1 + 1e-9)).alias("violating"), F.max(F.col("recon") != F.col("fixed")).alias("changed"))


@query("SELECT 64 AS components, true AS orthonormal, true AS falling")
def pca_basis_quality(spark, d):
    import numpy as np

    basis = corrector.fit(_class_pairs(spark, d), 0.02)
    u = basis.vectors
    count, sums, products = corrector.moments(_class_pairs(spark, d), 64, 0.02 * 8)
    power = np.einsum("ij,jk,ik->i", u, (products - np.outer(sums, sums) / count) / (count - 1), u)
    row = (len(u), bool(np.abs(u @ u.T - np.eye(64)).max() < 1e-8), bool((np.diff(power) < 1e-9).all()))
    return spark.createDataFrame([row], "components int, orthonormal boolean, falling boolean")


@query("SELECT label, count(*) AS n, true AS within FROM embeddings GROUP BY 1")
def residual_codec_roundtrip(spark, d):
    rows = _class_pairs(spark, d).withColumn("shape", F.array(F.lit(1), F.lit(8), F.lit(8)))
    coded = residual_codec.compress(rows, 0.02, 0.0, 1.0)
    met = rows.join(residual_codec.decompress(rows.join(coded, "id"), 0.0, 1.0), "id")
    sse = F.aggregate(F.zip_with("orig", "fixed", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    return met.groupBy("label").agg(F.count("*").alias("n"), (F.max(sse) <= 0.02**2 * 64 * (1 + 1e-5)).alias("within"))


@query("SELECT count(*) AS n, true AS smaller, true AS planes_ok FROM embeddings")
def residual_codec_stats(spark, d):
    rows = _class_pairs(spark, d).withColumn("shape", F.array(F.lit(1), F.lit(8), F.lit(8)))
    coded = residual_codec.compress(rows, 0.05, 0.0, 1.0)
    bytes_ = F.aggregate("streams", F.lit(0), lambda a, s: a + F.length(s))
    return coded.agg(F.count("*").alias("n"), (F.sum(bytes_) < F.lit(256) * F.count("*")).alias("smaller"), F.min(F.size("streams") == F.col("bit_count")).alias("planes_ok"))


@query("SELECT count(*) * 256 AS raw_bytes, true AS pays FROM embeddings")
def compression_ratio(spark, d):
    rows = _class_pairs(spark, d)
    basis = corrector.fit(rows, 0.05)
    found = stats.compression_ratio(corrector.compress(rows, basis), F.lit(table(spark, d, "embeddings").count() * 256), F.lit(64 * 64 * 8))
    return found.select("raw_bytes", (F.col("cr") > F.col("cr_with_meta")).alias("pays"))


@query("SELECT target, count(*) AS patches, CAST(0 AS BIGINT) AS over FROM embeddings, (SELECT unnest([0.1, 0.05, 0.02])::DOUBLE AS target) GROUP BY 1")
def sweep_targets(spark, d):
    rows, out = _class_pairs(spark, d), None
    for eps in (0.1, 0.05, 0.02):
        basis = corrector.fit(rows, eps)
        fixed = corrector.decompress(rows.join(corrector.compress(rows, basis), "id"), basis) if basis else rows.select("id", F.col("recon").alias("fixed"))
        far = F.sqrt(F.aggregate(F.zip_with("orig", "fixed", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
        one = rows.join(fixed, "id").agg(F.lit(eps).alias("target"), F.count("*").alias("patches"), F.count_if(far > eps * 8 * (1 + 1e-9)).alias("over"))
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT CAST(20 AS BIGINT) AS frames, CAST(0 AS BIGINT) AS missing, true AS within")
def archive_roundtrip(spark, d):
    """A synthetic field compressed to an archive, read back from its files alone, and compared."""
    from cubeweave.plans.compressor import compress, decompress, verify
    from cubeweave.scratch import new_path
    from cubeweave.sources.raw import frames_of_cells, synthetic

    shape = (1, 1, 20, 64, 64)
    frames, path = frames_of_cells(synthetic(spark, shape), 64), new_path(spark, "archive")
    compress(frames, shape, path, eps=1e-4, block=(64, 64))
    return verify(frames, decompress(spark, path)).select("frames", "missing", (F.col("nrmse") <= 1e-4 + 1.2e-7).alias("within"))


# frames of a stream's table


@query("SELECT event_type, epoch(date_trunc('day', ts))::BIGINT AS day, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY 1, 2")
def event_frames(spark, d):
    from cubeweave.streaming.frames import daily_frames

    return daily_frames(table(spark, d, "events")).select("event_type", (F.datediff(F.col("start").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400).alias("day"), "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


# scalar functions


@query("SELECT CAST(i // 4096 AS BIGINT) AS t, CAST(i // 64 % 64 AS BIGINT) AS h, CAST(i % 64 AS BIGINT) AS w, round(sin(h * 2 * pi() / 63) * cos(w * 2 * pi() / 63) * cos(0.1 * t * 4 * pi() / 4) + 0.3 * sin(2 * h * 2 * pi() / 63 + 0.05 * t * 4 * pi() / 4), 3) + 0.0 AS x FROM (SELECT i, i // 4096 AS t, i // 64 % 64 AS h, i % 64 AS w FROM range(5 * 4096) r(i))")
def synthetic_field(spark, d):
    from cubeweave.sources.raw import synthetic

    return synthetic(spark, (1, 1, 5, 64, 64)).select("t", "h", "w", (F.round("x", 3) + 0.0).alias("x"))


SCALES = [0.1, 0.25, 0.5, 1.0, 2.5, 8.0, 20.0]


@query(f"WITH {V} SELECT v, t, CAST(len(list_filter({SCALES[:-1]}::DOUBLE[], lambda s: s < greatest(x / 50, 0.1))) AS INTEGER) AS row FROM c")
def scale_rows(spark, d):
    from cubeweave.functions.codes import scale_row

    return cube_v(spark, d).select("v", "t", scale_row(F.col("x") / 50, SCALES).alias("row"))


@query(f"WITH {V} SELECT v, t, round_even(x - 0.25, 0) + 0.25 AS q, least(greatest(x, 45.0), 55.0) AS c FROM c")
def quantize_around_offset(spark, d):
    from cubeweave.functions.codes import clamp, quantize_around

    return cube_v(spark, d).select("v", "t", quantize_around(F.col("x"), 0.25).alias("q"), clamp(F.col("x"), 45.0, 55.0).alias("c"))


@query(f"WITH {V} SELECT v, count(*) AS n, true AS near FROM c GROUP BY 1")
def normal_rate(spark, d):
    """Bits under a normal model: the column function against math.erfc in an Arrow function."""
    import pandas as pd

    from cubeweave.functions.codes import normal_likelihood

    def exact(batches):
        for b in batches:
            yield pd.DataFrame({"v": b.v, "near": [abs(p - entropy.likelihood(x, s)) <= 2e-7 for p, x, s in zip(b.p, b.x, b.s, strict=True)]})

    q = cube_v(spark, d).select("v", F.rint(F.col("x") - 50).alias("x"), (1 + F.col("t") / 4).alias("s"))
    rows = q.select("v", "x", "s", normal_likelihood(F.col("x"), F.col("s")).alias("p"))
    return rows.mapInPandas(exact, "v string, near boolean").groupBy("v").agg(F.count("*").alias("n"), F.min("near").alias("near"))


# files


@query(f"WITH {E} SELECT v, s, t, h, w, x FROM e WHERE t < 30")
def raw_file_roundtrip(spark, d):
    """Ten labels of 30 frames written as one headerless float32 file and read back by ranges of frames."""
    from cubeweave.scratch import new_path
    from cubeweave.sources.raw import cells_of_frames, frames_of_cells, read_raw, write_raw

    cells, path = layout.tail_trim(cube_e(spark, d), 30), new_path(spark, "raw")
    write_raw(frames_of_cells(cells, 8), path)
    return cells_of_frames(read_raw(spark, path, (10, 1, 30, 8, 8)), 8)


@query(f"WITH {E} SELECT v, s, t, h, w, x FROM e")
def raw_file_roundtrip_all(spark, d):
    """All frames of all labels in one headerless float32 file, label after label; raw_file_roundtrip has 30 of each."""
    from pyspark.sql import Window

    from cubeweave.scratch import new_path
    from cubeweave.sources.raw import cells_of_frames, frames_of_cells, read_raw, write_raw

    frames, path = frames_of_cells(cube_e(spark, d), 8), new_path(spark, "raw")
    write_raw(frames, path)
    lengths = frames.groupBy("v").agg(F.count("*").alias("n"))
    spans = lengths.select(F.col("v").alias("label"), (F.sum("n").over(Window.orderBy("v")) - F.col("n")).alias("start"), "n")
    read = read_raw(spark, path, (1, 1, frames.count(), 8, 8))
    met = read.join(F.broadcast(spans), (F.col("t") >= F.col("start")) & (F.col("t") < F.col("start") + F.col("n")))
    return cells_of_frames(met.select(F.col("label").cast("long").alias("v"), "s", (F.col("t") - F.col("start")).alias("t"), "data"), 8)


@query("SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS sid, CAST(256 AS INTEGER) AS bytes FROM embeddings")
def stream_file_roundtrip(spark, d):
    from cubeweave.scratch import new_path, shared_dir
    from cubeweave.sources.files import load_streams, save_streams
    from cubeweave.sources.raw import filesystem

    path = new_path(spark, "streams")
    files, target = filesystem(path)
    files.create_dir(target.rpartition("/")[0], recursive=True)
    data = table(spark, d, "embeddings").select(F.col("vec_id").alias("sid"), F.encode(F.rpad(F.hex("vec_id"), 256, "0"), "UTF-8").alias("payload"))
    save_streams(data, path)
    assert path.startswith(shared_dir(spark))
    return load_streams(spark, path).select("sid", F.length("payload").alias("bytes"))


@query("SELECT CAST(v AS BIGINT) AS id, true AS same FROM (SELECT DISTINCT label AS v FROM embeddings)")
def biased_codec_roundtrip(spark, d):
    """Codes of each label, 8 x 8 by time, through the biased residual codec, a container file, and back."""
    from cubeweave.operators import biased_codec
    from cubeweave.scratch import new_path
    from cubeweave.sources.files import load_container, save_container
    from cubeweave.sources.raw import filesystem

    k = linear([(F.col("t"), 1), (F.col("h"), 8), (F.col("w"), 8)])
    rows = cube_e(spark, d).select(F.col("v").alias("id"), k.alias("k"), quantize(F.col("x"), 0.05).alias("q")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda e: e["q"]).alias("q"))
    blocks = rows.withColumn("shape", F.array((F.size("q") / 64).cast("int"), F.lit(8), F.lit(8)))
    weights = biased_codec.fit_bias(blocks)
    path = new_path(spark, "container")
    files, target = filesystem(path)
    files.create_dir(target.rpartition("/")[0], recursive=True)
    save_container(path, {"weights": weights.tolist()}, biased_codec.compress(blocks, weights).withColumn("step", F.lit(0.05)))
    head, coded = load_container(spark, path)
    import numpy as np

    back = biased_codec.decompress(coded.join(blocks.select("id", "shape"), "id"), np.array(head["weights"])).withColumnRenamed("q", "back")
    return blocks.join(back, "id").select("id", (F.col("q") == F.col("back")).alias("same"))


@query("SELECT 0.02::DOUBLE AS target, true AS holds, true AS largest")
def global_step(spark, d):
    """One quantiser step for all residuals: it holds the bound, and a step a hundredth larger doesn't."""
    from cubeweave.operators import biased_codec

    pairs = _pairs(spark, d).select("x", "y")
    step, span = biased_codec.global_step(pairs, 0.02)
    r = F.col("x") - F.col("y")
    error = lambda st: F.sqrt(F.avg(F.pow(r - F.rint(r / st) * st, 2))) / span
    return pairs.agg(F.lit(0.02).alias("target"), (error(step) <= 0.02).alias("holds"), (error(step * 1.01) > 0.02).alias("largest"))


@query(f"WITH {E} SELECT v AS sid, count(*) AS n, CAST(0 AS BIGINT) AS wrong FROM e GROUP BY 1")
def rans_gaussian_roundtrip(spark, d):
    """Codes under normal tables chosen by scale, with escapes."""
    scales, tables, offset = entropy.gaussian_tables(16, support=5)
    from cubeweave.functions.codes import scale_row

    sym = cube_e(spark, d).select(F.col("v").alias("sid"), linear([(F.col("t"), 1), (F.col("h"), 8), (F.col("w"), 8)]).alias("i"), quantize(F.col("x"), 0.02).alias("q"), scale_row(1 + F.col("w") / 2, scales).alias("r"))
    packed = sym.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("i", "q", "r"))).alias("e"))
    streams = packed.select("sid", F.transform("e", lambda e: e["q"]).alias("sym"), F.transform("e", lambda e: e["r"].cast("long")).alias("idx"))
    back = entropy.decode_streams(entropy.encode_streams(streams, tables, offset).join(streams.select("sid", "idx"), "sid"), tables, offset).withColumnRenamed("sym", "back")
    wrong = F.size(F.filter(F.zip_with("sym", "back", lambda a, b: a.eqNullSafe(b)), lambda x: ~x))
    return streams.join(back, "sid").select("sid", F.size("sym").cast("long").alias("n"), wrong.cast("long").alias("wrong"))
