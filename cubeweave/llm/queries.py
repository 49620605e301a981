"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeweave.llm.chat import render
from cubeweave.llm.html_tree import extract
from cubeweave.llm.mixing import BLOCK_ROWS, mix
from cubeweave.llm.quality import POLICIES, RULES, ablations, judge, mask, stored_ledger
from cubeweave.llm.sentencepieces import encode_documents
from cubeweave.llm.sharding import shard_documents
from cubeweave.llm.simhash import near_duplicates
from cubeweave.llm.topk import top_k
from cubeweave.llm.url_templates import filter_urls
from cubeweave.llm.warc import round_trip


#: Target weights of the mixture, in tickets; other sources have one.
MIX_TICKETS = {"src1": 2, "src2": 3}


#: The contract's rules.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Those of op4's SQL, which is left as it was: it blocks net/de/, where the contract allows it.
URL_RULES_OF_SQL = (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes."""
    return shard_documents(table(spark, sf_dir, "documents"), leaves=16)


def op2_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to."""
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_simhash_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def near_duplicate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of op6's classes, audited against exact search: a sample of texts against all of them."""
    found = near_duplicates(table(spark, sf_dir, "documents"), audit=True)
    return found.agg(F.count("*").alias("documents"), F.count_distinct("class_id").alias("classes"), F.min("audited_recall").alias("recall"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return round_trip(table(spark, sf_dir, "pages"), least_bytes=0)


def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as each of its participants sees it; masks as start-end pairs, joined by commas."""
    found = render(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.withColumn("masks", spans)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of every whole text, and the verdicts of two policies on the stored ledger."""
    found = judge(table(spark, sf_dir, "documents"), others=("v2",))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_v2", "n_lines", "fail_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy costs, over the stored ledger of all documents."""
    rows = stored_ledger(table(spark, sf_dir, "documents"))
    return reduce(DataFrame.unionAll, [ablations(rows, p).select(F.lit(p).alias("policy"), "*") for p in ("base", "v1", "v2")])


def op9_pfair_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a mixture with the weights of MIX_TICKETS."""
    return mix(table(spark, sf_dir, "documents"), MIX_TICKETS)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of each vector whose vec_id is divisible by 100, against all others."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kd_tree_shards": op1_kd_tree_shards,
    "op2_style_tree": op2_style_tree,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_url_templates": op4_url_templates,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash_graph": op6_simhash_graph,
    "op7_warc": op7_warc,
    "op8_perspectives": op8_perspectives,
    "op9_pfair_mixture": op9_pfair_mixture,
    "op10_exact_top_k": op10_exact_top_k,
    "quality_ablations": quality_ablations,
    "near_duplicate_recall": near_duplicate_recall,
}


def url_sql() -> str:
    """op4 in SQL: the template tree, a level after the other."""
    cases = sorted(URL_RULES_OF_SQL, key=lambda r: -len(r[1]))
    fits = lambda r: f"((host = '{r.split('/', 1)[0]}' OR ends_with(host, '.{r.split('/', 1)[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}'))"
    pick = lambda i: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[i]}'" for r in cases) + " END"
    return f"""
        WITH RECURSIVE u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
        , h AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
        , r AS (
            SELECT page_id, host, path, {pick(1)} AS rule, {pick(0)} AS label,
                   list_transform(string_split(regexp_replace(path, '^/', ''), '/'),
                       lambda x: CASE WHEN regexp_full_match(x, '[0-9a-f]{{8,}}') AND regexp_matches(x, '[a-f]') AND regexp_matches(x, '[0-9]') THEN '<h>' ELSE regexp_replace(x, '[0-9]+', '<n>', 'g') END) AS shape
            FROM h)
        , l AS (
            SELECT host, shape, count(*) AS n, count(*) FILTER (label = 'block') AS b, count(*) FILTER (label = 'allow') AS a, '' AS parent, '' AS tpl, 0 AS i, false AS done FROM r GROUP BY host, shape
            UNION ALL
            SELECT host, shape, n, b, a, CASE WHEN inside THEN tpl ELSE parent END,
                   CASE WHEN NOT inside THEN tpl WHEN shapes = 1 THEN tpl || '/' || array_to_string(shape[i + 1 :], '/') WHEN kids >= 8 AND 2 * kids > urls THEN tpl || '/*' ELSE tpl || '/' || shape[i + 1] END,
                   i + 1, NOT inside OR shapes = 1
            FROM (
                SELECT *, len(shape) > i AS inside, count(DISTINCT CASE WHEN len(shape) > i THEN shape[i + 1] END) OVER w AS kids,
                       sum(CASE WHEN len(shape) > i THEN n END) OVER w AS urls, count(CASE WHEN len(shape) > i THEN 1 END) OVER w AS shapes
                FROM l WHERE NOT done WINDOW w AS (PARTITION BY host, tpl)))
        , k AS (SELECT * FROM l WHERE done)
        , t AS (SELECT host, parent, tpl, sum(b) AS b, sum(a + b) AS n FROM k GROUP BY 1, 2, 3 HAVING sum(a + b) > 0)
        , o AS (SELECT *, sum(b) OVER w - b AS b2, sum(n) OVER w - n AS n2, sum(b) OVER w / sum(n) OVER w AS p FROM t WINDOW w AS (PARTITION BY host, parent))
        , j AS (SELECT *, coalesce(round(pow(b / n - b2 / nullif(n2, 0), 2) / nullif(p * (1 - p) * (1 / n + 1 / nullif(n2, 0)), 0), 9) > 3.841, false) AS differs FROM o)
        , g AS (SELECT *, CASE WHEN differs THEN tpl ELSE '' END AS branch FROM j)
        , d AS (SELECT host, tpl, sum(n) OVER w >= 5 AND round(sum(b) OVER w / (sum(n) OVER w + 4.0::DOUBLE), 9) >= 0.8 AS bad FROM g WINDOW w AS (PARTITION BY host, parent, differs, branch))
        , v AS (SELECT k.host, k.shape, k.tpl AS template, CASE WHEN d.bad THEN 'block' ELSE 'allow' END AS method FROM k LEFT JOIN d ON k.host = d.host AND k.tpl = d.tpl)
        SELECT page_id, r.host, path, rule, coalesce(label, method) AS verdict, template FROM r JOIN v ON r.host = v.host AND r.shape = v.shape
    """


def sharding_sql() -> str:
    """op1 in SQL: four levels of splits at the row whose middle is nearest half of its node's bytes."""
    table_ = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ 0xEDB88320 if n & 1 else n >> 1
        table_.append(n)
    code = lambda c: f"CASE WHEN {c} IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY {c}) - 1 END"
    levels = ""
    for i in range(4):
        share = lambda d: f"(max(l{i}.{d}) OVER n - min(l{i}.{d}) OVER n) / any_value(w.{d}) OVER n"
        levels += f"""
        , a{i} AS (SELECT l{i}.*, {share('d1')} AS w1, {share('d2')} AS w2, {share('d3')} AS w3, {share('d4')} AS w4 FROM l{i}, w WINDOW n AS (PARTITION BY shard))
        , b{i} AS (SELECT *, CASE greatest(w1, w2, w3, w4) WHEN w1 THEN d1 WHEN w2 THEN d2 WHEN w3 THEN d3 ELSE d4 END AS d FROM a{i})
        , l{i + 1} AS (
            SELECT doc_id, crc, d1, d2, d3, d4, shard * 2 + CASE WHEN 2 * (sum(d1) OVER o - d1) + d1 <= sum(d1) OVER (PARTITION BY shard) THEN 0 ELSE 1 END AS shard
            FROM b{i} WINDOW o AS (PARTITION BY shard ORDER BY d, d4 ROWS UNBOUNDED PRECEDING))"""
    return f"""
        WITH x AS (SELECT *, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents)
        , l0 AS (
            SELECT doc_id, len(bytes) + 1 AS d1, {code('lang')} AS d2, {code('source')} AS d3, doc_id AS d4, 0 AS shard,
                   xor(list_reduce(bytes, lambda c, b: xor(c >> 8, ({table_}::BIGINT[])[CAST(xor(c, b) & 255 AS INTEGER) + 1]), 4294967295::BIGINT), 4294967295) AS crc
            FROM x)
        , w AS (SELECT {', '.join(f'CAST(greatest(1, max({d}) - min({d})) AS DOUBLE) AS {d}' for d in ('d1', 'd2', 'd3', 'd4'))} FROM l0){levels}
        SELECT doc_id, CAST(d1 AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
               row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM l4
    """


def mixing_sql() -> str:
    """op9 in SQL: the schedule a slot after the other, all sources' counters in lists."""
    tickets = " ".join(f"WHEN '{s}' THEN {a}" for s, a in MIX_TICKETS.items())
    pick = "list_min(list_filter(list_transform(range(1, len(done) + 1), lambda i: CASE WHEN done[i] < n[i] AND (done[i] - base[i]) * total // a[i] <= t - start THEN ((done[i] - base[i] + 1) * total + a[i] - 1) // a[i] * 1000000 + i END), lambda x: x IS NOT NULL)) % 1000000"
    return f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY (doc_id % 2147483647) * 1103515245 % 2147483648, doc_id) - 1 AS r FROM documents),
        s AS (SELECT source, (count(*) + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} AS n, CASE source {tickets} ELSE 1 END AS a FROM documents GROUP BY 1),
        p AS (SELECT list(n ORDER BY source) AS n, list(a ORDER BY source) AS a, list(source ORDER BY source) AS names, CAST(list_sum(list(a)) AS BIGINT) AS whole FROM s),
        sim AS (
            SELECT CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS start, list_transform(n, lambda x: CAST(0 AS BIGINT)) AS done, list_transform(n, lambda x: CAST(0 AS BIGINT)) AS base, whole AS total,
                   CAST(NULL AS BIGINT) AS who, CAST(NULL AS BIGINT) AS k, CAST(NULL AS BIGINT) AS release, CAST(NULL AS BIGINT) AS deadline FROM p
            UNION ALL
            SELECT t + 1, CASE WHEN over THEN t + 1 ELSE start END, after, CASE WHEN over THEN after ELSE base END,
                   CASE WHEN over THEN CAST(coalesce(list_sum(list_transform(range(1, len(after) + 1), lambda i: CASE WHEN after[i] < n[i] THEN a[i] ELSE 0 END)), 0) AS BIGINT) ELSE total END,
                   who, after[who] - 1, start + (after[who] - 1 - base[who]) * total // a[who], start + ((after[who] - base[who]) * total + a[who] - 1) // a[who]
            FROM (SELECT *, after[who] = n[who] AS over FROM (
                SELECT *, list_transform(range(1, len(done) + 1), lambda i: CASE WHEN i = who THEN done[i] + 1 ELSE done[i] END) AS after
                FROM (SELECT t, start, done, base, total, n, a, CAST({pick} AS BIGINT) AS who FROM sim, p WHERE total > 0))))
        SELECT doc_id, d.source, k AS block, t - 1 AS slot, r % {BLOCK_ROWS} AS place, release, deadline
        FROM d, p, sim WHERE sim.who IS NOT NULL AND names[sim.who] = d.source AND k = r // {BLOCK_ROWS}
    """


#: The measurements and failure bits of op5, as table f.
LEDGER_SQL = r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (
            SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
                   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
            FROM d
        ), g AS (
            SELECT doc_id, i, list_reduce(w[i : i + 4], lambda a, b: a || ' ' || b) AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
        ), twice AS (
            SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
        ), r AS (
            SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY 1
        ), m AS (
            SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                   CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                   CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines
            FROM w LEFT JOIN r ON w.doc_id = r.doc_id
        ), f AS (
            SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (n_symbols > n_words)::INT
                + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (word_chars > 40 * n_words)::INT + 32 * (word_chars < n_words * 3 // 2)::INT AS BIGINT) AS fail_bits FROM m
        )
"""


def ablations_sql() -> str:
    """What follows LEDGER_SQL to count each policy's rules."""
    bits = {r.name: 1 << r.bit for r in RULES}
    pairs = ", ".join(f"('{p}', {mask(p)}, '{r}', {bits[r]})" for p in ("base", "v1", "v2") for r in POLICIES[p])
    return f"""
        SELECT policy, rule, count(*) FILTER (fail_bits & bit <> 0) AS failed, count(*) FILTER (fail_bits & whole = bit) AS rejected_alone,
               count(*) FILTER (fail_bits & whole = 0) AS kept_with, count(*) FILTER (fail_bits & whole & ~bit = 0) AS kept_without
        FROM f, (VALUES {pairs}) AS p(policy, whole, rule, bit) GROUP BY policy, rule
    """


ORACLES: dict[str, str] = {
    "op1_kd_tree_shards": sharding_sql(),
    "op4_url_templates": url_sql(),
    "op5_quality_rules": LEDGER_SQL + "SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits & 15 = 0 AS kept_v2 FROM f",
    "quality_ablations": LEDGER_SQL + ablations_sql(),
    "op6_simhash_graph": r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        n AS (SELECT t, min(doc_id) AS node FROM d GROUP BY t),
        w AS (SELECT node, regexp_extract_all(t, '[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+') AS w FROM n),
        s AS (
            SELECT DISTINCT node, list_reduce(w[i : i + 4], lambda x, y: x || ' ' || y) AS s
            FROM (SELECT node, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
        ), f AS (SELECT s, row_number() OVER (ORDER BY count(*), s) AS r FROM s GROUP BY s HAVING count(*) > 1),
        z AS (SELECT node, count(*) AS n FROM s GROUP BY node),
        k AS (SELECT node, r FROM s JOIN f USING (s)),
        p AS (
            SELECT k.node, k.r, z.n FROM k JOIN z USING (node)
            QUALIFY row_number() OVER (PARTITION BY k.node ORDER BY k.r) <= z.n - ceil(0.8 * z.n - 1e-9) + 1
        ), c AS (
            SELECT DISTINCT a.node AS a, b.node AS b, a.n AS m, b.n AS n FROM p a JOIN p b ON a.r = b.r AND a.node < b.node
            WHERE least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9
        ), l AS (
            SELECT a, b FROM c JOIN k x ON x.node = a JOIN k y ON y.node = b AND y.r = x.r
            GROUP BY a, b, m, n HAVING count(*) >= 0.8 * (m + n - count(*)) - 1e-9
        ), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        g AS (SELECT node, node AS root FROM n UNION SELECT e.b, g.root FROM g JOIN e ON g.node = e.a WHERE g.root < e.b),
        h AS (SELECT node, min(root) AS root FROM g GROUP BY node)
        SELECT doc_id, h.root AS class_id, doc_id = h.root AS kept FROM d JOIN n USING (t) JOIN h USING (node)
    """,
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
        SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(1 + ((CAST('0x' || substr(d, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f
    """,
    "op8_perspectives": r"""
        WITH t AS (
            SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS pos
            FROM conversations
        ), v AS (
            SELECT t.*, s.speaker, t.role = s.speaker AS own,
                   CASE WHEN t.role = s.speaker THEN '<|assistant|>' || chr(10)
                        ELSE '<|user name=' || replace(replace(replace(t.role, '\', '\\'), '|', '\p'), chr(10), '\n') || '|>' || chr(10) END AS head,
                   replace(replace(t.text, '<\', '<\\'), '<|', '<\|') || '<|end|>' || chr(10) AS body
            FROM t JOIN (SELECT DISTINCT conv_id, role AS speaker FROM t) s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
        ), o AS (
            SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, pos // 64 ORDER BY pos) AS e FROM v
        )
        SELECT conv_id, speaker, CAST(pos // 64 AS BIGINT) AS part, count(*) AS n_turns, count(*) FILTER (own) AS n_trained,
               string_agg(head || body, '' ORDER BY pos) AS text,
               coalesce(string_agg(CAST(CAST(e - length(body) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(e AS BIGINT) AS VARCHAR), ',' ORDER BY pos) FILTER (own), '') AS masks
        FROM o GROUP BY conv_id, speaker, pos // 64
    """,
    "op9_pfair_mixture": mixing_sql(),
    "op10_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), t AS (
            SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
            FROM t q JOIN t c ON q.i = c.i AND q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0 GROUP BY ALL
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s
        )
        SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
    """,
}
ORACLES["near_duplicate_recall"] = f"SELECT count(*) AS documents, count(DISTINCT class_id) AS classes, 1.0::DOUBLE AS recall FROM ({ORACLES['op6_simhash_graph']})"
