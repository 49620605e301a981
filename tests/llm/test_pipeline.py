"""The pipeline at the smallest size: every stage, and all of them, against brute force."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cubeweave.llm import mixing, queries, quality, sentencepieces, simhash
from cubeweave.scratch import materialize

SF = "/root/testdata/sf0.001"


def in_order(docs):
    """doc_ids in the order of the mixture, a slot after the other: [(doc_id, source)] of whole documents."""
    by = defaultdict(list)
    for r in docs:
        by[r["source"]].append(r["doc_id"])
    for s in by:
        by[s].sort(key=lambda i: (i % 2147483647 * 1103515245 % 2147483648, i))
    tickets = {s: queries.MIX_TICKETS.get(s, 1) for s in by}
    blocks = {s: [x[i : i + mixing.BLOCK_ROWS] for i in range(0, len(x), mixing.BLOCK_ROWS)] for s, x in by.items()}
    done, base, t, start, out = dict.fromkeys(by, 0), dict.fromkeys(by, 0), 0, 0, []
    live = sorted(by)
    while live:
        total = sum(tickets[s] for s in live)
        open_ = [(-(-(done[s] - base[s] + 1) * total // tickets[s]), s) for s in live if (done[s] - base[s]) * total // tickets[s] <= t - start]
        s = min(open_)[1]
        out += blocks[s][done[s]]
        done[s] += 1
        t += 1
        if done[s] == len(blocks[s]):
            live, start, base = [x for x in live if x != s], t, dict(done)
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4
    good = {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()}
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert first.columns == docs.columns and {r["doc_id"] for r in first.collect()} == good
    one = corpus_pipeline.STAGES[1][1](spark, first, SF)
    sets = {r["doc_id"]: set(simhash.Shingler()(r["text"]).tolist()) for r in first.collect()}
    kept = {r["doc_id"] for r in one.collect()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert not any(alike(a, b) for a in kept for b in kept if a < b)
    assert all(any(alike(a, b) for b in good if b < a) for a in good - kept)
    mixture = materialize(corpus_pipeline.STAGES[2][1](spark, one, SF), "mixture")
    want = in_order(one.collect())
    assert mixture.columns == docs.columns and [r["doc_id"] for r in mixing.with_places(mixture).orderBy("place").collect()] == want
    model = sentencepieces.ChunkTable(queries.tokenizer("piece_bpe_32k.model")).model
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).orderBy("place").collect()
    assert [r["doc_id"] for r in got] == want and [r["place"] for r in got] == list(range(len(want)))
    for r in got:
        ids = model.encode(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("rows", [0, 40])
def test_stages_bear_odd_tables(spark, rows):
    words = [f"w{i}" for i in range(50)]
    text = lambda i: None if i % 9 == 0 else "" if i % 9 == 1 else " ".join(words[i % 7 :] + [f"own{i}"] * (i % 3)) + "\n" * (i % 2)
    data = [(None if i % 11 == 0 else i // 2, text(i), None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None) for i in range(rows)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("__text", "__file", "__row", "place", "slot", "node", "grp", "bucket", "word", "kept"):
        docs = docs.withColumn(c, F.lit(None).cast("string"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), materialize(stage(spark, docs, SF), name)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() <= before
        if name == "mixing":
            assert docs.count() == before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r["place"] for r in last) == list(range(docs.count())) and bool(last) == bool(rows)


def test_every_query_runs_and_is_stable(spark):
    for name in ("op1_kd_tree_shards", "op4_url_templates", "op8_perspectives"):
        a, b = (sorted(map(str, queries.QUERIES[name](spark, SF).collect())) for _ in range(2))
        assert a == b and a
