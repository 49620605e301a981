"""SimHash near-duplicate removal with navigable small-world graphs over Hamming distance.

1. Every text gets a 256-bit SimHash of its set of word 5-grams and eight min-wise hashes of that set. Equal texts
   become one node.
2. Nodes are dealt into shards by each min-wise hash in turn: two texts of similarity 0.8 meet in no shard with
   probability 0.2**8. Nodes that share a hash with no other are dealt nowhere. A hash that very many nodes share is
   cut over several shards, which have a sample of its nodes in common.
3. A shard builds a navigable small-world graph of its nodes and searches it with all of them, from entry points
   that share their hash. Beams expand while they hold nothing but near nodes. The recall of a sample is audited
   against exact search; where it is not whole, beams are doubled, at last up to the shard.
4. The edges that a shard finds between nodes of different groups fall into connected sets. A set goes by a hash of its
   nodes, so one that several shards find, or that has been verified before, counts once. Its nodes meet again with
   their sets of shingles, are verified exactly, by shared shingles, and give a spanning forest of the links that
   are true. So what moves grows with the nodes of a connected set, and never with its pairs.
5. Links are united to groups. Steps 2 to 5 run twice: first with some of the hashes, then with all, but only
   those that nodes of several groups share.
6. Nodes of a hash that was cut, if several groups still share it, meet again by an exact prefix filter: of two
   similar sets the first 0.2 n + 1 shingles in any one order have one in common. The order begins with shingles
   that few of these nodes have, so no bucket is cut. Nodes with fewer of those than that meet by their min-wise
   hashes, every cut with every other. Within a bucket of up to 2 HOT_NODES nodes fingerprints are compared exactly.
7. If asked, the result is audited against exact search: a sample of nodes is compared with all nodes, and of the pairs
   that are similar by their shingles the share is given that fell in one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeweave.components import components
from cubeweave.rowkeys import with_row_keys
from cubeweave.scratch import drop_table, materialize
from cubeweave.workers import bounded_batches

WORDS, SIMILARITY = 5, 0.8
HASHES, FIRST = 8, 3  # min-wise hashes; how many the first pass uses
FP = ("f0", "f1", "f2", "f3")
#: At similarity 0.8 fingerprints differ in 38 +- 6 of 256 bits, those of FEW shingles or less in up to 48 +- 6,
#: unrelated ones in 128 +- 8. Pairs up to NEAR are searched; of larger sets, those up to NEAR_LARGE count.
NEAR, NEAR_LARGE, FEW = 74, 62, 24
#: Nodes dealt to a shard, and nodes of one hash before it is cut; nodes that its shards have in common.
SHARD_NODES, HOT_NODES, COMMON = 1024, 800, 32
BEAM, LINKS, OLD_LINKS = 16, 16, 4
AUDIT = 128
#: Nodes that are compared with all, and pairs of them that are looked at, when the result is audited.
AUDITED, AUDITED_PAIRS = 256, 4096
#: Keys of texts to verify up to which they are broadcast (at about 150 bytes); beyond, the texts are shuffled.
BROADCAST_KEYS = 100_000
#: Nodes that are verified in one go; a set of more than a quarter of that goes alone.
VERIFIED = 512
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a word up to which its hash is a sum of TABLE's numbers; bytes of a text that are hashed in one go.
LONG_WORD, HASHED_BYTES = 64, 1 << 20
#: A random number for each place in a word and each byte there; none for the space, so what stands behind a word adds nothing.
TABLE = mix(np.arange(1, LONG_WORD * 256 + 1, dtype=np.uint64) * MULTIPLIER).reshape(LONG_WORD, 256)
TABLE[:, 0x20] = 0
TABLE = TABLE.ravel()
#: Of ASCII, what str.split() takes for white space, as spaces.
SPACES = bytes(0x20 if chr(c).isspace() else c for c in range(128)) + bytes(range(128, 256))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, as str.split() finds them, in order."""
    raw = text.encode().translate(SPACES) if text.isascii() else " ".join(text.split()).encode("utf-8", "surrogatepass")
    out, at = [], 0
    while at < len(raw):
        end = raw.find(b" ", at + HASHED_BYTES) if at + HASHED_BYTES < len(raw) else -1
        end = len(raw) if end < 0 else end
        out.append(_word_hashes(raw[at:end]))
        at = end
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint64)


def _word_hashes(raw: bytes) -> np.ndarray:
    codes = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(codes != 0x20, prepend=False, append=False))
    starts, size = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    codes, begin = codes[starts[0] :], starts - starts[0]
    place = np.arange(len(codes)) - np.repeat(begin, np.diff(begin, append=len(codes)))
    out = np.add.reduceat(TABLE[np.minimum(place, LONG_WORD - 1) * 256 + codes], begin)
    long = np.flatnonzero(size > LONG_WORD)
    if len(long):
        from xxhash import xxh64_intdigest

        out[long] = np.array([xxh64_intdigest(raw[starts[k] : starts[k] + size[k]]) for k in long], np.uint64)
    return out


class Shingler:
    """Sets of 64-bit hashes of word 5-grams. A text of fewer words is one shingle; without words it has none."""

    def __call__(self, text: str) -> np.ndarray:
        w = word_hashes(text)
        if not len(w):
            return w
        if len(w) < WORDS:
            out = np.array([len(w)], np.uint64)
            for x in w:
                out = mix(out * MULTIPLIER + x)
            return out
        out = w[: len(w) - WORDS + 1].copy()
        for k in range(1, WORDS):
            out *= MULTIPLIER
            out += w[k : len(w) - WORDS + 1 + k]
        out = np.sort(mix(out))
        return out[np.r_[True, out[1:] != out[:-1]]]


_seeds = mix(np.arange(1, 13, dtype=np.uint64) * MULTIPLIER)


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """256 bits as four numbers: each the majority of that bit in the shingles' hashes."""
    counts = np.zeros(256, np.int64)
    for at in range(0, len(shingles), 255):  # as many as a byte can count: bits are summed eight bytes at a time
        bits = np.unpackbits(mix(shingles[at : at + 255, None] ^ _seeds[None, :4]).view(np.uint8), axis=1)
        counts += bits.view(np.uint64).sum(axis=0).view(np.uint8)
    return np.packbits(2 * counts > len(shingles)).view(np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest of the shingles under each of the hash orders."""
    parts = (shingles[None, at : at + 4096] ^ _seeds[4 : 4 + HASHES, None] for at in range(0, len(shingles), 4096))
    return np.min([mix(p).min(axis=1) for p in parts], axis=0)


def features(keyed: DataFrame, doc: str, text: str) -> DataFrame:
    """Keys of each row, digest of its text, number of shingles, fingerprint and min-wise hashes."""
    names = ["n", *FP, *(f"h{i}" for i in range(HASHES))]
    given = keyed.select(F.col(doc).cast("long").alias("doc_id"), F.col("__file"), F.col("__row"), F.md5(F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")).alias("digest"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = np.zeros((part.num_rows, len(names)), np.int64)
                for i, t in enumerate(part.column(4).to_pylist()):
                    s = shingler(t)
                    out[i, 0] = len(s)
                    if len(s):
                        out[i, 1:5] = fingerprint(s).view(np.int64)
                        out[i, 5:] = minima(s).view(np.int64)
                columns = [*(part.column(i) for i in range(4)), *(pa.array(np.ascontiguousarray(c)) for c in out.T)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "__file", "__row", "digest", *names])

    return given.mapInArrow(run, "doc_id long, __file string, __row long, digest string, " + ", ".join(f"{c} long" for c in names))


class Graph:
    """A navigable small-world graph over fingerprints, built by inserting nodes in batches.

    Every node links to the nearest it finds among those before it, to its predecessor and back; of the links of
    a node the first OLD_LINKS stay, as ways over long distances, the others are the nearest.
    """

    def __init__(self, fp: np.ndarray) -> None:
        self.fp, n = fp, len(fp)
        self.links = np.repeat(np.arange(n, dtype=np.int32)[:, None], LINKS, axis=1)
        size = min(n, 64)
        self._connect(np.arange(size), *self.exact(fp[:size], size, LINKS // 2 + 1))
        while size < n:
            new = np.arange(size, min(n, size * 2, size + 512))
            near, _ = self.search(fp[new], BEAM, self.entries(new, size), size)
            own, _ = exact(fp[new], fp[new], LINKS // 4 + 1)
            found = np.concatenate([near[:, : LINKS // 2], new[own], new[:, None] - 1], axis=1).astype(np.int32)
            self._connect(new, found, distances(fp, new[:, None], found))
            size = len(new) + size

    def exact(self, q: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        return exact(q, self.fp[:size], k)

    def entries(self, nodes: np.ndarray, size: int) -> np.ndarray:
        """Entry points: the node itself or the last before it that is in the graph, and a few spread over it."""
        spread = np.linspace(0, size - 1, 4).astype(np.int32)
        return np.concatenate([np.minimum(nodes, size - 1)[:, None].astype(np.int32), np.repeat(spread[None], len(nodes), axis=0)], axis=1)

    def _connect(self, nodes: np.ndarray, found: np.ndarray, dist: np.ndarray) -> None:
        a, b, d = np.repeat(nodes, found.shape[1]), found.ravel().astype(np.int64), dist.ravel()
        a, b, d = np.r_[a, b], np.r_[b, a], np.r_[d, d]
        old_a = np.repeat(np.unique(a), LINKS)
        old_b = self.links[old_a[::LINKS]].ravel().astype(np.int64)
        age = np.r_[np.tile(np.where(np.arange(LINKS) < OLD_LINKS, 0, 1), len(old_a) // LINKS), np.ones(len(a), int)]
        a, b, d = np.r_[old_a, a], np.r_[old_b, b], np.r_[distances(self.fp, old_a, old_b), d]
        keep = a != b
        a, b, d, age = a[keep], b[keep], d[keep], age[keep]
        order = np.lexsort((d, age, b, a))
        a, b, d, age = a[order], b[order], d[order], age[order]
        once = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
        a, b, d, age = a[once], b[once], d[once], age[once]
        order = np.lexsort((b, d, age, a))
        a, b = a[order], b[order]
        start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
        rank = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
        fits = rank < LINKS
        rows = np.unique(a)
        self.links[rows] = rows[:, None]
        self.links[a[fits], rank[fits]] = b[fits]

    def search(self, q: np.ndarray, beam: int, entries: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, distances) of each query's beam, nearest first; absent places have distance 999."""
        ids = np.full((len(q), beam), -1, np.int32)
        dist = np.full((len(q), beam), 999, np.int32)
        spent = np.zeros((len(q), beam), bool)
        ids, dist, spent = _merge(ids, dist, spent, entries, self._to(q, entries), beam)
        live = np.arange(len(q))
        for _ in range(8 * beam):
            open_ = ~spent[live] & (dist[live] < 999)
            live = live[open_.any(axis=1)]
            if not len(live):
                break
            at = np.argmax(~spent[live] & (dist[live] < 999), axis=1)
            spent[live, at] = True
            new = self.links[ids[live, at]]
            ids[live], dist[live], spent[live] = _merge(ids[live], dist[live], spent[live], new, self._to(q[live], new), beam)
        return ids, dist

    def _to(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fp[ids] ^ q[:, None]).sum(axis=2, dtype=np.int32)


def _merge(ids, dist, spent, new, far, beam):
    """The nearest of a beam and new nodes; nodes that are in the beam, or come twice, count once."""
    known = (new[:, :, None] == ids[:, None, :]).any(axis=2) | np.tril(new[:, :, None] == new[:, None, :], -1).any(axis=2)
    i = np.concatenate([ids, new], axis=1)
    d = np.concatenate([dist, np.where(known, 999, far)], axis=1)
    s = np.concatenate([spent, np.zeros(new.shape, bool)], axis=1)
    order = np.argsort(d, axis=1, kind="stable")[:, :beam]
    return np.take_along_axis(i, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(s, order, 1)


def distances(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[a] ^ fp[b]).sum(axis=-1, dtype=np.int32)


def all_distances(q: np.ndarray, fp: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(fp)), np.int16)
    for k in range(fp.shape[1]):
        out += np.bitwise_count(q[:, None, k] ^ fp[None, :, k])
    return out


def exact(q: np.ndarray, fp: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    d = all_distances(q, fp)
    ids = np.argsort(d, axis=1, kind="stable")[:, :k]
    return ids.astype(np.int32), np.take_along_axis(d, ids, 1).astype(np.int32)


def near_pairs(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, distance) of pairs up to NEAR, a < b, by beams over the graph of fp, audited and expanded."""
    n = len(fp)
    if n <= 4 * BEAM:
        return _pairs(np.arange(n), all_distances(fp, fp))
    graph, everyone = Graph(fp), np.arange(n)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    left, beam = everyone, BEAM
    tested = everyone[:: max(1, n // AUDIT)]
    truth = all_distances(fp[tested], fp) <= NEAR
    while len(left) and beam * beam < n:  # a wider beam costs more than the whole shard
        ids, dist = graph.search(fp[left], beam, graph.entries(left, n), n)
        where = np.searchsorted(left, tested)
        ours = (where < len(left)) & (left[np.minimum(where, len(left) - 1)] == tested)
        rows = where[ours]
        found = np.zeros((len(rows), n), bool)
        hit = dist[rows] <= NEAR
        found[np.nonzero(hit)[0], ids[rows][hit]] = True
        full = dist[:, -1] <= NEAR
        whole = (found | full[rows, None]) >= truth[ours]
        if not whole.all():  # recall of the audit is short: all of these again, with wider beams
            beam *= 2
            continue
        done = ~full
        r, c = np.nonzero((dist <= NEAR) & done[:, None])
        out.append((left[r], ids[r, c].astype(np.int64), dist[r, c]))
        left, beam = left[full], beam * 4
    for at in range(0, len(left), 256):
        out.append(_pairs(left[at : at + 256], all_distances(fp[left[at : at + 256]], fp)))
    a, b, d = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    _, first = np.unique(lo * n + hi, return_index=True)
    first = first[lo[first] != hi[first]]
    return lo[first], hi[first], d[first]


def _pairs(rows: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, c = np.nonzero(dist <= NEAR)
    a, b = rows[r], c
    keep = a < b if len(rows) == dist.shape[1] else a != b
    return a[keep], b[keep], dist[r, c][keep]


def forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the links of a minimum spanning forest, beginning with the clusters in label, and the clusters after it."""
    label = np.unique(label, return_inverse=True)[1]
    key = d.astype(np.int64) * (len(a) + 1) + np.arange(len(a))
    taken: list[np.ndarray] = []
    while True:
        la, lb = label[a], label[b]
        live = np.flatnonzero(la != lb)
        if not len(live):
            return np.unique(np.concatenate(taken)) if taken else np.zeros(0, int), label
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, la[live], key[live])
        np.minimum.at(best, lb[live], key[live])
        links = np.unique(best[best < np.iinfo(np.int64).max] % (len(a) + 1))
        taken.append(links)
        x, y = label[a[links]], label[b[links]]
        root = np.arange(n)
        while True:
            low = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            root = root[root]
            if (root == before).all():
                break
        label = root[label]


def connected(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Rows (key, node, size) of the connected sets of edges a, b; the key is a hash of a set's nodes."""
    from xxhash import xxh64_intdigest

    _, label = forest(len(node), a, b, np.zeros(len(a), int), np.arange(len(node)))
    member = np.unique(np.r_[a, b])
    member = member[np.lexsort((node[member], label[member]))]
    parts = np.split(node[member], np.flatnonzero(np.diff(label[member])) + 1) if len(member) else []
    keys = np.array([xxh64_intdigest(p.tobytes()) for p in parts], np.uint64).view(np.int64)
    sizes = [len(p) for p in parts]
    return pa.table({"key": pa.array(np.repeat(keys, sizes), pa.int64()), "node": pa.array(node[member], pa.int64()), "size": pa.array(np.repeat(sizes, sizes), pa.int64())})


def candidates(table: pa.Table) -> pa.Table:
    """The connected sets of near nodes of different groups in one shard: key, node, size."""
    rows = {c: table[c].to_numpy() for c in ("node", "n", "grp", "i", "h")}
    order = np.lexsort((rows["node"], rows["h"], rows["i"]))
    node = rows["node"][order]
    _, first = np.unique(node, return_index=True)
    order = order[np.sort(first)]
    node, count, group = (rows[c][order] for c in ("node", "n", "grp"))
    fp = np.stack([table[c].to_numpy()[order] for c in FP], axis=1).view(np.uint64)
    a, b, d = near_pairs(fp)
    large, small = np.maximum(count[a], count[b]), np.minimum(count[a], count[b])
    can = (group[a] != group[b]) & (small >= SIMILARITY * large - 1e-9) & ((d <= NEAR_LARGE) | (small <= FEW))
    return connected(node, a[can], b[can])


def bucket_candidates(table: pa.Table) -> pa.Table:
    """As candidates, of rows with a bucket: all pairs of nodes of a bucket are compared."""
    bucket = table["bucket"].to_numpy()
    order = np.argsort(bucket, kind="stable")
    node, count, group = (table[c].to_numpy()[order] for c in ("node", "n", "grp"))
    fp = np.stack([table[c].to_numpy()[order] for c in FP], axis=1).view(np.uint64)
    ends = np.flatnonzero(np.r_[np.diff(bucket[order]) != 0, True]) + 1
    out = []
    for start, end in zip(np.r_[0, ends[:-1]], ends, strict=True):
        n, g, f, near = count[start:end], group[start:end], fp[start:end], []
        for at in range(0, end - start, 256):
            part = slice(at, at + 256)
            d = all_distances(f[part], f)
            large, small = np.maximum(n[part, None], n[None]), np.minimum(n[part, None], n[None])
            can = (g[part, None] != g[None]) & (small >= SIMILARITY * large - 1e-9) & ((d <= NEAR_LARGE) | (d <= NEAR) & (small <= FEW))
            r, c = np.nonzero(can)
            near.append((r[r + at < c] + at, c[r + at < c]))
        a, b = (np.concatenate(x) for x in zip(*near, strict=True))
        if len(a):
            out.append(connected(node[start:end], a, b))
    return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("key", "node", "size")})


def true_links(table: pa.Table) -> pa.Table:
    """Spanning forests (a, b) of the similar nodes of each connected set; rows (key, node, grp, s), s a set of shingles."""
    keys = table["key"].to_numpy()
    order = np.argsort(keys, kind="stable")
    node, group = table["node"].to_numpy()[order], table["grp"].to_numpy()[order]
    lists = table["s"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    all_sizes = lists.value_lengths().to_numpy().astype(np.int64)
    begin, values = np.cumsum(all_sizes) - all_sizes, lists.flatten().to_numpy()
    ends = np.flatnonzero(np.r_[np.diff(keys[order]) != 0, True]) + 1
    los, his = [], []
    for start, end in zip(np.r_[0, ends[:-1]], ends, strict=True):
        rows = order[start:end]
        sets, size = [values[begin[r] : begin[r] + all_sizes[r]] for r in rows], all_sizes[rows]
        if len(rows) == 2:
            a, b, x = np.array([0]), np.array([1]), np.array([len(np.intersect1d(sets[0], sets[1], assume_unique=True))])
        else:
            a, b, x = similar_pairs(intersections(np.concatenate(sets), size), size)
        own, g = node[start:end], group[start:end]
        true = (x >= SIMILARITY * (size[a] + size[b] - x) - 1e-9) & (g[a] != g[b])
        a, b, x = a[true], b[true], x[true]
        tree, _ = forest(len(own), a, b, -x, g)
        los.append(np.minimum(own[a[tree]], own[b[tree]]))
        his.append(np.maximum(own[a[tree]], own[b[tree]]))
    return pa.table({"a": pa.array(np.concatenate(los), pa.int64()), "b": pa.array(np.concatenate(his), pa.int64())})


def intersections(shingles: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Shared shingles [n, n] of n sets that stand one after the other. Shingles of few sets are counted pair by
    pair, those of many by a product of 0-1 matrices, a block of shingles at a time."""
    n = len(size)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(shingles, kind="stable")
    owner, keys = owner[order], shingles[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    df = np.diff(np.r_[start, len(keys)])
    out = np.zeros(n * n, np.int32)
    for k in np.unique(df[(df > 1) & (df <= 16)]):
        groups = owner[start[df == k][:, None] + np.arange(k)[None]]
        for i in range(k):
            for j in range(i + 1, k):
                np.add.at(out, groups[:, i] * n + groups[:, j], 1)
    out = out.reshape(n, n)
    many = np.flatnonzero(df > 16)
    for at in range(0, len(many), 2048):
        part = many[at : at + 2048]
        has = np.zeros((n, len(part)), np.float32)
        has[owner[np.concatenate([np.arange(start[m], start[m] + df[m]) for m in part])], np.repeat(np.arange(len(part)), df[part])] = 1
        for rows in range(0, n, 256):
            out[rows : rows + 256] += (has[rows : rows + 256] @ has.T).astype(np.int32)
    return out


def similar_pairs(shared: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, shared shingles) of the pairs a < b whose similarity is high enough."""
    found = []
    for at in range(0, len(size), 256):
        x = shared[at : at + 256]
        both = size[at : at + 256, None] + size[None] - x
        a, b = np.nonzero((x > 0) & (x >= SIMILARITY * both - 1e-9))
        keep = a + at < b
        found.append((a[keep] + at, b[keep], x[a[keep], b[keep]].astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def minima_rows(nodes: DataFrame, hashes: range) -> DataFrame:
    """Rows (node, grp, i, h): a row for each of the given min-wise hashes of a node. They are as narrow as can be, as all of them are shuffled."""
    which = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"h{i}").alias("h")) for i in hashes]))
    return nodes.filter("n > 0").select("node", "grp", which.alias("k")).select("node", "grp", "k.i", "k.h")


def shared_by_groups(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that nodes of several groups have, and how many nodes: keys, size."""
    return rows.groupBy(*keys).agg(F.count("*").alias("size"), F.min("grp").alias("x"), F.max("grp").alias("y")).filter("x < y").drop("x", "y")


def deal(nodes: DataFrame, hashes: range) -> tuple[DataFrame, DataFrame]:
    """Rows (shard, node, n, grp, i, h, fingerprint) by those of the given min-wise hashes that several groups share; these hashes."""
    spark = nodes.sparkSession
    rows = minima_rows(nodes, hashes)
    shared = materialize(shared_by_groups(rows, "i", "h"), "simhash-shared")
    total = shared.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // SHARD_NODES), int(spark.conf.get("spark.sql.shuffle.partitions")) if total > 100_000 else 1)
    hot = F.col("size") > HOT_NODES
    cuts = F.when(hot, F.ceil(F.col("size") / HOT_NODES)).otherwise(F.lit(1))
    common = hot & (F.pmod(F.xxhash64("node", "h"), F.greatest(F.expr(f"size div {COMMON}"), F.lit(1))) == 0)
    met = rows.select("node", "i", "h").join(shared.select(F.col("i").alias("__i"), F.col("h").alias("__h"), "size"), (F.col("i") == F.col("__i")) & (F.col("h") == F.col("__h")))
    every = F.sequence(F.lit(0).cast("long"), cuts - 1)
    cut = F.explode(F.when(common, every).otherwise(F.array(F.pmod(F.xxhash64("h", "node"), cuts))))
    dealt = met.select("node", "i", "h", hot.alias("hot"), cut.alias("cut"))
    dealt = dealt.select(F.when(F.col("hot"), F.concat_ws("/", "i", "h", "cut")).otherwise(F.pmod(F.xxhash64("i", "h"), F.lit(shards)).cast("string")).alias("shard"), "node", "i", "h")
    return dealt.join(nodes.select("node", "n", "grp", *FP), "node"), shared


def deal_exactly(rows: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (shard, bucket, node, n, grp, fingerprint): any two similar nodes of rows are in a bucket.

    rows (node, grp, i, h) have the min-wise hashes of the nodes in question, nodes all that is known of nodes, sets
    (node, s) all their shingles.
    """
    members = nodes.select("node", "n", "grp", *FP).join(rows.select("node").distinct(), "node", "left_semi")
    each = sets.select("node", F.explode("s").alias("h"))
    often = materialize(each.groupBy("h").count().filter(F.col("count") > HOT_NODES).select("h"), "simhash-often")
    seldom = each.join(often, "h", "left_anti").groupBy("node").agg(F.array_sort(F.collect_list("h")).alias("seldom"))
    prefix = (F.col("n") - F.ceil(SIMILARITY * F.col("n") - 1e-9) + 1).cast("int")
    split = members.join(seldom, "node", "left").withColumn("seldom", F.coalesce("seldom", F.array().cast("array<bigint>")))
    split = split.select("node", "n", "grp", *FP, F.slice("seldom", 1, prefix).alias("first"), (F.size("seldom") < prefix).alias("short"))
    split = materialize(split, "simhash-prefixes")
    columns = ["node", "n", "grp", *FP]
    first = split.select(*columns, F.lit(-1).alias("i"), F.explode("first").alias("h"))
    short = split.filter("short").select(*columns).join(rows.select("node", "i", "h"), "node").select(*columns, "i", "h")
    both = first.unionAll(short)
    shared = materialize(shared_by_groups(both, "i", "h"), "simhash-buckets")
    shards = max(1, -(-(shared.agg(F.sum("size")).first()[0] or 0) // SHARD_NODES))
    cuts = F.ceil(F.col("size") / HOT_NODES)
    own = F.pmod(F.xxhash64("h", "node"), cuts)
    met = both.join(shared.select(F.col("i").alias("__i"), F.col("h").alias("__h"), "size"), (F.col("i") == F.col("__i")) & (F.col("h") == F.col("__h")))
    met = met.select(*columns, "i", "h", cuts.alias("cuts"), own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), cuts - 1)).alias("other"))
    pair = F.concat_ws("/", "i", "h", F.least("own", "other"), F.greatest("own", "other"))
    return met.select(F.when(F.col("cuts") > 1, pair).otherwise(F.pmod(F.xxhash64("i", "h"), F.lit(shards)).cast("string")).alias("shard"), F.xxhash64(pair).alias("bucket"), *columns)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, s) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingler(t).view(np.int64) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["node", "s"])

    return texts.mapInArrow(run, "node long, s array<long>")


def audited_recall(nodes: DataFrame, groups: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> float:
    """Of the similar pairs between a sample of nodes and all nodes, found by exact search, the share that is in one
    group; 1 if there are none. Sample and pairs are bounded and drawn by hashes."""
    columns = ["node", "n", *FP]
    chosen = nodes.filter("n > 0").orderBy(F.xxhash64("digest"), "node").limit(AUDITED).select(*columns).toArrow()
    own, count, fp = chosen["node"].to_numpy(), chosen["n"].to_numpy(), np.stack([chosen[c].to_numpy() for c in FP], axis=1).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            with_all = np.stack([batch.column(2 + k).to_numpy() for k in range(4)], axis=1).view(np.uint64)
            for at in range(0, len(node), 512):
                part = slice(at, at + 512)
                large, small = np.maximum(n[part, None], count[None]), np.minimum(n[part, None], count[None])
                r, c = np.nonzero((all_distances(with_all[part], fp) <= NEAR) & (small >= SIMILARITY * large - 1e-9) & (node[part, None] != own[None]))
                yield pa.RecordBatch.from_arrays([pa.array(own[c]), pa.array(node[part][r])], names=["a", "b"])

    pairs = nodes.filter("n > 0").select(*columns).mapInArrow(run, "a long, b long").orderBy(F.xxhash64("a", "b")).limit(AUDITED_PAIRS)
    pairs = materialize(pairs, "simhash-audit")
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    known = sets.join(groups, "node", "left").select("node", "s", F.coalesce("root", "node").alias("root"))
    met = pairs.join(known.select(*[F.col(c).alias(f"{c}_a") for c in known.columns]), F.col("a") == F.col("node_a")).join(known.select(*[F.col(c).alias(f"{c}_b") for c in known.columns]), F.col("b") == F.col("node_b"))
    shared = F.size(F.array_intersect("s_a", "s_b"))
    true = met.filter(shared >= SIMILARITY * (F.size("s_a") + F.size("s_b") - shared) - 1e-9)
    n, found = true.agg(F.count("*"), F.count_if(F.col("root_a") == F.col("root_b"))).first()
    return found / n if n else 1.0


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", audit: bool = False) -> DataFrame:
    """One row for every row of documents: doc_id, class_id, kept; with audit also audited_recall, the same in all rows.

    class_id is the smallest doc_id of the group of texts that are equal or joined by links of similarity
    SIMILARITY or more of their sets of word 5-grams; kept is true for exactly one row of a group, one with that
    id. Null texts are as empty ones; texts without words are only grouped with equal texts, shorter ones than
    five words are one shingle. Null doc_ids sort last. Repeated rows fall in one group. An empty table gives
    no rows; extra columns are ignored.
    """
    names = documents.columns
    return _classes(with_row_keys(documents), *(f"c{names.index(c)}" for c in (id_col, text_col)), audit=audit).drop("__file", "__row")


def _classes(keyed: DataFrame, doc: str, text: str, audit: bool = False) -> DataFrame:
    bounded_batches(keyed.sparkSession)
    rows = materialize(features(keyed, doc, text), "simhash-features")
    hashes = [f"h{i}" for i in range(HASHES)]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__file", "__row")).alias("first")
    nodes = rows.groupBy("digest").agg(first, *[F.min(c).alias(c) for c in ("n", *FP, *hashes)])
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "first", "n", *FP, *hashes), "simhash-nodes")
    at = nodes.select("node", F.col("first.__file").alias("__f"), F.col("first.__row").alias("__r"))
    source = keyed.select("__file", "__row", F.col(text).cast("string").alias("text"))

    def grouped(groups: DataFrame | None) -> DataFrame:
        return nodes.withColumn("grp", F.col("node")) if groups is None else nodes.join(groups, "node", "left").withColumn("grp", F.coalesce("root", "node")).drop("root")

    def sets_of(wanted: DataFrame) -> DataFrame:
        where = materialize(at.join(wanted.select("node").distinct(), "node", "left_semi"), "simhash-wanted")
        where = F.broadcast(where) if where.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else where
        texts = source.join(where, (F.col("__file") == F.col("__f")) & (F.col("__row") == F.col("__r"))).select("node", "text")
        return materialize(shingle_sets(texts), "simhash-sets")

    def united(asked: DataFrame, known: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """links and the true ones of the connected sets in asked."""
        own = sets or sets_of(asked)
        buckets = max(1, -(-asked.count() // VERIFIED))
        met = asked.join(known.select("node", "grp"), "node").join(own, "node").withColumn("bucket", F.when(4 * F.col("size") > VERIFIED, F.col("key")).otherwise(F.pmod("key", F.lit(buckets))))
        true = met.groupBy("bucket").applyInArrow(true_links, "a long, b long")
        out = materialize(true if links is None else true.unionAll(links), "simhash-links")
        drop_table(own)
        return out

    links, groups, verified = None, None, None
    for part in (range(FIRST), range(HASHES)):
        known = grouped(groups)
        dealt, shared = deal(known, part)
        asked = dealt.groupBy("shard").applyInArrow(candidates, "key long, node long, size long").distinct()
        if verified is not None:
            asked = asked.join(verified.select("key").distinct(), "key", "left_anti")
        verified = materialize(asked, "simhash-asked")
        links = united(verified, known)
        groups = components(links)
    known = grouped(groups)
    hot = shared.filter(F.col("size") > HOT_NODES).select("i", "h")
    hot = F.broadcast(hot) if hot.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else hot
    cut = materialize(minima_rows(known, range(HASHES)).join(hot, ["i", "h"]), "simhash-cut")
    cut = materialize(cut.join(shared_by_groups(cut, "i", "h").select("i", "h"), ["i", "h"]), "simhash-apart")
    if cut.limit(1).count():
        sets = sets_of(cut)
        asked = deal_exactly(cut, known, sets).groupBy("shard").applyInArrow(bucket_candidates, "key long, node long, size long").distinct()
        links = united(materialize(asked.join(verified.select("key").distinct(), "key", "left_anti"), "simhash-asked"), known, sets)
        groups = components(links)
    root = F.coalesce("root", "node")
    of_nodes = materialize(nodes.join(groups, "node", "left").select("digest", "first", root.alias("root")), "simhash-groups")
    best = of_nodes.groupBy("root").agg(F.min("first").alias("best"))
    of_digest = of_nodes.join(best, "root").select(F.col("digest").alias("__d"), "best")
    out = rows.select("doc_id", "__file", "__row", "digest").join(of_digest, F.col("digest") == F.col("__d"))
    kept = (F.col("__file") == F.col("best.__file")) & (F.col("__row") == F.col("best.__row"))
    out = out.select("doc_id", F.col("best.doc_id").alias("class_id"), kept.alias("kept"), "__file", "__row")
    return out.withColumn("audited_recall", F.lit(audited_recall(nodes, groups, sets_of))) if audit else out


def without_near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents, one of each group, with all their columns."""
    names = documents.columns
    keyed = with_row_keys(documents)
    kept = _classes(keyed, *(f"c{names.index(c)}" for c in (id_col, text_col))).filter("kept").select("__file", "__row")
    return keyed.join(kept, ["__file", "__row"], "left_semi").drop("__file", "__row").toDF(*names)
