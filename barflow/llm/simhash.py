"""Near-duplicate documents by 64-bit SimHash and BK-trees.

A text's words (maximal runs of other than ASCII white space, A-Z lower-cased) make
three-word shingles, repeats included, joined by one blank; fewer words are one shingle;
none make fingerprint zero.  A bit is set if over half of the shingles' XXH64 (UTF-8, seed
42) have it.  Texts whose fingerprints differ in at most ``radius`` bits are linked.

Only distinct fingerprints are searched.  The 64 bits are cut into ``m`` blocks; two
fingerprints within the radius agree in at least m - radius of them, so each fingerprint
is posted under every choice of m - radius blocks, and a key (choice, bits) names a shard.
m grows with the number of fingerprints, so that a shard of chance neighbours stays small.
Every shard gets a BK-tree: a node's children are keyed by their Hamming distance to it.
A shard above ``block`` fingerprints gets several trees of bounded size.  Trees are built
once, written as node rows, and sent to the groups that hold their shard's fingerprints;
a search goes down only edges whose key lies within the radius of the distance to the node.
Trees of all shards together grow with the corpus, so none is broadcast to every task.

All trees of a task are built, and searched, together: one vectorised step a level.
Links leave a task as a forest (at most one link a fingerprint and group), components are
found over fingerprints, and documents, however many share one, only look theirs up.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any other;
long texts are read whole; repeated rows are in one component; a row without an id is in
its fingerprint's component, whose id is the smallest there is (null if none has one); an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import HOT, WHITE, Scratch, hot_keys, join_hot, slices, text_buffers, words
from barflow.llm.components import components

SLICE = 1 << 19
SHINGLES_AT_ONCE = 1 << 16
LIBRARY_FROM = 256  # bytes: longer shingles are hashed one by one by the library
GROUP_ROWS = 1 << 15
# XXH64, as published
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def xxh64(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte range [start, end)."""
    padded = np.append(raw, np.zeros(8, np.uint8))
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    four = np.ndarray((len(raw) + 1,), "<u4", padded, strides=(1,))
    n, at, low = ends - starts, starts.copy(), (1 << 64) - 1
    h = np.full(len(n), seed + int(P5) & low, np.uint64)
    wide = np.flatnonzero(n >= 32)
    if len(wide):
        v = [np.full(len(wide), x & low, np.uint64) for x in (seed + int(P1) + int(P2), seed + int(P2), seed, seed - int(P1))]
        open_ = np.arange(len(wide))
        while len(open_):
            place = at[wide[open_]]
            for k in range(4):
                v[k][open_] = _round(v[k][open_], eight[place + 8 * k])
            at[wide[open_]] += 32
            open_ = open_[ends[wide[open_]] - at[wide[open_]] >= 32]
        total = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
        for k in range(4):
            total = (total ^ _round(np.zeros(len(wide), np.uint64), v[k])) * P1 + P4
        h[wide] = total
    h += n.astype(np.uint64)
    open_ = np.flatnonzero(ends - at >= 8)
    while len(open_):
        h[open_] = _turn(h[open_] ^ _round(np.zeros(len(open_), np.uint64), eight[at[open_]]), 27) * P1 + P4
        at[open_] += 8
        open_ = open_[ends[open_] - at[open_] >= 8]
    open_ = np.flatnonzero(ends - at >= 4)
    h[open_] = _turn(h[open_] ^ (four[at[open_]].astype(np.uint64) * P1), 23) * P2 + P3
    at[open_] += 4
    open_ = np.flatnonzero(ends > at)
    while len(open_):
        h[open_] = _turn(h[open_] ^ (raw[at[open_]].astype(np.uint64) * P5), 11) * P1
        at[open_] += 1
        open_ = open_[ends[open_] > at[open_]]
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    return h ^ (h >> np.uint64(32))


#: A byte's bits as eight counters of eight bits.
_SPREAD = (((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(1)) << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(axis=1).astype(np.uint64)


def bit_sums(h: np.ndarray, of: np.ndarray, into: np.ndarray) -> None:
    """Add to into[text] how many of the hashes of a text (sorted by text) have each bit."""
    if not len(h):
        return
    place = np.arange(len(h))
    new = np.append(True, of[1:] != of[:-1])
    begin = np.maximum.accumulate(np.where(new, place, 0))
    cuts = np.flatnonzero((place - begin) % 255 == 0)  # a counter of eight bits holds 255
    data = h.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[data[:, k]], cuts).view(np.uint8).reshape(-1, 8)
        np.add.at(into[:, 8 * k : 8 * k + 8], of[cuts], sums)


def simhashes(raw: np.ndarray, offsets: np.ndarray, size: int = 3) -> np.ndarray:
    """The 64-bit SimHash of each text."""
    n = len(offsets) - 1
    starts, ends, of = words(raw, offsets)
    if not len(starts):
        return np.zeros(n, np.uint64)
    keep = ~WHITE[raw]
    after = ends[ends < len(raw)]
    keep[after] = True  # one blank after each word; at a text's end it may be the next one's first byte
    place = np.cumsum(keep, dtype=np.int32 if len(raw) < 1 << 31 else np.int64)
    text = raw[keep]
    text = np.where(WHITE[text], np.uint8(32), np.where((text >= 65) & (text <= 90), text + np.uint8(32), text))
    starts, ends = place[starts].astype(np.int64) - 1, place[ends - 1].astype(np.int64)
    many = np.bincount(of, minlength=n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    begins = np.flatnonzero(np.where(many[of] >= size, many[of] - nth >= size, nth == 0))
    last = begins + np.minimum(size, many[of[begins]]) - 1
    counts, shingles = np.zeros((n, 64), np.int64), np.bincount(of[begins], minlength=n)
    for k in range(0, len(begins), SHINGLES_AT_ONCE):
        a, b, t = starts[begins[k : k + SHINGLES_AT_ONCE]], ends[last[k : k + SHINGLES_AT_ONCE]], of[begins[k : k + SHINGLES_AT_ONCE]]
        long = b - a > LIBRARY_FROM
        h = xxh64(text, a, np.where(long, a, b))
        for j in np.flatnonzero(long).tolist():
            h[j] = xxhash.xxh64_intdigest(text[a[j] : b[j]].data, 42)
        bit_sums(h, t, counts)
    return ((2 * counts > shingles[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _fingerprints(batches):
    for batch in slices(batches, "text", SLICE):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(simhashes(*text_buffers(batch.column(1))).view(np.int64))], names=["id", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): the SimHash of every whole text, as a long."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(_fingerprints, "id long, fp long")


def keys_of(fp: np.ndarray, blocks: int, radius: int) -> np.ndarray:
    """(fingerprints, choices): the pigeonhole keys of each fingerprint."""
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    cells = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    out = []
    for k, chosen in enumerate(combinations(cells, blocks - radius)):
        own = (fp & np.uint64(sum(chosen))) ^ np.uint64(k * 0x9E3779B97F4A7C15 & ((1 << 64) - 1))
        own = (own ^ (own >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)  # one to one within a choice
        out.append(own ^ (own >> np.uint64(29)))
    return np.stack(out, axis=1)


def blocks_for(n: int, radius: int, aim: int = 64) -> int:
    """As few blocks as leave about ``aim`` chance neighbours a key, or fewer."""
    m = radius + 1
    while n >> (64 * (m - radius) // m) > aim and m < 4 * (radius + 1):
        m += 1
    return m


def _posted(blocks: int, radius: int):
    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            keys = keys_of(fp.view(np.uint64), blocks, radius).view(np.int64)
            yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(fp, keys.shape[1]))], names=["key", "fp"])

    return run


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def bk_forest(tree: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent or -1, edge) of each fingerprint: a BK-tree per value of ``tree`` (sorted); a tree's first is its root. Fingerprints of a tree differ."""
    parent, edge = np.full(len(fp), -1), np.zeros(len(fp), np.int64)
    root = np.maximum.accumulate(np.where(np.append(True, tree[1:] != tree[:-1]), np.arange(len(fp)), 0)) if len(fp) else np.zeros(0, np.int64)
    open_ = np.flatnonzero(root != np.arange(len(fp)))
    at = root[open_]
    while len(open_):
        d = distance(fp[open_], fp[at])
        _, first, same = np.unique(at * 65 + d, return_index=True, return_inverse=True)
        child = open_[first]  # the first of an edge becomes the node there
        parent[child], edge[child] = at[first], d[first]
        rest = np.ones(len(open_), bool)
        rest[first] = False
        at, open_ = child[same][rest], open_[rest]
    return parent, edge


def search(parent: np.ndarray, edge: np.ndarray, fp: np.ndarray, query: np.ndarray, root: np.ndarray, radius: int, at_once: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs within the radius; each query goes down from its root along edges that can hold some."""
    child = np.flatnonzero(parent >= 0)
    code = parent[child] * 65 + edge[child]
    order = np.argsort(code, kind="stable")
    child, code = child[order], code[order]
    found = [(np.zeros(0, np.int64),) * 2]
    for k in range(0, len(query), at_once):
        q = np.arange(k, min(k + at_once, len(query)))
        node = root[q]
        while len(q):
            d = distance(query[q], fp[node])
            near = d <= radius
            found.append((q[near], node[near]))
            low, high = np.searchsorted(code, node * 65 + np.maximum(d - radius, 0)), np.searchsorted(code, node * 65 + np.minimum(d + radius, 64), "right")
            many = high - low
            q, node = np.repeat(q, many), child[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    a, b = zip(*found, strict=True)
    return np.concatenate(a), np.concatenate(b)


def _build(table: pa.Table) -> pa.Table:
    """Entries (key, block, fp) of whole trees as node rows."""
    key, block, fp = (table[c].to_numpy() for c in ("key", "block", "fp"))
    order = np.lexsort((fp, block, key))
    key, block, fp = key[order], block[order], fp[order]
    new = np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])) if len(key) else np.zeros(0, bool)
    parent, edge = bk_forest(np.cumsum(new), fp.view(np.uint64))
    first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
    blocks = table["blocks"].to_numpy()[order]
    local = np.where(parent >= 0, parent - first, -1)
    return pa.table({"key": pa.array(key), "block": pa.array(block), "blocks": pa.array(blocks), "node": pa.array((np.arange(len(key)) - first).astype(np.int32)), "fp": pa.array(fp), "parent": pa.array(local.astype(np.int32)), "edge": pa.array(edge.astype(np.int32))})


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (a, b) connect, at most one a member: (member, smallest of its component)."""
    names, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = both[: len(a)], both[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b):
            np.minimum.at(new, x, low)
            np.minimum.at(new, label[x], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _probe(radius: int):
    def run(queries: pa.Table, trees: pa.Table) -> pa.Table:
        key, block, deal, node, fp, parent, edge = (trees[c].to_numpy() for c in ("key", "block", "deal", "node", "fp", "parent", "edge"))
        order = np.lexsort((node, deal, block, key))
        key, block, deal, node, fp, parent, edge = (x[order] for x in (key, block, deal, node, fp, parent, edge))
        first = np.flatnonzero(node == 0)
        offset = np.repeat(first, np.diff(np.append(first, len(node))))
        parent = np.where(parent >= 0, parent + offset, -1).astype(np.int64)
        names = np.rec.fromarrays([key[first], block[first], deal[first]], names="key,block,deal")
        own = queries["fp"].to_numpy()
        wanted = np.rec.fromarrays([queries["key"].to_numpy(), queries["block"].to_numpy(), queries["deal"].to_numpy()], names="key,block,deal")
        root = first[np.searchsorted(names, wanted)]  # every query's tree is in its group
        q, hit = search(parent, edge.astype(np.int64), fp.view(np.uint64), own.view(np.uint64), root, radius)
        a, b = own[q], fp[hit]
        a, b = forest(a[a != b], b[a != b])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_links(fps: DataFrame, total: int, radius: int, scratch: Scratch, block: int = 2048) -> DataFrame:
    """(a, b): links that connect distinct fingerprints (fp) as all their pairs within the radius do."""
    blocks = blocks_for(total, radius)
    posted = scratch.keep(fps.select("fp").mapInArrow(_posted(blocks, radius), "key long, fp long"))
    shared = scratch.keep(posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    entries = join_hot(posted, shared, "key", hot_keys_of(shared, len(list(combinations(range(blocks), radius))) * total))
    entries = scratch.keep(entries.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).drop("n"))
    groups = F.lit(max(1, -(-entries.count() // GROUP_ROWS)))
    shard = lambda *c: F.pmod(F.xxhash64(*c), groups).alias("shard")
    nodes = "key long, block int, blocks int, node int, fp long, parent int, edge int"
    trees = scratch.keep(entries.withColumn("shard", shard("key", "block")).groupBy("shard").applyInArrow(_build, nodes))
    # a pair is met once: in the tree of its lower block, by the fingerprints of its higher one
    queries = entries.select("key", "fp", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("tree"), F.col("block").alias("deal")).withColumnRenamed("tree", "block")
    sent = trees.select("*", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("deal")).drop("blocks")
    left = queries.withColumn("shard", shard("key", "block", "deal")).groupBy("shard")
    right = sent.withColumn("shard", shard("key", "block", "deal")).groupBy("shard")
    return left.cogroup(right).applyInArrow(_probe(radius), "a long, b long")


def hot_keys_of(counted: DataFrame, total: int) -> DataFrame:
    """The keys of a table (key, n) that hold at least 1/HOT of ``total`` rows."""
    return counted.filter(F.col("n") >= max(2, -(-total // HOT))).select("key")


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) of every row of docs."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, key, text))
    fps = scratch.keep(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    total = fps.count()
    roots = components(near_links(fps, total, radius, scratch), scratch)
    rooted = scratch.keep(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
    least = scratch.keep(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    named = join_hot(rooted.select("fp", "root"), least.select("root", "component_id"), "root", least.filter(F.col("n") >= max(2, -(-total // HOT))).select("root"))
    named = scratch.keep(named.select("fp", "component_id"))
    n_rows = rows.count()
    found = join_hot(rows, named, "fp", hot_keys(rows, "fp", n_rows))
    return found.select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
