"""SimHash components against pairwise distances, BK-trees against all pairs, XXH64 against the library."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from barflow.llm.common import Scratch, text_buffers
from barflow.llm.simhash import bk_forest, blocks_for, forest, keys_of, near_links, search, simhash_components, simhashes, xxh64

SF = "/root/testdata/sf0.001"


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def classes(fps, radius=2):
    """fingerprint -> smallest of its component, by all pairs."""
    fps = sorted(set(fps))
    top = {x: x for x in fps}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, a in enumerate(fps):
        for b in fps[:k]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {x: find(x) for x in fps}


def expected(rows):
    fp = [plain(t) for _, t in rows]
    top = classes(fp)
    least = {}
    for (d, _), f in zip(rows, fp, strict=True):
        if d is not None:
            least[top[f]] = min(d, least.get(top[f], d))
    return sorted(((d, f"{f:016x}", least.get(top[f])) for (d, _), f in zip(rows, fp, strict=True)), key=str)


ROWS = [
    (1, "The quick brown fox jumps over the lazy dog " * 20),
    (2, "the QUICK brown fox jumps over the lazy dog " * 20),
    (2, "the QUICK brown fox jumps over the lazy dog " * 20),
    (3, None), (4, ""), (5, " \n\x0b"), (0, "\t"),
    (6, "one"), (7, "One"), (8, "one two"), (9, "one  two\nthree"), (None, "one two three"), (10, "one\x0btwo three"),
    (None, "nobody else says this"), (11, "日本語 " * 40 + "é" * 700), (12, "x" * 300 + " y " + "z" * 40), (13, "long words " * 60000),
]


def test_cases(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("id", "fp", "key", "n", "first", "root", "a", "b", "block", "shard")])
    got = simhash_components(docs)
    assert got.columns == ["id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(ROWS)
    assert simhash_components(docs.limit(0)).count() == 0


def test_query(spark):
    from barflow.llm.queries import QUERIES

    t = pq.read_table(f"{SF}/documents.parquet")
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    got = QUERIES["op11_simhash_components"](spark, SF)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


def test_xxh64():
    random.seed(3)
    parts = [random.randbytes(n) for n in [*range(140), 1000, 5000]]
    raw, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    for seed in (0, 42):
        assert xxh64(raw, starts, ends, seed).tolist() == [xxhash.xxh64_intdigest(p, seed) for p in parts]


def test_fingerprints():
    random.seed(4)
    texts = [" ".join(random.choice(["foo", "Bar", "é", "ZZ", "日本", "q" * 99, "w" * 400]) for _ in range(random.randrange(0, 2000))) for _ in range(20)] + [None, "", "a", "A b"]
    assert simhashes(*text_buffers(pa.array(texts))).tolist() == [plain(t) for t in texts]


def cluster(n, seed):
    rng = random.Random(seed)
    found = {rng.getrandbits(64) for _ in range(n // 4)}
    while len(found) < n:
        x = rng.choice(sorted(found)) if rng.random() < 0.02 else next(iter(found))
        for _ in range(rng.randrange(1, 5)):
            x ^= 1 << rng.randrange(64)
        found.add(x)
    return np.array(sorted(found), np.uint64)


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_tree_finds_all(radius):
    fp = cluster(900, radius)
    tree = np.arange(len(fp)) // 300  # three trees at once
    parent, edge = bk_forest(tree, fp)
    root = np.searchsorted(tree, tree)
    at = parent >= 0
    assert (edge[at] == np.bitwise_count(fp[at] ^ fp[parent[at]])).all()
    siblings = list(zip(parent[at].tolist(), edge[at].tolist(), strict=True))
    assert len(set(siblings)) == len(siblings)
    q, node = search(parent, edge, fp, fp, root, radius, at_once=77)
    want = {(int(i), int(j)) for i, j in np.argwhere(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius) if tree[i] == tree[j]}
    assert set(zip(q.tolist(), node.tolist(), strict=True)) == want and len(q) == len(want)


@pytest.mark.parametrize(("blocks", "radius"), [(3, 2), (4, 2), (5, 2), (6, 3)])
def test_keys_meet(blocks, radius):
    rng = random.Random(blocks)
    a = np.array([rng.getrandbits(64) for _ in range(500)], np.uint64)
    b = a.copy()
    for k in range(500):
        for bit in rng.sample(range(64), radius):
            b[k] ^= np.uint64(1 << bit)
    assert ((keys_of(a, blocks, radius) == keys_of(b, blocks, radius)).sum(axis=1) >= 1).all()


def test_blocks_grow():
    assert blocks_for(1000, 2) == 3 and blocks_for(10**9, 2) == 4 and blocks_for(5 * 10**11, 2) == 5


def test_large_shards(spark):
    """Shards of several trees connect what all pairs do."""
    fp = cluster(1500, 9)
    fps = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    got = near_links(fps, len(fp), 2, Scratch(spark, "test"), block=100).collect()
    low = (1 << 64) - 1
    assert all(((r.a ^ r.b) & low).bit_count() > 0 for r in got)
    a, b = np.array([r.a for r in got]), np.array([r.b for r in got])
    top = dict(zip(*[x.tolist() for x in forest(a, b)], strict=True))
    want = classes([int(x) for x in fp])
    mine = {}
    for x in fp:
        mine.setdefault(top.get(int(x.view(np.int64)), int(x.view(np.int64))), set()).add(int(x))
    theirs = {}
    for x, y in want.items():
        theirs.setdefault(y, set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))
