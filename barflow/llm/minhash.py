"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

A text is its set of five-word shingles (words: runs of other than ASCII white
space; a shorter text is one shingle).  All shingles weigh the same however often
they occur, because links are decided on plain sets and the bands must find those.
Every shingle is a Poisson process of its weight's rate: its next arrival comes an
exponential waiting time later and hits a random register; a register keeps the
shingle that came first.  A shingle stops as soon as its next arrival is later than
all registers of its text, so a long text costs little more than its length.  Two
signatures agree in a register with the probability Jaccard, here that of the sets.

128 registers make 32 bands of four: a pair at 0.8 of the sets is missed once in 20
million, repeated passages or not.
Texts with equal words are one class, and only classes go on.  Every member of a
bucket is first verified against the bucket's smallest, in blocks of bounded size: as
many pairs as members, which joins a large group of near copies in one pass.  What then
shares a bucket with a text of another class so far is met with all of its candidate
group through the group's own index, in blocks, but never with its own class, and the
group's largest class never with itself.  Pairs of at least ``threshold`` Jaccard are
links, and the links' components are the near-duplicate classes.  No link between
different texts of a bucket is lost, and no pair of copies is ever emitted.

``docs`` is read twice and its rows are numbered by their place: give a written
table.  Defined cases: texts that are null or have no word are never duplicates;
long texts are read whole; equal texts, repeated rows too, are one class; the first
of a class (smallest doc_id, then row) is the one kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import HOT, Scratch, give_back, join_hot, mix, slices, spans_hash, text_buffers, words
from barflow.llm.components import components
from barflow.llm.linededup import SLICE, marked, marks_of

_LOW48 = np.uint64((1 << 48) - 1)
_STEP = np.uint64(0xD1B54A32D192ED03)


def _turn(k: int) -> np.uint64:
    return np.uint64(k * int(_STEP) & ((1 << 64) - 1))


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(48-bit shingle, text, times) sorted by text and shingle, and a hash of each text's word sequence (0: no word)."""
    starts, ends, of = words(raw, offsets)
    n = len(offsets) - 1
    h = spans_hash(raw, starts, ends)
    many = np.bincount(of, minlength=n)
    first = np.cumsum(many) - many
    place = (np.arange(len(h)) - np.repeat(first, many)).astype(np.uint64)
    full = np.flatnonzero(many)
    sequence = np.zeros(n, np.uint64)
    if len(full):
        sequence[full] = np.maximum(mix(np.add.reduceat(mix(h + place * _STEP), first[full]) ^ many[full].astype(np.uint64)), np.uint64(1))
    total = np.zeros(len(h), np.uint64)
    for k in range(min(size, len(h))):
        total[: len(h) - k] += mix(h[k:] + _turn(k + 1))
    begins = np.repeat(many, many) - place.astype(np.int64) >= size
    keys = (of[begins].astype(np.uint64) << np.uint64(48)) | (mix(total[begins]) >> np.uint64(16))
    short = np.flatnonzero((many > 0) & (many < size))
    keys = np.sort(np.concatenate([keys, (short.astype(np.uint64) << np.uint64(48)) | (sequence[short] >> np.uint64(16))]))
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at] & _LOW48, (keys[at] >> np.uint64(48)).astype(np.int64), np.diff(np.append(at, len(keys))), sequence


def signatures(shingle: np.ndarray, of: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """(n, registers): the shingle that arrived first in each register; all texts of a call advance together."""
    time, held = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint64)
    latest = np.full(n, np.inf)
    own, at, t, w = mix(shingle.copy()), of, np.zeros(len(shingle)), weight
    name, turn = shingle, 0
    while len(own):
        turn += 1
        draw = mix(own + _turn(turn))
        t = t - np.log1p(-(draw >> np.uint64(11)).astype(float) * (1.0 / (1 << 53))) / w
        go = t < latest[at]
        own, at, t, w, name, draw = own[go], at[go], t[go], w[go], name[go], draw[go]
        if not len(own):
            break
        cell = at * registers + (mix(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(time, cell, t)
        won = time[cell] == t
        held[cell[won]] = name[won]
        if turn < 4 or turn % 4 == 0:
            active = np.flatnonzero(np.bincount(at, minlength=n))
            latest[active] = time.reshape(n, registers)[active].max(axis=1)
    return held.reshape(n, registers)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.shape[1] // bands
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _STEP
    for k in range(rows):
        key = mix(key + parts[:, :, k] * np.uint64(2 * k + 3))
    return key.view(np.int64)


def sketch(registers: int, bands: int):
    """Rows (d, u, c, n, keys): class hash, number of shingles and, once a task and class, the band keys."""

    def run(batches):
        seen: set[int] = set()
        for whole in slices(batches, "text", SLICE):
            for s in range(0, whole.num_rows, 1 << 15):
                batch = whole.slice(s, 1 << 15)
                shingle, of, _, c = shingles(*text_buffers(batch.column(2)))
                n = np.bincount(of, minlength=batch.num_rows)
                new = np.zeros(batch.num_rows, bool)
                for k, x in enumerate(c.tolist()):
                    if x and x not in seen:
                        seen.add(x)
                        new[k] = True
                if len(seen) > 2_000_000:  # memory; a class told twice is only told twice
                    seen.clear()
                pick = new[of]
                nth = np.cumsum(new) - 1
                keys = band_keys(signatures(shingle[pick], nth[of[pick]], np.ones(int(pick.sum())), int(new.sum()), registers), bands)
                ends = pa.array(np.append(0, np.cumsum(new * bands)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c.view(np.int64)), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], names=["d", "u", "c", "n", "keys"])

    return run


def bags(of_docs, of_classes):
    """(c, bag): the shingle sets of marked classes, once a task."""

    def run(batches):
        told: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array(marked(of_docs.value, batch.column(0).to_numpy())))
            for whole in slices(iter([batch]), "text", SLICE):
                for s in range(0, whole.num_rows, 1 << 15):
                    part = whole.slice(s, 1 << 15)
                    shingle, of, _, c = shingles(*text_buffers(part.column(2)))
                    hit = [k for k in np.flatnonzero(marked(of_classes.value, c.view(np.int64))).tolist() if c[k] and not (c[k] in told or told.add(c[k]))]
                    if hit:
                        ends = np.searchsorted(of, np.arange(part.num_rows + 1))
                        yield pa.record_batch([pa.array(c[hit].view(np.int64)), pa.array([shingle[ends[k] : ends[k + 1]].view(np.int64) for k in hit], pa.list_(pa.int64()))], names=["c", "bag"])

    return run


def _bags(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, all shingles) of a group's sets."""
    bag = table["bag"].combine_chunks()
    bag = bag.chunk(0) if isinstance(bag, pa.ChunkedArray) else bag
    return bag.value_lengths().to_numpy(), bag.flatten().to_numpy()


def star_links(threshold: float):
    """The links between a bucket's leader (b) and a block of its members: (a, b)."""

    def run(table: pa.Table) -> pa.Table:
        c, b = table["c"].to_numpy(), table["b"].to_numpy()
        n, flat = _bags(table)
        at = int(np.flatnonzero(c == b)[0])
        ends = np.cumsum(n)
        own = np.sort(flat[ends[at] - n[at] : ends[at]])
        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.add.reduceat((own[place] == flat).astype(np.int64), ends - n)
        near = (both >= threshold * (n + n[at] - both) - 1e-9) & (c != b)
        if len(flat) > 1 << 18:
            del flat, place
            give_back()
        return pa.table({"a": pa.array(c[near], pa.int64()), "b": pa.array(b[near], pa.int64())})

    return run


def links(threshold: float):
    """The links between sets of different classes so far (root) in a block of a candidate group (or between two blocks), as a forest: (a, b)."""

    def run(table: pa.Table) -> pa.Table:
        c, side = table["c"].to_numpy(), table["side"].to_numpy()
        n, flat = _bags(table)
        cross = table["x"][0] != table["y"][0]
        of = np.repeat(np.arange(len(c)), n)
        _, ids = np.unique(flat, return_inverse=True)
        by = np.argsort(ids, kind="stable")
        docs, starts = of[by], np.searchsorted(ids[by], np.arange(ids.max(initial=-1) + 2))
        _, head, same = np.unique(table["root"].to_numpy(), return_index=True, return_inverse=True)
        root = head[same]  # one class already: no pair within it is met

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        ends, out = np.cumsum(n), []
        for k in range(len(c)):
            own = ids[ends[k] - n[k] : ends[k]]
            a, m = starts[own], starts[own + 1] - starts[own]
            at = np.repeat(a - (np.cumsum(m) - m), m) + np.arange(m.sum())
            both = np.bincount(docs[at], minlength=len(c))[:k]
            near = np.flatnonzero((both > 0) & (both >= threshold * (n[k] + n[:k] - both) - 1e-9))
            for j in near.tolist():
                if (not cross or side[j] != side[k]) and (p := top(j)) != (q := top(k)):
                    root[p] = q
                    out.append((c[k], c[j]))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.8, registers: int = 128, bands: int = 32, block_rows: int = 1024, block_size: int = 500_000) -> DataFrame:
    """(u, d, class_id, kept) of every row of docs (d: long order, u: long row, text)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "near")
    share = scratch.share
    rows = scratch.keep(docs.mapInArrow(sketch(registers, bands), "d long, u long, c long, n int, keys array<long>"))
    found = rows.filter("c <> 0")
    classes = scratch.keep(found.groupBy("c").agg(F.min("d").alias("d"), F.first("n").alias("n"), F.count("*").alias("times"), F.first(F.when(F.size("keys") > 0, F.col("keys")), ignorenulls=True).alias("keys")))
    hot = lambda counted, key, total: counted.filter(F.col("times") >= max(2, -(-total // HOT))).select(key)
    in_blocks = F.greatest(F.ceil(F.col("times") / block_rows), F.ceil(F.col("total") / block_size)).cast("int")

    # 1. buckets of more than one class; each member meets the smallest, block by block
    buckets = classes.select("c", "n", F.explode("keys").alias("bucket"))
    leaders = buckets.groupBy("bucket").agg(F.min("c").alias("leader"), F.max("c").alias("other"), F.count("*").alias("times")).filter("leader <> other")
    leaders = scratch.keep(leaders.select("bucket", "leader", "times"))
    # buckets that hold at least 1/HOT of all postings, HOT at most, are looked up in a literal map; the others' few shared postings are joined
    frequent = {r.bucket: r.leader for r in leaders.filter(F.col("times") >= max(2, -(-bands * classes.count() // HOT))).select("bucket", "leader").collect()}
    shared = buckets.filter(~F.col("bucket").isin(list(frequent))).join(leaders.select("bucket", "leader"), "bucket").select("c", "n", "bucket", "leader")
    if frequent:
        table = F.create_map(*[F.lit(x) for kv in frequent.items() for x in kv])
        shared = shared.unionByName(buckets.filter(F.col("bucket").isin(list(frequent))).withColumn("leader", F.try_element_at(table, F.col("bucket"))))
    shared = scratch.keep(shared)
    stars = scratch.keep(shared.filter("c <> leader").select("c", "n", F.col("leader").alias("b")).distinct())
    members = stars.select("c").unionByName(stars.select(F.col("b").alias("c"))).distinct().join(classes.select("c", "d"), "c")
    members = scratch.keep(members)
    of_docs, of_classes = share(marks_of(members.select("d"))), share(marks_of(members.select("c")))
    sets = scratch.keep(docs.mapInArrow(bags(of_docs, of_classes), "c long, bag array<long>").groupBy("c").agg(F.first("bag").alias("bag")))
    scratch.release()
    degree = stars.groupBy("b").agg(F.count("*").alias("times"), F.sum("n").alias("total"))
    degree = scratch.keep(degree.select("b", "times", in_blocks.alias("blocks")))
    dealt = join_hot(stars.select("c", "b"), degree.select("b", "blocks"), "b", hot(degree, "b", stars.count())).select("c", "b", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int").alias("x"))
    centres = degree.select(F.col("b").alias("c"), "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"))
    edges = dealt.unionByName(centres).join(sets, "c").groupBy("b", "x").applyInArrow(star_links(threshold), "a long, b long")
    roots = scratch.keep(components(edges, scratch))

    # 2. what still shares a bucket with another class is met with all others of its candidate group; the group's largest class isn't met with itself
    own = shared.select("c", "n", "bucket").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    own = scratch.keep(own)
    mixed = scratch.keep(own.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("times")).filter("low <> high").select("bucket", "low", "times"))
    if not mixed.isEmpty():
        open_ = scratch.keep(join_hot(own, mixed.select("bucket", "low"), "bucket", hot(mixed, "bucket", own.count())))
        groups = components(open_.select(F.col("root").alias("a"), F.col("low").alias("b")), scratch)
        heads = open_.select("c", "n", "root").distinct()
        placed = heads.groupBy("root").agg(F.count("*").alias("times"), F.sum("n").alias("total")).join(groups.select(F.col("node").alias("root"), F.col("root").alias("comp")), "root")
        largest = placed.groupBy("comp").agg(F.max(F.struct("times", "root", "total")).alias("top"), F.sum("times").alias("all_times"), F.sum("total").alias("all_total"))
        size = lambda t, s: F.greatest(F.ceil(t / block_rows), F.ceil(s / block_size)).cast("int")
        largest = largest.select("comp", F.col("top.root").alias("top"), size(F.col("top.times"), F.col("top.total")).alias("first"), F.greatest(F.lit(1), size(F.col("all_times") - F.col("top.times"), F.col("all_total") - F.col("top.total"))).alias("rest"))
        plan = scratch.keep(placed.join(largest, "comp").select("root", "times", "comp", (F.col("root") == F.col("top")).alias("is_top"), "first", "rest"))
        heads = scratch.keep(heads)
        met = join_hot(heads, plan.drop("times"), "root", hot(plan, "root", heads.count()))
        met = met.withColumn("side", F.when(F.col("is_top"), F.pmod(F.xxhash64("c"), F.col("first"))).otherwise(F.col("first") + F.pmod(F.xxhash64("c"), F.col("rest"))).cast("int"))
        others = F.when(F.col("is_top"), F.sequence(F.col("first"), F.col("first") + F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("first") + F.col("rest") - 1))
        met = met.select("c", "root", "comp", "side", F.explode(others).alias("other"))
        met = met.select("c", "root", "comp", "side", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"))
        more = met.join(sets, "c").groupBy("comp", "x", "y").applyInArrow(links(threshold), "a long, b long")
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), scratch)

    rooted = scratch.keep(classes.select("c", "d").join(roots.withColumnRenamed("node", "c"), "c", "left").select("c", "d", F.coalesce("root", "c").alias("root")))
    first_d = scratch.keep(rooted.groupBy("root").agg(F.min("d").alias("class_id"), F.count("*").alias("times")))
    ids = scratch.keep(join_hot(rooted.select("c", "root"), first_d.select("root", "class_id"), "root", hot(first_d, "root", rooted.count())))
    firsts = found.groupBy("c").agg(F.min(F.struct("d", "u")).alias("first")).join(ids, "c").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.u").alias("u"), F.lit(True).alias("is_first"))
    total = rows.count()
    hot_classes = rows.groupBy("c").agg(F.count("*").alias("times"))  # the empty class (0) too
    out = join_hot(rows.select("u", "d", "c"), ids.select("c", "class_id"), "c", hot(hot_classes, "c", total), left=True).join(firsts, "u", "left")
    return out.select("u", "d", F.coalesce("class_id", "d").alias("class_id"), (F.coalesce("is_first", F.lit(False)) | (F.col("c") == 0)).alias("kept"))


def numbered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(docs with __u, the same as d, u, text)."""
    own = docs.withColumn("__u", F.monotonically_increasing_id())
    return own, own.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63))).alias("d"), F.col("__u").alias("u"), F.col(f"`{text}`").alias("text"))


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of docs without all but the first of each near-duplicate class."""
    own, narrow = numbered(docs, key, text)
    gone = near_duplicates(narrow, threshold).filter("not kept").select(F.col("u").alias("__u"))
    return own.join(gone, "__u", "left_anti").drop("__u")
