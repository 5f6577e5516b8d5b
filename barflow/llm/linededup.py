"""Line dedup by an exact set-similarity join of lines.

A line is the set of its words (maximal runs of other than ASCII white space).  A
line goes if an earlier line - smaller doc_id, then row, then line number - has a
Jaccard similarity of at least ``threshold`` to it; blank lines always stay, and so
do, if ``least`` is given, lines of fewer distinct words than that (off by default).

1. Rarity: about how often each word occurs, over all texts, as a table of 2**24
   counters indexed by word hash; it only orders the words, the same for all lines.
2. Each line's words in order of rarity.  Equal sets meet by hash and all but the
   first go.  For the others the prefix filter applies: two lines that are similar
   share a word among the first |x| - ceil(t |x|) + 1, and words that occur once in
   the corpus need no posting, nor do lines so short that only an equal set can be
   similar (below four words at 0.8).  Frequent words post together with a second word
   of a prefix one word longer, so groups stay small where words are everywhere.  A
   posting carries its position, the line's size and a 128-bit parity sketch of the set.
3. Postings of a key meet; a group that is still large is told in full and met in
   blocks of bounded size, every pair of blocks a group of its own.  Length and
   positional filters and the sketches' distance, which never exceeds the sets'
   difference, leave candidates; each line of a larger group names its few nearest
   earlier ones, and lines whose named candidates all fail are met again with all of
   theirs.
4. The words of candidate lines are read again and Jaccard is verified exactly.

Nothing but fixed-size tables is broadcast, and no group emits all its pairs.
``docs`` is read several times and its rows are numbered by their place: give a
written table.  Defined cases: null and empty texts stay as they are; a text that
loses all lines becomes empty (the pipeline drops it); long texts are read whole;
of repeated rows the later ones lose their lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import HOT, Scratch, batches_of, chunked, dense_total, give_back, hot_keys, join_hot, mix, slices, spans_hash, text_buffers, words

COUNTERS = 1 << 24
MARKS = 1 << 26
OFTEN = 4096  # words above this count are keys only together with another word
WIDE = 32  # distinct words up to which a line's frequent words post in pairs
DIRECT = 4096  # a larger group is met in blocks
BLOCK = 2048
NAMED = 4
GATHER = 50_000  # postings that are met at once
MATRIX = 1 << 18  # pairs of a group that are weighed at once: some ten numbers each
SLICE = 1 << 18  # bytes of text at once: what is made of them takes some fifty times as much
_STEPS = 4  # counters above 127 keep a quarter of an octave


def coded(n: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact below 128, then a quarter of an octave."""
    return np.where(n < 128, n, np.minimum(255, 128 + np.floor(_STEPS * (np.log2(np.maximum(n, 128)) - 7)))).astype(np.uint8)


def decoded(c: np.ndarray) -> np.ndarray:
    """At least what was coded."""
    return np.where(c < 128, c.astype(np.int64), np.ceil(2.0 ** (7 + (c.astype(float) - 127) / _STEPS))).astype(np.int64)


def rarity(docs: DataFrame, text: str) -> np.ndarray:
    """The coded counters of all words; a task counts a word up to 65,535 times, which is enough to order them."""

    def count(batches):
        n = np.zeros(COUNTERS, np.uint16)
        for batch in slices(batches, text, SLICE):
            raw, offsets = text_buffers(batch.column(0))
            starts, ends, _ = words(raw, offsets)
            at = np.sort((spans_hash(raw, starts, ends) & np.uint64(COUNTERS - 1)).astype(np.int32))
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
            n[at[first]] = np.minimum(n[at[first]].astype(np.int64) + np.diff(np.append(first, len(at))), 65535)
        yield from chunked(n)

    return dense_total(docs.select(text).mapInArrow(count, "chunk int, data binary"), "uint16", COUNTERS, "int64", finish=coded)


def line_words(raw: np.ndarray, offsets: np.ndarray, count: np.ndarray):
    """Distinct words of each line in order of rarity: (hash, line, first word of each line, text and number of each line, coded counts)."""
    starts, ends, of = words(raw, offsets)
    breaks = np.flatnonzero(raw == 10)
    before = np.searchsorted(breaks, offsets[:-1])
    number = np.searchsorted(breaks, starts) - before[of] if len(starts) else starts
    h = spans_hash(raw, starts, ends)
    c = count[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]
    line = of.astype(np.int64) << 32 | number
    edge = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else line
    nth = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(line))))
    # by line, count and the hash's high bits in one key; ties of the key are ordered by the hash below
    key = (nth.astype(np.uint64) << np.uint64(40)) | (c.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32))
    by = np.argsort(key)  # what is alike in key and hash is one word, so its order is all one
    key, h, nth, c = key[by], h[by], nth[by], c[by]
    if (tie := (key[1:] == key[:-1]) & (h[1:] != h[:-1])).any():
        by = np.lexsort((h, key))
        h, nth, c = h[by], nth[by], c[by]
        del tie
    keep = np.append(True, (h[1:] != h[:-1]) | (nth[1:] != nth[:-1])) if len(h) else np.zeros(0, bool)
    h, nth, c = h[keep], nth[keep], c[keep]
    first = np.flatnonzero(np.append(True, nth[1:] != nth[:-1])) if len(h) else np.zeros(0, np.int64)
    return h, nth, first, (line[edge] >> 32), (line[edge] & 0xFFFFFFFF), c


def set_hashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    return mix(np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)).view(np.int64) if len(first) else np.zeros(0, np.int64)


def prefix(size, threshold: float):
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


LINES = "d long, u long, line int, set long, size int, a long, b long, at array<int>, tokens array<long>"


def lines(docs: DataFrame, threshold: float, least: int, count) -> DataFrame:
    """Lines that may have a match: place, set hash, size, sketch and the words of the prefix with their positions.

    A task tells a set's words once, and again where it meets the set at a smaller d: rows may come in any order, and
    of the places told the smallest must be the set's first."""

    def run(batches):
        seen: dict[int, int] = {}
        for batch in slices(batches, "text", SLICE):
            raw, offsets = text_buffers(batch.column(2))
            h, nth, first, of, number, c = line_words(raw, offsets, count.value)
            if not len(first):
                continue
            size = np.diff(np.append(first, len(h)))
            sets = set_hashes(h, first)
            bit = np.uint64(1) << (h & np.uint64(63))
            side = (h >> np.uint64(6)) & np.uint64(1) == 0
            a = np.bitwise_xor.reduceat(np.where(side, bit, np.uint64(0)), first).view(np.int64)
            b = np.bitwise_xor.reduceat(np.where(side, np.uint64(0), bit), first).view(np.int64)
            place = np.arange(len(h)) - np.repeat(first, size)
            # another set is at best a set of one word more: size / (size + 1)
            upto = prefix(size, threshold) + (size <= wide(threshold))  # one word more where words post in pairs
            post = (place < np.repeat(upto, size)) & (c > 1) & np.repeat(size >= threshold * (size + 1) - 1e-9, size)
            twin = np.minimum.reduceat(c, first) > 1
            new = np.zeros(len(first), bool)
            for k, (s, d) in enumerate(zip(sets.tolist(), batch.column(0).to_numpy()[of].tolist(), strict=True)):
                if d < seen.get(s, d + 1):
                    seen[s] = d
                    new[k] = True
            if len(seen) > 2_000_000:  # memory; a set told twice is only told twice
                seen.clear()
            post &= np.repeat(new, size)
            n = np.add.reduceat(post.astype(np.int64), first)
            keep = (size >= least) & (twin | (n > 0))
            post &= np.repeat(keep, size)
            ends = pa.array(np.append(0, np.cumsum(n[keep])).astype(np.int32))
            ids = pa.array(of[keep])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(ids), batch.column(1).take(ids), pa.array(number[keep].astype(np.int32)), *(pa.array(x[keep]) for x in (sets, size.astype(np.int32), a, b)), pa.ListArray.from_arrays(ends, pa.array(place[post].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(h[post].view(np.int64)))],
                names=["d", "u", "line", "set", "size", "a", "b", "at", "tokens"],
            )

    return docs.mapInArrow(run, LINES)


#: What a group yields: candidate pairs, or (key not null) the postings of a group that is too large, set and sketch in the places of late and early.
MET = "late long, late_d long, early long, early_d long, more boolean, key long, info long"
_MET = [c.split()[0] for c in MET.split(", ")]


def meet(threshold: float, wanted=None, direct: int | None = None):
    """Candidates within groups of a key, whose rows arrive together; wanted: marks of the only later sets to tell of, with all theirs.

    A group of more than ``direct`` postings is handed on as it is, a batch at a time, so no group has to fit into memory."""

    def group(p: dict[str, np.ndarray], out: list) -> None:
        n = len(p["set"])
        whole = not p["cross"][0]
        step = max(1, MATRIX // n)
        for s in range(0, n, step):
            i = np.arange(s, min(n, s + step))
            if wanted is not None:
                i = i[marked(wanted.value, p["set"][i])]
                if not len(i):
                    continue
            lower = p["d"][None, :] <= p["d"][i, None]
            ok = lower & (p["set"][None, :] != p["set"][i, None])
            if not whole:
                ok &= p["side"][None, :] != p["side"][i, None]
            sizes = p["size"].astype(np.int64)
            total = sizes[None, :] + sizes[i, None]
            need = np.ceil(threshold / (1 + threshold) * total - 1e-9)  # words that similar lines share
            small = np.minimum(sizes[None, :], sizes[i, None])
            ok &= small >= threshold * np.maximum(sizes[None, :], sizes[i, None]) - 1e-9
            ok &= np.minimum(sizes[None, :] - p["at"][None, :], sizes[i, None] - p["at"][i, None]) >= need  # holds at the first word that similar lines share
            far = np.bitwise_count(p["a"][None, :] ^ p["a"][i, None]).astype(np.int64) + np.bitwise_count(p["b"][None, :] ^ p["b"][i, None])
            ok &= far <= total - 2 * need
            r, c = np.nonzero(ok)
            if not len(r):
                continue
            if wanted is None:
                by = np.lexsort((far[r, c], r))
                r, c = r[by], c[by]
                nth = np.arange(len(r)) - np.searchsorted(r, r)
                more = np.searchsorted(r, r, "right") - np.searchsorted(r, r) > NAMED
                r, c, more = r[nth < NAMED], c[nth < NAMED], more[nth < NAMED]
            else:
                more = np.zeros(len(r), bool)
            out.append((p["set"][i[r]], p["d"][i[r]], p["set"][c], p["d"][c], more))

    def small(p: dict[str, np.ndarray], start: np.ndarray, n: np.ndarray, out: list) -> None:
        """Many short groups at once: entries k and k + step of a group, for every step."""
        left = np.repeat(n, n) - (np.arange(len(p["set"])) - np.repeat(start, n))
        size, rest = p["size"], p["size"] - p["at"]
        crossed = bool(p["cross"].any())
        for step in range(1, int(n.max(initial=1))):
            i = np.flatnonzero(left > step)
            a, b = size[i], size[i + step]
            total = a + b
            # the words that similar lines share: more than the smaller line has, or than are left in either, rules the pair out
            need = np.ceil(threshold / (1 + threshold) * total - 1e-9)
            keep = (np.minimum(a, b) >= need) & (np.minimum(rest[i], rest[i + step]) >= need)
            i, need, total = i[keep], need[keep], total[keep]
            j = i + step
            ok = np.bitwise_count(p["a"][i] ^ p["a"][j]).astype(np.int64) + np.bitwise_count(p["b"][i] ^ p["b"][j]) <= total - 2 * need
            ok &= p["set"][i] != p["set"][j]
            if crossed:
                ok &= (p["cross"][i] == 0) | (p["side"][i] != p["side"][j])
            i, j = i[ok], j[ok]
            after = p["d"][i] > p["d"][j]
            i, j = np.where(after, j, i), np.where(after, i, j)  # j is the later one
            if wanted is not None:
                ok = marked(wanted.value, p["set"][j]) | (p["d"][i] == p["d"][j])
                i, j = i[ok], j[ok]
            same = p["d"][i] == p["d"][j]
            out.append((p["set"][j], p["d"][j], p["set"][i], p["d"][i], np.zeros(len(i), bool)))
            out.append((p["set"][i][same], p["d"][i][same], p["set"][j][same], p["d"][j][same], np.zeros(same.sum(), bool)))

    names = ("key", "info", "d", "set", "a", "b")

    def told(late, late_d, early, early_d, more) -> pa.RecordBatch:
        none = pa.nulls(len(late), pa.int64())
        return pa.record_batch([*map(pa.array, (late, late_d, early, early_d, more)), none, none], names=_MET)

    def handed_on(p: dict[str, np.ndarray]) -> pa.RecordBatch:
        own = [p[k].view(np.int64) for k in ("set", "d", "a", "b")]
        return pa.record_batch([*map(pa.array, own), pa.nulls(len(own[0]), pa.bool_()), pa.array(p["key"]), pa.array(p["info"])], names=_MET)

    def run(batches):
        rest: dict[str, np.ndarray] | None = None
        held: list = []
        large = None  # the key of the group that is being handed on
        for batch in _then_none(batches):
            if batch is not None:
                held.append(batch)
                if sum(x.num_rows for x in held) < GATHER:
                    continue
            p = {k: np.concatenate([x.column(i).to_numpy() for x in held]) if held else np.zeros(0, np.int64) for i, k in enumerate(names)}
            held = []
            p |= {k: p[k].view(np.uint64) for k in ("a", "b")}  # of a signed number the bits of its absolute value would be counted
            if rest is not None:
                p = {k: np.concatenate([rest[k], p[k]]) for k in names}
                rest = None
            if large is not None and len(p["key"]):
                own = int(np.searchsorted(p["key"] != large, True))
                if own:
                    yield handed_on({k: v[:own] for k, v in p.items()})
                    p = {k: v[own:] for k, v in p.items()}
                large = large if not len(p["key"]) else None
            if not len(p["set"]):
                continue
            start = np.flatnonzero(np.append(True, p["key"][1:] != p["key"][:-1]))
            n = np.diff(np.append(start, len(p["set"])))
            if direct is not None:
                for s, m in zip(start[n > direct].tolist(), n[n > direct].tolist(), strict=True):
                    yield handed_on({k: v[s : s + m] for k, v in p.items()})
                if batch is not None and n[-1] > direct:
                    large = int(p["key"][-1])
            if batch is not None and large is None:  # the last group may go on
                rest = {k: v[start[-1] :] for k, v in p.items()}
                p = {k: v[: start[-1]] for k, v in p.items()}
                start, n = start[:-1], n[:-1]
            p["size"], p["at"], p["side"], p["cross"] = unpacked(p["info"])
            out: list = []
            big = n > 64
            for s, m in zip(start[big].tolist(), n[big].tolist(), strict=True):
                if direct is not None and m > direct:
                    continue
                by = s + np.argsort(p["d"][s : s + m], kind="stable")
                _, one = np.unique(p["set"][by], return_index=True)  # sorted by d: the first of a set is its earliest
                own = {k: v[by[np.sort(one)]] for k, v in p.items()}
                if len(one) > 1:
                    group(own, out)
            some = np.repeat(~big & (n > 1), n)
            if some.any():
                m = n[~big & (n > 1)]
                small({k: v[some] for k, v in p.items()}, np.cumsum(m) - m, m, out)
            if out:
                late, late_d, early, early_d, more = map(np.concatenate, zip(*out, strict=True))
                if len(late):
                    yield told(late, late_d, early, early_d, more)

    return run


def packed(size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """size and at (30 bits each) in a long, above two bits: the side (2) a posting is on and whether only the other side's are to be met (1)."""
    return size.astype(np.int64) << 32 | at.astype(np.int64) << 2


def unpacked(info: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return info >> 32, info >> 2 & 0x3FFFFFFF, info >> 1 & 1, info & 1


POSTING = "key long, info long, d long, set long, a long, b long"


def wide(threshold: float) -> int:
    """Up to this size lines have postings by two words; similar lines share two words only above a threshold of a half."""
    return WIDE if threshold > 0.5 else 0


def postings(count, threshold: float, only=None):
    """A line's postings: (key, info, d, set, a, b). only: marks of the keys wanted.

    Similar lines share the first of their common words within both prefixes, and the second of them within prefixes
    that are one word longer.  So a rare word is a key by itself, and a frequent one only together with each later word
    of the longer prefix.  Lines above ``wide`` words, whose pairs would be too many, post frequent words alone, and so
    do, besides, the lines that are long enough to be similar to one of these."""

    def run(batches):
        for batch in batches:
            lists = batch.column(6)
            many = lists.value_lengths().to_numpy(zero_copy_only=False)
            of, end = np.repeat(np.arange(batch.num_rows), many), np.repeat(np.cumsum(many), many)
            token, at = lists.flatten().to_numpy().view(np.uint64), batch.column(5).flatten().to_numpy()
            size = batch.column(2).to_numpy()[of].astype(np.int64)
            begins = at < prefix(size, threshold)
            often = decoded(count.value[(token & np.uint64(COUNTERS - 1)).astype(np.int64)]) > OFTEN
            alone = np.flatnonzero(begins & (~often | (size > threshold * wide(threshold))))
            first = np.flatnonzero(begins & often & (size <= wide(threshold)))
            where, keys = [alone], [token[alone]]
            for step in range(1, WIDE):
                first = first[first + step < end[first]]
                if not len(first):
                    break
                where.append(first)
                keys.append(mix(token[first] * np.uint64(3) + mix(token[first + step].copy())))
            where, key = np.concatenate(where), np.concatenate(keys).view(np.int64)
            if only is not None:
                keep = marked(only.value, key)
                where, key = where[keep], key[keep]
            d, set_, _, a, b = (batch.column(i).to_numpy()[of[where]] for i in range(5))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (key, packed(size[where], at[where]), d, set_, a, b)], names=["key", "info", "d", "set", "a", "b"])

    return run


def in_blocks(large: DataFrame) -> DataFrame:
    """Postings of large groups (of ``meet``, a set once a key) dealt to all pairs of their group's blocks, each a key of its own."""
    own = large.select("key", "info", F.col("late_d").alias("d"), F.col("late").alias("set"), F.col("early").alias("a"), F.col("early_d").alias("b"))
    sizes = own.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    met = join_hot(own, sizes, "key", hot_keys(own, "key", large.count()))
    met = met.withColumn("own", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x, y = F.least("own", "other"), F.greatest("own", "other")
    info = F.col("info").bitwiseOR(F.when(x == y, 0).otherwise(F.when(F.col("own") == x, 1).otherwise(3)).cast("long"))
    return met.select(F.xxhash64("key", x, y).alias("key"), info.alias("info"), "d", "set", "a", "b")


def _then_none(batches):
    yield from batches
    yield None
    give_back()


def marked(marks: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = (mix(x.astype(np.int64).view(np.uint64).copy()) & np.uint64(MARKS - 1)).astype(np.int64)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def marks_of(rows: DataFrame, made=iter) -> np.ndarray:
    """A bit table of fixed size with all values of a long column marked (and, by chance, others).

    made: batches to those whose first column is marked. It runs in the same worker: two Python steps on end would hold two workers a task."""

    def run(batches):
        bits = np.zeros(MARKS >> 3, np.uint8)
        for batch in made(batches):
            at = (mix(batch.column(0).to_numpy().view(np.uint64).copy()) & np.uint64(MARKS - 1)).astype(np.int64)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield from chunked(bits)

    return dense_total(rows.mapInArrow(run, "chunk int, data binary"), "uint8", MARKS >> 3, "uint8", union=True)


def repeated_lines(docs: DataFrame, threshold: float = 0.8, least: int = 1) -> DataFrame:
    """(u, line) of every line that goes; docs: d (order), u (row), text."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lines")
    share = scratch.share
    count = share(rarity(docs, "text"))
    found = scratch.keep(lines(docs, threshold, least, count))
    place = F.struct("d", "u", "line")
    firsts = scratch.keep(found.groupBy("set").agg(F.min(place).alias("first"), F.count("*").alias("n")))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    posting = found.filter(F.size("tokens") > 0).select("d", "set", "size", "a", "b", "at", "tokens")

    def candidates(rows: DataFrame, only=None, wanted=None) -> DataFrame:
        dealt = lambda x: x.repartition(parts, "key").sortWithinPartitions("key")
        once = lambda x: x.groupBy("late", "early", "key").agg(F.min("late_d").alias("late_d"), F.min("early_d").alias("early_d"), F.max("more").alias("more"), F.min("info").alias("info"))
        with batches_of(spark, 20_000):
            met = scratch.keep(once(dealt(rows.mapInArrow(postings(count, threshold, only), POSTING)).mapInArrow(meet(threshold, wanted, DIRECT), MET)))
            named, large = met.filter("key IS NULL"), met.filter("key IS NOT NULL")
            if large.isEmpty():
                return named
            found_in = dealt(in_blocks(large)).mapInArrow(meet(threshold, wanted), MET)
            return scratch.keep(once(named.unionByName(found_in)))

    def verified(pairs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        both = pairs.select(F.explode(F.array(F.struct(F.col("late").alias("set"), F.col("late_d").alias("d")), F.struct(F.col("early").alias("set"), F.col("early_d").alias("d")))).alias("e")).select("e.*")
        of_sets, of_docs = share(marks_of(both.select("set"))), share(marks_of(both.select("d")))

        def tokens(batches):
            told: set[int] = set()
            for batch in batches:
                batch = batch.filter(pa.array(marked(of_docs.value, batch.column(0).to_numpy())))
                for part in slices(iter([batch]), "text", SLICE):
                    raw, offsets = text_buffers(part.column(2))
                    h, _, first, _, _, _ = line_words(raw, offsets, count.value)
                    sets = set_hashes(h, first)
                    ends = np.append(first, len(h))
                    hit = [k for k in np.flatnonzero(marked(of_sets.value, sets)).tolist() if not (sets[k] in told or told.add(sets[k]))]
                    if hit:
                        yield pa.record_batch([pa.array(sets[hit]), pa.array([h[ends[k] : ends[k + 1]].view(np.int64) for k in hit], pa.list_(pa.int64()))], names=["set", "words"])

        bags = scratch.keep(docs.mapInArrow(tokens, "set long, words array<long>").groupBy("set").agg(F.first("words").alias("words")))
        pick = lambda c: bags.select(F.col("set").alias(c), F.col("words").alias(f"{c}_words"))
        first = lambda c: firsts.select(F.col("set").alias(c), F.col("first").alias(f"{c}_first"))
        met = join_hot(pairs.join(pick("late"), "late"), pick("early"), "early", hot_keys(pairs, "early", pairs.count()))
        common = F.size(F.array_intersect("late_words", "early_words"))
        alike = met.filter(common >= F.lit(threshold) * (F.size("late_words") + F.size("early_words") - common) - 1e-9).select("late", "early")
        ordered = alike.join(first("late"), "late").join(first("early"), "early").filter("early_first < late_first")
        return scratch.keep(ordered.select(F.col("late").alias("set")).distinct()), [bags]

    pairs = candidates(posting).select("late", "early", "late_d", "early_d", "more")
    gone, used = verified(pairs)
    scratch.drop(*used)
    again = pairs.filter("more").select(F.col("late").alias("set")).distinct().join(gone, "set", "left_anti")
    again = scratch.keep(again)
    if not again.isEmpty():
        keys = marks_of(posting.join(again, "set", "left_semi").select(*posting.columns), postings(count, threshold))
        all_pairs = candidates(posting, share(keys), share(marks_of(again)))
        late, used = verified(all_pairs)
        scratch.drop(*used)
        gone = gone.unionByName(late).distinct()
    # one row a set: every line of a set that goes, all but the first of another one
    decided = scratch.keep(firsts.join(gone.withColumn("gone", F.lit(True)), "set", "left").filter("gone OR n > 1").select("set", "first", F.coalesce("gone", F.lit(False)).alias("gone")))
    scratch.release()
    hot = firsts.filter(F.col("n") >= max(2, -(-found.count() // HOT))).select("set")
    met = join_hot(found.select("set", "d", "u", "line"), decided, "set", hot)
    return met.filter(F.col("gone") | (place > F.col("first"))).select("u", "line")


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, least: int = 1) -> DataFrame:
    """All columns of docs with ``text`` less the lines that go, and __lines (before) and __gone (their numbers, sorted)."""
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold must be 0.5 to 1")
    numbered = docs.withColumn("__u", F.monotonically_increasing_id())
    own = numbered.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63))).alias("d"), F.col("__u").alias("u"), F.col(f"`{text}`").alias("text"))
    lost = repeated_lines(own, threshold, least).groupBy(F.col("u").alias("__u")).agg(F.sort_array(F.collect_list("line")).alias("__gone"))
    met = numbered.join(lost.hint("shuffle_hash"), "__u", "left").drop("__u")  # no sort of texts: what is hashed are a few numbers a row
    t = F.col(f"`{text}`")
    split = F.split(t, "\n", -1)
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("__gone", i)), "\n")
    met = met.withColumn("__lines", F.when(t.isNull(), 0).otherwise(F.size(split)))
    return met.withColumn(text, F.when(F.col("__gone").isNull(), t).otherwise(kept)).withColumn("__gone", F.coalesce("__gone", F.array().cast("array<int>")))


