"""Prediction by partial matching over bytes, trained on the whole corpus.

Every task counts its own byte n-grams (a context of up to ``order`` bytes and the
symbol after it) and one exchange adds them up into a written table.  All counted
n-grams are the model, none is left out, whatever the size of the corpus.

A symbol is coded at the longest context that was seen.  Escape estimation: each
distinct symbol gives ESCAPE of its count to the escape (method D has a half).
Symbol exclusion: after an escape, symbols of the longer context are taken out of
the shorter one.  Because a longer context's symbols are always among its shorter
one's, the excluded weight is one number a context.

Scores come in three tiers that give the same value.  N-grams that make up at least
``share`` of all symbols are looked up in a broadcast table, which never has more
than 1/share rows; ``share`` decides speed only.  All others go with their text's
number through a join with the written table of the longest n-grams.  Those that
training never saw, which only held-out texts have, are looked up once each at all
their shorter contexts.  ``Trie`` is the same model in memory, for tests.

The model reads the text with A-Z in lower case, preceded by a start symbol and
followed by an end symbol.  The word base of ``score`` is a unigram model with
additive smoothing over the same training texts; frequent words are looked up in
a broadcast table bounded by ``word_share``, all others are joined by their hash.

Defined cases: a null text is an empty one (only the end symbol); long texts are
scored whole; repeated rows give repeated rows; without any training text all
counts are 0, base_score is 0 and every symbol has the same probability.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.llm.common import Scratch, slices, spans_hash, text_buffers, words

START, END = 0xFE, 0xFF  # bytes that UTF-8 never has
#: What a symbol's count gives to the escape: the context's escape weight is this for each distinct symbol.
ESCAPE = 0.3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def framed(raw: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with ``order`` start symbols before and an end symbol after each text, places of the symbols to predict)."""
    sizes = np.diff(offsets)
    n, step = len(sizes), order + 1
    out = np.full(len(raw) + n * step, START, np.uint8)
    at = np.arange(len(raw)) + np.repeat(np.arange(n) * step + order, sizes)
    out[at] = raw
    ends = offsets[1:] + np.arange(1, n + 1) * step - 1
    out[ends] = END
    symbol = np.ones(len(out), bool)
    begins = ends - sizes - order
    for k in range(order):
        symbol[begins + k] = False
    return out, np.flatnonzero(symbol)


def grams(data: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Most recent context byte first, oldest last, the symbol in the low byte: sorting keeps alike contexts together."""
    key = np.zeros(len(at), np.uint64)
    for k in range(1, order + 1):
        key |= data[at - k].astype(np.uint64) << np.uint64(8 * (order + 1 - k))
    return key | data[at].astype(np.uint64)


def shorter(keys: np.ndarray, order: int, to: int) -> np.ndarray:
    """The same n-grams with ``to`` context bytes."""
    return ((keys >> np.uint64(8 * (order + 1 - to))) << np.uint64(8)) | (keys & np.uint64(0xFF)) if to < order else keys


def add_up(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, n
    by = np.argsort(keys, kind="stable")
    keys, n = keys[by], n[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


class Trie:
    """The model in memory, of counts by order: sorted n-grams and their contexts; what was left out of them is escape weight."""

    def __init__(self, order: int, tables: list[tuple[np.ndarray, np.ndarray]], totals: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.order, self.levels = order, []
        for k, ((keys, n), (own, total)) in enumerate(zip(tables, totals, strict=True)):
            by = np.argsort(keys)
            keys, n = keys[by], n[by].astype(float)
            contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
            seen = np.add.reduceat(n, first) if len(n) else n
            by = np.argsort(own)
            all_ = total[by][np.searchsorted(own[by], contexts)].astype(float) if len(contexts) else seen
            distinct = np.diff(np.append(first, len(keys))).astype(float)
            level = {"keys": keys, "log": np.log10(np.maximum(n, 1) - ESCAPE), "n": n, "contexts": contexts, "seen": seen, "distinct": distinct, "lost": all_ - seen}
            if k:
                below = self.levels[-1]
                part = below["n"][np.searchsorted(below["keys"], shorter(keys, k, k - 1))] if len(keys) else n
                level["shared"] = np.add.reduceat(part, first) if len(n) else part  # weight that exclusion takes out of the next shorter context
            self.levels.append(level)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each n-gram's symbol after its context."""
        out, todo = np.zeros(len(keys)), np.arange(len(keys))
        gone, took = np.zeros(len(keys)), np.zeros(len(keys))  # distinct symbols and weight excluded at the next level
        for k in range(self.order, -1, -1):
            level, key = self.levels[k], shorter(keys[todo], self.order, k)
            if not len(level["contexts"]):
                continue
            context = key >> np.uint64(8)
            c = np.minimum(np.searchsorted(level["contexts"], context), len(level["contexts"]) - 1)
            here = level["contexts"][c] == context
            at, c = todo[here], c[here]
            left = level["distinct"][c] - gone[at]
            escape = ESCAPE * np.maximum(left, 1) + level["lost"][c]
            weight = np.log10(np.maximum(level["seen"][c] - took[at] - ESCAPE * left, 0) + escape)
            e = np.minimum(np.searchsorted(level["keys"], key[here]), len(level["keys"]) - 1)
            found = level["keys"][e] == key[here]
            out[at] += np.where(found, level["log"][e], np.log10(escape)) - weight
            gone[at], took[at] = level["distinct"][c], level["shared"][c] if k else 0
            rest = np.ones(len(todo), bool)
            rest[np.flatnonzero(here)[found]] = False
            todo = todo[rest]
            if not len(todo):
                return out
        free = 256 - (self.levels[0]["distinct"][0] if len(self.levels[0]["contexts"]) else 0)
        out[todo] -= np.log10(max(free, 1))
        return out


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = text_buffers(column)
    return _LOWER[raw], offsets


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word; 0 stands for the end token alone."""
    starts, ends, of = words(raw, offsets)
    return np.maximum(spans_hash(raw, starts, ends), np.uint64(1)), of


def count_task(order: int, text: str) -> Callable:
    """A task's counts as rows (level, gram, n): n-grams by order, START as symbol for a context's total; words under level -1."""

    def rows(level: int, keys: np.ndarray, n: np.ndarray):
        for s in range(0, len(keys), 1 << 16):
            part = keys[s : s + (1 << 16)]
            yield pa.record_batch([pa.array(np.full(len(part), level, np.int8)), pa.array(part.view(np.int64)), pa.array(n[s : s + (1 << 16)].astype(np.int64))], names=["level", "gram", "n"])

    def tally(held: list, keys: np.ndarray) -> list:
        keys = np.sort(keys)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        held.append((keys[first], np.diff(np.append(first, len(keys)))))
        return held if sum(len(k) for k, _ in held[1:]) < 2_000_000 else [add_up(*map(np.concatenate, zip(*held, strict=True)))]

    def run(batches):
        held, tokens, texts = [], [], 0
        for batch in slices(batches, text, 1 << 22):
            raw, offsets = lowered(batch.column(text))
            held = tally(held, grams(*framed(raw, offsets, order), order))
            tokens = tally(tokens, word_hashes(raw, offsets)[0])
            texts += batch.num_rows
        if not held:
            return
        keys, n = add_up(*map(np.concatenate, zip(*tokens, strict=True)))
        yield from rows(-1, np.append(np.uint64(0), keys), np.append(texts, n))
        keys, n = add_up(*map(np.concatenate, zip(*held, strict=True)))
        for k in range(order, -1, -1):
            if k < order:
                keys, n = add_up(shorter(keys, k + 1, k), n)
            yield from rows(k, keys, n)
            contexts, total = add_up(keys >> np.uint64(8), n)
            yield from rows(k, (contexts << np.uint64(8)) | np.uint64(START), total)

    return run


def longest(counts: DataFrame, order: int) -> DataFrame:
    """(gram, n, log) of every n-gram of the longest order: log10 of its probability, which needs no escape."""
    own = counts.filter(F.col("level") == order)
    is_total = F.col("gram").bitwiseAND(0xFF) == START
    totals = own.filter(is_total).select(F.shiftright("gram", 8).alias("context"), F.col("n").alias("total"))
    met = own.filter(~is_total).select("gram", "n", F.shiftright("gram", 8).alias("context")).join(totals, "context")
    return met.select("gram", "n", (F.log10(F.col("n") - F.lit(ESCAPE)) - F.log10("total")).alias("log"))


def escapes(counts: DataFrame, absent: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """(gram, log) of n-grams that were never seen whole, from all their shorter contexts."""
    symbol = F.col("gram").bitwiseAND(0xFF)
    paths = absent.select("gram", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("level"))
    paths = paths.withColumn("context", F.expr(f"shiftright(gram, 8 * ({order + 1} - level))")).withColumn("key", F.shiftleft("context", 8).bitwiseOR(symbol))
    paths = scratch.keep(paths)
    grams = counts.filter((F.col("level") >= 0) & (symbol != START)).select(F.col("level").cast("int").alias("level"), "gram", "n")
    own = grams.withColumn("context", F.shiftright("gram", 8)).join(paths.select("level", "context").distinct(), ["level", "context"], "left_semi")
    own = scratch.keep(own.withColumn("shorter", F.shiftleft(F.shiftright("gram", 16), 8).bitwiseOR(symbol)))
    below = grams.select((F.col("level") + 1).alias("level"), F.col("gram").alias("shorter"), F.col("n").alias("shared"))
    below = below.join(own.select("level", "shorter").distinct(), ["level", "shorter"])  # tables as small as this one are joined without moving the counts
    own = own.join(below, ["level", "shorter"], "left")
    stats = scratch.keep(own.groupBy("level", "context").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.coalesce(F.sum("shared"), F.lit(0)).alias("shared")))
    single = scratch.keep(grams.withColumnRenamed("gram", "key").join(paths.select("level", "key").distinct(), ["level", "key"]))

    def look(part: str, small) -> DataFrame:
        return paths.filter(part).join(small(stats.filter(part)), ["level", "context"]).join(small(single.filter(part)), ["level", "key"], "left")

    # a context of at most one byte is everyone's: its at most 257 rows and 65,792 n-grams are broadcast
    met = look("level < 2", F.broadcast).unionByName(look("level >= 2", lambda x: x))
    values = ("n", "total", "distinct", "shared")
    wide = met.groupBy("gram").agg(*(F.coalesce(F.max(F.when(F.col("level") == k, F.col(v))), F.lit(0)).alias(f"{v}{k}") for k in range(order + 1) for v in values))
    # without any training text there is no context at all
    wide = absent.join(wide, "gram", "left").na.fill(0)

    def run(batches):
        for batch in batches:
            n, total, distinct, shared = (np.stack([batch.column(f"{v}{k}").to_numpy(zero_copy_only=False) for k in range(order + 1)]).astype(float) for v in values)
            out, gone, took, todo = *(np.zeros(batch.num_rows) for _ in range(3)), np.ones(batch.num_rows, bool)
            for k in range(order, -1, -1):
                here = todo & (total[k] > 0)
                left = distinct[k] - gone
                escape = ESCAPE * np.maximum(left, 1)
                weight = np.log10(np.maximum(total[k] - took - ESCAPE * left, 0) + escape)
                out += np.where(here, np.log10(np.where(n[k] > 0, n[k] - ESCAPE, escape)) - weight, 0)
                gone, took = np.where(here, distinct[k], gone), np.where(here, shared[k], took)
                todo &= n[k] == 0
            out -= np.where(todo, np.log10(np.maximum(256 - distinct[0], 1)), 0)
            yield pa.record_batch([batch.column("gram"), pa.array(out)], names=["gram", "log"])

    return wide.mapInArrow(run, "gram long, log double")


def text_scores(keys: np.ndarray, logs: np.ndarray, order: int, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
    """(log10 of the probability of each text's n-grams among keys, its other n-grams, once each, how often they are there); at most 65,536 texts a call.

    The text's number stands below its n-grams' bits, so that one plain sort brings equal n-grams together."""
    n = len(offsets) - 1
    data, at = framed(raw, offsets, order)
    of = np.repeat(np.arange(n, dtype=np.uint64), np.diff(offsets) + 1)
    both = np.sort((grams(data, at, order) << np.uint64(16)) | of)
    own = both >> np.uint64(16)
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    times = np.diff(np.append(first, len(own)))
    log, hit = np.zeros(len(first)), np.zeros(len(first), bool)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, own[first]), len(keys) - 1)
        hit = keys[at] == own[first]
        log[hit] = logs[at[hit]]
    score = np.bincount((both & np.uint64(0xFFFF)).astype(np.int64), np.repeat(log, times), n).astype(float)
    rest = both[np.repeat(~hit, times)]
    first = np.flatnonzero(np.append(True, rest[1:] != rest[:-1])) if len(rest) else np.zeros(0, np.int64)
    many, rest = np.diff(np.append(first, len(rest))), rest[first]
    of = (rest & np.uint64(0xFFFF)).astype(np.int64)
    by = np.argsort(of, kind="stable")
    ends = pa.array(np.searchsorted(of[by], np.arange(n + 1)).astype(np.int32))
    return score, pa.ListArray.from_arrays(ends, pa.array((rest[by] >> np.uint64(16)).view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(many[by].astype(np.int32)))


def ppm_scores(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", order: int = 5, share: float = 4e-7, word_share: float = 2.5e-7) -> DataFrame:
    """Per document: ``key``, held_out (not ``learn``), n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    share: n-grams this frequent are looked up, all others joined, with equal results.  order: at most 5, so that an n-gram and a text's number fit 64 bits."""
    if not 0 <= order <= 5:
        raise ValueError("order must be 0 to 5")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ppm")
    own = docs.select(F.col(f"`{key}`").alias("__key"), F.coalesce(learn, F.lit(False)).alias("__learn"), F.col(f"`{text}`").alias("__text"))
    counts = own.filter("__learn").select("__text").mapInArrow(count_task(order, "__text"), "level byte, gram long, n long")
    counts = scratch.keep(counts.groupBy("level", "gram").agg(F.sum("n").alias("n")))
    is_word = F.col("level") == -1
    seen, distinct = counts.filter(is_word).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = counts.filter(is_word & (F.col("n") >= max(1, int(word_share * seen)))).select("gram", "n").toArrow()
    often_keys, often_n = often["gram"].to_numpy().view(np.uint64), often["n"].to_numpy()
    by = np.argsort(often_keys)
    symbols = counts.filter((F.col("level") == 0) & (F.col("gram") == START)).agg(F.sum("n")).first()[0] or 0
    whole_grams = scratch.keep(longest(counts, order))
    tier = whole_grams.filter(F.col("n") >= max(1, int(share * symbols))).select("gram", "log").toArrow()
    tier_keys, tier_logs = tier["gram"].to_numpy().view(np.uint64), tier["log"].to_numpy()
    sorted_ = np.argsort(tier_keys)
    model = spark.sparkContext.broadcast((tier_keys[sorted_], tier_logs[sorted_], often_keys[by], often_n[by]))
    out = T.StructType([own.schema[0], T.StructField("held_out", T.BooleanType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("logs", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("rare_n", T.ArrayType(T.IntegerType())), T.StructField("missed", T.ArrayType(T.LongType())), T.StructField("missed_n", T.ArrayType(T.IntegerType()))])

    def score(batches):
        top, logs_of, keys, n = model.value
        for whole in slices(batches, "__text"):
            for s in range(0, whole.num_rows, 1 << 16):
                batch = whole.slice(s, 1 << 16)
                raw, offsets = lowered(batch.column(2))
                h, of = word_hashes(raw, offsets)
                rows = batch.num_rows
                h, of = np.append(h, np.zeros(rows, np.uint64)), np.append(of, np.arange(rows))
                by = np.argsort(h)
                h, of = h[by], of[by]
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                times = np.diff(np.append(first, len(h)))
                at = np.minimum(np.searchsorted(keys, h[first]), max(len(keys) - 1, 0))
                hit = keys[at] == h[first] if len(keys) else np.zeros(len(first), bool)
                c = np.where(hit, n[at], 0) if len(keys) else np.zeros(len(first), np.int64)
                known, hits = np.repeat(c, times), np.repeat(hit, times)
                logs = np.bincount(of[hits], np.log10(known[hits] + 0.1), rows).astype(float)
                rare, rare_of = h[~hits], of[~hits]
                by = np.lexsort((rare, rare_of))
                rare, rare_of = rare[by], rare_of[by]
                first = np.flatnonzero(np.append(True, (rare[1:] != rare[:-1]) | (rare_of[1:] != rare_of[:-1]))) if len(rare) else np.zeros(0, np.int64)
                ends = pa.array(np.searchsorted(rare_of[first], np.arange(rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (rare[first].view(np.int64), np.diff(np.append(first, len(rare))).astype(np.int32))]
                known_score, *missed = text_scores(top, logs_of, order, raw, offsets)
                made = [np.diff(offsets), np.bincount(of, minlength=rows), np.bincount(of[hits], minlength=rows), logs, known_score]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(~batch.column(1).to_numpy(zero_copy_only=False)), *map(pa.array, made), *lists, *missed], names=out.names)

    scored = scratch.keep(own.mapInArrow(score, out).withColumn("__row", F.monotonically_increasing_id()))
    rare = scored.select("__row", F.explode(F.arrays_zip("rare", "rare_n")).alias("w")).select("__row", F.col("w.rare").alias("gram"), F.col("w.rare_n").alias("times"))
    met = rare.join(counts.filter(is_word).select("gram", "n"), "gram", "left")
    c = F.coalesce("n", F.lit(0))
    sums = met.groupBy("__row").agg(F.sum(F.col("times") * F.log10(c + 0.1)).alias("rare_logs"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    absent = scratch.keep(scored.filter("held_out").select(F.explode("missed").alias("gram")).distinct().join(whole_grams, "gram", "left_anti"))
    logs = whole_grams.select("gram", "log").unionByName(escapes(counts, absent, order, scratch))
    missed = scored.select("__row", F.explode(F.arrays_zip("missed", "missed_n")).alias("g")).select("__row", F.col("g.missed").alias("gram"), F.col("g.missed_n").alias("times"))
    joined = missed.join(logs, "gram").groupBy("__row").agg(F.sum(F.col("times") * F.col("log")).alias("missed_score"))
    score_ = F.col("score") + F.coalesce("missed_score", F.lit(0.0))
    z = float(np.log10(seen + 0.1 * (distinct + 1)))
    return scored.join(sums, "__row", "left").join(joined, "__row", "left").select(
        F.col("__key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(seen).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * z).alias("base_score"),
        score_.alias("score"),
        (-score_ / F.lit(float(np.log10(2))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
