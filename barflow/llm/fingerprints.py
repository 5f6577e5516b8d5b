"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs, in SQL expressions only.

A text is cut into its lines and these into pieces of at most 32 words; the set of
piece digests (40 bits and a 24-bit check of them) is sketched in cells (count, XOR
of digests), each digest in one cell of each of three tables of eight.  Two sketches
subtract cell by cell; cells that hold one digest are peeled until nothing is left,
which recovers the digests that only one version has.  A pair that doesn't peel is
sketched anew, four times larger: its digests are dealt by hash to four sketches of
the same shape, and again those that still don't peel, which keeps the work in
proportion to the text.  After the last attempt the digest sets themselves are
compared, so a likeness is always exact for the digests (up to hash collisions).

Likeness is the share of common digests among all: |A and B| / |A or B|; two texts
without digests are alike (1).  Defined cases: a null text is an empty one; texts
are read whole; a piece that repeats within a text counts once; equal texts have
equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TABLES, ROWS = 3, 8
ROUNDS = 7
#: How often a sketch that doesn't peel is dealt to four larger-sized ones before sets are compared.
DEEPEST = 6
PIECE = r"(?:\S++[^\S\n]*+){1,32}"
CHECK = (1 << 24) - 1  # the low bits of a digest check its high bits, so a cell needs no check of its own


def digests(text: str) -> str:
    """The distinct digests of a text's pieces: 40 bits of hash above 24 bits that check them."""
    checked = f"(h & {~CHECK}L) | cast(hash(shiftrightunsigned(h, 24)) & {CHECK} as bigint)"
    return f"array_distinct(transform(transform(regexp_extract_all({text}, r'{PIECE}', 0), p -> xxhash64(p)), h -> {checked}))"


def _sketch(d: str, minus: str | None = None) -> str:
    """Cells of the digests ``d`` (a column or lambda variable), less those of ``minus``."""
    cells = []
    for t in range(TABLES):
        for r in range(ROWS):
            own = lambda x: f"filter({x}, x -> (shiftrightunsigned(x, {24 + 3 * t}) & 7L) = {r}L)"  # noqa: B023, E731
            if minus is None:
                cells.append(f"transform(array({own(d)}), f -> named_struct('n', size(f), 'k', aggregate(f, 0L, (a, x) -> a ^ x)))[0]")
            else:
                cells.append(f"transform(array(named_struct('f', {own(d)}, 'g', {own(minus)})), u -> named_struct('n', size(u.f) - size(u.g), 'k', aggregate(concat(u.f, u.g), 0L, (a, x) -> a ^ x)))[0]")
    return f"array({', '.join(cells)})"


def _minus(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (u, v) -> named_struct('n', u.n - v.n, 'k', u.k ^ v.k))"


def _peel(cells: str) -> str:
    """(left, plus, minus): cells not emptied, digests only the first and only the second has."""
    pure = f"array_distinct(filter(s.cells, c -> (c.n = 1 OR c.n = -1) AND (hash(shiftrightunsigned(c.k, 24)) & {CHECK}) = (c.k & {CHECK}L)))"
    hit = "(shiftrightunsigned(q.k, 24 + 3 * shiftright(i, 3)) & 7L) = (i & 7)"
    less = f"transform(s.cells, (c, i) -> aggregate(filter(p, q -> {hit}), c, (a, q) -> named_struct('n', a.n - q.n, 'k', a.k ^ q.k)))"
    step = f"transform(array({pure}), p -> if(size(p) = 0, s, named_struct('cells', {less}, 'plus', s.plus + size(filter(p, q -> q.n = 1)), 'minus', s.minus + size(filter(p, q -> q.n = -1)))))[0]"
    done = "named_struct('left', size(filter(s.cells, c -> c.n <> 0 OR c.k <> 0L)), 'plus', s.plus, 'minus', s.minus)"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'plus', 0, 'minus', 0), (s, r) -> {step}, s -> {done})"


def differences(rows: DataFrame, pairs: dict[str, tuple[str, str, str, str]]) -> DataFrame:
    """Add a struct (plus, minus) for each pair (digests, other digests, sketch, other sketch): digests that only one has.

    All pairs of a row share one list of what is still open; each further attempt deals an open
    entry's digests by two more bits of their hash to four sketches of the same shape.
    """
    tried = "transform(array({z}), z -> named_struct('p', {p}, 'a', {a}, 'b', {b}, 'left', z.left, 'plus', z.plus, 'minus', z.minus))[0]"
    first = [tried.format(z=_peel(_minus(ca, cb)), p=k, a=a, b=b) for k, (a, b, ca, cb) in enumerate(pairs.values())]
    out = rows.withColumn("__tried", F.expr(f"array({', '.join(first)})")).withColumn("__done", F.expr("filter(transform(__tried, t -> named_struct('p', t.p, 'left', t.left, 'plus', t.plus, 'minus', t.minus)), t -> t.left = 0)"))
    for level in range(DEEPEST):
        dealt = lambda d: f"filter({d}, x -> (shiftrightunsigned(x, {33 + 2 * level}) & 3L) = i)"  # noqa: B023, E731
        open_ = f"flatten(transform(filter(__tried, t -> t.left > 0), t -> transform(array(0L, 1L, 2L, 3L), i -> named_struct('p', t.p, 'a', {dealt('t.a')}, 'b', {dealt('t.b')}))))"
        out = out.withColumn("__open", F.expr(open_))
        again = tried.format(z=_peel(_sketch("h.a", "h.b")), p="h.p", a="h.a", b="h.b")
        out = out.withColumn("__tried", F.expr(f"transform(__open, h -> {again})")).drop("__open")
        out = out.withColumn("__done", F.expr("concat(__done, filter(transform(__tried, t -> named_struct('p', t.p, 'left', t.left, 'plus', t.plus, 'minus', t.minus)), t -> t.left = 0))"))
    rest = "transform(filter(__tried, t -> t.left > 0), t -> named_struct('p', t.p, 'left', 0, 'plus', size(array_except(t.a, t.b)), 'minus', size(array_except(t.b, t.a))))"
    out = out.withColumn("__done", F.expr(f"concat(__done, {rest})"))
    sums = [F.expr(f"aggregate(filter(__done, t -> t.p = {k}), named_struct('plus', 0, 'minus', 0), (s, t) -> named_struct('plus', s.plus + t.plus, 'minus', s.minus + t.minus))").alias(name) for k, name in enumerate(pairs)]
    return out.select(*rows.columns, *sums)


def likeness(a: str, b: str, found: str) -> str:
    return f"if(size({a}) + size({b}) = 0, 1D, cast(size({a}) - {found}.plus as double) / (size({a}) + {found}.minus))"


def printed(cells: str) -> str:
    """A sketch as text: count and digests of each cell, nothing for an empty one."""
    return f"array_join(transform({cells}, c -> if(c.n = 0, '', concat_ws('.', cast(c.n as string), hex(c.k)))), '-')"


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of each whole text; an input column called ``out`` is replaced."""
    own = docs.withColumn("__d", F.expr(digests(f"coalesce(`{text}`, '')")))
    return own.withColumn(out, F.expr(printed(_sketch("__d")))).drop("__d")


def _bucket(sid: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds lie at or above sid: descending ranges of ids, found in two steps."""
    coarse, size = bounds[::256], 256
    ge = lambda xs: F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in xs]), lambda b: b >= sid)) if xs else F.lit(0)
    if len(bounds) <= size:
        return ge(bounds)
    fine = F.array(*[F.array(*[F.lit(x).cast("long") for x in bounds[k : k + size]]) for k in range(0, len(bounds), size)])
    block = F.greatest(ge(coarse) - 1, F.lit(0))
    return block * size + F.size(F.filter(F.get(fine, block), lambda b: b >= sid))


def with_next(docs: DataFrame, key: str, carried: list[str], bucket_rows: int = 2048, most: int = 1 << 14) -> DataFrame:
    """Add next_<c> for each carried column: the value in the row of the next smaller key, after the smallest the largest.

    Rows are dealt into ranges of the key (quantiles; at most ``most`` of them), and each range also gets
    a copy of the row after its last, so that no range waits for another. Null keys come last; rows of
    equal keys are in the order of the carried columns' hash.
    """
    sid = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    rows = docs.count()
    n = min(most, max(1, rows // bucket_rows))
    cuts = [k / n for k in range(1, n)]
    got = docs.select(F.percentile_approx(sid, cuts, 100 * n)).first()[0] if n > 1 and rows else []
    bounds = sorted({int(b) - 1 for b in got or []}, reverse=True)
    placed = docs.withColumn("__sid", sid).withColumn("__bucket", _bucket(F.col("__sid"), bounds)).withColumn("__order", F.xxhash64(*carried))
    heads = docs.select(sid.alias("__sid")).withColumn("__bucket", _bucket(F.col("__sid"), bounds)).groupBy("__bucket").agg(F.max("__sid").alias("__head"))
    chain = Window.orderBy("__bucket")  # one row a range
    everything = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = heads.select("__bucket", F.coalesce(F.lead("__head").over(chain), F.first("__head").over(everything)).alias("__head"))
    guests = placed.join(F.broadcast(follow.select(F.col("__head").alias("__sid"), F.col("__bucket").alias("__to"))), "__sid")  # at most ``most`` rows
    both = placed.withColumn("__guest", F.lit(0)).unionByName(guests.withColumn("__bucket", F.col("__to")).drop("__to").withColumn("__guest", F.lit(1)))
    w = Window.partitionBy("__bucket").orderBy("__guest", F.desc("__sid"), "__order")
    return both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried]).filter("__guest = 0").drop("__sid", "__bucket", "__order", "__guest")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text against its edited version (its last third replaced by as much of the next text's beginning) and the next text."""
    own = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    own = own.withColumn("d", F.expr(digests("text")))
    met = with_next(own, "doc_id", ["text", "d"]).withColumn("n_chars", F.length("text").cast("long"))
    cut = "cast(n_chars div 3 as int)"
    met = met.withColumn("edited", F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {cut}), substring(next_text, 1, {cut}))"))
    met = met.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "d", "next_d", F.expr(digests("edited")).alias("e"))
    met = met.select("*", F.expr(_sketch("d")).alias("cells"), F.expr(_sketch("e")).alias("cells_e"), F.expr(_sketch("next_d")).alias("cells_n"))
    met = differences(met, {"to_e": ("d", "e", "cells", "cells_e"), "to_n": ("d", "next_d", "cells", "cells_n")})
    return met.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.expr(printed("cells")).alias("fingerprint"),
        F.expr(printed("cells_e")).alias("edited_fingerprint"),
        F.expr(likeness("d", "e", "to_e")).alias("near_edited"),
        F.expr(likeness("d", "next_d", "to_n")).alias("near_next"),
    )
