"""The whole job where a part of it was done before: one test a finding."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F


def test_op2_scores_with_all_ngrams(spark, tmp_path):
    """However few n-grams are broadcast, the score is that of the model of all of them."""
    from barflow.llm import ppm

    r = random.Random(5)
    texts = [" ".join(r.choice(("data", "datum", "stream", "strand", f"x{r.randrange(60)}", "é")) for _ in range(r.randint(0, 40))) for _ in range(80)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    batch = pa.record_batch([pa.array([t for k, t in enumerate(texts) if k % 5])], names=["text"])
    t = pa.Table.from_batches(ppm.count_task(5, "text")(iter([batch])))
    level, gram, n = t["level"].to_numpy(), t["gram"].to_numpy().view(np.uint64), t["n"].to_numpy()
    total = (gram & np.uint64(255)) == ppm.START
    pick = lambda k, x: (gram[(level == k) & (total == x)], n[(level == k) & (total == x)])
    trie = ppm.Trie(5, [pick(k, False) for k in range(6)], [(g >> np.uint64(8), m) for g, m in (pick(k, True) for k in range(6))])
    want = {k: trie.log10(ppm.grams(*ppm.framed(*ppm.lowered(pa.array([t])), 5), 5)).sum() for k, t in enumerate(texts)}
    docs = spark.read.parquet(str(tmp_path / "t"))
    for share in (0.02, 1e-9):
        got = {x.doc_id: x.score for x in ppm.ppm_scores(docs, F.col("doc_id") % 5 != 0, share=share).collect()}
        assert got == {k: pytest.approx(x) for k, x in want.items()}


def test_op5_rows_out_of_order(spark, tmp_path):
    """Repeated lines met late before early in one task: the earlier doc_id counts, not the place in the file."""
    from barflow.llm.linededup import line_dedup

    r = random.Random(7)
    rows = []
    for g in range(30):
        x = [f"w{g}x{k}" for k in range(10)]
        y = [*x[:9], f"own{g}"]
        rows += [(1000 * g + 100, " ".join(x)), (1000 * g + 5, " ".join(x)), (1000 * g + 50, " ".join(y))]
    rows = [rows[0], *rows[1:3], *r.sample(rows[3:], len(rows) - 3)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    got = line_dedup(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert {x.doc_id for x in got if not x["__gone"]} == {1000 * g + 5 for g in range(30)}


def test_op5_short_lines(spark, tmp_path):
    """Every non-blank line takes part, against brute force without a least number of words."""
    from barflow.llm.linededup import line_dedup

    r = random.Random(11)
    texts = ["\n".join(" ".join(r.choice("abcdefg") * r.choice((1, 1, 2)) for _ in range(r.randint(0, 6))) for _ in range(5)) for _ in range(60)]
    texts += ["Les.\n \n\nLes. Les.", "head head head\nhead"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    want, before = {k: [] for k in range(len(texts))}, []
    for k, text in enumerate(texts):
        for line, x in enumerate(text.split("\n")):
            if s := set(x.split()):
                if any(len(s & q) >= 0.8 * len(s | q) - 1e-9 for q in before):
                    want[k].append(line)
                before.append(s)
    got = line_dedup(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert {x.doc_id: x["__gone"] for x in got} == want


def test_op5_query_whole(spark):
    """The query against brute force over every non-blank line."""
    import collections

    import pyarrow.parquet as pq

    from barflow.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    t = pq.read_table(f"{sf}/documents.parquet")
    sizes, post, want = [], collections.defaultdict(list), collections.defaultdict(set)
    for d, text in sorted(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)):
        for k, line in enumerate(text.split("\n")):
            s = set(line.encode().split())
            both = collections.Counter(j for w in s for j in post[w])
            if any(n >= 0.8 * (len(s) + sizes[j] - n) - 1e-9 for j, n in both.items()):
                want[d].add(k)
            for w in s:
                post[w].append(len(sizes))
            sizes.append(len(s))
    got = {r.doc_id: {int(x) for x in r.removed.split(",") if x} for r in QUERIES["op5_line_dedup"](spark, sf).collect()}
    assert got == {d: want[d] for d in got}


def test_op8_repeated_passages(spark, tmp_path):
    """Near copies whose own passages are repeated often: alike as sets, far apart by how often shingles occur."""
    from barflow.llm.minhash import near_duplicates, numbered

    rows = []
    for g in range(40):
        common = " ".join(f"c{g}x{k}" for k in range(404))
        rows += [(2 * g + side, f"{common} " + " ".join([" ".join(f"o{g}s{side}x{k}" for k in range(32))] * 3000)) for side in range(2)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    got = {r.d: r.class_id for r in near_duplicates(numbered(spark.read.parquet(str(tmp_path / "t")))[1]).collect()}
    bag = lambda t: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)}
    a, b = bag(rows[0][1]), bag(rows[1][1])
    assert len(a & b) >= 0.8 * len(a | b)
    assert got == {d: d - d % 2 for d, _ in rows}


@pytest.mark.parametrize("often, direct, block", [(0, 30, 10), (0, 10**6, 10), (10**9, 30, 10), (5, 60, 40)])
def test_op5_keys_and_blocks(spark, tmp_path, monkeypatch, often, direct, block):
    """Rare and frequent words, short and long lines, groups met at once and in blocks: always what brute force finds."""
    from barflow.llm import linededup

    r = random.Random(9)
    bases = [[f"w{r.randrange(90)}" for _ in range(n)] for n in (4, 5, 6, 9, 12, 20, 26, 31, 32, 33, 38, 41, 60)]
    texts = []
    for k in range(400):
        own = list(bases[k % len(bases)])
        for _ in range(r.randint(0, max(1, len(own) // 6))):
            own[r.randrange(len(own))] = f"w{r.randrange(90)}"
        texts.append(" ".join(own[: len(own) - r.randint(0, len(own) // 10)]))
    sets = [set(t.split()) for t in texts]
    want = {k for k, s in enumerate(sets) if any(len(s & q) >= 0.8 * len(s | q) - 1e-9 for q in sets[:k])}
    monkeypatch.setattr(linededup, "OFTEN", often)
    monkeypatch.setattr(linededup, "DIRECT", direct)
    monkeypatch.setattr(linededup, "BLOCK", block)
    monkeypatch.setattr(linededup, "NAMED", 1)
    monkeypatch.setattr(linededup, "GATHER", 100)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    got = linededup.line_dedup(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert {x.doc_id for x in got if x["__gone"]} == want


def test_repeated_misses_are_sent_once():
    """A held-out text that repeats itself sends each n-gram it misses once, with how often it is there."""
    import numpy as np
    import pyarrow as pa

    from barflow.llm.common import text_buffers
    from barflow.llm.ppm import text_scores

    texts = ["zq" * 20_000, "", "zq" * 5, "abc"]
    raw, offsets = text_buffers(pa.array(texts))
    none = np.zeros(0, np.uint64)
    score, missed, times = text_scores(none, np.zeros(0), 5, raw, offsets)
    assert score.tolist() == [0.0] * 4
    for text, grams, n in zip(texts, missed.to_pylist(), times.to_pylist(), strict=True):
        assert len(set(grams)) == len(grams) == len(n) and sum(n) == len(text) + 1  # and the end
    assert len(missed[0]) < 12 and max(times[0].as_py()) > 19_000
