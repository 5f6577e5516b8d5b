"""The registered queries against plain brute force on the smallest tables, and parts against exact references."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    t = pq.read_table(f"{SF}/documents.parquet")
    return sorted(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), t["lang"].to_pylist(), strict=True))


def query(spark, name):
    from barflow.llm.queries import QUERIES

    return QUERIES[name](spark, SF).collect()


def test_op1(spark, rows):
    cut = re.compile(r"(?:\S++[^\S\n]*+){1,32}", re.A)

    def alike(a, b):
        x, y = set(cut.findall(a)), set(cut.findall(b))
        return len(x & y) / len(x | y) if x | y else 1.0

    down = rows[::-1]
    got = {r.doc_id: r for r in query(spark, "op1_fingerprints")}
    for k, (d, text, _) in enumerate(down):
        after = down[(k + 1) % len(down)][1]
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(alike(text, edited)) and r.near_next == pytest.approx(alike(text, after))


def test_op2(spark, rows):
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    words = {d: [*text.encode().lower().split(), None] for d, text, _ in rows}
    count = collections.Counter(w for d, ws in words.items() if not held(d) for w in ws)
    n, v = sum(count.values()), len(count)
    got = query(spark, "op2_ppm_scores")
    assert len(got) == len(rows)
    for r in got:
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(words[r.doc_id]), sum(w in count for w in words[r.doc_id]), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
        assert r.score > -math.log10(256) * (len(words[r.doc_id]) + len(dict((d, t) for d, t, _ in rows)[r.doc_id].encode()))


def test_op2_beats_its_base(spark):
    from barflow.llm.queries import QUERIES

    out = QUERIES["op2_ppm_scores"](spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_ppm_adds_up_to_one():
    from barflow.llm import ppm

    texts = pa.array(["the cat sat on the mat", "the rat sat", "a cat and a rat"] * 3)
    batch = pa.record_batch([texts], names=["text"])
    t = pa.Table.from_batches(ppm.count_task(3, "text")(iter([batch])))
    level, gram, n = t["level"].to_numpy(), t["gram"].to_numpy().view(np.uint64), t["n"].to_numpy()
    total = (gram & np.uint64(255)) == ppm.START
    pick = lambda k, x: (gram[(level == k) & (total == x) & (n > 1)], n[(level == k) & (total == x) & (n > 1)])
    trie = ppm.Trie(3, [pick(k, False) for k in range(4)], [(g >> np.uint64(8), m) for g, m in (pick(k, True) for k in range(4))])
    for context in (b"the", b" ca", b"xyz", b"\xfe\xfet"):
        c = sum(b << (8 * (k + 1)) for k, b in enumerate(context))
        every = np.array([(c << 0) | s for s in range(256)], np.uint64)
        assert (10 ** trie.log10(every)).sum() == pytest.approx(1)


def test_op4(spark, rows):
    from barflow.llm.bpe import encoder

    lib = encoder("byte_bpe_50k.json").library([t for _, t, _ in rows])
    ids = {d: np.array([*x, 0], "<u4") for (d, *_), x in zip(rows, lib, strict=True)}
    got = query(spark, "op4_best_fit_packing")
    pieces, used = collections.Counter(), collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert used[r.sequence_id] == r.offset
        used[r.sequence_id] += r.length
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32
        pieces[r.doc_id] += r.length
    assert max(used.values()) <= 2048 and {d: len(x) for d, x in ids.items()} == dict(pieces)
    assert len(used) <= math.ceil(sum(used.values()) / 2048) * 1.05 + 1


@pytest.mark.parametrize("seed", range(5))
def test_plan(seed):
    from barflow.llm.packing import places, plan

    r = np.random.default_rng(seed)
    counts = np.bincount(np.minimum(r.geometric(0.02, 500), 128), minlength=129)
    counts[0] = 0
    runs = plan(counts, 128)
    seen = np.zeros(129, int)
    for pattern, times in runs:
        assert sum(pattern) <= 128 and times > 0
        for n in pattern:
            seen[n] += times
    assert (seen == counts).all() and set(places(runs)) == set(np.flatnonzero(counts).tolist())


def test_op5_least(spark, rows):
    """With ``least=3``: lines of fewer distinct words stay and are no one's model (the query, which leaves none out, is held in test_whole)."""
    from barflow.llm.linededup import line_dedup

    sizes, post, want = [], collections.defaultdict(list), collections.defaultdict(set)
    for d, text, _ in rows:
        for k, line in enumerate(text.split("\n")):
            s = set(line.encode().split())
            if len(s) < 3:
                continue
            both = collections.Counter(j for w in s for j in post[w])
            if any(n >= 0.8 * (len(s) + sizes[j] - n) - 1e-9 for j, n in both.items()):
                want[d].add(k)
            for w in s:
                post[w].append(len(sizes))
            sizes.append(len(s))
    got = {r.doc_id: set(r["__gone"]) for r in line_dedup(spark.read.parquet(f"{SF}/documents.parquet"), least=3).collect()}
    assert got == {d: want[d] for d, *_ in rows}


def test_op5_blocks(spark, rows, monkeypatch, tmp_path):
    """Many variants of one line, in blocks far smaller than the group."""
    from barflow.llm import linededup

    r = random.Random(3)
    base = [f"word{k}" for k in range(30)]
    texts = []
    for _ in range(300):
        own = list(base)
        for _ in range(r.randint(0, 4)):
            own[r.randrange(30)] = f"new{r.randrange(40)}"
        texts.append(" ".join(own))
    sets = [set(t.split()) for t in texts]
    want = {k for k, s in enumerate(sets) if any(len(s & q) >= 0.8 * len(s | q) - 1e-9 for q in sets[:k])}
    monkeypatch.setattr(linededup, "BLOCK", 50)
    monkeypatch.setattr(linededup, "NAMED", 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "t"))
    got = linededup.line_dedup(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert {x.doc_id for x in got if x["__gone"]} == want


def test_op6(spark, rows):
    lang = {d: x for d, _, x in rows}
    got = [r for r in query(spark, "op6_language_id") if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.95 * len(got)


def test_op8(spark, rows):
    root, post, bags = list(range(len(rows))), collections.defaultdict(list), []

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, (_, text, _) in enumerate(rows):
        w = text.encode().split()
        s = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for j, n in collections.Counter(j for x in s for j in post[x]).items():
            if n >= 0.8 * (len(s) + len(bags[j]) - n) - 1e-9 and top(j) != top(k):
                root[max(top(j), top(k))] = min(top(j), top(k))
        for x in s:
            post[x].append(k)
        bags.append(s)
    want = {rows[k][0]: rows[top(k)][0] for k in range(len(rows))}
    got = query(spark, "op8_near_duplicates")
    assert {r.doc_id: r.class_id for r in got} == want and all(r.kept == (r.class_id == r.doc_id) for r in got)


def test_op9(spark, rows):
    kinds = [re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    names, least = ("assign", "access", "hex"), (8, 16, 32)
    for r in query(spark, "op9_secret_scan"):
        text = dict((d, t) for d, t, _ in rows)[r.doc_id]
        spans = sorted((m.start(), k, m.end()) for k, p in enumerate(kinds) for m in p.finditer(text) if len(m[2] if k == 0 else m[0]) >= least[k])
        told = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))


def test_trigram_queries():
    from barflow.llm.secretscan import trigram_query

    assert trigram_query("abcd") == [["abc", "bcd"]]
    assert trigram_query("(abc|xyz)1*") == [["abc"], ["xyz"]]
    assert trigram_query("[0-9a-f]{32,}") == [[]]
    assert trigram_query("ab?cd") == [["abc", "bcd"], ["acd"]]


def test_op10(spark, rows):
    from barflow.llm.bpe import encoder

    lib = encoder("byte_bpe_50k.json").library([t for _, t, _ in rows])
    want = {d: (len(t.encode()), len(x), len(x) > 1024) for (d, t, _), x in zip(rows, lib, strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in query(spark, "op10_token_counts")} == want


def test_chunks_encode_alike():
    from barflow.llm.bpe import Encoder

    e = Encoder("byte_bpe_50k.json", cache=500)
    r = random.Random(1)
    parts = ["a", "b", "  ", "\n", "\t", "é", " ", "1", "½", "'s", "<|endoftext|>", "語", "🙂", "　", "\x1c", ".", " x", "\r\n", "̀"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)] + [None, "", " ", "x" * 5000]
    n, ids = e.encode(pa.array(texts))
    want = e.library([t or "" for t in texts])
    assert ids.tolist() == [x for w in want for x in w] and n.tolist() == e.count(pa.array(texts)).tolist() == [len(w) for w in want]


def odd_texts():
    """Words of many scripts, more than a small cache holds, texts that a hash by powers cannot tell apart, and very long runs."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdeéß中😀　 \n'1.") for _ in range(r.randint(1, 9))) for _ in range(900)]
    turns = [k.bit_count() % 2 for k in range(2048)]
    same = ["".join("ab"[b] for b in turns), "".join("ba"[b] for b in turns)]
    return [" ".join(r.choice(words) for _ in range(60)) for _ in range(120)] + same + [" " * 1_500_000 + "x", None, "", "a <|endoftext|> b"]


def test_encoder_forgets_nothing_within_a_batch():
    from barflow.llm.bpe import Encoder

    e, texts = Encoder("byte_bpe_50k.json", cache=400), odd_texts()
    want = e.library([t or "" for t in texts])
    for at in (0, 40, 0, 80):  # the cache starts anew between and within batches, with chunks it knows among those it does not
        part = pa.array(texts[at:], pa.string())
        n, ids = e.encode(part)
        assert n.tolist() == [len(w) for w in want[at:]]
        assert ids.tolist() == [i for w in want[at:] for i in w]


def test_op10_counts_all_chunks(spark):
    """Whole slices with a full cache; long chunks are not in the broadcast table."""
    from barflow.llm import bpe
    from barflow.llm.tokencount import hot_table, token_counts

    texts = odd_texts()
    want = [len(w) for w in bpe.encoder("byte_bpe_50k.json").library([t or "" for t in texts])]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(docs, "byte_bpe_50k.json").collect()} == {k: (len((t or "").encode()), n) for k, (t, n) in enumerate(zip(texts, want, strict=True))}
    e = bpe.Encoder("byte_bpe_50k.json", cache=400)
    hot = hot_table(docs, "byte_bpe_50k.json", hot_size=200)
    for at in (0, 40, 0, 80):
        assert e.count(pa.array(texts[at:], pa.string()), hot).tolist() == want[at:]
    assert not len(hot_table(docs.filter("length(text) = 2048"), "byte_bpe_50k.json")[0])
