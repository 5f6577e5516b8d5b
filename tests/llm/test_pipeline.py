"""Each stage of the pipeline against brute force, on the smallest table with nulls, empty, blank, repeated and clashing rows put in."""

import collections

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    t = pq.read_table(f"{SF}/documents.parquet")
    some = t["text"][0].as_py()
    odd = [(90001, None, None, "web1"), (90002, "", "en", None), (90003, " \n\t\n", None, "web1"), (90004, "🙂🙂 123 ́", "en", "web2"), (90005, some, None, None), (90005, some, None, None), (None, "nur ein kurzer Satz\nauf Deutsch", "de", "web1"), (90007, "Les.\nLes.\nhead head", "fr", "src1")]
    names = ["doc_id", "text", "lang", "source"]
    extra = pa.table([pa.array(c, t.schema.field(n).type) for n, c in zip(names, zip(*odd), strict=True)], names=names).append_column("n_chars", pa.array([len(x[1] or "") for x in odd], t.schema.field("n_chars").type))
    path = str(tmp_path_factory.mktemp("docs") / "t.parquet")
    pq.write_table(pa.concat_tables([t.select([*names, "n_chars"]), extra]), path)
    return spark.read.parquet(path)


def told(df):
    return collections.Counter((r.doc_id, r.text, r.n_chars) for r in df.collect())


def in_order(docs):
    return sorted(((r.doc_id if r.doc_id is not None else -(1 << 63), k, r) for k, r in enumerate(docs.collect())), key=lambda x: x[:2])


def letters(text):
    import unicodedata

    return any(unicodedata.category(c)[0] == "L" for c in text or "")


def test_language(spark, docs):
    from pyspark.sql import functions as F

    from corpus_pipeline import identify_language

    out = identify_language(spark, docs, SF)
    assert out.columns == docs.columns
    kept, every = told(out), told(docs)
    assert all(letters(t) for _, t, _ in kept) and all(n == every[k] for k, n in kept.items())
    with_letters = sum(n for (_, t, _), n in every.items() if letters(t))
    assert sum(kept.values()) >= 0.9 * with_letters and out.filter("lang IS NULL").count() == 0
    plain = docs.withColumn("lang", F.lit(None).cast("string"))
    assert sum(told(identify_language(spark, plain, SF)).values()) == with_letters
    assert identify_language(spark, docs.limit(0), SF).count() == 0


def test_lines(spark, docs):
    from corpus_pipeline import dedup_lines

    want, before, post = collections.Counter(), [], collections.defaultdict(list)
    for _, _, r in in_order(docs):
        if r.text is None:
            want[r.doc_id, None, r.n_chars] += 1
            continue
        kept, lines = [], r.text.split("\n")
        for line in lines:
            s = set(line.encode().split())
            both = collections.Counter(j for w in s for j in post[w])
            if not any(n >= 0.8 * (len(s) + len(before[j]) - n) - 1e-9 for j, n in both.items()):
                kept.append(line)
            for w in s:
                post[w].append(len(before))
            before.append(s)
        text = "\n".join(kept)
        if len(kept) == len(lines):
            want[r.doc_id, r.text, r.n_chars] += 1
        elif text.encode().split():
            want[r.doc_id, text, len(text)] += 1
    assert told(dedup_lines(spark, docs, SF)) == want
    none = dedup_lines(spark, docs.limit(0), SF)
    assert none.columns == docs.columns and none.collect() == []


def test_documents(spark, docs):
    from corpus_pipeline import dedup_documents

    rows, root, post, bags = in_order(docs), [], collections.defaultdict(list), []

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, (_, _, r) in enumerate(rows):
        w = (r.text or "").encode().split()
        s = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        root.append(k)
        for j, n in collections.Counter(j for x in s for j in post[x]).items():
            if n >= 0.8 * (len(s) + len(bags[j]) - n) - 1e-9 and top(j) != top(k):
                root[max(top(j), top(k))] = min(top(j), top(k))
        for x in s:
            post[x].append(k)
        bags.append(s)
    want = collections.Counter((r.doc_id, r.text, r.n_chars) for k, (_, _, r) in enumerate(rows) if top(k) == k)
    assert told(dedup_documents(spark, docs, SF)) == want
    none = dedup_documents(spark, docs.limit(0), SF)
    assert none.columns == docs.columns and none.collect() == []


def test_mixture(spark, docs):
    from barflow.llm.queries import ORACLE_SQL
    from corpus_pipeline import mix_sources

    named = docs.filter("doc_id IS NOT NULL")  # null languages and sources are values of their own
    documents = named.toArrow()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = collections.Counter(r[0] for r in con.sql(ORACLE_SQL["op3_source_mix"]).fetchall())
    assert collections.Counter(r.doc_id for r in mix_sources(spark, named, SF).collect()) == want
    assert {r.doc_id for r in named.collect()} != set(want) != set()  # some are left out
    mixed = mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns
    nameless = collections.Counter(r.text for r in mixed.filter("doc_id IS NULL").collect())
    rows = collections.Counter(r.text for r in docs.filter("doc_id IS NULL").collect())
    assert set(nameless) <= set(rows) and all(n % rows[t] == 0 for t, n in nameless.items())  # of an equal place: all or none in an epoch


def test_packing(spark, docs):
    from barflow.llm.bpe import encoder
    from corpus_pipeline import pack

    rows = docs.collect()
    assert pack(spark, docs.limit(0), SF).collect() == []
    sizes = [len(x) + 1 for x in encoder("byte_bpe_50k.json").library([r.text or "" for r in rows])]
    want = collections.Counter()
    for r, n in zip(rows, sizes, strict=True):
        first = n % 2048 or 2048
        want.update([(r.doc_id, 0, 0, first), *((r.doc_id, k + 1, first + k * 2048, 2048) for k in range((n - first) // 2048))])
    got = pack(spark, docs, SF).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == want
    used = collections.Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert used[r.sequence_id] == r.offset
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048
