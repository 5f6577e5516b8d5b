"""Text cleaning, features and hashes against a plain Python twin of the rules, which takes nothing from the engine, over whole tables and hard cases."""

import hashlib
import re

import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"
HARD = [
    None, "", "[deleted]", " [Removed] ", " [DEAD] ", "I am a bot, and please contact the moderators", "i'm a boté no", "Bot | r/x", "a bot | x", "go &lt;b&gt; &amp;lt; &zzz; &#123; x", "it&rsquo;s &ldquo;up&rdquo; &lsquo;&#39;&apos; &#x200B; &#٣; &AMP; &amp;amp;", "see https://a.b/c now www.x.y", "HTTP://A b hTTpſ://q",
    "[a](https://b.c/d) e", "[a\nb](https://c)", "**bold** and ~~gone~~ ***x***", "**a\nb**", "a **b c**d", "```code\nmore``` `y` z", "# head\n> quote\n---\n|--|--|\nrest", "# head\r\n> q\r---", "a ---\n---\n", "\n\n--- \n\nb", "$BTC to the moooooooon!!!!!! 🚀🚀", "$BTC$ETH $ETHé $ABC_ $LONGTICKERNAME $A",
    "lol", "LOL", "lol!!!", "lol 🚀", "ok", " Lol　", "loſ", "K", "Please read our subreddit rules. fine", "please read our\nrules", "Not your keys, not your coin do your own research !! dyor", "reminder these rules", "x reminder: rules", "word " * 200, "x" * 600, "é" * 513, "ab " * 170 + "c" * 9,
    "ÄÖÜ äöü ß É ǅ Ⓐ", "this is not financial advice dude", "12345 ... ???", "a b\tc", "a b c", "a b c", "a\u001cb\u001dc\u001e\u001fd\u0085e", "x\n\n\n\n\n\n\ny", "x\r\r\r\r\r\r\ry", "😀😀😀😀😀😀😀", "?!?!.,;:!?", "YES WE CAN GO UP NOW FAST", "İstanbul ΣΑΣ", "<b\n>x</b> <>", "automoderator", "AUTOMODERATORS", "́a $BTĆ",
]

# The rules, in Python's spelling (white space, words and case of all scripts).
GONE = re.compile(r"^\s*\[(?:deleted|removed|dead|unavailable)\]\s*$", re.I)
ROBOT = re.compile("|".join([r"i am a bot[,\s].*?(?:contact the moderators|modmail)", "this action was performed automatically", "please contact the moderators", r"if you have any questions.*?message the mods", r"^bot\s*\|", "automoderator", r"i'm a bot\b"]), re.I | re.S)
LINK = re.compile(r"http[s]?://\S+|www\.\S+|\[.*?\]\(https?://\S+\)", re.I)
STANDS_FOR = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–", "hellip": "…", "rsquo": "'", "lsquo": "'", "rdquo": '"', "ldquo": '"'}
FENCE, STRONG, TITLE = re.compile(r"```.*?```", re.S), re.compile(r"\*{1,3}(.*?)\*{1,3}"), re.compile(r"^#{1,6}\s+", re.M)
MARKS = [(FENCE, " "), (re.compile(r"`[^`]+`"), " "), (STRONG, r"\1"), (re.compile(r"~~(.*?)~~"), r"\1"), (TITLE, ""), (re.compile(r"^>+\s?", re.M), ""), (re.compile(r"^[-*_]{3,}\s*$", re.M), " "), (re.compile(r"^\|?[-| :]+\|$", re.M), " ")]
RULES = re.compile("|".join([r"please read our.*?rules", "this is not financial advice", r"^reminder[:\s].*?rules", r"not your keys[,\s]+not your coins?", r"do your own research[\s.!]*dyor"]), re.I)
NOTHING = set("ok okay lol lmao lmfao haha hehe yep yup nope nah yes no wow same nice true k ty thx thanks np gg rip f oof meh hmm smh ikr idk imo tbh irl omg omfg wtf ffs fml bruh bro dude ditto based cringe".split())
NOTHING_RE = re.compile("^(?:" + "|".join(sorted(NOTHING)) + ")$", re.I)
PICTURE = re.compile("[─-⯯\U0001f300-\U0001f9ff\U0001fa00-\U0001fa9f]")
RUN, SHOUT, LOUD = re.compile(r"(.)\1{4,}"), re.compile(r"\b[A-Z]{2,}\b"), re.compile(r"[!?]{2,}")


def noise(x: str) -> bool:
    return bool(GONE.match(x) or ROBOT.search(x))


def clean(x: str | None, prices: bool = False) -> str:
    c = (x or "").strip()
    if noise(c):
        return ""
    c = re.sub(r"&(?:#\d+|[a-zA-Z]+);", lambda m: STANDS_FOR.get(m[0][1:-1], " "), c)
    c = LINK.sub("[URL]", re.sub(r"<[^>]+>", " ", c))
    for pattern, to in MARKS:
        c = pattern.sub(to, c)
    c = re.sub(r"\$([A-Z]{2,10})\b", r"\1", RULES.sub(" ", c))
    if prices:
        for letters, by in (("kK", 1000), ("mM", 1_000_000)):
            c = re.sub(rf"\$?([\d,]+\.?\d*)[{letters}]\b", lambda m, by=by: str(int(float(m[1].replace(",", "")) * by)), c)
    c = re.sub(r"\s+", " ", RUN.sub(r"\1\1\1\1", c)).strip()
    if NOTHING_RE.match(c) and not (PICTURE.search(c) or SHOUT.search(c) or LOUD.search(c)):
        return ""
    return c[:512].rsplit(" ", 1)[0] if len(c) > 512 else c


def features(raw: str | None, c: str) -> dict:
    raw = raw or ""
    runs = len(RUN.findall(raw))
    seen = {"char_repeats": runs, "had_url": bool(LINK.search(raw)), "had_bot": noise(raw), "had_markdown": any(p.search(raw) for p in (STRONG, TITLE, FENCE)), "is_valid": c != ""}
    if not c:
        return seen | {"emoji_count": 0, "caps_ratio": 0.0, "punct_intensity": 0, "exclamations": 0, "questions": 0, "token_count": 0, "spam_score": 0.0, "content_hash": ""}
    letters, tokens = [x for x in c if x.isalpha()], len(c.split())
    caps = sum(x.isupper() for x in letters) / len(letters) if letters else 0.0
    spam = (0.2 if tokens < 3 else 0.0) + (min(runs / tokens * 0.3, 0.3) if tokens else 0.0)
    spam += (0.2 if caps > 0.8 and tokens > 5 else 0.0) + (0.3 if sum(x in "!?.,;:" for x in c) / len(c) > 0.4 else 0.0)
    return seen | {
        "emoji_count": len(PICTURE.findall(c)), "caps_ratio": round(caps, 4), "punct_intensity": len(LOUD.findall(c)), "exclamations": c.count("!"), "questions": c.count("?"),
        "token_count": tokens, "spam_score": round(min(spam, 1.0), 4), "content_hash": hashlib.md5(c.encode()).hexdigest(),
    }


def plain_simhash(text: str | None) -> int:
    votes = [0] * 64
    for t in (text or "").lower().split():
        h = int(hashlib.md5(t.encode()).hexdigest(), 16)
        votes = [v + (1 if h >> k & 1 else -1) for k, v in enumerate(votes)]
    want = sum(1 << k for k, v in enumerate(votes) if v > 0)
    return want - (1 << 64) if want >> 63 else want


@pytest.fixture(scope="module")
def texts():
    return HARD + pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist() + pq.read_table(f"{SF}/conversations.parquet")["text"].to_pylist()


@pytest.fixture(scope="module")
def done(spark, texts):
    from barflow.operators.posts import apply_cleaning

    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r.asDict() for r in apply_cleaning(df, "text", features=True, drop_invalid=False).orderBy("id").collect()]


def test_clean(texts, done):
    assert [(r["text"], r["cleaned_text"], clean(r["text"])) for r in done if r["cleaned_text"] != clean(r["text"])] == []


def test_features(done):
    for r in done:
        want = features(r["text"], r["cleaned_text"])
        assert {k: r[k] for k in want} == want, r["text"]


def test_simhash(spark, texts, done):
    from barflow.operators.posts import simhash

    assert [r["text"] for r in done if r["simhash"] != plain_simhash(r["cleaned_text"])] == []
    raw = simhash(spark.createDataFrame(list(enumerate(HARD)), "id int, text string"), "text").collect()
    assert [r.text for r in raw if r.simhash != plain_simhash(r.text)] == []


def test_drop_invalid(spark):
    from barflow.operators.posts import apply_cleaning

    df = spark.createDataFrame([(k, t) for k, t in enumerate(HARD)], "id int, text string")
    kept = apply_cleaning(df, "text")
    assert kept.columns == ["id", "text", "cleaned_text", "is_valid"]
    assert sorted(r.id for r in kept.collect()) == [k for k, t in enumerate(HARD) if clean(t)]


def test_prices(spark):
    from barflow.operators.posts import clean_text

    cases = ["buy 50k or 2.5M now", "$1,250.5k at 3m", "12kg and 4K_", "9kk 7Mé 8m.", "1.5k1 k 2k,3M"]
    got = clean_text(spark.createDataFrame([(t,) for t in cases], "text string"), "text", prices=True).collect()
    assert [r.clean for r in got] == [clean(t, True) for t in cases]


@pytest.mark.parametrize(("n", "most", "aim"), [(400, 3, 64), (400, 3, 0), (300, 1, 1), (200, 0, 64)])
def test_hamming_pairs(spark, n, most, aim):
    """No pair is lost or told twice, whatever the number of blocks."""
    import random

    from barflow.operators.posts import hamming_pairs

    rng = random.Random(n + most)
    hashes = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(hashes) < n:
        x = rng.choice(hashes)
        for _ in range(rng.randrange(0, 5)):
            x ^= 1 << rng.randrange(64)
        hashes.append(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in hashes]
    first = {}
    for k, x in enumerate(signed):
        first.setdefault(x, k)
    keys = sorted(first.items(), key=lambda kv: kv[1])
    want = sorted((a, b, ((x ^ y) & ((1 << 64) - 1)).bit_count()) for j, (y, b) in enumerate(keys) for x, a in keys[:j] if ((x ^ y) & ((1 << 64) - 1)).bit_count() <= most)
    got = hamming_pairs(spark.createDataFrame(list(enumerate(signed)), "id long, simhash long"), "id", most=most, aim=aim)
    assert sorted(map(tuple, got.collect())) == want


def test_hamming_groups_stay_small(spark):
    """Keys of ten million random hashes: as many blocks as are chosen for them leave no key above 64 members."""
    from pyspark.sql import functions as F

    from barflow.operators.posts import _blocks_for, hamming_keys

    n = 10_000_000
    keys = hamming_keys(F.xxhash64("id"), _blocks_for(n, 3, 64), 3)
    largest = spark.range(n).select(keys[0].alias("k")).groupBy("k").count().agg(F.max("count")).first()[0]
    assert len(keys) == 10 and largest <= 64


def test_rules_are_not_passed_over(spark):
    """What texts must hold before a rule is tried lets all its matches through, letters of other cases too; a filter on the result does not make the plan grow."""
    from pyspark.sql import functions as F

    from barflow.functions import text as X
    from barflow.operators.posts import apply_cleaning

    parts = ["I am a bot,", "contact the moderators", "modmail", "THI\u017f action wa\u017f performed automat\u0131cally", "if you have any questions", "message the mod\u017f", "bot\u3000|", "AutoModerator", "\u0130'm a BOT",
             "HTTP\u017f://q", "wWw.abc", "[a](https://b)", "please read our", "rule\u017f", "th\u0131s is not f\u0131nancial advice", "Rem\u0131nder:", "not your \u212aeys, not your coin", "do your own re\u017fearch . DYOR", " ", "\u2003", "\n", "word"]
    rows = spark.createDataFrame([(a + g + b,) for a in parts for b in parts for g in (" ", "\u00a0\t", "")], "text string")
    c = F.col("text")
    plain = {"noise": c.rlike(X.REMOVED) | c.rlike(X.BOT), "url": c.rlike(X.URL), "moderator": c.rlike(X.MODERATOR), "strip": F.regexp_replace(c, rf"^[{X.WS}]+|[{X.WS}]+\z", ""), "gaps": F.regexp_replace(c, f"[{X.WS}]+", " ")}
    made = {"noise": X.is_noise(c), "url": X.has_url(c), "moderator": X.may_be_moderator(c) & c.rlike(X.MODERATOR), "strip": X.strip(c), "gaps": F.regexp_replace(c, X.GAP, " ")}
    for name in plain:
        assert not rows.filter(~plain[name].eqNullSafe(made[name])).count(), name
    assert apply_cleaning(rows, "text", prices=True).count()


def test_texts_are_not_exchanged_and_fits_read_a_table(spark, monkeypatch):
    """A post's text is used up before posts meet their times; a model is fitted on a written table."""
    from barflow.plans import queries as Q

    for name in ("text_clean", "text_features", "hourly_sentiment", "alpha_features", "corr_with_target"):
        plan = Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        below = plan.split("Join", 1)[1]
        assert "text#" not in plan.split("Join", 1)[0] and "text#" in below, name
        assert not any("text#" in line.split("Project [", 1)[1].split(" AS ", 1)[0] for line in plan.splitlines() if "Project [text#" in line), name
    read = []
    monkeypatch.setattr(Q, "settle", lambda df: read.append(df) or df)
    Q.q_random_forest(spark, "/root/testdata/sf0.001")
    Q.q_gbt(spark, "/root/testdata/sf0.001")
    assert len(read) == 2


def test_word_list_holds_one_text_at_a_time(spark):
    """Batches to Python are bounded in bytes and rows, and words are those of one text."""
    import tracemalloc

    import pandas as pd

    from barflow.functions.batches import BYTES, ROWS
    from barflow.operators.posts import _listed, score

    score(spark.createDataFrame([("up",)], "text string"), "text")
    assert int(spark.conf.get(ROWS)) <= 2000 and int(spark.conf.get(BYTES).rstrip("bB")) <= 4 << 20
    part = pd.Series(["up the bear goes " * 2000] * 50)
    tracemalloc.start()
    got = next(_listed(iter([part])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["up"].tolist() == got["down"].tolist() == [2000] * 50 and peak < 3_000_000
