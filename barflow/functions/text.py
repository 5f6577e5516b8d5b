"""Social text: the ordered cleaning steps, features, 64-bit SimHash."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, and what a word is made of, as the rules mean them: of all scripts, spelled out so that no engine's own idea of \\s and \\b counts.
WS = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SOLID = f"[^{WS}]"
# The same as a class that looks most characters up in a table of bits and leaves the others at once: single characters below 256, then one range around the rest.
SPACE = r"[\t\n\x0B\f\r\x1C\x1D\x1E\x1F\x20\x85\xA0[\u1680-\u3000&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]]"
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Runs of white space that are not a single space already.
GAP = rf"\x20{SPACE}+|[\t\n\x0B\f\r\x1C\x1D\x1E\x1F\x85\xA0[\u1680-\u3000&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]]{SPACE}*"
BEGIN, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

# The patterns and words of the cleaning rules. (?iu): either case in all scripts; (?d): only \n ends a line.
REMOVED = rf"(?iud)^{SPACE}*\[(?:deleted|removed|dead|unavailable)\]{SPACE}*$"
BOT = rf"(?iusd)(?:i am a bot[,{WS}].*?(?:contact the moderators|modmail)|this action was performed automatically|please contact the moderators|if you have any questions.*?message the mods|^bot{SPACE}*\||automoderator|i'm a bot{END})"
URL = rf"(?iud)http[s]?://{SOLID}+|www\.{SOLID}+|\[.*?\]\(https?://{SOLID}+\)"
ENTITY = r"&(?:#\p{Nd}+|[a-zA-Z]+);"
TAG = r"<[^>]+>"
MODERATOR = rf"(?iud)(?:please read our.*?rules|this is not financial advice|^reminder[:{WS}].*?rules|not your keys[,{WS}]+not your coins?|do your own research[{WS}.!]*dyor)"
FILLER = r"(?iud)^(?:ok|okay|lol|lmao|lmfao|haha|hehe|yep|yup|nope|nah|yes|no|wow|same|nice|true|k|ty|thx|thanks|np|gg|rip|f|oof|meh|hmm|smh|ikr|idk|imo|tbh|irl|omg|omfg|wtf|ffs|fml|bruh|bro|dude|ditto|based|cringe)$"
TICKER = rf"\$([A-Z]{{2,10}}){END}"
REPEAT = r"(?d)(.)\1{4,}"
EMOJI = r"[\x{2600}-\x{27BF}\x{1F300}-\x{1F9FF}\x{2700}-\x{27BF}\x{1FA00}-\x{1FA9F}\x{2500}-\x{2BEF}]"
CAPS_WORD = rf"{BEGIN}[A-Z]{{2,}}{END}"
INTENSE = r"[!?]{2,}"
PUNCTUATION = r"[!?.,;:]"
#: What an entity stands for; any other is a space.
ENTITIES = {
    "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&mdash;": "—", "&ndash;": "–",
    "&hellip;": "…", "&rsquo;": "'", "&lsquo;": "'", "&rdquo;": '"', "&ldquo;": '"',
}
#: Markdown in order: pattern, replacement, and the signs of which a text must hold one.
CODE, BOLD, HEADER = r"(?s)```.*?```", r"(?d)\*{1,3}(.*?)\*{1,3}", rf"(?md)^#{{1,6}}{SPACE}+"
MARKDOWN = (
    (CODE, " ", ("```",)),
    (r"`[^`]+`", " ", ("`",)),
    (BOLD, "$1", ("*",)),
    (r"(?d)~~(.*?)~~", "$1", ("~~",)),
    (HEADER, "", ("#",)),
    (rf"(?md)^>+{SPACE}?", "", (">",)),
    (rf"(?md)^[-*_]{{3,}}{SPACE}*$", " ", ("-", "*", "_")),
    (r"(?md)^\|?[-| :]+\|$", " ", ("|",)),
)


def strip(x: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(x, F.lit(WHITE))


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x in the expression once, however often f names it: rules one after another would else double when a filter on their result is pushed below them."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


# What a text must hold in either case for a rule to match: pieces of the rule's words without i, k and s, which have cases beyond ASCII.
def may_be_bot(x: Column) -> Column:
    return _once(F.lower(x), lambda low: low.contains("bot") | low.contains("automat") | low.contains("moderator") | low.contains("the mod"))


def may_have_url(x: Column) -> Column:
    return _once(F.lower(x), lambda low: low.contains("://") | low.contains("www."))


def may_be_moderator(x: Column) -> Column:
    return _once(F.lower(x), lambda low: low.startswith("rem") | low.contains("read our") | low.contains("al adv") | low.contains("not your ") | low.contains("do your own re"))


def is_noise(x: Column) -> Column:
    """Deleted placeholders and bot notices."""
    return x.rlike(REMOVED) | (may_be_bot(x) & x.rlike(BOT))


def has_url(x: Column) -> Column:
    return may_have_url(x) & x.rlike(URL)


def _each(x: Column, pattern: str, group: int, value: Callable[[Column], Column]) -> Column:
    """Every match of a pattern replaced by what its group stands for, in one scan: what comes out is not read again."""
    gaps, found = F.split(x, pattern, -1), F.regexp_extract_all(x, F.lit(pattern), F.lit(group))

    def one(gap: Column, i: Column) -> Column:
        return F.when(F.get(found, i).isNotNull(), F.array(gap, value(F.get(found, i)))).otherwise(F.array(gap))

    return F.array_join(F.flatten(F.transform(gaps, one)), "")


def decode_entities(x: Column) -> Column:
    """Known entities to their characters, unknown ones to a space, in one scan: ``&amp;lt;`` gives ``&lt;``."""
    table = F.create_map(*[F.lit(v) for kv in ENTITIES.items() for v in kv])
    return F.when(x.contains("&"), _each(x, ENTITY, 0, lambda e: F.coalesce(F.try_element_at(table, e), F.lit(" ")))).otherwise(x)


def expand_prices(x: Column) -> Column:
    """50k to 50000, 2.5M to 2500000: the text is cut at the prices and joined again with their values."""
    for pattern, factor in ((rf"\$?([\d,]+\.?\d*)[kK]{END}", 1_000), (rf"\$?([\d,]+\.?\d*)[mM]{END}", 1_000_000)):
        value = lambda v, by=factor: F.coalesce((F.regexp_replace(v, ",", "").try_cast("double") * by).cast("decimal(38,0)").cast("string"), v)
        x = _each(x, pattern, 1, value)
    return x


def _where(x: Column, may: Callable[[Column], Column], pattern: str, to: str) -> Column:
    """The pattern's matches replaced in texts that may have one."""
    return _once(x, lambda v: F.when(may(v), F.regexp_replace(v, pattern, to)).otherwise(v))


def markdown_steps(x: Column) -> list[Column]:
    """A stage a rule, applied where a text holds its signs."""
    return [_where(x, lambda v, marks=marks: reduce(lambda a, b: a | b, [v.contains(m) for m in marks]), pattern, to) for pattern, to, marks in MARKDOWN]


def collapse(x: Column) -> Column:
    return strip(F.regexp_replace(x, GAP, " "))


def clean_steps(x: Column, tickers: bool = True, prices: bool = False) -> list[Column]:
    """The cleaning as stages for one projection after another (each names the stage before it ``__clean``)."""
    c = F.col("__clean")
    steps = [strip(F.coalesce(x, F.lit(""))), _once(c, lambda v: F.when(is_noise(v), "").otherwise(v)), F.regexp_replace(decode_entities(c), TAG, " "), _where(c, may_have_url, URL, "[URL]"), *markdown_steps(c), _where(c, may_be_moderator, MODERATOR, " ")]
    if tickers:
        steps.append(F.regexp_replace(c, TICKER, "$1"))
    if prices:
        steps.append(expand_prices(c))
    steps += [collapse(F.regexp_replace(c, REPEAT, "$1$1$1$1"))]
    filler = c.rlike(FILLER) & ~(c.rlike(EMOJI) | c.rlike(CAPS_WORD) | c.rlike(INTENSE))
    return [*steps, F.when(filler, "").otherwise(c)]


def shorten(x: Column, most: int) -> Column:
    """At most so many characters, back to the last space."""
    return F.when(F.length(x) > most, F.regexp_replace(F.substring(x, 1, most), r" [^ ]*$", "")).otherwise(x)


TOKENS_KEPT = 200_000


def _md5_low(token: str) -> int:
    return int.from_bytes(hashlib.md5(token.encode()).digest()[8:], "big")


def simhash64(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """64-bit SimHashes: bits with more votes for than against are set, a vote a word (parted by white space of all scripts, lower case) by its MD5.

    A word's hash is kept while few enough are; votes are summed eight counters at a time, 255 words a time.
    """
    known: dict[str, int] = {}
    spread = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(axis=1).astype(np.uint64)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for batch in texts:
        out = np.zeros(len(batch), np.uint64)
        for k, text in enumerate(batch):
            words = (text or "").lower().split()
            if not words:
                continue
            if len(known) > TOKENS_KEPT:
                known.clear()
            for w in set(words).difference(known):
                known[w] = _md5_low(w)
            data = np.fromiter(map(known.__getitem__, words), np.uint64, len(words)).view(np.uint8).reshape(-1, 8)
            sums = np.add.reduceat(spread[data], np.arange(0, len(words), 255), axis=0)
            votes = sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)
            out[k] = powers[2 * votes > len(words)].sum(dtype=np.uint64)
        yield pd.Series(out.view(np.int64))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
