"""SQL of the text rules for DuckDB, written from the rules and not from the engine's expressions (its regular expressions know no look-around and no back-references)."""

from __future__ import annotations

WS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PART = r"[^\p{L}\p{N}_]"

# The words and patterns of the rules.
GONE = rf"(?i)^[{WS}]*\[(deleted|removed|dead|unavailable)\][{WS}]*$"
ROBOT = rf"(?is)i am a bot[,{WS}].*?(contact the moderators|modmail)|this action was performed automatically|please contact the moderators|if you have any questions.*?message the mods|^bot[{WS}]*\||automoderator|i''m a bot({PART}|$)"
LINK = rf"(?i)https?://[^{WS}]+|www\.[^{WS}]+|\[[^\n]*?\]\(https?://[^{WS}]+\)"
BOILER = rf"(?i)please read our[^\n]*?rules|this is not financial advice|^reminder[:{WS}][^\n]*?rules|not your keys[,{WS}]+not your coins?|do your own research[{WS}.!]*dyor"
FILLER = "(?i)^(ok|okay|lol|lmao|lmfao|haha|hehe|yep|yup|nope|nah|yes|no|wow|same|nice|true|k|ty|thx|thanks|np|gg|rip|f|oof|meh|hmm|smh|ikr|idk|imo|tbh|irl|omg|omfg|wtf|ffs|fml|bruh|bro|dude|ditto|based|cringe)$"
PICTURE = r"[\x{2600}-\x{27BF}\x{1F300}-\x{1F9FF}\x{2700}-\x{27BF}\x{1FA00}-\x{1FA9F}\x{2500}-\x{2BEF}]"
KNOWN = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "''", "nbsp": " ", "mdash": "—", "ndash": "–", "hellip": "…", "rsquo": "''", "lsquo": "''", "rdquo": '"', "ldquo": '"'}
MARKS = [(r"(?s)```.*?```", " "), ("`[^`]+`", " "), (r"\*{1,3}([^\n]*?)\*{1,3}", r"\1"), (r"~~([^\n]*?)~~", r"\1"), (rf"(?m)^#{{1,6}}[{WS}]+", ""), (rf"(?m)^>+[{WS}]?", ""), (rf"(?m)^[-*_]{{3,}}[{WS}]*$", " "), (r"(?m)^\|?[-| :]+\|$", " ")]


def _all(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def noise(x: str) -> str:
    return f"(regexp_matches({x}, '{GONE}') OR regexp_matches({x}, '{ROBOT}'))"


def strip(x: str) -> str:
    return _all(x, f"^[{WS}]+|[{WS}]+$", "")


def same_before(c: str, i: str, n: int) -> str:
    """Whether the n characters before place i are the one there."""
    return " AND ".join(f"{c}[{i} - {k}] = {c}[{i}]" for k in range(1, n + 1))


def cleaned(source: str, key: str, text: str, name: str = "tc") -> str:
    """CTEs ending in ``name`` (key, raw, clean): a rule a step."""
    entity = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in KNOWN.items()) + "}"
    steps = [
        f"SELECT {key}, coalesce({text}, '') AS raw, {strip(f'''coalesce({text}, '')''')} AS c FROM {source}",
        f"SELECT {key}, raw, string_split(CASE WHEN {noise('c')} THEN '' ELSE c END, '&') AS p FROM {{}}",
        # every part after an ampersand may begin with the rest of an entity
        f"""SELECT {key}, raw, p[1] || array_to_string(list_transform(p[2:], lambda x: CASE WHEN regexp_matches(x, '^(#\\p{{Nd}}+|[a-zA-Z]+);')
            THEN coalesce({entity}[x[:strpos(x, ';') - 1]], ' ') || x[strpos(x, ';') + 1:] ELSE '&' || x END), '') AS c FROM {{}}""",
        f"SELECT {key}, raw, {_all(_all('c', '<[^>]+>', ' '), LINK, '[URL]')} AS c FROM {{}}",
        *[f"SELECT {key}, raw, {_all('c', p, to)} AS c FROM {{}}" for p, to in MARKS],
        f"SELECT {key}, raw, string_split({_all('c', BOILER, ' ')}, '$') AS p FROM {{}}",
        f"""SELECT {key}, raw, p[1] || array_to_string(list_transform(p[2:], lambda x: CASE WHEN regexp_matches(x, '^[A-Z]{{2,10}}({PART}|$)') THEN x ELSE '$' || x END), '') AS c FROM {{}}""",
        f"SELECT {key}, raw, regexp_extract_all(c, '(?s).') AS p FROM {{}}",
        f"SELECT {key}, raw, array_to_string(list_filter(p, lambda x, i: i <= 4 OR x = chr(10) OR NOT ({same_before('p', 'i', 4)})), '') AS c FROM {{}}",
        f"SELECT {key}, raw, {strip(_all('c', f'[{WS}]+', ' '))} AS c FROM {{}}",
        f"""SELECT {key}, raw, CASE WHEN regexp_matches(c, '{FILLER}') AND NOT regexp_matches(c, '{PICTURE}') AND NOT regexp_matches(c, '(^|{PART})[A-Z]{{2,}}({PART}|$)') AND NOT regexp_matches(c, '[!?]{{2,}}')
            THEN '' WHEN length(c) > 512 THEN regexp_replace(substr(c, 1, 512), ' [^ ]*$', '') ELSE c END AS clean FROM {{}}""",
    ]
    names = [f"{name}{k}" for k in range(len(steps) - 1)] + [name]
    return ", ".join(f"{n} AS ({s.replace('{}', names[k - 1])})" for k, (n, s) in enumerate(zip(names, steps, strict=True)))


def featured(key: str, cleaned_name: str = "tc", name: str = "tf") -> str:
    """CTEs ending in ``name``: the features of ``cleaned_name``."""
    n = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"
    return f"""{name}0 AS (SELECT {key}, raw, clean, regexp_extract_all(raw, '(?s).') AS p, {n('clean', chr(92) + 'p{L}')} AS letters, {n('clean', chr(92) + 'p{Lu}')} AS capitals, {n('clean', f'[^{WS}]+')} AS tokens FROM {cleaned_name}),
        {name}1 AS (SELECT *, CASE WHEN letters > 0 THEN CAST(capitals AS DOUBLE) / letters ELSE 0e0 END AS caps,
            CAST(len(list_filter(p, lambda x, i: i > 4 AND x <> chr(10) AND {same_before('p', 'i', 4)} AND (i = 5 OR p[i - 5] <> x))) AS BIGINT) AS runs FROM {name}0),
        {name}2 AS (SELECT *, CASE WHEN tokens < 3 THEN 0.2e0 ELSE 0e0 END + CASE WHEN tokens > 0 THEN least(CAST(runs AS DOUBLE) / tokens * 0.3e0, 0.3e0) ELSE 0e0 END
            + CASE WHEN caps > 0.8 AND tokens > 5 THEN 0.2e0 ELSE 0e0 END + CASE WHEN {n('clean', '[!?.,;:]')} > 0.4e0 * length(clean) THEN 0.3e0 ELSE 0e0 END AS spam FROM {name}1),
        {name} AS (SELECT {key}, raw, clean, CAST(runs AS INTEGER) AS char_repeats, CAST(tokens AS INTEGER) AS token_count, CAST({n('clean', PICTURE)} AS INTEGER) AS emoji_count, round_even(caps, 4) AS caps_ratio,
            CAST({n('clean', '[!?]{2,}')} AS INTEGER) AS punct_intensity, CAST({n('clean', '!')} AS INTEGER) AS exclamations, CAST({n('clean', '[?]')} AS INTEGER) AS questions,
            regexp_matches(raw, '{LINK}') AS had_url, {noise('raw')} AS had_bot, regexp_matches(raw, '{MARKS[2][0]}|{MARKS[4][0]}|{MARKS[0][0]}') AS had_markdown,
            CASE WHEN clean = '' THEN '' ELSE md5(clean) END AS content_hash, clean <> '' AS is_valid, CASE WHEN clean = '' THEN 0e0 ELSE round_even(least(spam, 1e0), 4) END AS spam_score FROM {name}2)"""


def simhashed(source: str, key: str, text: str, name: str = "sh", p: str = "s") -> str:
    """CTEs ending in ``name`` (key, simhash): bit by bit the majority of the low halves of the words' MD5."""
    return f"""{p}k AS (SELECT {key}, unnest(list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[{WS}]+'), lambda x: x <> '')) AS t FROM {source}),
        {p}w AS (SELECT {key}, CAST('0x' || substr(md5(t), 17, 16) AS UBIGINT) AS v, count(*) AS times FROM {p}k GROUP BY 1, 2),
        {p}b AS (SELECT {key}, k, sum(CASE WHEN (v >> CAST(k AS UBIGINT)) & 1 = 1 THEN times ELSE -times END) AS votes FROM {p}w, (SELECT unnest(range(64)) AS k) GROUP BY 1, 2),
        {p}v AS (SELECT {key}, sum(CASE WHEN votes > 0 THEN CASE WHEN k = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << CAST(k AS INTEGER)) END ELSE 0 END) AS h FROM {p}b GROUP BY 1),
        {name} AS (SELECT {key}, CAST(coalesce(h, 0) AS BIGINT) AS simhash FROM {source} LEFT JOIN {p}v USING ({key}))"""
