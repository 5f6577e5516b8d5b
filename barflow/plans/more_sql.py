"""SQL of ordered recurrences for DuckDB: parabolic stops, the Hilbert family, hashes and features that carry a state."""

from __future__ import annotations

from barflow.plans import text_sql


def sar(bars: str, out: str, signed: bool) -> str:
    """A state a bar: direction, extreme, next stop, rate and what is shown."""
    shown = "CASE WHEN n_long THEN shown ELSE -shown END" if signed else "shown"
    return f"""WITH RECURSIVE {bars}, st AS (
        SELECT b.symbol, CAST(1 AS BIGINT) AS rn, NOT (f.low - b.low > b.high - f.high AND f.low - b.low > 0) AS is_long, CASE WHEN NOT (f.low - b.low > b.high - f.high AND f.low - b.low > 0) THEN b.high ELSE b.low END AS ep,
            CASE WHEN NOT (f.low - b.low > b.high - f.high AND f.low - b.low > 0) THEN f.low ELSE f.high END AS stop, CAST(0.02 AS DOUBLE) AS rate, b.high AS ph, b.low AS pl, CAST(NULL AS DOUBLE) AS shown
        FROM b JOIN b f ON f.symbol = b.symbol AND f.rn = 1 WHERE b.rn = 2
        UNION ALL
        SELECT symbol, rn, n_long, n_ep, CASE WHEN n_long THEN least(moved, pl, low) ELSE greatest(moved, ph, high) END, n_rate, high, low, {shown} FROM (
            SELECT *, base + n_rate * (n_ep - base) AS moved FROM (
                SELECT *, shown AS base FROM (
                    SELECT symbol, rn, high, low, ph, pl, turned <> is_long AS n_long,
                        CASE WHEN turned THEN CASE WHEN is_long THEN greatest(ep, ph, high) ELSE least(ep, pl, low) END ELSE stop END AS shown,
                        CASE WHEN turned THEN CASE WHEN is_long THEN low ELSE high END WHEN is_long THEN greatest(ep, high) ELSE least(ep, low) END AS n_ep,
                        CASE WHEN turned THEN 0.02 WHEN is_long AND high > ep OR NOT is_long AND low < ep THEN least(rate + 0.02, 0.2) ELSE rate END AS n_rate
                    FROM (SELECT s.symbol, b.rn, b.high, b.low, s.ph, s.pl, s.is_long, s.ep, s.stop, s.rate, CASE WHEN s.is_long THEN b.low <= s.stop ELSE b.high >= s.stop END AS turned FROM st s JOIN b ON b.symbol = s.symbol AND b.rn = s.rn + 1)))))
        SELECT b.symbol, b.datetime, round(st.shown, 6) + 0.0 AS {out} FROM b LEFT JOIN st ON st.symbol = b.symbol AND st.rn = b.rn AND st.shown IS NOT NULL"""


def _hilbert(first: int) -> str:
    """CTE hb: the state of the discriminator from bar number ``first`` (counted from 1) on; ls: lists of the last seven values, newest first."""
    quad = lambda x: f"0.0962 * {x}[1] + 0.5769 * {x}[3] - 0.5769 * {x}[5] - 0.0962 * {x}[7]"
    push = lambda v, x: f"list_prepend({v}, {x}[1:6])"
    zero = "CAST([0, 0, 0, 0, 0, 0, 0] AS DOUBLE[])"
    d = "CAST(0 AS DOUBLE)"
    return f"""w4 AS (SELECT symbol, datetime, rn, close, (4 * close + 3 * lag(close, 1) OVER v + 2 * lag(close, 2) OVER v + lag(close, 3) OVER v) / 10 AS p, list(close) OVER (PARTITION BY symbol ORDER BY datetime ROWS 59 PRECEDING) AS back
            FROM b WINDOW v AS (PARTITION BY symbol ORDER BY datetime)),
        hb AS (SELECT symbol, CAST({first - 1} AS BIGINT) AS rn, {zero} AS p, {zero} AS de, {zero} AS q, {zero} AS i, {d} AS i2, {d} AS q2, {d} AS re, {d} AS im, {d} AS period, {d} AS sp, {d} AS ph, {d} AS mama, {d} AS fama, CAST([] AS DOUBLE[]) AS ps FROM b GROUP BY symbol
        UNION ALL
        SELECT symbol, rn, p, de, q, i, n_i2, n_q2, n_re, n_im, n_period, 0.33 * n_period + 0.67 * sp, n_ph, n_mama, 0.5 * alpha * n_mama + (1 - 0.5 * alpha) * fama, list_prepend(p[1], ps[1:59]) FROM (
          SELECT *, alpha * close + (1 - alpha) * mama AS n_mama FROM (
            SELECT *, greatest(least(0.5 / greatest(ph - n_ph, 1.0), 0.5), 0.05) AS alpha, 0.2 * clipped + 0.8 * period AS n_period FROM (
              SELECT *, CASE WHEN i[1] <> 0 THEN degrees(atan(q[1] / i[1])) ELSE 0.0 END AS n_ph, least(greatest(greatest(least(CASE WHEN n_im <> 0 AND n_re <> 0 THEN 360 / degrees(atan(n_im / n_re)) ELSE period END, 1.5 * period), 0.67 * period), 6.0), 50.0) AS clipped FROM (
                SELECT *, 0.2 * (n_i2 * i2 + n_q2 * q2) + 0.8 * re AS n_re, 0.2 * (n_i2 * q2 - n_q2 * i2) + 0.8 * im AS n_im FROM (
                  SELECT *, 0.2 * (i[1] - ({quad('q')}) * adj) + 0.8 * i2 AS n_i2, 0.2 * (q[1] + ({quad('i')}) * adj) + 0.8 * q2 AS n_q2 FROM (
                    SELECT * REPLACE ({push(f'({quad("de")}) * adj', 'q')} AS q, {push('de[4]', 'i')} AS i) FROM (
                      SELECT * REPLACE ({push(f'({quad("p")}) * adj', 'de')} AS de) FROM (
                        SELECT h.* REPLACE (w.rn AS rn, list_prepend(w.p, h.p[1:6]) AS p), w.close, 0.075 * h.period + 0.54 AS adj FROM hb h JOIN w4 w ON w.symbol = h.symbol AND w.rn = h.rn + 1)))))))))"""


def hilbert(bars: str, columns: dict[str, str], first: int, shown: int) -> str:
    """Columns of hb (h) shown after so many bars."""
    cols = ", ".join(f"CASE WHEN b.rn > {shown} THEN round({x}, 6) + 0.0 END AS {c}" for c, x in columns.items())
    return f"WITH RECURSIVE {bars}, {_hilbert(first)} SELECT b.symbol, b.datetime, {cols} FROM b LEFT JOIN hb h ON h.symbol = b.symbol AND h.rn = b.rn"


PHASE = """n0 AS (SELECT h.symbol, h.rn, h.sp, h.ps, w.back, w.p, CAST(floor(h.sp + 0.5) AS INTEGER) AS size FROM hb h JOIN w4 w ON w.symbol = h.symbol AND w.rn = h.rn WHERE h.rn >= 38),
    n1 AS (SELECT *, list_sum(list_transform(range(0, size), lambda k: sin(2 * pi() * k / size) * coalesce(ps[k + 1], 0))) AS re, list_sum(list_transform(range(0, size), lambda k: cos(2 * pi() * k / size) * coalesce(ps[k + 1], 0))) AS im,
        CASE WHEN size > 0 THEN list_avg(back[-size:]) ELSE 0 END AS mean FROM n0),
    n2 AS (SELECT *, CASE WHEN abs(im) > 0 THEN degrees(atan(re / im)) WHEN re > 0 THEN 90 WHEN re < 0 THEN -90 ELSE 0 END + 90 + 360 / sp + CASE WHEN im < 0 THEN 180 ELSE 0 END AS raw,
        (4 * mean + 3 * coalesce(lag(mean, 1) OVER v, 0) + 2 * coalesce(lag(mean, 2) OVER v, 0) + coalesce(lag(mean, 3) OVER v, 0)) / 10 AS line FROM n1 WINDOW v AS (PARTITION BY symbol ORDER BY rn)),
    n3 AS (SELECT *, coalesce(CASE WHEN raw > 315 THEN raw - 360 ELSE raw END, 90) AS dc FROM n2),
    n4 AS (SELECT *, sin(radians(dc)) AS sine, sin(radians(dc + 45)) AS lead FROM n3),
    n5 AS (SELECT *, coalesce(lag(sine) OVER v, 0) AS sine1, coalesce(lag(lead) OVER v, 0) AS lead1, dc - coalesce(lag(dc) OVER v, 0) AS turn FROM n4 WINDOW v AS (PARTITION BY symbol ORDER BY rn)),
    n6 AS (SELECT *, CASE WHEN sine > lead AND sine1 <= lead1 OR sine < lead AND sine1 >= lead1 THEN 1 ELSE 0 END AS crossed FROM n5),
    n7 AS (SELECT *, sum(crossed) OVER (PARTITION BY symbol ORDER BY rn) AS run FROM n6),
    n8 AS (SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY rn) AS days FROM n7),
    n9 AS (SELECT *, CASE WHEN line <> 0 AND abs((p - line) / line) >= 0.015 THEN 1 WHEN crossed = 1 OR days < 0.5 * sp OR (turn > 0.67 * 360 / sp AND turn < 1.5 * 360 / sp) THEN 0 ELSE 1 END AS mode FROM n8)"""


def phase(bars: str, columns: dict[str, str], wrap: str = "round({x}, 6) + 0.0") -> str:
    cols = ", ".join(f"CASE WHEN b.rn > 63 THEN {wrap.format(x=x)} END AS {c}" for c, x in columns.items())
    return f"WITH RECURSIVE {bars}, {_hilbert(38)}, {PHASE} SELECT b.symbol, b.datetime, {cols} FROM b LEFT JOIN n9 n ON n.symbol = b.symbol AND n.rn = b.rn"


#: CTEs sh(post_id, simhash) and fh(h, id), the first post of each hash.
SIMHASH = text_sql.simhashed("posts", "post_id", "text") + ", fh AS (SELECT simhash AS h, min(post_id) AS id FROM sh GROUP BY 1)"
