"""The registered queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barflow.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barflow.llm.ppm import ppm_scores

    return ppm_scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 10 != 0)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barflow.llm.mixing import WEIGHTS, mix, tree

    return mix(table(spark, sf_dir, "documents"), tree(), WEIGHTS).select("doc_id", "lang", "source", F.col("__epoch").alias("epoch"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barflow.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 2048)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barflow.llm.linededup import line_dedup

    done = line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.size("__gone").cast("long").alias("n_removed"), F.array_join("__gone", ",").alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barflow.llm.langid import language_id

    # a document without an id has no remainder: it is held out, as in op2
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)))
    return language_id(docs, ~F.col("held_out"), keep=["doc_id", "held_out"])


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barflow.llm.topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barflow.llm.minhash import near_duplicates, numbered

    _, narrow = numbered(table(spark, sf_dir, "documents"))
    null = F.lit(-(1 << 63))
    return near_duplicates(narrow).select(F.nullif("d", null).alias("doc_id"), F.nullif("class_id", null).alias("class_id"), "kept")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barflow.llm.secretscan import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barflow.llm.tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", keep=["doc_id"], limit=1024)


def op11_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barflow.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


HOUR = 3_600_000_000


def op12_tolerant_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barflow.llm.asof import micros, once, tolerant_asof

    hashed = lambda c: F.crc32(F.col(c).cast("string"))
    floored = lambda t, h: F.when(h % 2 == 1, t - F.pmod(t, F.lit(HOUR))).otherwise(t)
    clicks, sales = table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales")
    events = once(clicks.select("click_id", micros(clicks, "ts").alias("t"), "client_id"), "click_id", "t", "client_id")
    events = events.select(F.col("client_id").alias("client"), floored(F.col("t"), hashed("click_id")).alias("t"), F.col("click_id").alias("event_id"))
    total = F.when(~F.isnan("total") & (F.abs("total") != float("inf")), F.floor(100 * F.col("total") + 0.5))
    orders = sales.select(F.col("client_id").alias("client"), floored(micros(sales, "sold_at"), hashed("sale_id")).alias("t"), hashed("sale_id").alias("h"), "sale_id", F.col("priority").cast("long").alias("priority"), total.alias("value"))
    own, second = F.struct("sale_id", "priority"), F.struct((-1 - F.col("sale_id")).alias("sale_id"), (6 - F.col("priority")).alias("priority"))
    orders = orders.select("client", "t", "value", F.explode(F.when(F.col("h") % 3 != 0, F.array(own, second)).otherwise(F.array(own))).alias("o"))
    found = tolerant_asof(events, orders.select("client", "t", F.col("o.sale_id").alias("order_id"), F.col("o.priority").alias("priority"), "value"), 240 * HOUR)
    names = {"event_id": "click_id", "client": "client_id", "t": "ts_us", "order_id": "sale_id", "lag": "lag_us", "value": "total_cents"}
    return found.withColumnsRenamed(names)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barflow.llm.audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_fingerprints, op2_ppm_scores, op3_source_mix, op4_best_fit_packing, op5_line_dedup, op6_language_id, op7_exact_top_k, op8_near_duplicates, op9_secret_scan, op10_token_counts, op11_simhash_components, op12_tolerant_asof, op13_filter_audit)
}
ORACLE_SQL: dict[str, str] = {
    "op3_source_mix": """
        WITH named AS (
            SELECT doc_id, lang, source, CAST(nullif(regexp_extract(coalesce(source, ''), '^src([0-9]{1,9})$', 1), '') AS INTEGER) AS n,
                   greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+'))) AS tokens
            FROM documents
        ), docs AS (
            SELECT doc_id, lang, source, tokens, coalesce(lang, chr(0)) AS l, coalesce(source, chr(0)) AS s, CASE WHEN n < 7 THEN 'web' WHEN n = 7 THEN 'books' WHEN n > 7 THEN 'code' ELSE 'other' END AS domain FROM named
        ), leaf AS (
            SELECT domain, l, s, sum(tokens) AS tokens, 4e0 * sum(tokens) AS capacity FROM docs GROUP BY ALL
        ), top AS (
            SELECT domain, sum(capacity) AS capacity, CASE domain WHEN 'web' THEN 0.4e0 WHEN 'books' THEN 0.3e0 WHEN 'code' THEN 0.25e0 ELSE 0.05e0 END AS weight, (SELECT CAST(sum(tokens) AS DOUBLE) FROM leaf) AS given FROM leaf GROUP BY domain
        ), top_full AS (
            SELECT *, coalesce(sum(capacity) OVER (ORDER BY capacity / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                      + capacity / weight * sum(weight) OVER (ORDER BY capacity / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= given + 1e-6 AS is_full
            FROM top
        ), top_budget AS (
            SELECT domain, CASE WHEN is_full THEN capacity ELSE (given - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ()) * weight / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS given FROM top_full
        ), middle AS (
            SELECT domain, l, sum(capacity) AS capacity, CASE l WHEN 'en' THEN 0.5e0 WHEN 'de' THEN 0.2e0 WHEN 'fr' THEN 0.2e0 WHEN 'es' THEN 0.1e0 ELSE 0.02e0 END AS weight, any_value(given) AS given
            FROM leaf JOIN top_budget USING (domain) GROUP BY domain, l
        ), middle_full AS (
            SELECT *, coalesce(sum(capacity) OVER (PARTITION BY domain ORDER BY capacity / weight, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                      + capacity / weight * sum(weight) OVER (PARTITION BY domain ORDER BY capacity / weight, l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= given + 1e-6 AS is_full
            FROM middle
        ), middle_budget AS (
            SELECT domain, l, CASE WHEN is_full THEN capacity ELSE (given - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER (PARTITION BY domain)) * weight / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY domain) END AS given FROM middle_full
        ), low AS (
            SELECT domain, l, s, tokens, capacity, given, CASE s WHEN 'src0' THEN 0.5e0 WHEN 'src1' THEN 2e0 ELSE 1e0 END AS weight FROM leaf JOIN middle_budget USING (domain, l)
        ), low_full AS (
            SELECT *, coalesce(sum(capacity) OVER (PARTITION BY domain, l ORDER BY capacity / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                      + capacity / weight * sum(weight) OVER (PARTITION BY domain, l ORDER BY capacity / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= given + 1e-6 AS is_full
            FROM low
        ), quota AS (
            SELECT domain, l, s, tokens, CAST(floor(round(CASE WHEN is_full THEN capacity ELSE (given - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER (PARTITION BY domain, l)) * weight / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY domain, l) END, 3)) AS BIGINT) AS quota
            FROM low_full
        ), placed AS (
            SELECT d.*, quota // q.tokens AS epochs, quota % q.tokens AS rest, md5('7:' || CAST(quota // q.tokens AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS h
            FROM docs d JOIN quota q USING (domain, l, s)
        ), taken AS (
            SELECT *, epochs + CASE WHEN sum(tokens) OVER (PARTITION BY domain, l, s ORDER BY h) <= rest THEN 1 ELSE 0 END AS copies FROM placed
        )
        SELECT doc_id, lang, source, CAST(unnest(range(CAST(copies AS BIGINT))) AS INTEGER) AS epoch FROM taken
    """,
    "op7_exact_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.u AS u, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.u <> c.u AND len(q.e) = len(c.e)
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op12_tolerant_asof": """
        WITH crc AS (
            SELECT list_transform(range(0, 256), lambda i: list_reduce([CAST(i AS BIGINT)] || list_transform(range(0, 8), lambda z: CAST(0 AS BIGINT)),
                   lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS cells
        ), click AS (
            SELECT click_id, min(struct_pack(t := epoch_us(ts), client := client_id)) AS x FROM clicks GROUP BY click_id
        ), click_hash AS (
            SELECT click_id, x.t AS t, x.client AS client_id,
                   xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(click_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda c, b: xor(c >> 8, cells[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) AS h
            FROM click, crc
        ), event AS (
            SELECT click_id, client_id, CASE WHEN h % 2 = 1 THEN CAST(floor(t / 3600000000.0) AS BIGINT) * 3600000000 ELSE t END AS t FROM click_hash
        ), sale_hash AS (
            SELECT sale_id, client_id, epoch_us(sold_at) AS t, CAST(priority AS BIGINT) AS priority, CAST(floor(100 * total + 0.5) AS BIGINT) AS cents,
                   xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda c, b: xor(c >> 8, cells[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) AS h
            FROM sales, crc
        ), first_order AS (
            SELECT sale_id, client_id, CASE WHEN h % 2 = 1 THEN CAST(floor(t / 3600000000.0) AS BIGINT) * 3600000000 ELSE t END AS t, priority, cents, h FROM sale_hash
        ), orders AS (
            SELECT sale_id, client_id, t, priority, cents FROM first_order UNION ALL SELECT -1 - sale_id, client_id, t, 6 - priority, cents FROM first_order WHERE h % 3 <> 0
        ), tied AS (
            SELECT client_id, t, first(struct_pack(sale_id := sale_id, cents := cents) ORDER BY priority ASC NULLS LAST, sale_id DESC NULLS LAST, cents ASC NULLS LAST) AS best, count(*) AS n
            FROM orders WHERE client_id IS NOT NULL AND t IS NOT NULL GROUP BY client_id, t
        )
        SELECT click_id, e.client_id AS client_id, e.t AS ts_us,
               CASE WHEN e.t - g.t <= 864000000000 THEN g.best.sale_id END AS sale_id, CASE WHEN e.t - g.t <= 864000000000 THEN e.t - g.t END AS lag_us,
               CASE WHEN e.t - g.t <= 864000000000 THEN g.best.cents END AS total_cents, CASE WHEN e.t - g.t <= 864000000000 THEN g.n ELSE 0 END AS n_tied
        FROM event e ASOF LEFT JOIN tied g ON e.client_id = g.client_id AND e.t >= g.t
    """,
    "op13_filter_audit": """
        WITH words AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), counted AS (
            SELECT doc_id, part, text, len(w) AS n, len(list_distinct(w)) AS d, length(text) AS chars, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals FROM words
        ), firsts AS (
            SELECT text, min(doc_id) AS first_id FROM counted GROUP BY text
        ), marks AS (
            SELECT doc_id, coalesce(max(CAST(quality = 1 AS INTEGER)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INTEGER)), 0) AS toxic FROM labels GROUP BY doc_id
        ), fails AS (
            SELECT part, CAST(n < 50 AS INTEGER) + 2 * CAST(100 * d < 65 * n AS INTEGER) + 4 * CAST(100 * capitals > 5 * chars AS INTEGER)
                   + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(counted.doc_id > first_id, FALSE) AS INTEGER) AS mask,
                   coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
            FROM counted JOIN firsts USING (text) LEFT JOIN marks ON counted.doc_id = marks.doc_id
        ), hist AS (
            SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, mask
        ), letters AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit
        ), orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
        ), steps AS (
            SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0) AS prior FROM orders, (SELECT unnest(range(1, 6)) AS step)
        ), counts AS (
            SELECT part, filter_order, step, own,
                   sum(CASE WHEN mask & CAST(prior + own AS INTEGER) = 0 THEN n ELSE 0 END) AS kept,
                   sum(CASE WHEN mask & CAST(prior AS INTEGER) = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN mask & CAST(prior AS INTEGER) <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
                   sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN mask & CAST(prior AS INTEGER) = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost,
                   sum(CASE WHEN mask & CAST(prior AS INTEGER) = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
            FROM hist, steps GROUP BY ALL
        )
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM counts
    """,
}
