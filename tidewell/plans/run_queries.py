"""Queries over the registry, pagination, the fetch log and run statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.times import http_date_seconds, retry_after_seconds, rfc3339
from tidewell.operators import fetchlog as fl
from tidewell.operators import paging as pg
from tidewell.operators import summary as sm
from tidewell.operators.merge import first_wins, per_body
from tidewell.operators.summary import provider_runs
from tidewell.plans.derived import DERIVED_SQL, PARSED_SQL, derived, table
from tidewell.sources import registry as rg
from tidewell.sources.bodies import BODY, records

# ---------------------------------------------------------------- registry


def q_seed_plan(spark, sf_dir):
    """Seeds of each source."""
    s = rg.seeds(spark)
    return s.groupBy("ord", "id").agg(F.count("*").alias("n_seeds"), F.count_distinct("url").alias("n_urls"), F.array_join(F.array_sort(F.collect_set("default_scheme")), ",").alias("schemes"), F.array_join(F.array_sort(F.collect_set("parse_kind")), ",").alias("kinds"))


def q_list_providers(spark, sf_dir):
    return rg.listing(rg.providers(spark)).select("id", "protocols", "refresh", "site")


REQUESTED = ["spys", "geonode", "nope", "spys", "hookzof", "geonode"]


def q_provider_select(spark, sf_dir):
    """Chosen sources in the order asked for, and what is unknown."""
    asked = spark.createDataFrame(list(enumerate(REQUESTED)), "ix int, id string")
    chosen, unknown = rg.select_providers(rg.providers(spark), asked)
    return chosen.select("id", F.col("ord").cast("int").alias("ord")).unionByName(unknown.select("id", F.lit(-1).alias("ord")))


def q_registry_integrity(spark, sf_dir):
    """repeated ids of a registry doubled in part."""
    r = rg.providers(spark)
    return rg.check_integrity(r.unionByName(r.filter("ord % 7 = 0")))


# ---------------------------------------------------------------- pagination


def _chains(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count("*") * 700).alias("total"))
    return e.withColumn("page_size", F.when(F.col("user_id") % 2 == 0, 500).otherwise(1000)).withColumn("max_requests", F.when(F.col("user_id") % 3 == 0, 5).otherwise(64))


def q_paging_expected(spark, sf_dir):
    """The pages that a chain should fetch."""
    return pg.expected_pages(_chains(spark, sf_dir)).select("user_id", F.col("page").cast("int").alias("page"), F.col("last").cast("int").alias("last_page"), pg.next_page(F.col("page"), F.col("total"), F.col("page_size")).cast("int").alias("next_page"))


def q_paging_truncation(spark, sf_dir):
    """What stopped each chain."""
    p = pg.expected_pages(_chains(spark, sf_dir)).filter(F.col("page") <= 3 + F.col("user_id") % 11)
    k = F.col("user_id") % 13
    p = p.select(
        "user_id",
        "page",
        "max_requests",
        (k != 1).alias("ok"),
        (k == 2).alias("cancelled"),
        k.isin(1, 3).alias("late"),
        (k == 4).alias("panicked"),
        F.when(k == 5, 100_000).otherwise(10).alias("n_records"),
        F.when(k == 6, "missing total").alias("advance_error"),
        (k == 7).alias("seen"),
        (F.col("page") < F.col("last")).alias("has_next"),
    )
    stopped = pg.stop_reasons(p, ["user_id"], 100_000)
    return stopped.select("user_id", F.col("page").cast("int").alias("page"), "reason", "truncated", "error")


# ---------------------------------------------------------------- fetch log


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    status = F.expr("CASE event_type WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 503 WHEN 2 THEN 429 ELSE 404 END WHEN 'view' THEN 304 ELSE 200 END")
    return e.select("event_id", "ts", "user_id", "event_type", F.concat(F.lit("http://h"), F.col("user_id").cast("string"), F.lit("/")).alias("url"), status.alias("status"), F.when(F.col("event_type") != "view", F.concat(F.lit("b"), F.col("event_id").cast("string"))).alias("body"))


def q_cache_lookup(spark, sf_dir):
    """Bodies of unchanged feeds from the cache of usable rows."""
    log = _log(spark, sf_dir)
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    cache = users.select(F.concat(F.lit("http://h"), F.col("user_id").cast("string"), F.lit("/")).alias("url"), F.expr("CASE user_id % 4 WHEN 0 THEN concat('\"e', user_id, '\"') WHEN 1 THEN '' WHEN 2 THEN 'a b' ELSE concat('W/', user_id) END").alias("etag"), F.expr("CASE WHEN user_id % 7 = 0 THEN '  ' ELSE concat('c', user_id) END").alias("body"))
    return fl.resolve_304(log, cache).select("event_id", "cached", "body")


def q_cache_merge(spark, sf_dir):
    """Upsert of the cache, new rows first."""
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), (F.col("c_custkey") % 997).cast("string")).alias("url"), "c_custkey")
    old = rows.select("url", F.concat(F.lit("o"), "url").alias("etag"), F.lit("old").alias("body"))
    new = rows.filter("c_custkey % 3 = 0").select("url", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("n"), "url")).otherwise(F.lit("bad tag")).alias("etag"), F.lit("new").alias("body"))
    return fl.merge_cache(old, new)


HARVEST_CAP = 50


def q_harvest_summary(spark, sf_dir):
    """Line bodies of all sources, capped, merged and counted as the run does."""
    d = derived(spark, sf_dir).filter("event_id % 9 <> 8").withColumn("page_ix", F.expr("cast(event_id div 1000 as int)"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "token"))), lambda x: x["token"]), "\n")
    landed = d.groupBy(F.col("source").alias("provider_id"), "ord", F.lit(0).alias("seed_ix"), "page_ix", "default_scheme").agg(text.alias("body")).withColumn("parse_kind", F.lit("entries"))
    once = per_body(records(landed, HARVEST_CAP))
    counted = once.groupBy(*BODY).agg(F.sum("copies").alias("records"))
    by_provider = counted.groupBy("provider_id").agg(F.sum("records").alias("records"), F.max(F.col("records") >= HARVEST_CAP).alias("capped"))
    chains = landed.groupBy("provider_id").agg(F.count("*").alias("ok_requests"), F.count("*").alias("total_requests"), F.lit(0.5).alias("duration_secs"), F.lit(False).alias("truncated")).withColumn("errors", F.array().cast("array<string>"))
    first = first_wins(once).groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("n_first"))
    runs = provider_runs(chains, by_provider).join(first, F.col("provider_id") == F.col("_s"), "left")
    return runs.select("provider_id", F.col("records").cast("long").alias("records"), "truncated", F.size("errors").alias("n_errors"), F.coalesce("n_first", F.lit(0)).alias("n_first"))


def q_status_class(spark, sf_dir):
    """X1, F14"""
    log = _log(spark, sf_dir)
    kind = fl.status_class(F.col("status"), F.col("event_id") % 10 == 0, F.col("user_id") % 2 == 0)
    return log.groupBy("status", kind.alias("kind")).agg(F.count("*").alias("n"))


def q_breaker_streak(spark, sf_dir):
    """Streaks of connection failures by host, threshold 3."""
    log = _log(spark, sf_dir).select("event_id", "ts", (F.col("user_id") % 50).alias("host"), (F.col("event_type") == "purchase").alias("success"), F.col("event_type").isin("error", "click").alias("connect_failure"))
    return fl.breaker(log, "host", ["ts", "event_id"], 3).select("event_id", "host", F.col("streak").cast("long").alias("streak"), "tripped")


def q_attempts(spark, sf_dir):
    """X2"""
    w = _log(spark, sf_dir)
    return w.groupBy("url").agg(F.count("*").alias("tries"), F.count_if(F.col("status") == 429).alias("limited"), F.max_by("status", F.struct("ts", "event_id")).cast("int").alias("last_status"))


def q_retry_after(spark, sf_dir):
    """Delays from seconds, dates or garbage."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp("o_orderdate").alias("s"))
    date = F.date_format(F.timestamp_seconds("s"), "dd MMM yyyy HH:mm:ss")
    header = F.when(F.col("o_orderkey") % 4 == 0, (F.col("o_orderkey") % 200).cast("string")).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("Xxx, "), date, F.lit(" GMT"))).when(F.col("o_orderkey") % 4 == 2, F.lit("soon")).otherwise(F.concat(F.lit("Mon, 31 Feb "), F.year(F.timestamp_seconds("s")).cast("string"), F.lit(" 00:00:10 GMT")))
    o = o.select("o_orderkey", "s", header.alias("header"))
    return o.select("o_orderkey", http_date_seconds(F.col("header")).alias("date_secs"), retry_after_seconds(F.col("header"), F.col("s") - F.col("o_orderkey") % 300).alias("delay"))


def q_rfc3339(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", rfc3339(F.col("ts")).alias("stamp"))


def q_declared_size(spark, sf_dir):
    """Declared sizes and charsets."""
    from tidewell.sources.bodies import charset_of

    e = table(spark, sf_dir, "events").select("event_id")
    length = F.expr("CASE event_id % 4 WHEN 0 THEN cast(event_id * 10000 as string) WHEN 1 THEN 'x' WHEN 2 THEN NULL ELSE concat('-', event_id) END")
    kind = F.expr("CASE event_id % 4 WHEN 0 THEN 'text/html; charset=gb2312' WHEN 1 THEN 'text/html' WHEN 2 THEN 'text/plain; Charset=\"utf-8\"; x' ELSE NULL END")
    return e.select("event_id", fl.declared_oversize(length).alias("oversize"), charset_of(kind).alias("charset"))


# ---------------------------------------------------------------- statistics


def _chain_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.format_string("%09d", "event_id")))
    return e.groupBy((F.col("user_id") % 40).alias("p"), "user_id").agg(F.count_if(F.col("event_type") != "error").alias("ok_requests"), F.count("*").alias("total_requests"), F.max("value").alias("duration_secs"), (F.count("*") > 20).alias("truncated"), F.array_sort(F.collect_list(error)).alias("errors")).withColumn("provider_id", F.concat(F.lit("p"), "p"))


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    records = e.filter("event_type = 'purchase' AND user_id % 40 <> 7").select(F.concat(F.lit("p"), (F.col("user_id") % 40).cast("string")).alias("provider_id"))
    return sm.provider_runs(_chain_stats(spark, sf_dir), records)


def q_provider_rollup(spark, sf_dir):
    """Chains to sources; sources without records stay."""
    return _runs(spark, sf_dir).select("provider_id", "ok_requests", "total_requests", "records", F.round("duration_secs", 6).alias("duration_secs"), "truncated", F.size("errors").cast("long").alias("n_errors"), F.get("errors", F.lit(0)).alias("first_error"))


def q_run_outcome(spark, sf_dir):
    """One row a set of sources: all, those that are clean, and none."""
    runs = _runs(spark, sf_dir)
    clean = runs.filter(sm.clean(F.col("ok_requests"), F.col("errors"), F.col("truncated")))
    parts = [("all", runs, 5, 0), ("clean", runs.withColumn("errors", F.array().cast("array<string>")).withColumn("truncated", F.lit(False)), 5, 0), ("crashed", clean, 5, 1), ("none", runs.filter("false"), 0, 0)]
    out = None
    for name, part, unique, failures in parts:
        one = sm.run_outcome(part, F.lit(unique).cast("long"), F.lit(failures)).withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def q_error_sample(spark, sf_dir):
    """W5, O9"""
    return _runs(spark, sf_dir).select("provider_id", sm.error_sample(F.col("errors")).alias("sample"))


def q_url_seen(spark, sf_dir):
    """Follow-ups that were not asked for before."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 9).alias("provider_id"), "event_id", "event_type")
    url = lambda k: F.concat(F.lit("u"), (F.col("event_id") % k).cast("string"))
    seen = e.filter("event_type = 'view'").select("provider_id", url(50).alias("url")).distinct()
    return pg.unseen(e.filter("event_type <> 'view'").select("provider_id", url(90).alias("url")), seen)


QUERIES = {f.__name__: f for f in (q_harvest_summary, q_seed_plan, q_list_providers, q_provider_select, q_registry_integrity, q_paging_expected, q_paging_truncation, q_cache_lookup, q_cache_merge, q_status_class, q_breaker_streak, q_attempts, q_retry_after, q_rfc3339, q_declared_size, q_provider_rollup, q_run_outcome, q_error_sample, q_url_seen)}

_SEEDS = [  # ord, id, seeds, schemes, kinds; from the survey's inventory, not from the registry module
    (0, "thespeedx", 3, "http,socks4,socks5", "entries"), (1, "hproxy", 4, "http,https,socks4,socks5", "entries"), (2, "monosans", 4, "http,socks4,socks5", "entries,json"), (3, "databay-labs", 3, "http,socks4,socks5", "entries"),
    (4, "xyzs996", 4, "http,https,socks4,socks5", "entries"), (5, "aliilapro", 3, "http,socks4,socks5", "entries"), (6, "vpslabcloud", 3, "http,socks4,socks5", "entries"), (7, "iplocate", 4, "http,https,socks4,socks5", "entries"),
    (8, "sunny9577", 3, "http,socks4,socks5", "entries"), (9, "hideip-me", 3, "http,socks4,socks5", "entries"), (10, "hookzof", 1, "socks5", "entries"), (11, "vakhov", 4, "http,https,socks4,socks5", "entries"),
    (12, "rix4uni", 1, "http", "entries"), (13, "blitzproxy", 3, "http,socks4,socks5", "entries"), (14, "proxio-io", 4, "http,https,socks4,socks5", "entries"), (15, "fate0", 1, "", "ndjson"),
    (16, "advancedname", 2, "http,socks5", "base64_rows"), (17, "databay", 4, "http,https,socks4,socks5", "json"), (18, "89ip", 130, "http", "table_pairs"), (19, "free-proxy-list-net", 3, "http,https", "socks_columns,textarea"),
    (20, "geonode", 4, "http,https,socks4,socks5", "json"), (21, "ip3366", 14, "", "web_columns"), (22, "m1noa-proxypool", 1, "", "json"), (23, "proxifly", 3, "", "entries"), (24, "proxylister", 1, "", "json"),
    (25, "proxyscrape", 3, "http,socks4,socks5", "entries"), (26, "pubproxy", 1, "http", "auto"), (27, "proxydb", 230, "http", "link_rows"), (28, "proxygenerator1", 1, "", "json"), (29, "spys", 1, "http", "entries"),
]

_CHAINS = "c AS (SELECT user_id, count(*) * 700 AS total, CASE WHEN user_id % 2 = 0 THEN 500 ELSE 1000 END AS size, CASE WHEN user_id % 3 = 0 THEN 5 ELSE 64 END AS most FROM events GROUP BY user_id), x AS (SELECT *, greatest(1, (total + size - 1) // size) AS last FROM c), e AS (SELECT *, unnest(range(1, CAST(least(last, most) + 1 AS BIGINT))) AS page FROM x)"
_LOG = "l AS (SELECT event_id, ts, user_id, event_type, 'http://h' || user_id || '/' AS url, CASE event_type WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 503 WHEN 2 THEN 429 ELSE 404 END WHEN 'view' THEN 304 ELSE 200 END AS status, CASE WHEN event_type <> 'view' THEN 'b' || event_id END AS body FROM events)"
_RUNS = """k AS (SELECT 'p' || (user_id % 40) AS provider_id, user_id, count(*) FILTER (event_type <> 'error') AS ok, count(*) AS n, max(value) AS d, count(*) > 20 AS t FROM events GROUP BY user_id),
er AS (SELECT 'p' || (user_id % 40) AS provider_id, list('e' || lpad(CAST(event_id AS VARCHAR), 9, '0') ORDER BY event_id) AS errors FROM events WHERE event_type = 'error' GROUP BY 1),
rc AS (SELECT 'p' || (user_id % 40) AS provider_id, count(*) AS records FROM events WHERE event_type = 'purchase' AND user_id % 40 <> 7 GROUP BY 1),
runs AS (SELECT provider_id, CAST(sum(ok) AS BIGINT) AS ok_requests, CAST(sum(n) AS BIGINT) AS total_requests, coalesce(any_value(records), 0) AS records, max(d) AS duration_secs, bool_or(t) AS truncated, coalesce(any_value(errors), []) AS errors
  FROM k LEFT JOIN er USING (provider_id) LEFT JOIN rc USING (provider_id) GROUP BY provider_id)"""

ORACLES = {
    "q_provider_select": "SELECT * FROM (VALUES ('spys', 0), ('geonode', 1), ('hookzof', 2), ('nope', -1)) v(id, ord)",
    "q_registry_integrity": "SELECT id, 2::BIGINT AS n FROM (VALUES " + ", ".join(f"({o}, '{i}')" for o, i, *_ in _SEEDS) + ") v(ord, id) WHERE ord % 7 = 0",
    "q_paging_expected": f"WITH {_CHAINS} SELECT user_id, CAST(page AS INT) AS page, CAST(last AS INT) AS last_page, CAST(CASE WHEN page * size < total THEN page + 1 END AS INT) AS next_page FROM e",
    "q_paging_truncation": f"""WITH {_CHAINS}, p AS (SELECT user_id, last, most, max(page) AS page FROM e WHERE page <= 3 + user_id % 11 GROUP BY ALL),
s AS (SELECT user_id, CAST(page AS INT) AS page, CASE WHEN user_id % 13 = 1 THEN 'provider time budget' WHEN user_id % 13 = 4 THEN 'parser panicked' WHEN user_id % 13 = 5 THEN 'page record cap'
  WHEN user_id % 13 = 6 THEN 'truncated, not exhausted' WHEN page >= last THEN 'exhausted' WHEN user_id % 13 = 7 THEN 'seen' WHEN user_id % 13 = 2 THEN 'harvest interrupted' WHEN page >= most THEN 'stopped at max_requests'
  WHEN user_id % 13 = 3 THEN 'provider time budget' ELSE 'missing page' END AS reason FROM p)
SELECT user_id, page, reason, reason NOT IN ('exhausted', 'seen', 'fetch failed', 'parser panicked') AS truncated, CASE WHEN reason NOT IN ('exhausted', 'seen') THEN reason END AS error FROM s""",
    "q_cache_lookup": f"WITH {_LOG}, c AS (SELECT *, event_type = 'view' AND user_id % 4 IN (0, 3) AND user_id % 7 <> 0 AS cached FROM l) SELECT event_id, cached, CASE WHEN status = 304 THEN CASE WHEN cached THEN 'c' || user_id END ELSE body END AS body FROM c",
    "q_cache_merge": """WITH r AS (SELECT 'u' || (c_custkey % 997) AS url, c_custkey AS k FROM customer)
SELECT url, CASE WHEN bool_or(k % 6 = 0) THEN 'n' ELSE 'o' END || url AS etag, CASE WHEN bool_or(k % 6 = 0) THEN 'new' ELSE 'old' END AS body FROM r GROUP BY url""",
    "q_harvest_summary": f"""WITH {DERIVED_SQL}, {PARSED_SQL}, n AS (SELECT *, rec_ix // 1000 AS page, row_number() OVER (PARTITION BY source, rec_ix // 1000 ORDER BY rec_ix) AS i FROM r WHERE rec_ix % 9 <> 8),
k AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord, page, rec_ix) AS first FROM n WHERE i <= {HARVEST_CAP}),
p AS (SELECT source, page, count(*) AS c FROM k GROUP BY ALL),
t AS (SELECT source, max(c) >= {HARVEST_CAP} AS hit FROM p GROUP BY source),
s AS (SELECT DISTINCT source FROM d WHERE event_id % 9 <> 8)
SELECT s.source AS provider_id, count(k.url) AS records, coalesce(any_value(hit), false) AS truncated, CAST(coalesce(any_value(hit), false)::INT AS INT) AS n_errors, count(*) FILTER (first = 1) AS n_first
FROM s LEFT JOIN k ON k.source = s.source LEFT JOIN t ON t.source = s.source GROUP BY s.source""",
    "q_status_class": f"WITH {_LOG} SELECT CAST(status AS INT) AS status, CASE WHEN status = 304 AND user_id % 2 = 0 THEN 'hit' WHEN status = 200 AND event_id % 10 <> 0 THEN 'ok' WHEN status = 429 THEN 'limited' WHEN status IN (0, 503, 200) THEN 'retry' ELSE 'permanent' END AS kind, count(*) AS n FROM l GROUP BY ALL",
    "q_breaker_streak": """WITH a AS (SELECT event_id, ts, user_id % 50 AS host, event_type = 'purchase' AS ok, event_type IN ('error', 'click') AS bad FROM events),
b AS (SELECT *, sum(ok::INT) OVER (PARTITION BY host ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM a),
c AS (SELECT *, sum(bad::INT) OVER (PARTITION BY host, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM b)
SELECT event_id, host, CAST(streak AS BIGINT) AS streak, bool_or(streak >= 3) OVER (PARTITION BY host ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS tripped FROM c""",
    "q_attempts": f"WITH {_LOG} SELECT url, count(*) AS tries, count(*) FILTER (status = 429) AS limited, CAST(arg_max(status, (ts, event_id)) AS INT) AS last_status FROM l GROUP BY url",
    "q_retry_after": """WITH a AS (SELECT o_orderkey AS k, CAST(epoch(o_orderdate) AS BIGINT) AS s, CAST(epoch(make_date(year(o_orderdate), 2, 1)) AS BIGINT) + 30 * 86400 + 10 AS f FROM orders),
b AS (SELECT *, CASE k % 4 WHEN 1 THEN s WHEN 3 THEN f END AS t FROM a)
SELECT k AS o_orderkey, t AS date_secs, CAST(least(120, greatest(1, CASE k % 4 WHEN 0 THEN k % 200 WHEN 2 THEN 5 ELSE greatest(0, t - (s - k % 300)) END)) AS BIGINT) AS delay FROM b""",
    "q_rfc3339": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events",
    "q_declared_size": "SELECT event_id, event_id % 4 = 0 AND event_id * 10000 > 33554432 AS oversize, CASE event_id % 4 WHEN 0 THEN 'GB2312' ELSE 'UTF-8' END AS charset FROM events",
    "q_provider_rollup": f"WITH {_RUNS} SELECT provider_id, ok_requests, total_requests, records, round(duration_secs, 6) AS duration_secs, truncated, CAST(len(errors) AS BIGINT) AS n_errors, errors[1] AS first_error FROM runs",
    "q_run_outcome": f"""WITH {_RUNS},
p AS (SELECT 'all' AS part, 5 AS u, 0 AS f, records, ok_requests > 0 AND len(errors) = 0 AND NOT truncated AS clean FROM runs
 UNION ALL SELECT 'clean', 5, 0, records, ok_requests > 0 FROM runs
 UNION ALL SELECT 'crashed', 5, 1, records, true FROM runs WHERE ok_requests > 0 AND len(errors) = 0 AND NOT truncated),
a AS (SELECT part, coalesce(sum(records), 0) AS n, max(u) AS u, max(f) AS f, count(clean) AS k, bool_and(clean) AS c FROM (SELECT * FROM (VALUES ('all', 5, 0), ('clean', 5, 0), ('crashed', 5, 1), ('none', 0, 0)) v(part, u0, f0) LEFT JOIN p USING (part)) GROUP BY part),
o AS (SELECT part, CAST(n AS BIGINT) AS records_total, CAST(CASE WHEN part = 'none' THEN 0 ELSE 5 END AS BIGINT) AS records_unique, k AS providers, CASE WHEN n = 0 OR part = 'none' THEN 'failed' WHEN part <> 'crashed' AND k > 0 AND c THEN 'full' ELSE 'partial' END AS outcome FROM a)
SELECT part, outcome, CAST(CASE outcome WHEN 'full' THEN 0 WHEN 'partial' THEN 2 ELSE 1 END AS INT) AS exit_code, records_total, records_unique, providers FROM o""",
    "q_error_sample": f"WITH {_RUNS} SELECT provider_id, array_to_string(list_concat(errors[1:3], CASE WHEN len(errors) >= 3 THEN ['+' || (len(errors) - 3) || ' further'] ELSE [] END), '; ') AS sample FROM runs",
    "q_url_seen": """WITH n AS (SELECT DISTINCT user_id % 9 AS provider_id, 'u' || (event_id % 90) AS url FROM events WHERE event_type <> 'view'),
s AS (SELECT DISTINCT user_id % 9 AS provider_id, 'u' || (event_id % 50) AS url FROM events WHERE event_type = 'view')
SELECT * FROM n ANTI JOIN s USING (provider_id, url)""",
}
ORACLES["q_seed_plan"] = "SELECT ord, id, n AS n_seeds, n AS n_urls, schemes, kinds FROM (VALUES " + ", ".join(f"({o}, '{i}', {n}::BIGINT, '{s}', '{k}')" for o, i, n, s, k in _SEEDS) + ") v(ord, id, n, schemes, kinds)"
ORACLES["q_list_providers"] = "SELECT * FROM (VALUES " + ", ".join(
    [f"('{i}', '{','.join(dict.fromkeys(x.split(':')[0] for x in files.split() if x[0] != ':')) or rg.ALL}', '{refresh}', 'https://github.com/{repo}')" for i, repo, _, refresh, _, _, files in rg.FEEDS]
    + [f"('{i}', '{protocols}', '{refresh}', '{site}')" for i, site, protocols, refresh, *_ in rg.PAGED]
) + ") v(id, protocols, refresh, site)"
