"""The derived token feed: a deterministic corpus that Spark and SQL build alike from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, ts, ip (number), ep (address:port), ord, source, rec_ix, default_scheme, token"""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_id") - F.col("event_id") % 3).alias("g"))
    e = e.withColumn("ip", F.expr("(g * 2654435761) % 4294967296")).withColumn("port", F.expr("1 + g % 65535"))
    e = e.withColumn("ep", F.expr("concat(ip div 16777216, '.', (ip div 65536) % 256, '.', (ip div 256) % 256, '.', ip % 256, ':', port)"))
    token = F.expr(
        """CASE event_id % 9 WHEN 0 THEN ep WHEN 1 THEN concat('https://', ep, '/') WHEN 2 THEN concat(ep, ':Germany')
           WHEN 3 THEN concat(ep, ':socks5') WHEN 4 THEN concat('u', user_id, ':p@', ep) WHEN 5 THEN concat(ep, ':u', user_id, ':p')
           WHEN 6 THEN concat(ep, ':123') WHEN 7 THEN concat('vmess://', ep) ELSE concat('# ', ep) END"""
    )
    return e.select("event_id", "user_id", "ts", "ip", "ep", F.expr("cast(user_id % 5 as int)").alias("ord"), F.expr("concat('src', user_id % 5)").alias("source"), F.col("event_id").alias("rec_ix"), F.lit("http").alias("default_scheme"), token.alias("token"))


#: The same in DuckDB, as the common table expression ``d``.
DERIVED_SQL = """
d0 AS (SELECT event_id, user_id, ts, event_id - event_id % 3 AS g FROM events),
d1 AS (SELECT *, (g * 2654435761) % 4294967296 AS ip, 1 + g % 65535 AS port FROM d0),
d2 AS (SELECT *, (ip // 16777216) || '.' || ((ip // 65536) % 256) || '.' || ((ip // 256) % 256) || '.' || (ip % 256) || ':' || port AS ep FROM d1),
d AS (SELECT event_id, user_id, ts, ip, ep, CAST(user_id % 5 AS INT) AS ord, 'src' || (user_id % 5) AS source, event_id AS rec_ix,
      CASE event_id % 9 WHEN 0 THEN ep WHEN 1 THEN 'https://' || ep || '/' WHEN 2 THEN ep || ':Germany'
        WHEN 3 THEN ep || ':socks5' WHEN 4 THEN 'u' || user_id || ':p@' || ep WHEN 5 THEN ep || ':u' || user_id || ':p'
        WHEN 6 THEN ep || ':123' WHEN 7 THEN 'vmess://' || ep ELSE '# ' || ep END AS token
      FROM d2)
"""

WS_SQL = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
OCTET_SQL = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_SQL = rf"^(?:{OCTET_SQL}\.){{3}}{OCTET_SQL}$"
LABEL_SQL = "[a-z0-9_](?:[a-z0-9_-]{0,61}[a-z0-9_])?"
HOSTNAME_SQL = rf"^{LABEL_SQL}(?:\.{LABEL_SQL})+$"


def trim_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS_SQL}+', ''), '{WS_SQL}+$', '')"


def canon_sql(x: str) -> str:
    return f"CASE lower({trim_sql(x)}) WHEN 'http' THEN 'http' WHEN 'https' THEN 'https' WHEN 'ssl' THEN 'https' WHEN 'socks4' THEN 'socks4' WHEN 'socks4a' THEN 'socks4' WHEN 'socks' THEN 'socks5' WHEN 'socks5' THEN 'socks5' WHEN 'socks5h' THEN 'socks5' END"


def ip4_number_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{IPV4_SQL}') THEN CAST(split_part({x}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({x}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({x}, '.', 3) AS BIGINT) * 256 + CAST(split_part({x}, '.', 4) AS BIGINT) END"


# Written out on its own, not generated from the Spark side's table, so that the two can disagree.
CIDR_SQL = """
cidr(lo, hi, exception) AS (VALUES
  (0::BIGINT, 16777215::BIGINT, false), (167772160, 184549375, false), (2130706432, 2147483647, false), (2851995648, 2852061183, false),
  (2886729728, 2887778303, false), (3221225472, 3221225727, false), (3221225642, 3221225643, false), (3221225984, 3221226239, false),
  (3232235520, 3232301055, false), (3323068416, 3323199487, false), (3325256704, 3325256959, false), (3405803776, 3405804031, false),
  (3758096384, 4026531839, false), (4026531840, 4294967295, false), (3221225481, 3221225481, true), (3221225482, 3221225482, true))
"""


def unusable4_sql(n: str) -> str:
    return f"(({n} BETWEEN 0 AND 16777215) OR ({n} BETWEEN 167772160 AND 184549375) OR ({n} BETWEEN 2130706432 AND 2147483647) OR ({n} BETWEEN 2851995648 AND 2852061183) OR ({n} BETWEEN 2886729728 AND 2887778303) OR (({n} BETWEEN 3221225472 AND 3221225727) AND {n} NOT IN (3221225481, 3221225482)) OR ({n} BETWEEN 3221225984 AND 3221226239) OR ({n} BETWEEN 3232235520 AND 3232301055) OR ({n} BETWEEN 3323068416 AND 3323199487) OR ({n} BETWEEN 3325256704 AND 3325256959) OR ({n} BETWEEN 3405803776 AND 3405804031) OR ({n} >= 3758096384))"


#: Parsed and gated tokens of ``d`` as ``r``: IPv4 and host names (the feed has no IPv6).
PARSED_SQL = rf"""
t0 AS (SELECT *, trim({trim_sql('token')}, '"`') AS tk FROM d),
t1 AS (SELECT *, CASE WHEN contains(tk, '://') THEN {canon_sql("split_part(tk, '://', 1)")} END AS declared,
         CASE WHEN contains(tk, '://') THEN rtrim(substr(tk, strpos(tk, '://') + 3), '/') ELSE tk END AS body
       FROM t0 WHERE NOT regexp_matches(tk, '^[#<>%!|]') AND tk <> ''),
t2 AS (SELECT *, CASE WHEN contains(body, '@') THEN regexp_extract(body, '^(.*)@[^@]*$', 1) END AS creds,
         regexp_extract(body, '([^@]*)$', 1) AS rest
       FROM t1 WHERE NOT contains(tk, '://') OR declared IS NOT NULL),
t3 AS (SELECT *, string_split(rest, ':') AS p, len(string_split(rest, ':')) AS n FROM t2),
t4 AS (SELECT *, coalesce(CASE WHEN n = 3 THEN {canon_sql("p[3]")} END, declared, 'http') AS scheme, p[1] AS host0, p[2] AS port0,
         CASE WHEN n = 4 THEN p[3] WHEN creds IS NOT NULL THEN split_part(creds, ':', 1) END AS "user",
         CASE WHEN n = 4 THEN p[4] WHEN contains(creds, ':') THEN substr(creds, strpos(creds, ':') + 1) END AS pass
       FROM t3 WHERE n = 2 OR (n = 3 AND NOT regexp_matches(p[3], '^[0-9]+$')) OR (n = 4 AND creds IS NULL)),
t5 AS (SELECT *, {ip4_number_sql('host0')} AS num, TRY_CAST(port0 AS BIGINT) AS port_n FROM t4),
r AS (SELECT event_id, user_id, ord, source, rec_ix, scheme, CASE WHEN num IS NOT NULL THEN host0 ELSE lower(host0) END AS host, CAST(port_n AS INT) AS port, "user", pass,
        scheme || '://' || coalesce("user" || coalesce(':' || pass, '') || '@', '') || CASE WHEN num IS NOT NULL THEN host0 ELSE lower(host0) END || ':' || port_n AS url
      FROM t5
      WHERE port_n BETWEEN 1 AND 65535 AND CASE WHEN num IS NOT NULL THEN NOT {unusable4_sql('num')} ELSE regexp_matches(lower(host0), '{HOSTNAME_SQL}') END)
"""
