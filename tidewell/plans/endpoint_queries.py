"""Queries over entry tokens, the gate, hosts and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import gate as g
from tidewell.functions import hosts as h
from tidewell.functions.entry import parse_entries, skipped
from tidewell.functions.scheme import SCHEMES, canon, ordinal
from tidewell.functions.text import lines, tokens
from tidewell.operators.merge import first_wins, pool_order, scheme_counts
from tidewell.operators.summary import provenance
from tidewell.plans.derived import CIDR_SQL, DERIVED_SQL, HOSTNAME_SQL, PARSED_SQL, canon_sql, derived, ip4_number_sql, table, trim_sql, unusable4_sql
from tidewell.sources.bodies import effective_kind, ndjson_line, records

QUAD = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
STARTED = 1_700_000_000


def parsed(spark, sf_dir):
    """Gated records of the derived feed, through the gate of a run."""
    return g.gate(parse_entries(derived(spark, sf_dir), "token", "default_scheme"))


def merged(spark, sf_dir):
    return first_wins(parsed(spark, sf_dir), ["ord", "rec_ix"])


def q_entry_tokens(spark, sf_dir):
    """Tokens of each document, comments and markup skipped."""
    d = table(spark, sf_dir, "documents")
    every = F.flatten(F.transform(lines(F.col("text")), tokens))
    used = F.filter(every, lambda t: ~skipped(t))
    return d.select("doc_id", F.size(every).cast("long").alias("n_tokens"), F.size(used).cast("long").alias("n_used"), F.get(used, F.lit(0)).alias("first_used"))


def q_entry_parse(spark, sf_dir):
    """Raw fields of every token, rejected ones without a host."""
    return parse_entries(derived(spark, sf_dir), "token", "default_scheme").filter("host IS NOT NULL").select("event_id", "scheme", "host", "port", "user", "pass")


def q_port_gate(spark, sf_dir):
    d = derived(spark, sf_dir)
    text = F.expr("CASE event_id % 6 WHEN 0 THEN concat('+', event_id) WHEN 1 THEN concat(' 00', event_id, ' ') WHEN 2 THEN concat('-', event_id) WHEN 3 THEN concat(event_id, '.5') WHEN 4 THEN cast(event_id * 13 as string) ELSE '' END")
    return d.withColumn("text", text).select("event_id", "text", g.port_number(F.col("text")).alias("port"))


def q_hostname_gate(spark, sf_dir):
    """F4, T8 over the hosts of page URLs and odd variants of them."""
    p = table(spark, sf_dir, "pages").select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"))
    name = F.expr("CASE page_id % 5 WHEN 0 THEN upper(host) WHEN 1 THEN concat('-', host) WHEN 2 THEN replace(host, '.', '') WHEN 3 THEN concat(host, '..') ELSE host END")
    return p.withColumn("name", name).transform(lambda d: h.with_host(d, "name", "canon", ipv6=False)).select("page_id", "name", "canon")


def q_ipv4_extract(spark, sf_dir):
    """Dotted quads in text, with their numbers."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(QUAD), F.lit(0))).alias("quad"))
    return d.select("doc_id", "quad", h.ipv4_number(F.col("quad")).alias("number"))


def q_ipv4_special_ranges(spark, sf_dir):
    """F5, N5 as a literal predicate, T18."""
    return derived(spark, sf_dir).select("event_id", "ip", h.v4_unusable(F.col("ip")).alias("unusable"), F.shiftright("ip", 24).cast("long").alias("first_octet"))


def q_cidr_range_join(spark, sf_dir):
    """N5 as a range semi and anti join: addresses in a listed range and in no exception. The list has 17 rows, so it is broadcast."""
    rows = [(*h.bounds4(c), False) for c in [*h.V4_PRIVATE, h.V4_MULTICAST]] + [(*h.bounds4(c), True) for c in h.V4_EXCEPTIONS]
    nets = F.broadcast(spark.createDataFrame(rows, "lo long, hi long, exception boolean"))
    inside = (F.col("ip") >= F.col("lo")) & (F.col("ip") <= F.col("hi"))
    d = derived(spark, sf_dir).select("event_id", "ip")
    return d.join(nets.filter("NOT exception"), inside, "left_semi").join(nets.filter("exception"), inside, "left_anti")


# Own vectors: text, canonical form (None: rejected).
V6 = [
    ("2606:4700::1111", "[2606:4700::1111]"),
    ("2606:4700:0:0:0:0:0:1111", "[2606:4700::1111]"),
    ("[2A00:1450:4001:0081::200E]", "[2a00:1450:4001:81::200e]"),
    ("::ffff:9.9.9.9", "[::ffff:9.9.9.9]"),
    ("::ffff:10.1.2.3", None),
    ("2001:db8::7", None),
    ("fe80::1", None),
    ("fe80::1%eth0", None),
    ("fec0::1", "[fec0::1]"),
    ("2620:0:2d0:200::7", "[2620:0:2d0:200::7]"),
    ("2620:0:0:1:0:0:0:7", "[2620:0:0:1::7]"),
    ("2620::1::7", None),
    ("2620:1:2:3:4:5:6", None),
    ("ff02::1", None),
    ("3fff::1", None),
    ("2001:4:112::9", "[2001:4:112::9]"),
    ("1.2.3.4:80", None),
    ("[8.8.4.4]", "[8.8.4.4]"),
    ("[10.0.0.1]", None),
]


def q_ipv6_canon(spark, sf_dir):
    """F3, T17 on literal vectors, JVM-side."""
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(V6)], "ix int, text string")
    return h.with_host(d, "text", "canon").select("ix", "text", "canon")


def q_cred_filter(spark, sf_dir):
    """absent, empty and unclean credentials."""
    d = derived(spark, sf_dir)
    user = F.expr(r"CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('u', user_id) WHEN 3 THEN concat('u:', user_id) WHEN 4 THEN concat('u', chr(160), user_id) WHEN 5 THEN concat('u', chr(10)) ELSE concat('u#', user_id) END")
    word = F.expr("CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'a:b' ELSE 'p w' END")
    d = d.select("event_id", user.alias("user"), word.alias("pass"))
    return d.select("event_id", F.coalesce(g.credentials_ok(F.col("user"), F.col("pass")), F.lit(False)).alias("ok"))


def q_scheme_canon(spark, sf_dir):
    """Labels to schemes by a map lookup."""
    d = derived(spark, sf_dir)
    label = F.expr("CASE event_id % 8 WHEN 0 THEN ' HTTP' WHEN 1 THEN 'ssl' WHEN 2 THEN 'Socks4a ' WHEN 3 THEN 'socks' WHEN 4 THEN 'SOCKS5H' WHEN 5 THEN 'vmess' WHEN 6 THEN '' ELSE 'https' END")
    return d.withColumn("label", label).groupBy("label").agg(F.count("*").alias("n")).select("label", canon(F.col("label")).alias("scheme"), ordinal(canon(F.col("label"))).alias("scheme_ord"), "n")


def q_dedupe_first_wins(spark, sf_dir):
    return merged(spark, sf_dir).select("scheme", "host", "port", "user", "pass", "source")


def q_dedupe_sorted_url(spark, sf_dir):
    """O1: the ordered pool."""
    return pool_order(merged(spark, sf_dir)).select("url")


def q_scheme_counts(spark, sf_dir):
    return scheme_counts(merged(spark, sf_dir))


def q_provenance(spark, sf_dir):
    """S13, F17"""
    return provenance(merged(spark, sf_dir), STARTED)


def q_body_cap(spark, sf_dir):
    """W4, O5 with a small cap: the first 40 tokens of each document; a slice, no row leaves its place."""
    every = F.flatten(F.transform(lines(F.col("text")), tokens))
    d = table(spark, sf_dir, "documents").select("doc_id", F.slice(every, 1, 40).alias("kept")).filter(F.size("kept") > 0)
    return d.select("doc_id", F.size("kept").cast("long").alias("n"), (F.size("kept") >= 40).alias("cap_hit"), F.element_at("kept", -1).alias("last_token"))


def q_ndjson_filter(spark, sf_dir):
    """Lines that start with a brace, blanks and tabs aside, and are valid JSON."""
    d = derived(spark, sf_dir)
    line = F.expr("""CASE event_id % 4 WHEN 0 THEN concat('{"ip":"', ep, '"}') WHEN 1 THEN concat(chr(9), ' {"n":', event_id, '}') WHEN 2 THEN concat('{"ip":', ep) ELSE ep END""")
    return d.select("event_id", line.alias("line")).filter(ndjson_line(F.col("line")))


def q_body_dispatch(spark, sf_dir):
    """Bodies of every kind, each with an endpoint of the feed and a fixed one, through the run's dispatch."""
    d = derived(spark, sf_dir).withColumn("host", F.substring_index("ep", ":", 1)).withColumn("port", F.substring_index("ep", ":", -1))
    kinds = "entries", "ndjson", "json", "link_rows", "base64_rows", "table_pairs", "web_columns", "textarea", "auto"
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % len(kinds) + 1).cast("int"))
    code = lambda x: f"rtrim('=', base64(cast({x} as binary)))"
    body = F.expr(f"""CASE event_id % 9 WHEN 0 THEN concat('# list', chr(10), ep, chr(13), chr(10), '9.9.9.9:80')
  WHEN 1 THEN concat(chr(9), '{{"ip":"', host, '","port":', port, '}}', chr(10), '{{"proxy":"9.9.9.9:80"}}')
  WHEN 2 THEN concat('{{"data":[{{"ip":"', host, '","port":"', port, '"}},"9.9.9.9:80"],"total":2}}')
  WHEN 3 THEN concat('<tr><a href="/', host, '/', port, '#http">x</a><tr><a href="/9.9.9.9/80">x</a>')
  WHEN 4 THEN concat('<tr><td data-ip="', {code("host")}, '"><td data-port="', {code("port")}, '"><tr><td data-ip="', {code("'9.9.9.9'")}, '"><td data-port="', {code("'80'")}, '">')
  WHEN 5 THEN concat('<table class="layui-table"><td>', host, '</td><td>', lpad(port, 5, '0'), '</td><td>9.9.9.9</td><td>80</td></table>')
  WHEN 6 THEN concat('<tr><td>', host, '</td><td>', port, '</td><td></td><td>HTTP</td><tr><td>9.9.9.9</td><td>80</td><td></td><td>http</td>')
  WHEN 7 THEN concat('<textarea>', ep, chr(10), '9.9.9.9:80</textarea>')
  ELSE concat('["', ep, '", {{"host":"9.9.9.9","port":80}}]') END""")
    landed = d.select(F.lit("p").alias("provider_id"), F.lit(0).alias("ord"), F.lit(0).alias("seed_ix"), F.col("event_id").cast("int").alias("page_ix"), "default_scheme", kind.alias("parse_kind"), body.alias("body"))
    return records(landed).select(F.col("page_ix").cast("long").alias("event_id"), "url")


def q_auto_sniff(spark, sf_dir):
    """What a body of undeclared kind is read as."""
    d = derived(spark, sf_dir)
    body = F.expr("""CASE event_id % 5 WHEN 0 THEN concat('{"ip":"', ep, '"}') WHEN 1 THEN concat('{"a":1}', chr(10), '{"a":2}') WHEN 2 THEN concat(' ["', ep, '"]') WHEN 3 THEN '[::1]:80' ELSE ep END""")
    return effective_kind(d.select("event_id", body.alias("body"), F.lit("auto").alias("parse_kind"))).groupBy("kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (q_entry_tokens, q_entry_parse, q_port_gate, q_hostname_gate, q_ipv4_extract, q_ipv4_special_ranges, q_cidr_range_join, q_ipv6_canon, q_cred_filter, q_scheme_canon, q_dedupe_first_wins, q_dedupe_sorted_url, q_scheme_counts, q_provenance, q_body_cap, q_ndjson_filter, q_body_dispatch, q_auto_sniff)}

_TOKENS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\x0B\f\r,;\n]'), lambda x: x <> '')"
_MERGED = f"WITH {DERIVED_SQL}, {PARSED_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY scheme, host, port, \"user\", pass ORDER BY ord, rec_ix) AS k FROM r)"
_BARE = f"trim({trim_sql('x')}, '\"`')"

ORACLES = {
    "q_entry_tokens": rf"""WITH a AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
b AS (SELECT doc_id, t, list_filter(t, lambda x: {_BARE} <> '' AND NOT regexp_matches({_BARE}, '^[#<>%!|]')) AS u FROM a)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(u) AS BIGINT) AS n_used, u[1] AS first_used FROM b""",
    "q_entry_parse": f"WITH {DERIVED_SQL}, {PARSED_SQL} SELECT event_id, scheme, host0 AS host, port0 AS port, \"user\", pass FROM t4",
    "q_port_gate": f"""WITH {DERIVED_SQL}, x AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '+' || event_id WHEN 1 THEN ' 00' || event_id || ' ' WHEN 2 THEN '-' || event_id WHEN 3 THEN event_id || '.5' WHEN 4 THEN CAST(event_id * 13 AS VARCHAR) ELSE '' END AS text FROM d)
SELECT event_id, text, CAST(CASE WHEN regexp_matches(trim(text), '^[+]?[0-9]+$') AND CAST(ltrim(trim(text), '+') AS BIGINT) BETWEEN 1 AND 65535 THEN CAST(ltrim(trim(text), '+') AS BIGINT) END AS INT) AS port FROM x""",
    "q_hostname_gate": rf"""WITH a AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages),
b AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN upper(host) WHEN 1 THEN '-' || host WHEN 2 THEN replace(host, '.', '') WHEN 3 THEN host || '..' ELSE host END AS name FROM a)
SELECT page_id, name, CASE WHEN regexp_matches(lower(rtrim(name, '.')), '{HOSTNAME_SQL}') THEN lower(rtrim(name, '.')) END AS canon FROM b""",
    "q_ipv4_extract": f"WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '{QUAD}')) AS quad FROM documents) SELECT doc_id, quad, {ip4_number_sql('quad')} AS number FROM a",
    "q_ipv4_special_ranges": f"WITH {DERIVED_SQL} SELECT event_id, ip, {unusable4_sql('ip')} AS unusable, ip >> 24 AS first_octet FROM d",
    "q_cidr_range_join": f"""WITH {DERIVED_SQL}, {CIDR_SQL} SELECT event_id, ip FROM d
WHERE EXISTS (SELECT 1 FROM cidr WHERE ip BETWEEN lo AND hi AND NOT exception) AND NOT EXISTS (SELECT 1 FROM cidr WHERE ip BETWEEN lo AND hi AND exception)""",
    "q_ipv6_canon": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', {'NULL' if c is None else repr(c)})" for i, (t, c) in enumerate(V6)) + ") v(ix, text, canon)",
    "q_cred_filter": rf"""WITH {DERIVED_SQL}, x AS (SELECT event_id,
  CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'u' || user_id WHEN 3 THEN 'u:' || user_id WHEN 4 THEN 'u' || chr(160) || user_id WHEN 5 THEN 'u' || chr(10) ELSE 'u#' || user_id END AS u,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'a:b' ELSE 'p w' END AS p FROM d)
SELECT event_id, (u IS NULL OR event_id % 7 = 2) AND (p IS NULL OR (p = 'a:b' AND u IS NOT NULL)) AS ok FROM x""",
    "q_scheme_canon": f"""WITH {DERIVED_SQL}, x AS (SELECT CASE event_id % 8 WHEN 0 THEN ' HTTP' WHEN 1 THEN 'ssl' WHEN 2 THEN 'Socks4a ' WHEN 3 THEN 'socks' WHEN 4 THEN 'SOCKS5H' WHEN 5 THEN 'vmess' WHEN 6 THEN '' ELSE 'https' END AS label FROM d),
y AS (SELECT label, {canon_sql('label')} AS scheme, count(*) AS n FROM x GROUP BY ALL)
SELECT label, scheme, CAST(CASE scheme {' '.join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SCHEMES))} END AS INT) AS scheme_ord, n FROM y""",
    "q_dedupe_first_wins": f'{_MERGED} SELECT scheme, host, port, "user", pass, source FROM m WHERE k = 1',
    "q_dedupe_sorted_url": f'{_MERGED} SELECT url FROM m WHERE k = 1 ORDER BY CASE scheme {" ".join(f"WHEN {s!r} THEN {i}" for i, s in enumerate(SCHEMES))} END, host, port, "user" NULLS FIRST, pass NULLS FIRST',
    "q_scheme_counts": f"{_MERGED} SELECT " + ", ".join(f"count(*) FILTER (scheme = '{s}') AS {s}" for s in SCHEMES) + " FROM m WHERE k = 1",
    "q_provenance": _MERGED + " SELECT '{\"proxy\":\"' || url || '\",\"run_started_at\":" + str(STARTED) + ",\"source\":\"' || source || '\"}' AS value FROM m WHERE k = 1",
    "q_body_cap": f"""WITH a AS (SELECT doc_id, {_TOKENS} AS t FROM documents)
SELECT doc_id, CAST(least(40, len(t)) AS BIGINT) AS n, len(t) >= 40 AS cap_hit, t[least(40, len(t))] AS last_token FROM a WHERE len(t) > 0""",
    "q_ndjson_filter": f"""WITH {DERIVED_SQL}, x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{{"ip":"' || ep || '"}}' WHEN 1 THEN chr(9) || ' {{"n":' || event_id || '}}' WHEN 2 THEN '{{"ip":' || ep ELSE ep END AS line FROM d)
SELECT event_id, line FROM x WHERE starts_with(ltrim(line, chr(9) || ' '), '{{') AND json_valid(line)""",
    "q_body_dispatch": f"""WITH {DERIVED_SQL} SELECT event_id, 'http://' || ep AS url FROM d WHERE NOT {unusable4_sql('ip')} UNION ALL SELECT event_id, 'http://9.9.9.9:80' FROM d""",
    "q_auto_sniff": f"""WITH {DERIVED_SQL}, x AS (SELECT CASE event_id % 5 WHEN 0 THEN '{{"ip":"' || ep || '"}}' WHEN 1 THEN '{{"a":1}}' || chr(10) || '{{"a":2}}' WHEN 2 THEN ' ["' || ep || '"]' WHEN 3 THEN '[::1]:80' ELSE ep END AS body FROM d)
SELECT CASE WHEN starts_with(ltrim(body), '[') THEN 'json' WHEN starts_with(ltrim(body), '{{') THEN CASE WHEN json_valid(body) THEN 'json' ELSE 'ndjson' END ELSE 'entries' END AS kind, count(*) AS n FROM x GROUP BY ALL""",
}
