"""Truth tables for hosts, ports, credentials, tokens and bodies."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions.entry import parse_entries
from tidewell.functions.gate import credentials_ok, gate, port_number
from tidewell.functions.hosts import V4_PRIVATE, bounds4, ipv4_number, ipv4_text, v4_unusable, with_host
from tidewell.operators.merge import first_wins, pool_order
from tidewell.sources.bodies import decode_bodies, records

HOSTS = [
    ("1.1.1.1", "1.1.1.1"), (" 1.1.1.1. ", "1.1.1.1"), ("010.1.1.1", "010.1.1.1"), ("999.1.1.1", "999.1.1.1"), ("1.2.3", "1.2.3"), ("0.0.0.0", None), ("10.0.0.1", None),
    ("9.255.255.255", "9.255.255.255"), ("11.0.0.0", "11.0.0.0"), ("100.64.0.1", "100.64.0.1"), ("172.15.255.255", "172.15.255.255"), ("172.16.0.0", None), ("172.32.0.0", "172.32.0.0"),
    ("192.0.0.8", None), ("192.0.0.9", "192.0.0.9"), ("192.0.0.10", "192.0.0.10"), ("192.0.0.170", None), ("223.255.255.255", "223.255.255.255"), ("224.0.0.1", None), ("255.255.255.255", None),
    ("Proxy.Example.ORG", "proxy.example.org"), ("localhost", None), ("example.", None), ("-a.example", None), ("a-.example", None), ("a_b.example", "a_b.example"), ("", None), (None, None),
    ("x" * 63 + ".org", "x" * 63 + ".org"), ("x" * 64 + ".org", None), (" one.example　", "one.example"), ("exa mple.org", None), ("[1.1.1.1]", "[1.1.1.1]"), ("[::1]", None), ("[x", None),
    ("2a00::1\n", "[2a00::1]"), ("a.example\nb", None),
]


def test_hosts(spark):
    d = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HOSTS)], "i int, h string")
    got = {r["i"]: r["c"] for r in with_host(d, "h", "c").collect()}
    assert [got[i] for i in range(len(HOSTS))] == [c for _, c in HOSTS]


def test_v4_range_edges(spark):
    edges = []
    for cidr in V4_PRIVATE:
        lo, hi = bounds4(cidr)
        edges += [(lo, True), (hi, True)]
    d = spark.createDataFrame(edges, "n long, bad boolean")
    assert d.filter(v4_unusable(F.col("n")) != F.col("bad")).count() == 0
    assert d.filter(ipv4_number(ipv4_text(F.col("n"))) != F.col("n")).count() == 0


def test_ipv6_against_the_standard_library(spark):
    import ipaddress

    rnd = random.Random(5)
    texts = []
    for _ in range(300):
        groups = [rnd.choice(["0", "0", "0", f"{rnd.randrange(65536):x}", f"{rnd.randrange(65536):04x}"]) for _ in range(8)]
        groups[0] = rnd.choice(["2a00", "2606", "2400"])
        text = ":".join(groups)
        texts.append(rnd.choice([text, str(ipaddress.ip_address(":".join(g.lstrip("0") or "0" for g in groups)))]))
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in with_host(d, "t", "c").collect():
        assert r["c"] == f"[{ipaddress.ip_address(':'.join(g.lstrip('0') or '0' if g else '' for g in r['t'].split(':')))}]", r["t"]


PORTS = [("80", 80), ("+80", 80), (" 0080\t", 80), ("0", None), ("65535", 65535), ("65536", None), ("-1", None), ("80.5", None), ("", None), (None, None), ("8 0", None), ("99999999999999999999", None), ("80\n", 80), ("00000000000000080", 80)]


def test_ports(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PORTS)], "i int, t string")
    got = {r["i"]: r["p"] for r in d.select("i", port_number(F.col("t")).alias("p")).collect()}
    assert [got[i] for i in range(len(PORTS))] == [p for _, p in PORTS]


CREDENTIALS = [(None, None, True), ("u", None, True), ("u", "p", True), (None, "p", False), ("", None, False), ("u", "", False), ("u:v", "p", False), ("u", "p:q", True), ("u\x80", None, False), ("u", "p ", False), ("u\n", None, False), ("u@v", None, False), ("u", "a/b", False), ("u", "a\\b", False), ("u", "50%", False)]


def test_credentials(spark):
    d = spark.createDataFrame([(i, u, p) for i, (u, p, _) in enumerate(CREDENTIALS)], "i int, u string, p string")
    got = {r["i"]: r["ok"] for r in d.select("i", F.coalesce(credentials_ok(F.col("u"), F.col("p")), F.lit(False)).alias("ok")).collect()}
    assert [got[i] for i in range(len(CREDENTIALS))] == [ok for *_, ok in CREDENTIALS]


TOKENS = [
    ("1.1.1.1:80", "http", "http://1.1.1.1:80"), ("1.1.1.1:80", None, None), ('"`1.1.1.1:80`"', "http", "http://1.1.1.1:80"), ("1.1.1.1:80:US", "http", "http://1.1.1.1:80"), ("1.1.1.1:80:", "http", "http://1.1.1.1:80"),
    ("1.1.1.1:80:socks4a", "http", "socks4://1.1.1.1:80"), ("1.1.1.1:80:99", "http", None), ("1.1.1.1:80:u:p", "http", "http://u:p@1.1.1.1:80"), ("u:p@1.1.1.1:80", "http", "http://u:p@1.1.1.1:80"),
    ("u@1.1.1.1:80", "http", "http://u@1.1.1.1:80"), ("u:@1.1.1.1:80", "http", None), ("@1.1.1.1:80", "http", None), ("a@b:p@1.1.1.1:80", "http", None), ("u:p@1.1.1.1:80:x:y", "http", None), ("SSL://1.1.1.1:80//", None, "https://1.1.1.1:80"),
    ("vmess://1.1.1.1:80", "http", None), ("[2a00::1]:80", "http", "http://[2a00::1]:80"), ("2a00::1:8080", "http", None), ("2a00:0::1:8080", "http", "http://[2a00::1]:8080"), ("x]:80", "http", None), ("1.1.1.1", "http", None), ("# 1.1.1.1:80", "http", None),
    ("<td>", "http", None), ("", "http", None), ("1.1.1.1:0", "http", None), ("u:p:q@1.1.1.1:80", "http", "http://u:p:q@1.1.1.1:80"),
]


def test_tokens(spark):
    d = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(TOKENS)], "i int, token string, default_scheme string")
    got = {r["i"]: r["url"] for r in gate(parse_entries(d, "token", "default_scheme")).collect()}
    assert [got.get(i) for i in range(len(TOKENS))] == [u for *_, u in TOKENS]


def body(spark, *rows):
    schema = "provider_id string, ord int, seed_ix int, page_ix int, default_scheme string, parse_kind string, body string"
    return spark.createDataFrame([(p, i, 0, 0, s, k, b) for i, (p, s, k, b) in enumerate(rows)], schema)


def test_bodies_of_every_kind(spark):
    import base64

    code = lambda s: base64.b64encode(s.encode()).decode().rstrip("=")
    d = body(
        spark,
        ("lines", "http", "entries", "# head\r\n1.1.1.1:80, 1.1.1.2:80;junk\r\n\r\n socks5://1.1.1.3:1080\n"),
        ("json", "http", "json", '{"data":[{"ip":"1.1.1.1","port":80},"1.1.1.4:81",5]}'),
        ("nd", None, "ndjson", '{"host":"1.1.1.5","port":1,"type":"http"}\n{bad\n[1]\n'),
        ("auto1", "http", "auto", '[{"ip":"1.1.1.6","port":"2"}]'),
        ("auto2", "http", "auto", '{"ip":"1.1.1.7","port":3}\n{"ip":"1.1.1.8","port":3}'),
        ("auto3", "http", "auto", "1.1.1.9:4"),
        ("auto4", "http", "auto", "[2a00::1]:80"),
        ("links", "http", "link_rows", '<tr><td>a</td></tr><tr><a href="/1.1.1.10/5#socks4">'),
        ("b64", "socks5", "base64_rows", f'<tr><td data-ip="{code("1.1.1.11")}"><td data-port="{code("6")}"></tr>'),
        ("pairs", None, "table_pairs", '<table class="layui-table"><td>1.1.1.12</td> <td>77</td></table>'),
        ("web", None, "web_columns", "<tr><td>1.1.1.13</td><td>8</td><td></td><td>HTTPS</td>"),
        ("socks", None, "socks_columns", "<tr><td>1.1.1.14</td><td>9</td><td></td><td></td><td>Socks 5</td>"),
        ("area", "http", "textarea", "<textarea>\n1.1.1.15:10\n</textarea>"),
        ("blank", "http", "entries", "  "),
        ("bad", "http", "json", "{"),
    )
    got = {}
    for r in records(d).collect():
        got.setdefault(r["source"], []).append(r["url"])
    assert {k: sorted(v) for k, v in got.items()} == {
        "lines": ["http://1.1.1.1:80", "http://1.1.1.2:80", "socks5://1.1.1.3:1080"],
        "json": ["http://1.1.1.1:80", "http://1.1.1.4:81"],
        "nd": ["http://1.1.1.5:1"],
        "auto1": ["http://1.1.1.6:2"],
        "auto2": ["http://1.1.1.7:3", "http://1.1.1.8:3"],
        "auto3": ["http://1.1.1.9:4"],
        "links": ["socks4://1.1.1.10:5"],
        "b64": ["socks5://1.1.1.11:6"],
        "pairs": ["http://1.1.1.12:77"],
        "web": ["https://1.1.1.13:8"],
        "socks": ["socks5://1.1.1.14:9"],
        "area": ["http://1.1.1.15:10"],
    }


def test_decoding(spark):
    d = spark.createDataFrame([(1, "é".encode(), None), (2, "中".encode("gb2312"), "text/html; charset=gb2312"), (3, b"\xef\xbb\xbfx", "text/html; charset=latin1"), (4, b"a", "text/plain; charset=nope")], "i int, content binary, content_type string")
    assert {r["i"]: r["body"] for r in decode_bodies(d).collect()} == {1: "é", 2: "中", 3: "x", 4: "a"}


def test_first_wins_and_order(spark):
    rows = [(o, i, s, "h.example", p, u, w) for i, (o, s, p, u, w) in enumerate([(2, "http", 80, None, None), (1, "http", 80, None, None), (1, "http", 80, "u", None), (0, "socks5", 9, None, None), (3, "http", 9, "u", "p"), (3, "http", 9, "u", None)])]
    schema = "ord int, rec_ix int, scheme string, host string, port int, user string, pass string"
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        d = spark.createDataFrame(rows, schema).withColumn("source", F.concat(F.lit("s"), "ord")).withColumn("url", F.concat_ws("|", "scheme", "port", "user", "pass"))
        got = [(r["url"], r["source"]) for r in pool_order(first_wins(d, ["ord", "rec_ix"])).collect()]
        assert got == [("http|9|u", "s3"), ("http|9|u|p", "s3"), ("http|80", "s1"), ("http|80|u", "s1"), ("socks5|9", "s0")]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["http", "https", "socks4", "socks5"]), st.integers(1, 223), st.integers(1, 65535), st.one_of(st.none(), st.text("abcXYZ09-._~", min_size=1, max_size=8)), st.one_of(st.none(), st.text("abc:9!", min_size=1, max_size=8))), min_size=1, max_size=30))
def test_urls_round_trip(spark, records_):
    rows = [(s, f"{a}.7.8.9", str(p), u, w if u else None) for s, a, p, u, w in records_ if a not in (10, 127)]
    if not rows:
        return
    d = gate(spark.createDataFrame(rows, "scheme string, host string, port string, user string, pass string"))
    again = gate(parse_entries(d.select(F.col("url").alias("token"), F.lit(None).cast("string").alias("dflt")), "token", "dflt"))
    assert sorted(r["url"] for r in again.collect()) == sorted(r["url"] for r in d.collect())


@pytest.mark.parametrize("kind", ["a.txt", "x/proxies.jsonl", "x/run.summary.json", "noext"])
def test_paths(kind):
    from tidewell.sources.sinks import ArtifactPaths

    paths = ArtifactPaths.from_output(kind)
    assert len({paths.pool, paths.provenance, paths.summary}) == 3 and str(paths.pool) == kind
