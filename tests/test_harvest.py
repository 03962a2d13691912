"""The whole run: files, outcome, the last good files, and the streaming form."""

import json

import pytest
from pyspark.sql import functions as F

from tidewell.harvest import harvest
from tidewell.sources.sinks import write_atomic

BODY = "provider_id string, ord int, seed_ix int, page_ix int, default_scheme string, parse_kind string, body string"
CHAIN = "provider_id string, ok_requests long, total_requests long, duration_secs double, truncated boolean, errors array<string>"


def bodies(spark, *texts):
    return spark.createDataFrame([(f"p{i}", i, 0, 0, "http", "entries", t) for i, t in enumerate(texts)], BODY)


def chains(spark, n, errors=()):
    return spark.createDataFrame([(f"p{i}", 1, 1, 0.5, False, list(errors)) for i in range(n)], CHAIN)


def test_full_partial_failed(spark, tmp_path):
    out = str(tmp_path / "pool.txt")
    r = harvest(bodies(spark, "1.1.1.2:80\n1.1.1.1:80\n", "1.1.1.1:80 1.1.1.1:81"), chains(spark, 2), out, started_at=7)
    assert (r.outcome, r.exit_code, r.records_total, r.records_unique) == ("full", 0, 4, 3)
    assert (tmp_path / "pool.txt").read_text() == "http://1.1.1.1:80\nhttp://1.1.1.1:81\nhttp://1.1.1.2:80\n"
    lines = [json.loads(x) for x in (tmp_path / "pool.jsonl").read_text().splitlines()]
    assert lines[0] == {"proxy": "http://1.1.1.1:80", "run_started_at": 7, "source": "p0"}
    doc = json.loads((tmp_path / "pool.summary.json").read_text())
    assert list(doc) == sorted(doc) and doc["records_unique"] == 3 and [p["records"] for p in doc["providers"]] == [2, 2]
    r = harvest(bodies(spark, "1.1.1.9:80"), chains(spark, 1, ["late"]), out)
    assert (r.outcome, r.exit_code) == ("partial", 2)
    r = harvest(bodies(spark, "none"), chains(spark, 1), out)
    assert (r.outcome, r.exit_code) == ("failed", 1)
    assert (tmp_path / "pool.txt").read_text() == "http://1.1.1.9:80\n"  # the last good pool stays
    assert json.loads((tmp_path / "pool.summary.json").read_text())["outcome"] == "failed"


def test_cap_and_truncation(spark, tmp_path, monkeypatch):
    """A body gives no more records than the cap; its source is truncated and the run partial."""
    from tidewell import harvest as run
    from tidewell.sources import bodies as src

    monkeypatch.setattr(run, "RECORD_CAP", 3)
    monkeypatch.setattr(run, "records", lambda b: src.records(b, 3))
    many = "x " * 20 + " ".join(f"1.1.1.{k}:80" for k in range(9))
    landed = bodies(spark, many, "1.1.2.1:80 1.1.2.2:80", '[{"ip":"1.1.3.1","port":1,"protocols":["http","https","socks4","socks5"]}]').withColumn("parse_kind", F.when(F.col("ord") == 2, "json").otherwise("entries"))
    r = harvest(landed, chains(spark, 3), str(tmp_path / "o.txt"))
    assert (r.outcome, r.records_total) == ("partial", 3 + 2 + 3)
    doc = json.loads((tmp_path / "o.summary.json").read_text())
    assert [p["truncated"] for p in doc["providers"]] == [True, False, True] and "cap" in doc["providers"][0]["errors"][0]
    assert (tmp_path / "o.txt").read_text().split()[:3] == [f"http://1.1.1.{k}:80" for k in range(3)]


def test_write_error_leaves_a_failed_summary(spark, tmp_path):
    (tmp_path / "p.txt").mkdir()  # the pool cannot be renamed over a folder
    with pytest.raises(OSError):
        harvest(bodies(spark, "1.1.1.1:80"), chains(spark, 1), str(tmp_path / "p.txt"))
    assert json.loads((tmp_path / "p.summary.json").read_text())["outcome"] == "failed"


def test_decoding(spark):
    from tidewell.sources.bodies import decode_bodies

    rows = [(1, b"caf\xe9 \x80", "text/plain; charset=ISO-8859-1"), (2, "é".encode() + b"\xff", None), (3, b"\xff\xfea\0", "x"), (4, b"\xef\xbb\xbfb", "text/plain; charset=nope"), (5, "жук".encode("koi8-r"), 'text/html; charset="KOI8-R"')]
    got = {r["k"]: r["body"] for r in decode_bodies(spark.createDataFrame([(k, bytearray(b), t) for k, b, t in rows], "k int, content binary, content_type string")).collect()}
    assert got == {1: "café €", 2: "é\ufffd", 3: "a", 4: "b", 5: "жук"}


def test_atomic_write_leaves_no_rest(tmp_path):
    target = tmp_path / "t"
    target.write_text("old")

    def failing():
        yield "a"
        raise RuntimeError

    with pytest.raises(RuntimeError):
        write_atomic(target, failing())
    assert [p.name for p in tmp_path.iterdir()] == ["t"] and target.read_text() == "old"


def test_stream(spark, tmp_path):
    from tidewell.streaming.landing import BODY as LANDED
    from tidewell.streaming.landing import first_seen, landed

    rows = [("b", 1, 0, 0, "http", "1.1.1.1:80", "2026-01-01 00:10:00"), ("a", 0, 0, 0, "http", "1.1.1.1:80 1.1.1.2:80", "2026-01-01 00:20:00"), ("c", 2, 0, 0, "http", "1.1.1.3:80", "2026-01-01 09:00:00")]
    d = spark.createDataFrame(rows, LANDED.replace("landed_at timestamp", "landed_at string")).withColumn("landed_at", F.to_timestamp("landed_at"))
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = first_seen(landed(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["url"], r["source"], r["seen"]) for r in spark.table("seen").collect()}
    assert got == {("http://1.1.1.1:80", "a", 2), ("http://1.1.1.2:80", "a", 1)}


def test_command_line(spark, tmp_path, capsys):
    from tidewell.__main__ import arguments, level, main

    d = spark.createDataFrame([("spys", 29, 0, 0, "http", "entries", "1.1.1.1:80"), ("geonode", 20, 0, 0, "http", "entries", "1.1.1.1:80"), ("hproxy", 1, 0, 0, "http", "entries", "1.1.1.2:80")], BODY)
    d.write.parquet(str(tmp_path / "b"))
    spark.createDataFrame([(p, 1, 1, 0.1, False, []) for p in ("spys", "geonode", "hproxy")], CHAIN).write.parquet(str(tmp_path / "c"))
    base = ["--bodies", str(tmp_path / "b"), "--chains", str(tmp_path / "c"), "-o", str(tmp_path / "out.txt"), "-q"]
    assert main([*base, "--providers", "spys,geonode,spys"]) == 0
    lines = [json.loads(x) for x in (tmp_path / "out.jsonl").read_text().splitlines()]
    assert [(x["proxy"], x["source"]) for x in lines] == [("http://1.1.1.1:80", "spys")]
    assert main([*base, "--providers", "spys,nope"]) == 2
    assert main(["--list-providers"]) == 0 and capsys.readouterr().out.splitlines()[0].startswith("89ip ")
    assert level(True, True) < level(False, False) < level(False, True)
    with pytest.raises(SystemExit):
        arguments([])
