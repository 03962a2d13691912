"""Exact de-duplication, license scan and secret scan against brute force."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidewell.llm import common, exact_dedup, license_scan, secret_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(common.UPPER, common.UPPER.lower())


def low(t):
    return (t or "").translate(LOWER)


def copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        first = True
        for i in sorted(ids, key=lambda x: (x is not None, x or 0), reverse=True):
            out.append((i, keep, len(ids), first, hashlib.sha256(t.encode()).hexdigest()))
            first = False
    return sorted(map(str, out))


def got_copies(docs):
    return sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])) for r in exact_dedup.exact_dedup(docs).collect())


def test_exact_odd(odd_docs, no_docs):
    assert got_copies(odd_docs) == copies([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert got_copies(no_docs) == []


@pytest.mark.parametrize("floor", [2, 7, 10_000])
def test_exact_hot_groups(spark, monkeypatch, floor):
    """Salted groups give the same rows as unsalted ones."""
    monkeypatch.setattr(exact_dedup, "heat_threshold", lambda rows, parts: floor)
    rows = [(i, "Hot text") for i in range(120)] + [(200 + i, "É HOT") for i in range(20)] + [(300 + i, "é hot") for i in range(20)] + [(400 + i, f"own {i // 2}") for i in range(40)]
    assert got_copies(spark.createDataFrame(rows, "doc_id long, text string")) == copies(rows)


def test_exact_drop(odd_docs, spark):
    kept = exact_dedup.drop_exact_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(low(r["text"]) for r in kept.collect()) == sorted({low(r["text"]) for r in odd_docs.collect()})
    unique = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_copies(unique).collect()) == [2, 3]


def base_license(text):
    w = WORD.findall(low(text))
    at = [(i, label, len(p.split())) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, *_ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x, _ in at}))


def license_rows(docs):
    return sorted(str((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in license_scan.license_scan(docs).collect())


def test_license_base(spark, odd_docs, no_docs):
    texts = ["MIT license mit License", "see the Apache-License, CC BY 4.0 (cc by)", "GNU general public\nlicense", "kit license", "mit\x80license mit", "license mit apache", None, "cc by"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for docs in (d, odd_docs, no_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        assert license_rows(docs) == sorted(str((r["doc_id"], *base_license(r["text"]))) for r in docs.collect())


def test_license_votes(spark):
    filler = " ".join(f"w{i}" for i in range(300))
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    broken = mit.replace("charge,", "any charge").replace("copy of", "copy or part of")
    rows = [(1, f"{filler} {mit} {filler}"), (2, f"{filler} {broken} {filler} {mit}"), (3, f"{filler} permission is hereby granted {filler}"), (4, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met")]
    got = {r["doc_id"]: (r["labels"], round(r["score"], 2)) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("mit", 1.0) and got[2] == ("mit", 1.0) and got[3] == ("", 0.0) and got[4] == ("bsd", 1.0)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text):
    t = text or ""
    s = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    s += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    s += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(s)


def test_secret_base(spark, odd_docs, no_docs):
    h = "0123456789abcdef" * 2
    texts = [f"token = {h}", "secret:token:abcdefgh", "PassWord='hunter22' passwd=short", f"é\U0001f600 {h} {h}", "AKIA" + "Z9" * 8 + " AKIAAKIA" + "Q" * 13, "api_key: x.y.z.w", "apikey=abcdef=token=abcdefg", None, "token=" * 5, f"{h}:{h}="]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for docs in (d, odd_docs, no_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        want = []
        for r in docs.collect():
            b = base_secrets(r["text"])
            n = [sum(x[1] == k for x in b) for k in range(3)]
            want.append(str((r["doc_id"], *n, hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, k, e in b).encode()).hexdigest())))
        got = [str((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"])) for r in secret_scan.secret_scan(docs).collect()]
        assert sorted(got) == sorted(want)


def test_secret_battery(spark):
    import base64
    import random

    rnd = random.Random(3)
    keys = [base64.b64encode(rnd.randbytes(30)).decode() for _ in range(40)]
    plain = ["aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "version1version1version1version1version1", "abababab1abababababababababababababab", "aaaaabbbbbcccccdddddeeeee11111fffff2222"]
    d = spark.createDataFrame([(i, f"see {k} now") for i, k in enumerate(keys + plain)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_random"] for r in secret_scan.secret_scan(d).collect()}
    assert sum(got[i] for i in range(len(keys))) >= 38
    assert sum(got[len(keys) + i] for i in range(len(plain))) == 0
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.secret_scan(d).filter("n_random > 0").collect()}
    assert spans[0] == f"random:4:{4 + len(keys[0])}"


def test_native_plans_have_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for f in (exact_dedup.exact_dedup, license_scan.license_scan, secret_scan.secret_scan):
        plan = f(docs)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan), f
    assert F is not None
