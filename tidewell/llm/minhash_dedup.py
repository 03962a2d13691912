"""Near-duplicate classes by an LSH forest over MinHash signatures.

Words (`[^\\x20\\x09-\\x0D]+`, A-Z in lower case) make 5-word shingles; documents link when
``100 * intersection >= 75 * union`` of their shingle sets, confirmed on the full sets.

* Documents with equal sets are one class, represented by its smallest id; only representatives are compared.
* Each of ``TREES`` trees keeps ``DEPTH`` MinHash values of 16 bits. Sampled splitters range-partition all
  (tree, values) rows and an external sort orders them, so a region of any size spreads over tasks. Rows near each
  other in that order that share at least ``MIN_DEPTH`` leading values are candidates; and every row is paired
  with the smallest id of its region, the rows sharing so many leading values that at most ``REGION`` do
  (or all values). Rows at the ends of chunks are compared in a second, small pass. The number of candidates
  is linear in the rows, whatever the size of a group.
* Candidates whose 1-bit sketches or sizes exclude the similarity (by over five standard deviations, or
  strictly) go no further. Each row's smallest candidate is confirmed first; the components of
  those links settle most of the others, and every candidate that still joins two components is confirmed too.
* Rows that nearly link to another component look at ``WIDE`` neighbours on either side in every tree, among the
  components concerned, because one of many slightly different members may be similar where others are not.
* Rows that share all values of a tree with more than ``REGION - 1`` others, not all of one component, are joined exactly: all
  of them, whatever their trees, by a prefix filter on their shingles (rarest first) with sizes and positions.

A link between unequal texts can only be missed if no tree brings its rows together and one of them at least is in no region
above ``REGION`` at full depth; the chance is below 1e-4 at similarity 0.75 for a region of ordinary size, and recall is
measured in the tests.

Defined results: null and empty texts have no shingles, are a component each and linked with nothing; with
fewer than five words the whole sequence is the one shingle; rows of one id are one node; a null id takes its class's
component and is not kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import durable, each, fresh, heat_threshold, shuffle_partitions, sized_broadcast, small_batches, table, trims
from tidewell.llm.components import components

WORDS = 5
SIMILAR = 75  # hundredths
TREES, DEPTH, MIN_DEPTH = 16, 6, 2
NEIGHBOURS = 3
REGION = 64
NEARLY = 70  # hundredths of similarity from which a row that missed a component is looked at again
WIDE = 12  # neighbours on either side, then
TIGHT = 0.96  # share of equal bits from which only the next neighbour is needed beside the region's smallest id
EQUAL_BITS = 0.70  # 0.875 is expected at similarity 0.75; the deviation is 0.034
CHUNK = 200_000  # rows of the forest held at once
PER_CHUNK = 64  # members compared with one copy of a hub's text
LISTED = 500_000  # shingles whose frequency the exact join knows
CELL = 8192  # rows of one shingle compared in one piece; more are dealt in parts, each pair of which meets
SLICE = 1 << 18  # pairs or shingles of the exact join held at once

_RNG = np.random.default_rng(5_711)
_A = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_M = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    w = np.fromiter((digest(x) for x in words), np.uint64, len(words))
    n = len(w) - WORDS + 1
    s = np.zeros(n, np.uint64)
    for i in range(WORDS):
        s = s * _M + w[i : i + n]
    return np.unique(_mixed(s))


def _signature(s: np.ndarray) -> np.ndarray:
    out = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        out = np.minimum(out, (s[i : i + 2048, None] * _A + _B).min(axis=0))
    return _mixed(out)


SKETCH = "doc_id long, n long, same binary, high array<long>, low array<long>, b0 long, b1 long"


@trims
def _sketches(batches):
    """Arrow in and out: a null beside a value never turns a column of 64-bit numbers into floats."""
    for batch in batches:
        rows = []
        for text in each(batch.column("text")):
            s = shingles(text)
            if not len(s):
                rows.append((0, None, None, None, None, None))
                continue
            v = _signature(s)
            v16 = (v >> np.uint64(48)).reshape(TREES, DEPTH)
            high = (v16[:, 0] << np.uint64(48)) | (v16[:, 1] << np.uint64(32)) | (v16[:, 2] << np.uint64(16)) | v16[:, 3]
            low = (v16[:, 4] << np.uint64(16)) | v16[:, 5]
            bits = np.packbits((v & np.uint64(1)).astype(np.uint8))
            b = np.frombuffer(bits.tobytes().ljust(16, b"\0"), np.int64)
            rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), high.view(np.int64), low.astype(np.int64), int(b[0]), int(b[1])))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64())
        arrays = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "same", "high", "low", "b0", "b1"])


def sketches(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sketches, SKETCH)


ROW = ["tree", "high", "low", "node", "n", "b0", "b1"]
FOUND = "a long, b long, tree int, high long, low long, node long, n long, b0 long, b1 long"


def _equal_bits(f: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    x = np.bitwise_count((f["b0"][i] ^ f["b0"][j]).view(np.uint64)).astype(np.int64) + np.bitwise_count((f["b1"][i] ^ f["b1"][j]).view(np.uint64))
    return 1 - x / (TREES * DEPTH)


def _near(f: dict, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the pairs of places that can be similar, with their share of equal bits."""
    equal = _equal_bits(f, i, j)
    small, large = np.minimum(f["n"][i], f["n"][j]), np.maximum(f["n"][i], f["n"][j])
    ok = (equal >= EQUAL_BITS) & (100 * small >= SIMILAR * large) & (f["node"][i] != f["node"][j])
    return i[ok], j[ok], equal[ok]


def _shared(f: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many leading values the rows at the places share; -1 in different trees."""
    values = np.stack([f["tree"].astype(np.int64), *[(f["high"] >> s) & 0xFFFF for s in (48, 32, 16, 0)], (f["low"] >> 16) & 0xFFFF, f["low"] & 0xFFFF])
    return np.cumprod(values[:, i] == values[:, j], axis=0).sum(axis=0) - 1


def candidates_in(f: dict) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of nodes from rows in forest order."""
    n = len(f["node"])
    step = np.concatenate(([-1], _shared(f, np.arange(1, n), np.arange(n - 1)))) if n else np.empty(0, int)
    leader = np.arange(n)
    open_ = np.ones(n, bool)
    for depth in range(MIN_DEPTH, DEPTH + 1):
        region = np.cumsum(step < depth) - 1
        sizes = np.bincount(region, minlength=1)[region] if n else region
        settle = open_ & ((sizes <= REGION) | (depth == DEPTH))
        if settle.any():
            by = np.lexsort((f["node"], region))
            first = by[np.searchsorted(region[by], np.arange(region[-1] + 1))]
            leader[settle] = first[region[settle]]
            open_ &= ~settle
    i = np.flatnonzero(leader != np.arange(n))
    i, j, equal = _near(f, i, leader[i])
    tight = np.zeros(n, bool)
    tight[i[equal >= TIGHT]] = True
    pairs = [(i, j)]
    for k in range(1, NEIGHBOURS + 1):
        i = np.arange(k, n)
        near = np.ones(len(i), bool)
        for back in range(k):
            near &= step[i - back] >= MIN_DEPTH
        if k > 1:
            near &= ~(tight[i] & (leader[i] == leader[i - k]))
        pairs.append(_near(f, i[near], i[near] - k)[:2])
    a, b = (f["node"][np.concatenate([p[s] for p in pairs])] for s in (0, 1))
    both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
    return both[0], both[1]


@trims
def _walk(batches):
    """Pairs of each chunk of a range partition, and the rows at the chunk's ends, for a second pass over all ends."""
    frames, n = [], 0
    for frame in batches:
        frames.append(frame)
        n += len(frame)
        if n >= CHUNK:
            yield from _chunk(pd.concat(frames, ignore_index=True))
            frames, n = [], 0
    if n:
        yield from _chunk(pd.concat(frames, ignore_index=True))


def _chunk(frame: pd.DataFrame):
    a, b = candidates_in({c: frame[c].to_numpy() for c in ROW})
    for i in range(0, len(a), 65_536):
        yield pd.DataFrame({"a": a[i : i + 65_536], "b": b[i : i + 65_536]}).reindex(columns=["a", "b", *ROW]).astype("Int64")
    ends = frame.iloc[sorted({*range(min(NEIGHBOURS, len(frame))), *range(max(0, len(frame) - NEIGHBOURS), len(frame))})]
    yield ends.reindex(columns=["a", "b", *ROW]).astype("Int64")


def _forest(classes: DataFrame, *more: str) -> DataFrame:
    own = ["node", "n", "b0", "b1", *more]
    return classes.select(F.posexplode(F.arrays_zip("high", "low")).alias("tree", "v"), *own).select("tree", F.col("v.high").alias("high"), F.col("v.low").alias("low"), *own)


def candidates(classes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of representatives that may be similar."""
    rows, pairs = _forest(classes), []
    while True:
        ordered = rows.repartitionByRange("tree", "high", "low", "node").sortWithinPartitions("tree", "high", "low", "node")
        found = durable(ordered.mapInPandas(_walk, FOUND))
        pairs.append(found.select("a", "b").filter("a IS NOT NULL"))
        rows = found.filter("a IS NULL").select(*ROW)  # at most 2 * NEIGHBOURS for each chunk
        if rows.count() <= CHUNK:
            break
    last = rows.repartition(1).sortWithinPartitions("tree", "high", "low", "node").mapInPandas(_walk, FOUND)
    pairs.append(last.select("a", "b").filter("a IS NOT NULL"))
    return reduce(DataFrame.unionByName, pairs).distinct()


@trims
def _confirm(batches):
    hub, sets = None, []
    for frame in batches:
        out = []
        for key, chunk, is_hub, doc, text in frame[["hub", "chunk", "is_hub", "doc", "text"]].itertuples(index=False, name=None):
            own = shingles(text)
            if (key, chunk) != hub:
                hub, sets = (key, chunk), []
            if is_hub:
                sets.append(own)
                continue
            best = 0.0
            linked = False
            for other in sets:
                both = len(np.intersect1d(own, other, assume_unique=True))
                either = len(own) + len(other) - both
                linked |= bool(both) and 100 * both >= SIMILAR * either
                best = max(best, 100 * both / max(1, either))
            if linked or best >= NEARLY:
                out.append((key, doc, linked))
        yield pd.DataFrame(out, columns=["a", "b", "linked"]).astype({"a": "int64", "b": "int64", "linked": "bool"})


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (a, b) those similar on their full sets (linked), and those nearly so. A hub's members are dealt in chunks, each with the hub's text."""
    degree = pairs.groupBy("a").agg(F.count("*").alias("_d"))
    degree = sized_broadcast(degree, degree.count())
    members = pairs.join(degree, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.ceil(F.col("_d") / PER_CHUNK)).alias("chunk"), F.col("b").alias("doc"), F.lit(False).alias("is_hub"))
    members = durable(members)
    hubs = members.select("hub", "chunk").distinct().select("hub", "chunk", F.col("hub").alias("doc"), F.lit(True).alias("is_hub"))
    wanted = durable(members.unionByName(hubs))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    placed = texts.join(sized_broadcast(wanted, wanted.count()), F.col("_id") == F.col("doc"))
    dealt = placed.select("hub", "chunk", "is_hub", "doc", "text").repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", F.col("is_hub").desc())
    return dealt.mapInPandas(_confirm, "a long, b long, linked boolean").groupBy("a", "b").agg(F.bool_or("linked").alias("linked"))


@trims
def _wide(batches):
    """Pairs of loose rows with their wider neighbourhood, where both are of different components.

    The last rows of a batch are looked at again with the next, so that the size of batches changes nothing.
    """
    held = None
    for batch in batches:
        frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
        held = frame.iloc[max(0, len(frame) - WIDE) :]
        f = {c: frame[c].to_numpy() for c in [*ROW, "root", "loose"]}
        shares = np.concatenate(([False], _shared(f, np.arange(1, len(frame)), np.arange(len(frame) - 1)) >= MIN_DEPTH)) if len(frame) else np.empty(0, bool)
        pairs = [np.empty((2, 0), np.int64)]
        near = np.ones(len(frame), bool)
        for k in range(1, min(WIDE, len(frame) - 1) + 1):
            near = near[1:] & shares[: len(frame) - k + 1][1:] if k > 1 else shares[1:].copy()
            i = np.flatnonzero(near) + k
            i = i[(f["loose"][i] | f["loose"][i - k]) & (f["root"][i] != f["root"][i - k])]
            a, b, _ = _near(f, i, i - k)
            pairs.append(np.stack((np.minimum(f["node"][a], f["node"][b]), np.maximum(f["node"][a], f["node"][b]))))
        both = np.unique(np.concatenate(pairs, axis=1), axis=1)
        yield pd.DataFrame({"a": both[0], "b": both[1]})


def _with_roots(df: DataFrame, settled: DataFrame, n: int, *sides: str) -> DataFrame:
    for side in sides:
        roots = settled.select(F.col("node").alias(f"_n{side}"), F.col("root").alias(f"_r{side}"))
        df = df.join(sized_broadcast(roots, n), F.col(side) == F.col(f"_n{side}"), "left").withColumn(f"_r{side}", F.coalesce(f"_r{side}", side)).drop(f"_n{side}")
    return df


def second_look(classes: DataFrame, settled: DataFrame, missed: DataFrame) -> DataFrame:
    """Pairs to try for rows that nearly linked to another component: its members differ a little, and one may be similar.

    Only the components concerned take part, and only rows that nearly linked ask.
    """
    loose = durable(missed.select(F.explode(F.array("a", "b")).alias("_loose")).distinct())
    touched = durable(missed.select(F.explode(F.array("_ra", "_rb")).alias("_touched")).distinct())
    rows = _with_roots(classes, settled, settled.count(), "node").join(sized_broadcast(touched, touched.count()), F.col("_rnode") == F.col("_touched"), "left_semi")
    rows = rows.join(sized_broadcast(loose, loose.count()), F.col("node") == F.col("_loose"), "left").withColumn("loose", F.col("_loose").isNotNull()).withColumnRenamed("_rnode", "root")
    rows = _forest(rows, "root", "loose").repartitionByRange("tree", "high", "low", "node").sortWithinPartitions("tree", "high", "low", "node")
    return rows.mapInPandas(_wide, "a long, b long").distinct()


def crowded(classes: DataFrame, settled: DataFrame) -> DataFrame:
    """Rows (node, root, n) of the regions above ``REGION`` at full depth that hold several components."""
    rows = _forest(_with_roots(classes, settled, settled.count(), "node").withColumnRenamed("_rnode", "root"), "root")
    regions = rows.groupBy("tree", "high", "low").agg(F.count("*").alias("_rows"), F.min("root").alias("_low"), F.max("root").alias("_high"))
    regions = durable(regions.filter((F.col("_rows") > REGION) & (F.col("_low") < F.col("_high"))).select("tree", "high", "low"))
    return durable(rows.join(sized_broadcast(regions, regions.count()), ["tree", "high", "low"]).select("node", "root", "n").distinct())


@trims
def _frequencies(batches):
    def counted(sets):
        token, n = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_counts=True)
        return pd.DataFrame({"token": token.view(np.int64), "df": n})

    sets, size = [], 0
    for frame in batches:
        for text in frame["text"]:
            sets.append(shingles(text))
            size += len(sets[-1])
            if size >= SLICE:
                yield counted(sets)
                sets, size = [], 0
    yield counted(sets)


def _meeting(n: np.ndarray, left: np.ndarray, node: np.ndarray, root: np.ndarray, part: np.ndarray, across: bool):
    """Pairs of one shingle's rows, in order of size, whose sizes and places allow a link and whose roots differ."""
    low = np.searchsorted(n, -(-SIMILAR * n // 100))
    high = np.minimum(np.arange(len(n)), np.searchsorted(n, (100 + SIMILAR) * left // SIMILAR - n, "right"))
    counts = np.maximum(0, high - low)
    ends = np.cumsum(counts)
    first = 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLICE, "right")))
        c = counts[first:last]
        i = np.repeat(np.arange(first, last), c)
        j = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[first:last], c)
        ok = ((100 + SIMILAR) * left[j] >= SIMILAR * (n[i] + n[j])) & (root[i] != root[j])
        if across:
            ok &= part[i] != part[j]
        i, j = i[ok], j[ok]
        if len(i):
            yield np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        first = last


@trims
def _meet(batches):
    """Pairs of rows in order of (token, cell, n)."""

    def pairs(frame):
        f = {c: frame[c].to_numpy() for c in ("token", "cell", "n", "left", "node", "root", "part", "across")}
        edges = np.flatnonzero((np.diff(f["token"]) != 0) | (np.diff(f["cell"]) != 0)) + 1
        held, size = [], 0
        for a, b in zip([0, *edges], [*edges, len(frame)], strict=True):
            if b - a > 1:
                for pair in _meeting(*(f[c][a:b] for c in ("n", "left", "node", "root", "part")), bool(f["across"][a])):
                    held.append(np.stack(pair))
                    size += len(pair[0])
                    if size >= SLICE:
                        yield np.unique(np.concatenate(held, axis=1), axis=1)
                        held, size = [], 0
        if held:
            yield np.unique(np.concatenate(held, axis=1), axis=1)

    frames, n = [], 0
    for frame in batches:
        frames.append(frame)
        n += len(frame)
        if n >= 4 * CELL:
            every = pd.concat(frames, ignore_index=True)
            last = every[["token", "cell"]].iloc[-1]
            open_ = ((every["token"] == last["token"]) & (every["cell"] == last["cell"])).to_numpy()
            for both in pairs(every[~open_]):
                yield pd.DataFrame({"a": both[0], "b": both[1]})
            frames = [every[open_]]
            n = len(frames[0])
    if n:
        for both in pairs(pd.concat(frames, ignore_index=True)):
            yield pd.DataFrame({"a": both[0], "b": both[1]})


def exact_pairs(crowd: DataFrame, docs: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of crowded rows of different components that can be similar: none that links is left out.

    Rows show their rarest shingles, as many as must hold one that both sides of a link have. The order of shingles
    needs no exact frequencies, only one order for all rows: those seen less than ``floor`` times count as equally rare.
    """
    spark = docs.sparkSession
    n_rows, n_tokens = crowd.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    texts = durable(texts.join(sized_broadcast(crowd.select("node", "root").distinct(), n_rows), F.col("_id") == F.col("node")).select("node", "root", "text").distinct())
    floor = max(2, -(-n_tokens // LISTED))
    # at most LISTED rows, as Arrow: rows as Python objects would take twenty times the memory
    with small_batches(spark):
        listed = texts.mapInPandas(_frequencies, "token long, df long").groupBy("token").agg(F.sum("df").alias("df")).filter(F.col("df") >= floor).toArrow()
    token = listed.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(token)
    known = spark.sparkContext.broadcast((token[order], listed.column("df").to_numpy().astype(np.int64)[order]))

    names = ["token", "cell", "part", "across", "left", "n", "node", "root"]

    @trims
    def show(batches):
        tokens, dfs = known.value
        held, size = [], 0

        def rows():
            return pd.DataFrame(dict(zip(names, np.concatenate(held, axis=1), strict=True))).astype({"across": "bool"})

        for frame in batches:
            for node, root, text in zip(frame["node"], frame["root"], frame["text"], strict=True):
                s = shingles(text)
                if not len(s) or not len(tokens):
                    continue
                at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                df = np.where(tokens[at] == s, dfs[at], 0)
                by = np.lexsort((s, df))[: len(s) + SIMILAR * len(s) // -100 + 1]
                left = len(s) - np.arange(len(by))
                token, df = s[by], df[by]
                if floor == 2:  # the others are in one row alone
                    some = df > 0
                    token, df, left = token[some], df[some], left[some]
                # a shingle of k parts shows a row in k cells: its own part's with each part
                parts = np.maximum(1, -(-df // CELL))
                own = (_mixed(np.array([node], np.int64).view(np.uint64))[0] % parts.astype(np.uint64)).astype(np.int64)
                i = np.repeat(np.arange(len(token)), parts)
                other = np.arange(len(i)) - np.repeat(np.cumsum(parts) - parts, parts)
                k, own = parts[i], own[i]
                cell = np.minimum(own, other) * k + np.maximum(own, other)
                same = np.ones(len(i), np.int64)
                held.append(np.stack((token.view(np.int64)[i], cell, own, other != own, left[i], same * len(s), same * node, same * root)))
                size += len(i)
                if size >= SLICE // 8:
                    yield rows()
                    held, size = [], 0
        if held:
            yield rows()

    shown = texts.mapInPandas(show, "token long, cell long, part long, across boolean, left long, n long, node long, root long")
    return shown.repartition("token", "cell").sortWithinPartitions("token", "cell", "n").mapInPandas(_meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    sketched = durable(sketches(docs))
    classes = durable(
        sketched.filter("n > 0 AND doc_id IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("node"), F.count("*").alias("members"), F.first("n").alias("n"), F.first("high").alias("high"), F.first("low").alias("low"), F.first("b0").alias("b0"), F.first("b1").alias("b1"))
    )
    found = durable(candidates(classes))
    first = durable(found.groupBy("b").agg(F.min("a").alias("a")))
    tried = durable(confirm(first, docs))
    settled = components(tried.filter("linked"))
    left = durable(_with_roots(found.join(first, ["a", "b"], "left_anti"), settled, settled.count(), "a", "b").filter("_ra <> _rb").select("a", "b"))
    for look in (1, 2):
        if not left.isEmpty():
            more = durable(confirm(left, docs))
            tried = tried.unionByName(more)
            if not more.filter("linked").isEmpty():
                settled = components(tried.filter("linked"))
        if look == 1:
            missed = durable(_with_roots(tried.filter("NOT linked").select("a", "b"), settled, settled.count(), "a", "b").filter("_ra <> _rb"))
            if missed.isEmpty():
                break
            left = durable(second_look(classes, settled, missed).join(found, ["a", "b"], "left_anti"))
    crowd = crowded(classes, settled)
    if not crowd.isEmpty():
        more = durable(confirm(durable(exact_pairs(crowd, docs).join(found, ["a", "b"], "left_anti")), docs).filter("linked"))
        if not more.isEmpty():
            settled = components(tried.filter("linked").unionByName(more))
    # ids that stand for several classes (unequal texts of one id) are one node already
    roots = settled.select(F.col("node").alias("_n"), F.col("root").alias("_root"))
    by_class = durable(classes.join(sized_broadcast(roots, settled.count()), F.col("node") == F.col("_n"), "left").select("same", "members", F.coalesce("_root", "node").alias("_component")))
    own = sketched.select("doc_id", F.col("n").alias("n_shingles"), "same")
    # rows without shingles or id need no class; classes of many copies, at most eight a partition, are broadcast, so that no task gets one's rows
    hot_from = heat_threshold(by_class.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0], shuffle_partitions(docs.sparkSession))
    hot = by_class.filter(F.col("members") >= hot_from).select("same", F.col("_component").alias("_hot"))
    placed = own.filter("same IS NOT NULL").join(F.broadcast(hot), "same", "left")
    cold = placed.filter("_hot IS NULL").drop("_hot").join(by_class.filter(F.col("members") < hot_from).select("same", "_component"), "same", "left")
    every = placed.filter("_hot IS NOT NULL").select(*own.columns, F.col("_hot").alias("_component")).unionByName(cold.select(*own.columns, "_component"))
    every = every.unionByName(own.filter("same IS NULL").withColumn("_component", F.lit(None).cast("long")))
    return every.select("doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("_component", "doc_id"), F.lit(False)).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that are their component's smallest id, with all their columns; rows without an id stay."""
    (gone_id,) = fresh(docs.columns, "_gone")
    gone = durable(near_duplicates(docs).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(gone_id)).distinct())
    return docs.join(sized_broadcast(gone, gone.count()), F.col("doc_id").cast("long") == F.col(gone_id), "left_anti")


def op9_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(CAST(len(w) AS BIGINT) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS other FROM d UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN c ON c.id = doc_id LEFT JOIN n USING (doc_id)
"""
