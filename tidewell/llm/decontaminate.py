"""Benchmark decontamination: an FM-index for each training shard.

The benchmark's windows (10 consecutive words; an item of fewer words is one window) are the query set. Items
are cut into pieces of at most ``PIECE`` windows and dealt by hash to blocks of ``BLOCK_BYTES`` of text on average, each
collected and sent as arrays of word numbers, so what the driver and the executors hold of the
benchmark has a bound at any size of it; each block goes over all documents. A task cuts its documents into shards of at most
``SHARD_WORDS`` indexed words or ``SHARD_BYTES`` of text. Words that no window has end a run; runs shorter than the
shortest window cannot hold one and are left out of the index, which loses nothing. Backward search through
the wavelet ranks finds each window's row range, sampled suffix positions give the occurrences, and
overlapping occurrences merge to the spans to remove. One narrow pass over the documents, no shuffle.

Defined results: null and empty texts have no words; documents without a hit give n_items 0 and the
digest of the empty string; an empty benchmark hits nothing; repeated rows give equal rows; null ids
are carried along (a null item_id is left out of the list of ids); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import WORD_BYTES, durable, each, fresh, table, trims, words_of
from tidewell.llm.fm_index import FMIndex

WINDOW = 10
BLOCK_BYTES = 8 << 20
PIECE = 4096  # windows of an item that are dealt together
PATTERNS = 1 << 16  # windows searched at once
SHARD_WORDS = 1 << 20
SHARD_BYTES = 32 << 20


class Windows:
    """The distinct windows of a block, by length, over a vocabulary of the block's words.

    Rows are (item, piece of its words). ``ids`` has the words of all pieces end to end; a window is its place there, its
    items are a stretch of ``owners``.
    """

    def __init__(self, rows: list[tuple]):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        number: dict[str, int] = {}
        pieces, by_size, at = [], defaultdict(list), 0
        for item, text in rows:
            # symbol 1 separates runs
            ids = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text)), np.int32)
            size = min(WINDOW, len(ids))
            if not size:
                continue
            owner = -1 if item is None else number.setdefault(str(item), len(number))
            starts = np.arange(at, at + len(ids) - size + 1)
            by_size[size].append((starts, np.full(len(starts), owner)))
            pieces.append(ids)
            at += len(ids)
        self.names = list(number)
        self.ids = np.concatenate([*pieces, np.empty(0, np.int32)])
        self.by_size = {}
        for size, found in by_size.items():
            starts, owners = (np.concatenate(x) for x in zip(*found, strict=True))
            same = self._rows(starts, size).view(f"V{4 * size}").ravel()
            _, first, which = np.unique(same, return_index=True, return_inverse=True)
            pairs = np.unique(np.stack((which, owners)), axis=1)
            pairs = pairs[:, pairs[1] >= 0]
            self.by_size[size] = starts[first], np.searchsorted(pairs[0], np.arange(len(first) + 1)), pairs[1]
        self.shortest = min(self.by_size, default=0)

    def _rows(self, starts: np.ndarray, size: int) -> np.ndarray:
        return np.ascontiguousarray(self.ids[starts[:, None] + np.arange(size)])

    def patterns(self):
        """(size, words, bounds of the owners, owners) of the windows, a bounded number at a time."""
        for size, (starts, bounds, owners) in self.by_size.items():
            for i in range(0, len(starts), PATTERNS):
                some = starts[i : i + PATTERNS]
                yield size, self._rows(some, size).astype(np.int64), bounds[i : i + len(some) + 1], owners


class Shard:
    """Runs of benchmark words from some documents, indexed and searched together."""

    def __init__(self, windows: Windows):
        self.windows, self.pieces, self.starts, self.docs, self.offsets, self.size = windows, [], [], [], [], 0

    def add(self, doc: int, words: list[bytes]) -> None:
        shortest = self.windows.shortest
        if not shortest or len(words) < shortest:
            return
        get = self.windows.vocabulary.get
        ids = np.fromiter((get(w, 1) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 1).view(np.int8), [0]))))
        begins, ends = edges[::2], edges[1::2]
        long = ends - begins >= shortest
        for a, b in zip(begins[long], ends[long], strict=True):
            self.pieces += [ids[a:b], [1]]
            self.starts.append(self.size)
            self.docs.append(doc)
            self.offsets.append(a)
            self.size += b - a + 1

    def hits(self) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[int]]]:
        """Merged spans of word numbers, and numbers of items, by document."""
        spans, items = defaultdict(list), defaultdict(set)
        if not self.size:
            return spans, items
        index = FMIndex(np.concatenate(self.pieces))
        starts, docs, offsets = np.array(self.starts), np.array(self.docs), np.array(self.offsets)
        covered = np.zeros(self.size + 1, np.int64)
        for size, patterns, bounds, owners in self.windows.patterns():
            found, low, high = index.search(patterns)
            if not len(found):
                continue
            counts = high - low
            rows = np.repeat(low - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
            at = index.locate(rows)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + size, -1)
            pairs = np.unique(np.stack((docs[np.searchsorted(starts, at, "right") - 1], np.repeat(found, counts))), axis=1)
            for doc, k in pairs.T.tolist():
                items[doc].update(owners[bounds[k] : bounds[k + 1]].tolist())
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(covered[:-1]) > 0).view(np.int8), [0]))))
        run = np.searchsorted(starts, edges[::2], "right") - 1
        shift = offsets[run] - starts[run]
        for doc, a, b in zip(docs[run].tolist(), (edges[::2] + shift).tolist(), (edges[1::2] + shift).tolist(), strict=True):
            spans[doc].append((a, b))
        return spans, items


def _pieces(batches):
    """Items in pieces of at most PIECE windows, which overlap by what a window needs."""
    for batch in batches:
        out = []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of(text)
            for i in range(0, max(1, len(words) - WINDOW + 1), PIECE):
                out.append((item, i, b" ".join(words[i : i + PIECE + WINDOW - 1]).decode("utf-8", "surrogatepass")))
        columns = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["item_id", "piece", "text"])


def blocks_of(benchmark: DataFrame) -> list[DataFrame]:
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / BLOCK_BYTES))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    pieces = items.mapInArrow(_pieces, "item_id string, piece long, text string")
    return [pieces.filter(F.pmod(F.xxhash64("item_id", "piece", "text"), F.lit(n)) == k).select("item_id", "text") for k in range(n)]


def shards(windows: Windows, batches):
    """(batches, spans, items, word counts) of each shard in turn."""
    kept, shard, counts, size, rows = [], Shard(windows), [], 0, 0
    for batch in batches:
        for text in each(batch.column("text")):
            words = words_of(text)
            shard.add(rows, words)
            counts.append(len(words))
            size += len(text) if text else 0
            rows += 1
        kept.append(batch)
        if shard.size >= SHARD_WORDS or size >= SHARD_BYTES:
            yield pa.Table.from_batches(kept), *shard.hits(), counts
            kept, shard, counts, size, rows = [], Shard(windows), [], 0, 0
    if rows:
        yield pa.Table.from_batches(kept), *shard.hits(), counts


def find_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, spans (of word numbers, end exclusive) and items (sorted as strings)."""
    blocks = blocks_of(benchmark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(0) if len(blocks) == 1 else F.monotonically_increasing_id()).cast("long").alias("row"))
    if len(blocks) > 1:
        rows = durable(rows)
    return _hits(rows, blocks).drop("row")


HITS = "doc_id long, row long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _hits(rows: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """The hits of all blocks in rows of (doc_id, text, row), each on the whole text."""
    parts = []
    for block in blocks:
        windows = rows.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in block.collect()]))

        @trims
        def search(batches, windows=windows):
            names = windows.value.names
            for held, spans, items, counts in shards(windows.value, batches):
                n = range(len(counts))
                found = pa.array([[{"start": a, "end": b} for a, b in spans.get(i, ())] for i in n], _SPANS)
                named = pa.array([sorted(names[k] for k in items.get(i, ())) for i in n], pa.list_(pa.string()))
                out = pa.Table.from_arrays([held.column("doc_id"), held.column("row"), pa.array(counts, pa.int64()), found, named], names=["doc_id", "row", "n_words", "spans", "items"])
                yield from out.combine_chunks().to_batches()

        parts.append(rows.mapInArrow(search, HITS))
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    words = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("spans")), lambda s: F.sequence(s["start"], s["end"] - 1))))
    merged = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(words).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.select("doc_id", "row", "n_words", F.transform("hit", lambda w: F.struct(w.alias("start"), (w + 1).alias("end"))).alias("spans"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return find_hits(docs, benchmark).select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORD = re.compile(rb"[^ ]+")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.translate(WORD_BYTES))]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def remove_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, without the benchmark's spans; those left without a word go.

    ``n_chars``, where there is one, follows the text. The spans of all blocks of the benchmark are found on the whole text
    and cut at once, so the result does not depend on the number of blocks.
    """
    blocks = blocks_of(benchmark)
    if len(blocks) == 1:
        windows = docs.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in blocks[0].collect()]))

        @trims
        def clean(batches):
            for held, spans, _, counts in shards(windows.value, batches):
                yield from _without(held, spans, counts)

        return docs.mapInArrow(clean, docs.schema)
    row, hit, words = fresh(docs.columns, "_hit_row", "_hit_spans", "_hit_words")
    numbered = durable(docs.withColumn(row, F.monotonically_increasing_id()))
    found = _hits(numbered.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(row).alias("row")), blocks)
    found = found.filter(F.size("spans") > 0).select(F.col("row").alias(row), F.col("spans").alias(hit), F.col("n_words").alias(words))

    @trims
    def clean_marked(batches):
        for batch in batches:
            spans: dict[int, list[tuple[int, int]]] = {}
            for i, marked in enumerate(batch.column(hit).to_pylist()):
                for s in sorted(marked or (), key=lambda s: s["start"]):
                    own = spans.setdefault(i, [])
                    if own and s["start"] <= own[-1][1]:
                        own[-1] = (own[-1][0], max(own[-1][1], s["end"]))
                    else:
                        own.append((s["start"], s["end"]))
            yield from _without(pa.Table.from_batches([batch.drop_columns([row, hit, words])]), spans, batch.column(words).to_pylist())

    return numbered.join(found, row, "left").select(*[F.col(f"`{c}`") for c in docs.columns], row, hit, words).mapInArrow(clean_marked, docs.schema)


def _without(held: pa.Table, spans: dict[int, list[tuple[int, int]]], counts: list):
    """The rows without the words of their spans; other columns pass as they are, whatever their types."""
    if spans:
        texts = held.column("text").to_pylist()
        for i, found in spans.items():
            texts[i] = cut(texts[i], found)
        changes = {"text": texts}
        if "n_chars" in held.column_names and pa.types.is_integer(held.schema.field("n_chars").type):
            sizes = held.column("n_chars").to_pylist()
            for i in spans:
                sizes[i] = len(texts[i])
            changes["n_chars"] = sizes
        for name, values in changes.items():
            at = held.schema.get_field_index(name)
            held = held.set_column(at, held.schema.field(at), pa.array(values, held.schema.field(at).type))
        gone = {i for i, found in spans.items() if sum(b - a for a, b in found) == counts[i]}
        held = held.filter(pa.array([i not in gone for i in range(len(counts))]))
    yield from held.combine_chunks().to_batches()


def op4_benchmark_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, CAST(len(w) - least(10, len(w)) + 2 AS BIGINT))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bi),
di AS (SELECT rid, w, l.n, unnest(range(1, CAST(len(w) - l.n + 2 AS BIGINT))) AS i FROM d, (SELECT DISTINCT n FROM bw) l WHERE len(w) >= l.n),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM di),
hits AS (SELECT rid, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
       FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
