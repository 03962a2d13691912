"""Mixing sources to target weights.

Each source's documents lie end to end on a line of words, cut into blocks of ``BLOCK`` words. A source's
target is its weight's share of all words, held to ``MOST`` times its size (water-filling), and makes a number of
slots. Output shards have ``SHARD_SLOTS`` slots each, and shards are drawn in groups of ``GROUP``. A group gets its
even share of every source's slots; within it each shard's source counts are a multinomial draw of ``SHARD_SLOTS`` slots over
what the group still has of its sources, never more than that; its last shard has the rest. So every source's total
meets its target exactly, which independent draws could not promise, and no document can exceed ``MOST`` times its size.
Slot ``j`` of a source takes block ``permutation(j mod blocks)`` of the source's pseudorandom permutation for pass
``j div blocks`` (a keyed Feistel network, cycle-walked). The drawn slots join the blocks' words by block index:
``mixed`` gives the mixed corpus, one row a slot, and ``mix`` writes it into the shared folder and counts ``taken`` in what was written.

A group's share comes from a closed form of its number, so nothing is carried from group to group and no table grows with
the number of shards in one task; a group holds at most about ``GROUP * SHARD_SLOTS`` rows.

A source's line goes through its buckets (hashes of id and text), and in a bucket through ids and hashes, so it does not
depend on how the rows were dealt. The buckets' bases are prefix sums over a table with a row for each bucket and source. One shuffle
brings the texts into the order of the line, where they are cut into blocks; blocks that no slot takes (the inverse permutation tells) go no further, and
only parts of blocks at a bucket's ends are put together later. A source with a third of all rows never sits in one task. Reruns agree: draws and
permutations are keyed by ``SEED`` and the source's name alone.

Defined results: null and empty texts have size 0 and take nothing; a null source is a source of its
own, last in order; an empty table gives an empty result; repeated rows count each; other columns
are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import durable, each, shuffle_partitions, sized_broadcast, stored, table, trims

BLOCK = 64  # words
MOST = 3  # times a source's size
WEIGHTS = 3  # weights 1, 2, ... repeating over the sources in order
SHARD_SLOTS = 4096
GROUP = 16  # shards drawn together
HELD_BLOCKS = 4096  # blocks a task holds before it passes them on
SEED = 20_241
ROUNDS = 4


def _round(half: np.ndarray, key: int, r: int) -> np.ndarray:
    x = half + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, size: int, key: int, back: bool = False) -> np.ndarray:
    """A keyed pseudorandom permutation of range(size), or its inverse, at the given places."""
    half = max(1, (max(2, int(size)) - 1).bit_length() + 1 >> 1)
    mask = np.uint64((1 << half) - 1)
    out = np.asarray(index, np.uint64).copy()
    open_ = np.arange(len(out))
    while len(open_):
        left, right = out[open_] >> np.uint64(half), out[open_] & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ (_round(left, key, r) & mask), left
            else:
                left, right = right, left ^ (_round(right, key, r) & mask)
        out[open_] = (left << np.uint64(half)) | right
        open_ = open_[out[open_] >= np.uint64(size)]
    return out.astype(np.int64)


def _key(source: str, epoch: int) -> int:
    return zlib.crc32(f"{SEED}:{epoch}:{source}".encode("utf-8", "surrogatepass"))


def _columns(docs: DataFrame) -> DataFrame:
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    rows = docs.select(source.alias("_s"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("_s", "doc_id", F.xxhash64("doc_id", "text").alias("_h"), "text")


@trims
def _counted(batches):
    for batch in batches:
        size = [len(t.encode("utf-8", "surrogatepass").split()) if t else 0 for t in each(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("_s"), batch.column("doc_id"), pa.array(size, pa.int64()), batch.column("_h")], names=["_s", "doc_id", "size", "_h"])


def sized(docs: DataFrame) -> DataFrame:
    """Source, id, size and hash of the documents, without their texts."""
    return durable(_columns(docs).mapInArrow(_counted, "_s string, doc_id long, size long, _h long"))


def _ranked(sizes: DataFrame) -> DataFrame:
    """Sources with their place in order: sorted ranges, each counted, so that no task sees all sources."""
    by = sizes.groupBy("_s").agg(F.sum("size").alias("source_size"))
    null_last = F.when(F.col("_s") == "-", 1).otherwise(0)
    ranges = durable(by.repartitionByRange(null_last, "_s").select("_s", "source_size", F.spark_partition_id().alias("_part")))
    counts, before = [], 0
    for part, n in sorted(tuple(r) for r in ranges.groupBy("_part").agg(F.count("*")).collect()):  # a row for each partition
        counts.append((part, before))
        before += n
    bases = F.broadcast(sizes.sparkSession.createDataFrame(counts, "_part int, _base long"))
    own = Window.partitionBy("_part").orderBy(null_last, "_s")
    return ranges.withColumn("_own", F.row_number().over(own) - 1).join(bases, "_part").select("_s", "source_size", (F.col("_own") + F.col("_base")).alias("place"))


def targets(sizes: DataFrame) -> DataFrame:
    """Per source: _s, _k (its place in order), source_size, target, blocks, slots, key (of its first pass).

    The level (words for each unit of weight) rises until what the sources held to MOST times their size leave is shared out;
    a round is one aggregate, and each round holds at least one more source.
    """
    plan = durable(_ranked(sizes).withColumn("weight", F.col("place") % WEIGHTS + 1).withColumn("most", F.col("source_size") * MOST))
    level = 0.0
    while True:
        held = F.col("most") <= F.lit(level) * F.col("weight")
        total, kept, weight = plan.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(held, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0))).first()
        rise = (total - kept) / weight if weight else level
        if rise <= level:
            break
        level = rise
    target = F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight"))
    blocks = F.ceil(F.col("source_size") / BLOCK)
    slots = F.when(F.col("source_size") > 0, F.least(F.round(target * blocks / F.col("source_size")).cast("long"), blocks * MOST)).otherwise(F.lit(0))
    key = F.crc32(F.concat(F.lit(f"{SEED}:0:"), F.col("_s")).cast("binary"))
    return plan.select("_s", F.col("place").alias("_k"), "source_size", target.alias("target"), blocks.cast("long").alias("blocks"), slots.cast("long").alias("slots"), key.alias("key"))


def share(slots: int, groups: int, phase: int, g):
    """A source's slots in the groups before group ``g``: an even share, its rounding shifted by the source's phase."""
    return (slots * g + phase) // groups


def _group_rows(batches, groups: int):
    """(group, source, its place, blocks, first slot, slots) of the groups that have slots of a source."""
    for frame in batches:
        for s, place, blocks, slots in zip(frame["_s"], frame["_k"], frame["blocks"], frame["slots"], strict=True):
            phase = _key(s, -2) % groups
            if groups <= slots * 4:
                stretches = (range(a, min(groups, a + 65_536)) for a in range(0, groups, 65_536))
            else:  # the groups in which its few slots lie
                stretches = [sorted({((k + 1) * groups - phase - 1) // slots for k in range(slots)})]
            for stretch in stretches:
                first = [share(slots, groups, phase, g) for g in stretch]
                n = [share(slots, groups, phase, g + 1) - f for g, f in zip(stretch, first, strict=True)]
                yield pd.DataFrame({"g": list(stretch), "_s": s, "_k": place, "blocks": blocks, "first": first, "n": n}).query("n > 0")


def deal(counts: np.ndarray, group: int) -> list[np.ndarray]:
    """Source counts of each shard of a group: multinomial draws over what is left, the last shard has the rest."""
    rng = np.random.default_rng([SEED, group])
    left, out = counts.astype(np.int64).copy(), []
    while left.sum() > SHARD_SLOTS:
        drawn = np.zeros(len(left), np.int64)
        while (open_ := SHARD_SLOTS - drawn.sum()) > 0:
            drawn += np.minimum(rng.multinomial(open_, (left - drawn) / (left - drawn).sum()), left - drawn)
        out.append(drawn)
        left -= drawn
    return [*out, left]


@trims
def _fill(batches):
    """Slots of the groups: rows come in order of group and source."""

    def slots(g, rows):
        counts = np.array([n for *_, n in rows], np.int64)
        at = np.array([first for *_, first, _ in rows], np.int64)
        for k, drawn in enumerate(deal(counts, g)):
            out = []
            for i in np.flatnonzero(drawn):
                s, place, blocks, *_ = rows[i]
                slot = np.arange(at[i], at[i] + drawn[i])
                block = np.empty(len(slot), np.int64)
                for epoch in np.unique(slot // blocks):
                    own = slot // blocks == epoch
                    block[own] = permute(slot[own] % blocks, blocks, _key(s, int(epoch)))
                out.append(pd.DataFrame({"_k": place, "shard": (g << 16) + k, "slot": slot, "block": block}))
            at += drawn
            if out:
                yield pd.concat(out, ignore_index=True)

    group, rows = None, []
    for frame in batches:
        for g, s, place, blocks, first, n in frame[["g", "_s", "_k", "blocks", "first", "n"]].itertuples(index=False, name=None):
            if g != group and rows:
                yield from slots(group, rows)
                rows = []
            group = g
            rows.append((s, place, blocks, first, n))
    if rows:
        yield from slots(group, rows)


def draw(plan: DataFrame) -> DataFrame:
    """Blocks for slots: _k, shard, slot (within the source), block."""
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    groups = max(1, -(-total // (GROUP * SHARD_SLOTS)))
    rows = plan.filter("slots > 0").select("_s", "_k", "blocks", "slots").mapInPandas(lambda batches: _group_rows(batches, groups), "g long, _s string, _k long, blocks long, first long, n long")
    # few small rows that grow to many: a given number of tasks, which AQE doesn't merge
    dealt = rows.repartition(shuffle_partitions(plan.sparkSession), "g").sortWithinPartitions("g", "_s")
    return dealt.mapInPandas(_fill, "_k long, shard long, slot long, block long")


#: The order of a bucket's rows on the line; rows equal in all of it have the same id and text.
ORDER = ["doc_id", "_h"]


def bucketed(sizes: DataFrame, plan: DataFrame) -> tuple[int, DataFrame]:
    """The number of buckets, and for each source and bucket its base on the source's line. The window sees one row for each."""
    buckets = 1 << max(4, math.ceil(math.log2(2 * math.sqrt(sizes.count() + 1))))
    sums = sizes.filter("size > 0").groupBy("_s", F.pmod("_h", F.lit(buckets)).alias("bucket")).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("_s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0)))
    return buckets, durable(bases.join(plan.drop("source_size", "target"), "_s").select("_s", "bucket", "base", "_k", "blocks", "slots", "key"))


def _with_bases(rows: DataFrame, buckets: int, bases: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod("_h", F.lit(buckets))).join(sized_broadcast(bases, bases.count()), ["_s", "bucket"])


BLOCKS = "_k long, block long, text string, docs array<long>"


def _drawn(k: np.ndarray, block: np.ndarray, plans: dict) -> np.ndarray:
    """Whether a slot takes each block: all do once there are as many slots, else the slots of the first pass, which the inverse permutation names."""
    out = np.ones(len(k), bool)
    for source in np.unique(k):
        blocks, slots, key = plans[source]
        if slots < blocks:
            own = k == source
            out[own] = permute(block[own], blocks, key, back=True) < slots
    return out


@trims
def _blocks(batches):
    """Drawn blocks of rows that follow each other on their source's line, with the places of their documents on it; parts of blocks at the ends of buckets."""
    at = (None, None)  # source and base of the bucket
    held = None  # block, words, documents
    plans: dict[int, tuple] = {}
    offset, out = 0, []

    def close():
        block, words, own = held
        out.append((at[0], block, b" ".join(words), own))

    def table_of(rows):
        k, block = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        keep = _drawn(k, block, plans)
        rows = [r for r, x in zip(rows, keep, strict=True) if x]
        arrays = [pa.array(k[keep]), pa.array(block[keep]), pa.array([r[2] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, names=["_k", "block", "text", "docs"])

    for batch in batches:
        for k, base, blocks, slots, key, text in zip(*(each(batch.column(c)) for c in ("_k", "base", "blocks", "slots", "key", "text")), strict=True):
            if at != (k, base):
                if held:
                    close()
                at, held, offset = (k, base), None, base
                plans[k] = blocks, slots, key
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            doc, first = offset, 0
            while first < len(words):
                if held is None:
                    held = [offset // BLOCK, [], []]
                own = words[first : first + BLOCK - offset % BLOCK]
                held[1] += own
                held[2].append(doc)
                first += len(own)
                offset += len(own)
                if offset % BLOCK == 0:
                    close()
                    held = None
                if len(out) >= HELD_BLOCKS:
                    yield table_of(out)
                    out.clear()
    if held:
        close()
    yield table_of(out)


def _mixed(docs: DataFrame, plan: DataFrame, buckets: int, bases: DataFrame) -> DataFrame:
    rows = _with_bases(_columns(docs), buckets, bases).select("_k", "bucket", *ORDER, "base", "blocks", "slots", "key", "text")
    rows = rows.repartition("_k", "bucket").sortWithinPartitions("_k", "bucket", *ORDER)
    cut = rows.select("_k", "base", "blocks", "slots", "key", "text").mapInArrow(_blocks, BLOCKS)
    # one shuffle of blocks: the join below has the same keys
    blocks = cut.groupBy("_k", "block").agg(F.array_sort(F.collect_list(F.struct("docs", "text"))).alias("_p"))
    blocks = blocks.select("_k", "block", F.array_join("_p.text", " ").alias("text"), F.flatten("_p.docs").alias("docs"))
    # the drawn slots grow with the data: never broadcast, whatever their estimate
    return draw(plan).hint("shuffle_hash").join(blocks, ["_k", "block"]).select("shard", "_k", "slot", "block", "text", "docs")


def _named(rows: DataFrame, plan: DataFrame) -> DataFrame:
    names = plan.select(F.col("_k").alias("_pk"), F.when(F.col("_s") != "-", F.substring("_s", 2, 1 << 30)).alias("source"))
    return rows.join(sized_broadcast(names, plan.count()), F.col("_k") == F.col("_pk")).drop("_pk")


def mixed(docs: DataFrame) -> DataFrame:
    """The mixed corpus, one row a slot: shard, source, slot (within the source), block, text, and docs (places on the source's line of the documents in it)."""
    sizes = sized(docs)
    plan = durable(targets(sizes))
    return _named(_mixed(docs, plan, *bucketed(sizes, plan)), plan).select("shard", "source", "slot", "block", "text", "docs")


def words_taken(out: DataFrame) -> DataFrame:
    """Of rows of the mix: _k, offset (place of a document on its source's line), taken (its words in all slots)."""
    begin = F.col("block") * BLOCK
    words = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit(" "), F.lit(""))) + 1
    parts = out.select("_k", begin.alias("begin"), (begin + words).alias("end"), "docs")
    ends = F.concat(F.slice("docs", F.lit(2), F.size("docs")), F.array("end"))
    parts = parts.select("_k", F.explode(F.zip_with("docs", ends, lambda d, e: F.struct(d.alias("offset"), (e - F.greatest(d, F.col("begin"))).alias("words")))).alias("p"))
    return parts.groupBy("_k", "p.offset").agg(F.sum("p.words").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken. The mixed corpus is left in the shared folder (``mixed`` gives its rows)."""
    sizes = sized(docs)
    plan = durable(targets(sizes))
    buckets, bases = bucketed(sizes, plan)
    taken = words_taken(stored(_mixed(docs, plan, buckets, bases)))
    within = Window.partitionBy("_k", "bucket").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    on_line = _with_bases(sizes.filter("size > 0"), buckets, bases).withColumn("offset", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    counted = on_line.select("_s", "_k", "doc_id", "size", "offset").join(taken, ["_k", "offset"], "left").select("_s", "doc_id", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    figures = counted.unionByName(sizes.filter("size = 0").select("_s", "doc_id", "size", F.lit(0).cast("long").alias("taken")))
    return figures.join(sized_broadcast(plan.select("_s", "source_size", "target"), plan.count()), "_s").select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def op6_source_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
