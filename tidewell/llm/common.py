"""Helpers shared by the corpus operators: normalisation, durable cuts of lineage, table access."""

from __future__ import annotations

import ctypes
import functools
import math
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Everything that is not part of a word once A-Z are lower case.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only a local session without one (tests) gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewell-"))
    return sc.getCheckpointDir()


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1024


@contextmanager
def small_batches(spark: SparkSession):
    """Within an operator's own jobs at most ``BATCH_ROWS`` texts pass to Python at a time; the session's setting is put back."""
    before = spark.conf.get(BATCH, None)
    if before is None or not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH)
        else:
            spark.conf.set(BATCH, before)


def release() -> None:
    """Free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def trims(function):
    """For functions of Python workers: ``release`` once a task is done, for workers are used again."""

    @functools.wraps(function)
    def run(batches):
        yield from function(batches)
        release()

    return run


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the whole cluster shares."""
    _shared_folder(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write a table with texts as Parquet into the shared folder and read it again; ``discard`` deletes it."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` gave; a table from elsewhere is left alone."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("stage-"):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def heat_threshold(rows: int, partitions: int, floor: int = 256) -> int:
    """Rows from which a key is hot. At most ``8 * partitions`` keys can reach it, whatever the data."""
    return max(floor, math.ceil(rows / (8 * max(1, partitions))))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column has it, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: bytes.translate table: A-Z to lower case, every byte outside a word to a space.
WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def each(column):
    """The values of an Arrow column one at a time, so that a batch of texts is not held a second time as Python strings."""
    return (value.as_py() for value in column)


#: Rows of (long, long) up to which a counted table is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000


def sized_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of a few numbers a row if its counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
