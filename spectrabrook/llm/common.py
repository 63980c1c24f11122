"""What the corpus operators share: staged tables, text conventions, hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper-case ASCII letters and what they become; other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def _temporary() -> str:
    path = tempfile.mkdtemp(prefix="spectrabrook-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. A local session without
    that setting (a test) gets a temporary folder, which goes when Python ends;
    on a cluster, whose machines would each have their own, that is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(spark, "_shared_dir", None) or _temporary()
        spark._shared_dir = found
    return found.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs no more than the stage that
    was running, and later readers don't compute df again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for held in _SCOPES:
        held.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """df, a staged table, marked for broadcast if it has at most `most` rows; else it is joined by exchange."""
    return F.broadcast(df) if df.count() <= most else df


#: Paths staged since each open scope began.
_SCOPES: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def staged_tables(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside go at the end: for callers that have written their result by then.

    Without it they stay, for a lazy result reads them; whoever consumes it may
    empty the folder afterwards.
    """
    held: list[str] = []
    _SCOPES.append(held)
    try:
        yield
    finally:
        _SCOPES.remove(held)
        for path in held:
            remove(spark, path)


#: Bytes of an Arrow batch of texts that goes to Python; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in Arrow batches bounded by bytes, whatever their lengths.

    A session setting, the same for all corpus operators, so that none changes
    another's lazy plan; a smaller bound of the caller's stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty string.

    lower() has a fast path and the same result where all characters are ASCII.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds
