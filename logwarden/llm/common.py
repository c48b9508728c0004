"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import string
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, \x20 and \x09-\x0D. bytes.split() cuts at the same six bytes.
BLANKS = " \t\n\x0b\f\r"

#: For bytes.translate: A-Z to lower case, and every ASCII byte that is no letter or digit to a space. Bytes of
#: longer characters stay, so ``translate(...).split()`` gives the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
WORD_BYTES = bytes(b if b >= 128 or chr(b) in string.ascii_lowercase + string.digits else
                   b + 32 if chr(b) in string.ascii_uppercase else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def unique_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path on shared storage: in the session's ``spark.checkpoint.dir``, else in its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table that several steps read to shared storage and reads it back, which also cuts the lineage.

    The place is the session's ``spark.checkpoint.dir``; where that is unset, its warehouse, which is shared as well.
    """
    target = unique_folder(df.sparkSession, name)
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return (F.when(F.octet_length(text) == F.length(text), F.lower(text))
            .otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase)))


def same(left: Column, right: Column) -> Column:
    """Equality under which null equals null."""
    return left.eqNullSafe(right)


# -- in Python workers ----------------------------------------------------------------------------------------

#: What this worker has built, by kind, for one owner at a time.
BUILT: dict[str, object] = {}
OWNER = [""]


def built(owner: str, kind: str, make: Callable[[], object]) -> object:
    """What ``make`` returns, made once for this worker. What another owner has built is dropped first, so a worker that serves
    one operator after another holds the tables of the last one only. Called by module-level functions only: nested ones
    are shipped with copies of the globals they use."""
    if OWNER[0] != owner:
        BUILT.clear()
        OWNER[0] = owner
    if kind not in BUILT:
        BUILT[kind] = make()
    return BUILT[kind]


def tidied(batches: Iterator[pa.RecordBatch], keeps: bool = False) -> Iterator[pa.RecordBatch]:
    """Passes on the result of a task and gives back the memory that the worker, which Spark uses again, has no more use for.
    Without ``keeps`` that includes what was ``built``, here or by an operator before."""
    if not keeps:
        BUILT.clear()
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # only the GNU C library has it


def sliced(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with rows of about ``most`` in all, so that only so much is unpacked at a time."""
    first, size = 0, 0
    for i, n in enumerate(sizes.to_pylist()):
        size += n or 0
        if size >= most:
            yield batch.slice(first, i + 1 - first)
            first, size = i + 1, 0
    if first < batch.num_rows:
        yield batch.slice(first)
