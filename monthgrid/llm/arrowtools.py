"""What the Arrow-batched operators share: batch sizes, byte access, word bytes, shared storage, measured sides of joins."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

from monthgrid.session import forget, materialized, shared_dir, working_tables  # noqa: F401  the operators take them from here


BATCH_ROWS = 512

#: Lower-cases A-Z, keeps 0-9 a-z and every byte of a non-ASCII character, blanks the rest.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def small_batches(spark, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch of whole texts holds; read when a plan starts to run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def texts(column) -> list:
    """A string column's values as UTF-8 bytes, None for nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def in_slices(batches, column: int, most: int = 4 << 20):
    """Batches cut so that a slice holds about `most` bytes of a text column, or one row."""
    for batch in batches:
        size = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)])
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, "right")))
            yield batch.slice(a, b - a)
            a = b


def released(run):
    """A function of batches that hands the memory it no longer needs back to the system when a task ends: workers are
    kept for later tasks, and what each of them keeps adds up."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def settled(spark) -> None:
    """Hand back what the driver no longer needs, Python's and Java's: in a long run of small jobs, freed memory is kept, and
    generated code and plans pile up until the heap is at its limit."""
    release()
    spark.sparkContext._jvm.System.gc()


def spare(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until no column of a table has them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def written(df, name: str):
    """Cut the lineage: write to the shared folder as Parquet and read back."""
    return materialized(df, name)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: The most that is ever broadcast; a larger table is joined by its key instead.
BROADCAST_BYTES = 32 << 20


def small_side(df, bound: int = BROADCAST_BYTES):
    """Mark a written table for broadcast only where its measured size (text plus 64 bytes a row) is under the bound.

    Null values count as empty, and an empty table is small."""
    from pyspark.sql import functions as F

    wide = [F.octet_length(F.to_json(F.array(c)) if t.startswith("array") else F.col(c).cast("string")) for c, t in df.dtypes]
    row = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(64)).cast("bigint")
    size = df.agg(F.sum(row)).first()[0] or 0
    return F.broadcast(df) if size <= bound else df.hint("merge")
