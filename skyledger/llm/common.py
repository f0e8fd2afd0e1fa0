"""Shared pieces of the operators: table access, Arrow batches, hashing of words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows turned into Python objects at a time; bounds a worker's memory.
SLICE_ROWS = 512
# Rows of whole texts that the engine sends to a worker at a time, with what it holds of them on both sides.
BATCH_ROWS = 4 * SLICE_ROWS
# The same in bytes: batches of long texts or of whole shingle sets end before BATCH_ROWS.
BATCH_BYTES = 1 << 20
# Distinct words a worker remembers before it starts again.
CACHE_WORDS = 300_000
# The same for hashes, which cost less to compute again than words' features.
CACHE_HASHES = 100_000

WHITE = b" \t\n\v\f\r"  # [\x20\x09-\x0D]

_MASK = (1 << 64) - 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by ``BATCH_ROWS`` and ``BATCH_BYTES``: the engine and the worker both hold it, outside the heap."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        # A size may have a unit, as 512k or 64mb.
        held = spark.conf.get(key).lower().removesuffix("b")
        unit = 1 << 10 * ("kmgt".find(held[-1]) + 1)
        if not 0 < int(held.rstrip("kmgt")) * unit <= most:
            spark.conf.set(key, str(most))


def map_rows(df: DataFrame, work: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """Run ``work`` over slices of Arrow batches; it returns the columns of ``schema``.

    Columns may be Arrow arrays, numpy arrays or lists, and may have any length;
    ``None`` yields nothing for the slice.
    """
    import_schema = arrow_schema(df.sparkSession, schema)
    small_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                columns = work(batch.slice(start, SLICE_ROWS))
                if columns is not None:
                    yield to_batch(columns, import_schema)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        values = columns[field.name]
        arrays.append(values if isinstance(values, pa.Array) and values.type == field.type else pa.array(values, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered up to ``CACHE_HASHES`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_HASHES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, from the words' hashes; order matters."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mix(out + words[k : k + n] + np.uint64((k * 0x9E3779B97F4A7C15) & _MASK))
    return out


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's long."""
    return values.view(np.int64)
