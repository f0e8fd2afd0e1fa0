"""Exact k-means over integer vectors that are stored as codes into subvector dictionaries.

Vectors are cut into blocks of ``WIDTH`` dimensions. In each stored chunk of vectors, a block is a
dictionary of its distinct subvectors and one code per vector: nothing is rounded, the vectors can be
read back. In a round, each task computes the squared distance of every dictionary entry to every
centroid's block once, and a vector's distance is the sum of the partial distances at its codes. The
sums of a cluster come from counts per code. A dictionary belongs to a chunk of at most
``CHUNK_ROWS`` vectors, so no dictionary grows with the data, nothing but the centroids is sent to the
tasks, and no vector is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import arrow_schema, to_batch
from skyledger.session import materialize

WIDTH = 2  # dimensions in a block
CHUNK_ROWS = 16_384  # vectors in a chunk; codes are 16-bit numbers
LARGEST = 1 << 27  # components up to this size keep distances within a long

CHUNK = "ids array<bigint>, entries array<binary>, codes array<binary>"


def whole_numbers(vectors: DataFrame, dims: int, scale: int = 64, column: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors of exactly ``dims`` components, none null or not finite, as floor(scale * x)."""
    good = F.forall(column, lambda x: F.coalesce((x == x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    kept = vectors.where((F.size(column) == dims) & good)
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(column, lambda x: x.cast("double") * F.lit(float(scale))).alias("scaled"))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    values = np.floor(batch.column("scaled").flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, dims)
    if values.size and np.abs(values).max() > LARGEST:
        raise ValueError(f"a scaled component exceeds {LARGEST}: distances would not fit in a long")
    return values.astype(np.int32)


def encode_chunk(matrix: np.ndarray, width: int) -> tuple[list[bytes], list[bytes]]:
    """Dictionary and codes of each block of columns."""
    entries, codes = [], []
    for start in range(0, matrix.shape[1], width):
        distinct, code = np.unique(matrix[:, start : start + width], axis=0, return_inverse=True)
        entries.append(distinct.astype("<i4").tobytes())
        codes.append(code.reshape(-1).astype("<u2").tobytes())
    return entries, codes


def blocks_of(entries: list[bytes], codes: list[bytes], dims: int, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first dimension, distinct subvectors, code of each vector) of each block of a chunk."""
    for start, entry, code in zip(range(0, dims, width), entries, codes, strict=True):
        yield start, np.frombuffer(entry, "<i4").reshape(-1, min(width, dims - start)).astype(np.int64), np.frombuffer(code, "<u2").astype(np.intp)


def decode_chunk(entries: list[bytes], codes: list[bytes], dims: int, width: int = WIDTH) -> np.ndarray:
    """The vectors of a chunk."""
    return np.hstack([distinct[code] for _, distinct, code in blocks_of(entries, codes, dims, width)])


def encode_vectors(numbers: DataFrame, dims: int, width: int = WIDTH, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Chunks of ``numbers`` (vec_id, scaled), written to the shared folder."""
    if not 0 < chunk_rows <= 1 << 16:
        raise ValueError("codes are 16-bit numbers")
    schema = arrow_schema(numbers.sparkSession, CHUNK)

    def chunk(parts: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
        entries, codes = encode_chunk(np.vstack([m for _, m in parts]), width)
        ids = [i for column, _ in parts for i in column.to_pylist()]
        return to_batch({"ids": [ids], "entries": [entries], "codes": [codes]}, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                piece = batch.slice(0, chunk_rows - n)
                batch = batch.slice(piece.num_rows)
                held.append((piece.column("vec_id"), _matrix(piece, dims)))
                n += piece.num_rows
                if n == chunk_rows:
                    yield chunk(held)
                    held, n = [], 0
        if held:
            yield chunk(held)

    return materialize(numbers.mapInArrow(run, CHUNK), "chunks")


def nearest(entries: list[bytes], codes: list[bytes], centroids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number among equal ones) and squared distance of each vector of a chunk."""
    total = None
    for start, distinct, code in blocks_of(entries, codes, centroids.shape[1], width):
        difference = distinct[:, None, :] - centroids[None, :, start : start + distinct.shape[1]]
        partial = (difference * difference).sum(axis=2)[code]
        total = partial if total is None else total + partial
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(cluster)), cluster]


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes], list[bytes]]]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch.column("ids")[row].values, batch.column("entries")[row].as_py(), batch.column("codes")[row].as_py()


def cluster_totals(chunks: DataFrame, centroids: np.ndarray, width: int) -> tuple[np.ndarray, list[list[int]]]:
    """Vectors in each cluster and the sum of their components; one row per cluster leaves a task."""
    k, dims = centroids.shape
    ddl = "cluster int, n bigint, sums array<bigint>"
    schema = arrow_schema(chunks.sparkSession, ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, entries, codes in _chunks(batches):
            cluster, _ = nearest(entries, codes, centroids, width)
            counts += np.bincount(cluster, minlength=k)
            for start, distinct, code in blocks_of(entries, codes, dims, width):
                uses = np.bincount(cluster * len(distinct) + code, minlength=k * len(distinct)).reshape(k, -1)
                sums[:, start : start + distinct.shape[1]] += uses @ distinct
        some = np.flatnonzero(counts)
        yield to_batch({"cluster": some.astype(np.int32), "n": counts[some], "sums": sums[some].tolist()}, schema)

    parts = chunks.mapInArrow(run, ddl)
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)])
    counts, sums = np.zeros(k, np.int64), [[0] * dims for _ in range(k)]
    for row in merged.collect():  # at most k rows
        counts[row["cluster"]] = row["n"]
        sums[row["cluster"]] = list(row[2:])
    return counts, sums


def first_centroids(numbers: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest SHA-256 of ``seed:id``; null ids last, equal ids by components."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    whole = F.transform("scaled", lambda x: F.floor(x))
    rows = numbers.select(rank.alias("rank"), whole.alias("v")).orderBy(F.col("rank").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster_vectors(vectors: DataFrame, dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: str = "1", width: int = WIDTH, column: str = "embedding") -> DataFrame:
    """Cluster ``vectors`` (vec_id, ``column``) and return one row per kept vector.

    Columns: vec_id, cluster, distance (squared, to the final centroid), cluster_inertia, inertia and
    centroid_sha256. Vectors that are null, of another length, or hold a null, NaN or infinite component are
    left out. Equal and repeated vectors are vectors of their own; a null vec_id stays null and is
    drawn last as a first centroid. Fewer vectors than ``k`` give as many centroids; no vectors, no rows.
    A component beyond 2**27 after scaling raises an error, since a long could not hold its distances.
    Other columns are not read. All numbers are whole, so the result does not depend on partitions.
    """
    numbers = whole_numbers(vectors, dims, scale, column)
    out = "vec_id bigint, cluster int, distance bigint"
    spark = vectors.sparkSession
    centroids = first_centroids(numbers, k, seed)
    if not len(centroids):
        empty = spark.createDataFrame([], out)
        return empty.select("*", F.lit(0).cast("bigint").alias("cluster_inertia"), F.lit(0).cast("bigint").alias("inertia"), F.lit("").alias("centroid_sha256"))
    chunks = encode_vectors(numbers, dims, width)
    for _ in range(rounds):
        counts, sums = cluster_totals(chunks, centroids, width)
        for c in np.flatnonzero(counts):
            centroids[c] = [s // int(counts[c]) for s in sums[c]]
    schema, final = arrow_schema(spark, out), centroids.copy()

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, entries, codes in _chunks(batches):
            cluster, distance = nearest(entries, codes, final, width)
            yield to_batch({"vec_id": ids, "cluster": cluster.astype(np.int32), "distance": distance}, schema)

    assigned = materialize(chunks.mapInArrow(assign, out), "assigned")
    # At most k rows.
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    per_cluster = F.array(*[F.lit(inertia.get(c, 0)).cast("bigint") for c in range(len(final))])
    digests = F.array(*[F.lit(hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for row in final.tolist()])
    return assigned.select("*", per_cluster[F.col("cluster")].alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), digests[F.col("cluster")].alias("centroid_sha256"))
