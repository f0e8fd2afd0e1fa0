"""Lines that several documents share: two Bloom filters, then exact confirmation.

A first pass over the texts sends only 64-bit line hashes, combined per task, to
hash segments. Each segment keeps a filter of hashes seen once and collects the
hashes seen again into a filter of hashes seen twice. The twice-filters are
broadcast below a fixed size; when they are larger they are folded, which lets
more lines through and loses none. A second pass sends the lines that the
filter suspects to be confirmed by their text, and the smallest document keeps them.
Texts without a line to drop are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from skyledger.llm.common import WHITE, arrow_schema, map_rows, mix, text_bytes, to_batch
from skyledger.session import materialize

# Shortest line key, in code points, that is looked at.
MIN_POINTS = 10
# Text bytes per hash segment: about a million lines, 8 MB of hashes in a task.
SEGMENT_BYTES = 64 << 20
MIN_SEGMENTS = 64
# Bits of a filter per hash, and probes.
BITS_PER_HASH = 16
PROBES = 4
# Largest total size of the broadcast filters.
FILTER_BYTES = 32 << 20
# Hashes that a task gathers before it sends them on.
TASK_HASHES = 400_000
# Most bits of the map of documents that hold a line to drop (32 MB), bits of one of its blocks, seed of its hash.
ID_BITS = 1 << 28
BLOCK_BITS = 1 << 15
ID_SEED = 2


def line_keys(text: bytes) -> list[bytes | None]:
    """The key of each line, or None where the line is too short to count."""
    keys: list[bytes | None] = []
    for line in text.lower().split(b"\n"):  # bytes.lower changes A-Z only
        key = line.strip(WHITE)
        if len(key) < MIN_POINTS or (len(key) < 4 * MIN_POINTS and len(key.decode("utf-8", "replace")) < MIN_POINTS):
            keys.append(None)
        else:
            keys.append(key)
    return keys


def _hashes(keys: Iterable[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)


def _positions(hashes: np.ndarray, mask: np.ndarray | int) -> np.ndarray:
    """PROBES bit positions per hash, as rows, below ``mask`` + 1."""
    step = mix(hashes) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(hashes + np.uint64(k) * step) & np.asarray(mask, np.uint64) for k in range(PROBES)]).astype(np.int64)


def _width(n: int) -> int:
    """Bits of a filter for ``n`` hashes: a power of two."""
    return 1 << max(10, int(n * BITS_PER_HASH - 1).bit_length())


def _partials(segments: int):
    shift = np.uint64(64 - (segments - 1).bit_length()) if segments > 1 else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
        once: set[int] = set()
        twice: set[int] = set()

        def flush() -> pa.RecordBatch:
            one = np.fromiter(once, np.uint64, len(once))
            two = np.fromiter(twice, np.uint64, len(twice))
            once.clear()
            twice.clear()
            parts: dict[int, list[bytes]] = {}
            for k, values in enumerate((one, two)):
                places = (values >> shift).astype(np.int64) if shift is not None else np.zeros(len(values), np.int64)
                order = np.argsort(places, kind="stable")
                found, starts = np.unique(places[order], return_index=True)
                for segment, part in zip(found.tolist(), np.split(values[order], starts[1:]) if len(found) else [], strict=True):
                    parts.setdefault(segment, [b"", b""])[k] = part.tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array(list(parts), pa.int32()), pa.array([p[0] for p in parts.values()], pa.binary()), pa.array([p[1] for p in parts.values()], pa.binary())],
                schema=schema,
            )

        for batch in batches:
            for text in batch.column("text"):
                mine = {xxhash.xxh3_64_intdigest(k) for k in set(line_keys(text.as_py())) if k is not None}
                again = mine & once
                twice |= again
                once -= again
                once |= mine - twice
                if len(once) + len(twice) >= TASK_HASHES:
                    yield flush()
        if once or twice:
            yield flush()

    return run


def segment_filter(once: list[bytes], twice: list[bytes]) -> tuple[int, bytes] | None:
    """Width and bits of the filter of hashes seen twice, from the tasks' hashes of a segment."""
    chunks = [np.frombuffer(a, np.uint64) for a in once]
    again = [np.frombuffer(a, np.uint64) for a in twice]
    total = sum(map(len, chunks)) + sum(map(len, again))
    seen = np.zeros(_width(total), bool)
    repeated = list(again)
    # A hash seen twice inside one task is already known; its first sight still counts for others.
    for chunk in again:
        if len(chunk):
            seen[_positions(chunk, len(seen) - 1)] = True
    for chunk in chunks:
        if len(chunk):
            places = _positions(chunk, len(seen) - 1)
            repeated.append(chunk[seen[places].all(axis=0)])
            seen[places] = True
    hashes = np.unique(np.concatenate(repeated)) if repeated else np.empty(0, np.uint64)
    if not len(hashes):
        return None
    bits = np.zeros(_width(len(hashes)), bool)
    bits[_positions(hashes, len(bits) - 1)] = True
    return len(bits), np.packbits(bits, bitorder="little").tobytes()


def _fold(bits: bytes, times: int) -> bytes:
    """Halve a filter ``times`` times; whatever it held it still holds."""
    array = np.frombuffer(bits, np.uint8)
    for _ in range(times):
        if len(array) <= 128:
            break
        half = len(array) // 2
        array = array[:half] | array[half:]
    return array.tobytes()


class TwiceFilter:
    """The twice-filters of all segments in one bit array."""

    def __init__(self, segments: int, rows: list[tuple[int, bytes]]):
        self.shift = 64 - (segments - 1).bit_length() if segments > 1 else 64
        self.mask = np.zeros(segments, np.uint64)
        self.offset = np.zeros(segments, np.int64)
        self.known = np.zeros(segments, bool)
        at, parts = 0, []
        for segment, bits in rows:
            self.known[segment], self.offset[segment], self.mask[segment] = True, at, len(bits) * 8 - 1
            parts.append(np.frombuffer(bits, np.uint8))
            at += len(bits) * 8
        self.bits = np.concatenate(parts) if parts else np.zeros(1, np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        segment = (hashes >> np.uint64(self.shift)).astype(np.int64) if self.shift < 64 else np.zeros(len(hashes), np.int64)
        places = _positions(hashes, self.mask[segment]) + self.offset[segment]
        bits = (self.bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1
        return bits.all(axis=0) & self.known[segment]


def twice_filter(docs: DataFrame, filter_bytes: int = FILTER_BYTES) -> TwiceFilter:
    """Filter of the line hashes that at least two documents hold, with rare extras."""
    spark = docs.sparkSession
    texts = docs.select(text_bytes().alias("text"))
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    segments = max(MIN_SEGMENTS, 1 << max(0, (size // SEGMENT_BYTES)).bit_length())
    schema = arrow_schema(spark, "segment int, bits binary")

    def merge(group: pa.Table) -> pa.Table:
        made = segment_filter(group.column("once").to_pylist(), group.column("twice").to_pylist())
        rows = {"segment": [], "bits": []} if made is None else {"segment": [group.column("segment")[0].as_py()], "bits": [made[1]]}
        return pa.Table.from_batches([to_batch(rows, schema)])

    partials = texts.mapInArrow(_partials(segments), "segment int, once binary, twice binary")
    planes = materialize(partials.groupBy("segment").applyInArrow(merge, "segment int, bits binary"), "line-filter")
    total = planes.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    times = 0
    while total >> times > filter_bytes:
        times += 1
    if times:
        planes = map_rows(planes, lambda b: {"segment": b.column("segment"), "bits": [_fold(x, times) for x in b.column("bits").to_pylist()]}, "segment int, bits binary")
    return TwiceFilter(segments, [(r.segment, bytes(r.bits)) for r in planes.collect()])


def shared_lines(docs: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Lines to drop: (doc_id, hashes of the keys that a smaller doc_id holds)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(twice_filter(docs, filter_bytes))

    def suspects(batch: pa.RecordBatch) -> dict | None:
        ids, keys = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            mine = [k for k in set(line_keys(text)) if k is not None]
            keys += mine
            ids += [doc] * len(mine)
        if not keys:
            return None
        hashes = _hashes(keys)
        hits = np.flatnonzero(held.value.holds(hashes))
        return {"doc": [ids[i] for i in hits], "hash": hashes[hits].view(np.int64), "line": [keys[i] for i in hits]}

    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
    found = materialize(map_rows(texts, suspects, "doc bigint, hash bigint, line binary"), "suspected-lines")
    confirmed = found.groupBy("line", "hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select(F.col("hash").alias("known"), "first", F.md5("line").alias("digest"))
    drops = found.select("doc", "hash", F.md5("line").alias("line_digest")).join(confirmed, (F.col("hash") == F.col("known")) & (F.col("line_digest") == F.col("digest")) & (F.col("doc") > F.col("first")))
    return drops.groupBy(F.col("doc").alias("drop_doc")).agg(F.collect_set("hash").alias("drop_hashes"))


def mark_ids(rows: DataFrame, key: str, ids: DataFrame, name: str, most_bits: int = ID_BITS) -> DataFrame:
    """``rows`` with the boolean ``name``: false only where ``key`` is surely not in ``ids`` (one column without nulls).

    A bit map over hashes of the ids, 16 bits an id and at most ``most_bits`` in all; beyond, more rows are
    marked than need be. It is broadcast, at most ``most_bits`` / 8 bytes. A null key is not marked.
    """
    bits = BLOCK_BITS
    while bits < min(most_bits, 16 * ids.count()):
        bits *= 2

    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(ID_SEED), column), F.lit(bits))

    at = place(F.col(ids.columns[0]))
    places = ids.select(F.floor(at / BLOCK_BITS).alias("block"), F.pmod(at, F.lit(BLOCK_BITS)).alias("bit"))
    blocks = materialize(places.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("map")), "id-bits")
    # At most bits / BLOCK_BITS rows of BLOCK_BITS / 8 bytes.
    near = rows.withColumn("place", place(F.col(key))).join(F.broadcast(blocks), F.floor(F.col("place") / BLOCK_BITS) == F.col("block"), "left")
    bit = F.pmod("place", F.lit(BLOCK_BITS))
    byte = F.conv(F.hex(F.substring("map", F.floor(bit / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    found = F.col(key).isNotNull() & F.col("map").isNotNull() & (F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1)
    return near.select(*rows.columns, F.coalesce(found, F.lit(False)).alias(name))


def line_dedup(docs: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Input columns plus ``kept_text``, ``n_lines`` and ``n_dropped``.

    A text is cut at line feeds; null and empty are one empty line. A line's key is
    the line without white space at its ends, in lower case (A-Z only). A key of at
    least ten code points that at least two doc_ids hold loses all its lines outside
    the smallest of them; repeats inside that document stay. Rows with a null doc_id
    count for no key and keep all lines. Rows with the same doc_id are one document.
    Extra columns pass through, but for those with the names of the results.
    """
    drops = materialize(shared_lines(docs, filter_bytes), "line-drops")
    extra = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    # The rows travel as one struct, so no column of theirs can clash with ours.
    rows = docs.select(F.struct(*extra).alias("row"), F.col("doc_id").cast("bigint").alias("doc"), F.col("text").cast("string").alias("text"))
    # Only rows of documents that may hold a drop meet the drops; the others stay in their tasks.
    marked = mark_ids(rows, "doc", drops.select("drop_doc"), "may_drop")
    meeting = marked.where("may_drop").join(drops, F.col("doc") == F.col("drop_doc"), "left")
    passing = marked.where(~F.col("may_drop")).withColumn("drop_hashes", F.lit(None).cast(drops.schema["drop_hashes"].dataType))
    columns = ["row", text_bytes().alias("text"), "drop_hashes"]
    joined = meeting.select(*columns).unionAll(passing.select(*columns))

    def rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, dropped = [], [], []
            for text, hashes in zip(batch.column("text"), batch.column("drop_hashes"), strict=True):
                text, gone = text.as_py(), hashes.as_py()
                if not gone:
                    kept.append(text)
                    total.append(text.count(b"\n") + 1)
                    dropped.append(0)
                    continue
                gone = set(gone)
                lines = text.split(b"\n")
                stay = [a for a, k in zip(lines, line_keys(text), strict=True) if k is None or _signed(xxhash.xxh3_64_intdigest(k)) not in gone]
                kept.append(b"\n".join(stay))
                total.append(len(lines))
                dropped.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.binary()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names=["row", "kept", "n_lines", "n_dropped"])

    schema = StructType([joined.schema["row"], StructField("kept", BinaryType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    out = joined.mapInArrow(rebuild, schema)
    return out.select("row.*", F.col("kept").cast("string").alias("kept_text"), "n_lines", "n_dropped")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value
