"""Benchmark passages inside documents, found by winnowing.

Of every window of six consecutive 5-word grams the smallest hash is a
fingerprint, on both sides. Ten equal words are one such window, so they choose the
same fingerprint at the same place: no shared span of ten words can be missed. The
documents' fingerprints pass a bit map of the benchmark's fingerprints. One that is
shared is extended to the ten-word windows that chose it; these pass a second map, and
the join takes the fingerprint with the words on both sides of it as its key. A phrase
of five to nine words that stands in many documents and many items thus joins nothing.
The benchmark's side has one row per distinct window; its items are looked up afterwards.
The size of both maps is fixed whatever the benchmark holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import WordHashes, gram_hashes, map_rows, mix, signed, text_bytes
from skyledger.session import materialize

WINDOW = 10  # words that make a shared span
GRAM = 5  # words in a fingerprint

# Bits of each of the two maps of the benchmark: 2 MB, so the broadcast never exceeds 4 MB.
MAP_BITS = 1 << 24

# Bytes that belong to words, after lower-casing: digits, a-z and all of 0x80 and above.
_KEEP = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: A-Z in lower case, cut at every other ASCII sign."""
    return text.lower().translate(_KEEP).split()


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """Per ten-word window of a text the hash of its fingerprint, the smallest of its grams."""
    grams = gram_hashes(hashes, GRAM)
    width = WINDOW - GRAM + 1
    n = len(grams) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    least = grams[:n].copy()
    for k in range(1, width):
        np.minimum(least, grams[k : k + n], out=least)
    return least


def short_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, kept apart from the other sizes."""
    with np.errstate(over="ignore"):
        return mix(gram_hashes(hashes, size) + np.uint64(size))


def _test_rows(batch: pa.RecordBatch) -> dict:
    """Windows of the items with their fingerprint (for an item of fewer words, the hash of all)."""
    cache = WordHashes()
    out = {"size": [], "hash": [], "whole": [], "words": [], "digest": []}
    for text in batch.column("text").to_pylist():
        words = words_of(text)
        if not words:
            continue
        hashes = cache.of(words)
        size = min(len(words), WINDOW)
        whole = signed(short_hash(hashes, size))
        chosen = signed(fingerprints(hashes)) if size == WINDOW else whole
        out["size"] += [size] * len(whole)
        out["hash"] += chosen.tolist()
        out["whole"] += whole.tolist()
        out["words"] += [b" ".join(words[p : p + size]) for p in range(len(whole))]
        out["digest"] += [xxhash.xxh3_128_digest(b" ".join(words))] * len(whole)
    return out


def bit_map(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bit array with a set bit for every hash: at most ``bits`` / 64 rows reach the driver."""
    rows = (
        hashes.select(F.pmod(F.col("hash"), F.lit(bits)).alias("place"))
        .selectExpr("shiftright(place, 6) AS word", "shiftleft(1L, cast(place % 64 AS int)) AS bit")
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))
    )
    words = np.zeros(bits // 64, np.int64)
    got = rows.toPandas()
    words[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return words.view(np.uint64)


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes.view(np.int64) % np.int64(len(bits) * 64)  # as pmod
    return (bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) != 0


def _found(words: list[bytes], at: np.ndarray, size: int, values: np.ndarray) -> list[dict]:
    """The runs of ``size`` words at the places ``at``, with their hashes."""
    return [
        {"at": p, "size": size, "hash": h, "words": b" ".join(words[p : p + size])}
        for p, h in zip(at.tolist(), signed(values[at]).tolist(), strict=True)
    ]


def decontaminate(docs: DataFrame, benchmark: DataFrame, map_bits: int = MAP_BITS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, item_ids, contaminated.

    Words are runs of digits, letters a-z (A-Z lower-cased) and signs above 0x7F. A
    window is ten consecutive words of an item; an item with one to nine words is one
    window, and one without words matches nothing. ``n_hit`` counts the document's
    words inside any occurrence of a window, ``item_ids`` are the items with an
    occurring window as sorted strings, ``n_items`` their number. Null and empty texts
    have no words and no hits. Rows with equal doc_id and text, null doc_id included,
    get equal results; items with equal words are looked up once. A null item_id does
    not count as an item, but its words hit. Only doc_id, item_id and the texts are
    read, so other columns may have any name.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), text_bytes().alias("text"))
    tests = materialize(
        map_rows(items.select("text").distinct(), _test_rows, "size int, hash bigint, whole bigint, words binary, digest binary").distinct(),
        "benchmark-windows",
    )
    sizes = sorted(r.size for r in tests.select("size").distinct().collect())  # at most WINDOW values
    short = [s for s in sizes if s < WINDOW]
    held = spark.sparkContext.broadcast((bit_map(tests, map_bits), bit_map(tests.select(F.col("whole").alias("hash")), map_bits)))

    def scan(batch: pa.RecordBatch) -> dict:
        cache, (prints, wholes) = scan_cache, held.value
        out: dict[str, list] = {"doc": batch.column("doc").to_pylist(), "print": [], "n_words": [], "found": []}
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            found = []
            if words:
                hashes = cache.of(words)
                if WINDOW in sizes:
                    chosen = fingerprints(hashes)
                    at = np.flatnonzero(_passes(prints, chosen))
                    if len(at):
                        at = at[_passes(wholes, short_hash(hashes, WINDOW)[at])]
                        found += _found(words, at, WINDOW, chosen)
                for size in short:
                    values = short_hash(hashes, size)
                    found += _found(words, np.flatnonzero(_passes(wholes, values)), size, values)
            out["print"].append(xxhash.xxh3_128_digest(text))
            out["n_words"].append(len(words))
            out["found"].append(found)
        return out

    scan_cache = WordHashes()
    rows = docs.select(F.col("doc_id").alias("doc"), text_bytes().alias("text"))
    id_type = rows.schema["doc"].dataType.simpleString()
    scanned = materialize(
        map_rows(rows, scan, f"doc {id_type}, print binary, n_words bigint, found array<struct<at:int,size:int,hash:bigint,words:binary>>"),
        "document-prints",
    )

    # One row per distinct window, with a digest of the set of items that hold it: windows of one
    # passage share the set, so its items are listed once per document and not once per window.
    windows = materialize(
        tests.groupBy("size", "hash", "words").agg(
            F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y")).alias("items")
        ),
        "benchmark-sets",
    )
    holders = (
        windows.groupBy("items").agg(F.min(F.struct("size", "hash", "words")).alias("w")).select("items", "w.*")
        .join(tests.select("size", "hash", "words", "digest"), ["size", "hash", "words"])
        .select(F.col("items").alias("set"), "digest")
    )
    hits = scanned.where(F.size("found") > 0).select("doc", "print", F.explode("found").alias("f")).select("doc", "print", "f.*")
    spans = materialize(
        hits.join(windows, ["size", "hash", "words"]).select("doc", "print", F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end"), "items"),
        "benchmark-hits",
    )
    # Words covered by the union of the spans of a document, in order of their start.
    covered = (
        spans.groupBy("doc", "print", "start")
        .agg(F.max("end").alias("end"))
        .groupBy("doc", "print")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
        .select(
            "doc",
            "print",
            F.aggregate(
                "spans",
                F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto")),
                lambda a, s: F.struct(
                    (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"),
                    F.greatest(a["upto"], s["end"]).alias("upto"),
                ),
            )["n"].alias("n_hit"),
        )
    )
    digests = map_rows(items, _item_digests, "item string, item_digest binary")
    named = (
        spans.select("doc", "print", "items").distinct()
        .join(holders, F.col("items") == F.col("set"))
        .select("doc", "print", "digest").distinct()
        .join(digests, F.col("digest") == F.col("item_digest"))
        .groupBy("doc", "print")
        .agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    )
    hit = covered.join(named.withColumnsRenamed({"doc": "n_doc", "print": "n_print"}), F.col("doc").eqNullSafe(F.col("n_doc")) & (F.col("print") == F.col("n_print")), "left")
    hit = hit.select(F.col("doc").alias("h_doc"), F.col("print").alias("h_print"), "n_hit", "item_ids")
    out = scanned.select("doc", "print", "n_words").join(hit, F.col("doc").eqNullSafe(F.col("h_doc")) & (F.col("print") == F.col("h_print")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select(F.col("doc").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def _item_digests(batch: pa.RecordBatch) -> dict:
    out: dict[str, list] = {"item": [], "item_digest": []}
    for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
        if item is not None and (words := words_of(text)):
            out["item"].append(item)
            out["item_digest"].append(xxhash.xxh3_128_digest(b" ".join(words)))
    return out
