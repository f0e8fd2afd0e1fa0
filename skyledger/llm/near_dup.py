"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Two fixed permutations make all coordinates of a signature: the first scatters the
shingles, the second is read at K circular shifts, so one shingle's K values are K
neighbours in memory. Equal shingle sets are one class from the start. In a few rounds
each band bucket proposes its members to one of them. The members of buckets that still hold several
components then meet over their rarest shingles, which every similar pair shares some
of, so no bucket is expanded into its pairs. Every link is decided on the full sets.

With 32 bands of 4 rows a pair at similarity 0.75 shares a bucket with probability
1 - 5e-6, at 0.8 with 1 - 5e-8. The 128 coordinates also drop proposals whose
estimate is below 0.5, more than six standard errors under the threshold. A bit per
shingle, summed modulo 2, bounds the intersection from above and drops others without
loss: two such maps differ in no more bits than the sets differ in shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import WordHashes, gram_hashes, map_rows, mix, signed, text_bytes
from skyledger.llm.components import components, merged
from skyledger.llm.decontam import bit_map
from skyledger.session import materialize

SHINGLE = 5  # words
SIMILARITY = 75  # per cent of the union
BANDS, ROWS = 32, 4
UNIVERSE = 1 << 20  # values the shingles are scattered over
SEED = 20
LEAST_ESTIMATE = 0.5
ROUNDS = 3  # rounds of proposals to one member per bucket
# Bits of the map of documents whose sets are needed: 2 MB, whatever the corpus holds.
MAP_BITS = 1 << 24
PARITY_BITS = 512
# A shingle's level is 0 below 8 documents, then 1, and one more at each doubling.
FREQUENT = 8
LEVEL_BITS = 4


def shingle_set(text: bytes, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; one hash for one to four words."""
    words = text.lower().split()  # bytes: A-Z, and white space in ASCII only
    if not words:
        return np.empty(0, np.uint64)
    hashes = cache.of(words)
    if len(words) < SHINGLE:
        with np.errstate(over="ignore"):
            return mix(gram_hashes(hashes, len(words)) + np.uint64(len(words)))
    return np.unique(gram_hashes(hashes, SHINGLE))


class Circulant:
    """Signatures from two permutations of a fixed universe."""

    def __init__(self, length: int = BANDS * ROWS, universe: int = UNIVERSE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.length, self.mask = length, np.uint64(universe - 1)
        self.scatter = rng.permutation(universe).astype(np.uint32)
        second = rng.permutation(universe).astype(np.uint32)
        self.shifted = np.concatenate([second, second[:length]])

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Smallest value of each circular shift over the set; the set isn't empty."""
        rows = np.lib.stride_tricks.sliding_window_view(self.shifted, self.length)
        at = self.scatter[(mix(shingles) & self.mask).astype(np.int64)]
        least = np.full(self.length, np.iinfo(np.uint32).max, np.uint32)
        for k in range(0, len(at), 1024):
            np.minimum(least, rows[at[k : k + 1024]].min(axis=0), out=least)
        return least


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """One bucket number per band; bands do not share buckets."""
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return out


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bit map (bytes) of the places that an odd number of the shingles fall on."""
    places = (shingles >> np.uint64(40)).astype(np.int64) % PARITY_BITS
    return np.packbits((np.bincount(places, minlength=PARITY_BITS) & 1).astype(bool))


def may_be_similar(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes, with these rows of parity maps, can be similar enough."""
    apart = np.bitwise_count(a ^ b).sum(axis=1).astype(np.int64)
    total = n_a + n_b
    return (100 + SIMILARITY) * ((total - apart) // 2) >= SIMILARITY * total


def _similar(both: str, a: str, b: str) -> F.Column:
    return F.expr(f"100 * {both} >= {SIMILARITY} * ({a} + {b} - {both})")


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


def near_duplicates(docs: DataFrame, doc_sets: int = MAP_BITS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are cut at ASCII white space, A-Z in lower case. A text with fewer than
    five words is one shingle; one without words (null, empty, blank) has an empty
    set and is linked with nothing. ``component_id`` is the smallest doc_id reachable
    over links with a Jaccard similarity of at least 0.75, ``kept`` tells whether that
    is the row itself. Equal texts are linked. Repeated rows with one doc_id are one
    document. A row with a null doc_id is linked like others, but never names a component:
    its ``component_id`` is the smallest doc_id reachable, and it is kept only where no
    named document is, with a null ``component_id``. Other columns are not read; no rows,
    no rows.
    """
    spark = docs.sparkSession
    circulant = spark.sparkContext.broadcast(Circulant())
    cache = WordHashes()
    doc = F.col("doc_id").cast("bigint")
    # Finds a class's text again: by its id, without one by the text itself.
    key = F.when(doc.isNotNull(), F.xxhash64(doc)).otherwise(F.xxhash64(F.lit(SEED), text_bytes()))
    rows = docs.select(doc.alias("doc"), key.alias("key"), text_bytes().alias("text"))

    def sign(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc": batch.column("doc"), "key": batch.column("key"), "n": [], "digest": [], "bands": [], "small": []}
        for text in batch.column("text").to_pylist():
            found = shingle_set(text, cache)
            out["n"].append(len(found))
            out["digest"].append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            signature = circulant.value.signature(found) if len(found) else None
            out["bands"].append(None if signature is None else signed(band_hashes(signature)).tolist())
            out["small"].append(None if signature is None else signature.astype(np.uint8).tobytes() + parity(found).tobytes())
        return out

    signed_docs = materialize(map_rows(rows, sign, "doc bigint, key bigint, n bigint, digest binary, bands array<bigint>, small binary"), "signatures")
    # One class per shingle set, with a number of its own; ``first`` is its smallest document, null without any.
    order = F.struct(F.col("doc").isNull(), "doc", "key")
    classes = materialize(
        signed_docs.where("digest is not null")
        .groupBy("digest")
        .agg(F.min(F.struct(order.alias("order"), "key", "n", "bands", "small")).alias("m"), F.min("doc").alias("first"))
        .select("digest", F.monotonically_increasing_id().alias("rep"), "first", *[F.col(f"m.{c}").alias(c) for c in ("key", "n", "bands", "small")]),
        "classes",
    )
    buckets = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select(F.col("bucket").alias("shared"))
    members = materialize(buckets.join(shared, F.col("bucket") == F.col("shared")).select("bucket", "rep"), "buckets")

    open_members = members.withColumn("part", F.col("rep"))
    parts = None
    for number in range(ROUNDS):
        # Every bucket proposes its members to one of them, another one in each bucket and round.
        lead = F.min_by(F.struct("rep", "part"), F.xxhash64(F.lit(number), "bucket", "rep")).alias("lead")
        leaders = open_members.groupBy("bucket").agg(lead).select(F.col("bucket").alias("led"), F.col("lead.rep").alias("leader"), F.col("lead.part").alias("led_part"))
        # Stored, so that both sides of the join are plain shuffles and a full bucket can be split.
        leaders = materialize(leaders, "leaders")
        pairs = open_members.join(leaders, F.col("bucket") == F.col("led")).where("part <> led_part")
        found = materialize(_links(pairs.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")), classes, rows, doc_sets), "links")
        parts = components(found) if parts is None else merged(parts, found)
        parted = members.join(parts, F.col("rep") == F.col("node"), "left").select("bucket", "rep", F.coalesce("component", "rep").alias("part"))
        mixed = parted.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select(F.col("bucket").alias("mixed"))
        open_members = materialize(parted.join(mixed, F.col("bucket") == F.col("mixed")).select("bucket", "rep", "part"), "open-buckets")
    met = materialize(open_members.select("rep", "part").distinct(), "unsettled")
    final = merged(parts, _rest_links(met, classes, rows, doc_sets))

    placed = materialize(
        classes.select("digest", "rep", "first").join(final, F.col("rep") == F.col("node"), "left")
        .select("digest", F.coalesce("component", "rep").alias("whole"), "first"), "placed",
    )
    names = placed.groupBy("whole").agg(F.min("first").alias("name")).select(F.col("whole").alias("of"), "name")
    named = placed.join(names, F.col("whole") == F.col("of")).select(F.col("digest").alias("c_digest"), "name")
    out = signed_docs.select("doc", "n", "digest").join(named, F.col("digest") == F.col("c_digest"), "left")
    component = F.coalesce("name", "doc")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc")).alias("kept"))


def _links(pairs: DataFrame, classes: DataFrame, rows: DataFrame, map_bits: int) -> DataFrame:
    """The proposed pairs (a, b) of classes whose full sets are similar enough."""
    kept = _proposals(pairs, classes)
    wanted = kept.select(F.col("a").alias("id")).union(kept.select(F.col("b").alias("id"))).distinct()
    return _verified(kept, _sets(wanted, classes, rows, map_bits))


def _rest_links(met: DataFrame, classes: DataFrame, rows: DataFrame, map_bits: int) -> DataFrame:
    """Links between different parts of ``met`` (rep, part), by prefix filtering.

    Similar sets share one of their 25 % rarest shingles under any one order of the
    shingles. The order puts frequent ones last, so passages that many documents share
    propose nothing. Where a rare shingle meets several parts, the members outside the
    largest part are proposed to the members of the other parts, if what follows their
    first common shingle in either set can still make them similar. A later common
    shingle of the pair may fail that test; the first one of similar sets never does.
    """
    sets = _sets(met.select(F.col("rep").alias("id")), classes, rows, map_bits)
    counts = materialize(sets.select(F.explode("shingles").alias("hash")).groupBy("hash").count().where(F.col("count") >= FREQUENT), "frequent-shingles")
    # The level's binary digits, a map each. Any function of the shingle is a right order,
    # so shingles that meet in the maps cost time only.
    level = F.least(F.floor(F.log2(F.col("count") / FREQUENT)) + 1, F.lit(2**LEVEL_BITS - 1)).cast("int")
    levels = rows.sparkSession.sparkContext.broadcast([bit_map(counts.where(F.getbit(level, F.lit(k)) == 1), map_bits) for k in range(LEVEL_BITS)])

    def prefix(batch: pa.RecordBatch) -> dict:
        ids, parts, at, sizes = [], [], [], []
        for doc, shingles in zip(batch.column("id").to_pylist(), batch.column("shingles"), strict=True):
            values = shingles.values.to_numpy(zero_copy_only=False)
            place = values % np.int64(len(levels.value[0]) * 64)
            level = sum(((bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)) << np.uint64(k) for k, bits in enumerate(levels.value))
            first = np.lexsort((values, level))[: len(values) - -(-SIMILARITY * len(values) // 100) + 1]
            parts.append(values[first])
            ids += [doc] * len(first)
            at += range(len(first))
            sizes += [len(values)] * len(first)
        return {"id": ids, "shingle": np.concatenate(parts) if parts else [], "at": at, "n": sizes}

    rare = map_rows(sets, prefix, "id bigint, shingle bigint, at bigint, n bigint").join(met, F.col("id") == F.col("rep")).select("shingle", "id", "at", "n", "part")
    rare = materialize(rare, "rare-shingles")
    mixed = (
        rare.groupBy("shingle", "part").agg(F.count("*").alias("size"))
        .groupBy("shingle").agg(F.max_by("part", F.struct("size", "part")).alias("major"), F.count("*").alias("parts"))
        .where("parts > 1").select(F.col("shingle").alias("mixed"), "major")
    )
    minor = rare.join(mixed, F.col("shingle") == F.col("mixed")).where("part <> major").select("mixed", F.col("id").alias("b"), F.col("part").alias("b_part"), F.col("at").alias("b_at"), F.col("n").alias("b_n"), "major")
    able = F.expr(f"100 * least(n, b_n) >= {SIMILARITY} * greatest(n, b_n) and {100 + SIMILARITY} * least(n - at, b_n - b_at) >= {SIMILARITY} * (n + b_n)")
    rest = minor.join(rare, F.col("mixed") == F.col("shingle")).where("part <> b_part and (part = major or id < b)").where(able)
    pairs = rest.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))
    return _verified(_proposals(pairs, classes), sets)


def _proposals(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct pairs whose sizes, signatures and parity maps allow the similarity."""
    size_a = classes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("small").alias("small_a"))
    size_b = classes.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("small").alias("small_b"))
    sized = (
        pairs.distinct().join(size_a, "a").join(size_b, "b")
        .where(f"100 * least(n_a, n_b) >= {SIMILARITY} * greatest(n_a, n_b)")
    )

    def likely(batch: pa.RecordBatch) -> dict:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS + PARITY_BITS // 8) for c in ("small_a", "small_b"))
        n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
        estimate = ((a == b)[:, : BANDS * ROWS].mean(axis=1) - 1 / 256) / (1 - 1 / 256)
        able = may_be_similar(a[:, BANDS * ROWS :], b[:, BANDS * ROWS :], n_a, n_b)
        at = pa.array(np.flatnonzero((estimate >= LEAST_ESTIMATE) & able))
        return {c: batch.column(c).take(at) for c in ("a", "n_a", "b", "n_b")}

    return materialize(map_rows(sized, likely, "a bigint, n_a bigint, b bigint, n_b bigint"), "proposals")


def _sets(wanted: DataFrame, classes: DataFrame, rows: DataFrame, map_bits: int) -> DataFrame:
    """(id, shingles) of the classes in ``wanted`` (id), from the whole texts."""
    asked = materialize(classes.select("rep", "key", "digest").join(wanted, F.col("rep") == F.col("id"), "left_semi"), "asked")
    bits = rows.sparkSession.sparkContext.broadcast(bit_map(asked.select(F.col("key").alias("hash")), map_bits))
    cache = WordHashes()
    # Copies share a key: a task reads each key without an id once and sends each set once.
    sent: set[int | bytes] = set()

    def work(batch: pa.RecordBatch) -> dict | None:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        place = keys % np.int64(len(bits.value) * 64)
        at = np.flatnonzero((bits.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1))
        ids, texts, unnamed = batch.column("key").to_pylist(), batch.column("text"), batch.column("doc").is_null().to_pylist()
        found, digests = [], []
        for i in at.tolist():
            if unnamed[i]:
                if ids[i] in sent:
                    continue
                sent.add(ids[i])
            shingles = shingle_set(texts[i].as_py(), cache)
            digest = xxhash.xxh3_128_digest(shingles.tobytes())
            if digest not in sent:
                sent.add(digest)
                found.append(shingles)
                digests.append(digest)
        if not found:
            return None
        return {"set_digest": digests, "shingles": _list_array([signed(x) for x in found])}

    # Only the sets of the classes asked for, each once.
    made = map_rows(rows, work, "set_digest binary, shingles array<bigint>")
    made = made.join(asked.select(F.col("rep").alias("id"), "digest"), F.col("set_digest") == F.col("digest")).dropDuplicates(["id"])
    return materialize(made.select("id", "shingles"), "shingle-sets")


def _verified(kept: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    set_a = sets.select(F.col("id").alias("lo"), F.col("shingles").alias("set_lo"))
    set_b = sets.select(F.col("id").alias("hi"), F.col("shingles").alias("set_hi"))
    # The smaller set travels to the larger one.
    ordered = kept.select("a", "b", "n_a", "n_b", F.when(F.expr("n_a <= n_b"), F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(F.expr("n_a <= n_b"), F.col("b")).otherwise(F.col("a")).alias("hi"))
    both = F.size(F.array_intersect("set_lo", "set_hi"))
    return ordered.join(set_a, "lo").join(set_b, "hi").select("a", "b", "n_a", "n_b", both.alias("both")).where(_similar("both", "n_a", "n_b")).select("a", "b")
