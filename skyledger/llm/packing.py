"""Documents as token pieces packed into sequences of one size.

Each document is encoded once, in a task, and cut into pieces. Packing looks at lengths only: the
counts per length (one row for each of at most ``capacity`` lengths) are packed by bin completion
(:mod:`skyledger.llm.bins`), and each piece finds its sequence from its number among the pieces of its
length. Numbers come from a count inside the writing task plus the counts of the tasks before it, so no
length, however frequent, is sorted or collected.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyledger.llm.bins import NODES, WIDTH, Packing, complete_bins
from skyledger.llm.common import SLICE_ROWS, arrow_schema, text_bytes, to_batch
from skyledger.session import materialize

CAPACITY = 2048
END_ID = 0
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CACHED_WORDS = 400_000  # words and parts in one of a worker's two generations of remembered words
LONG_WORD = 64  # bytes; longer words are not remembered
ROWS_OUT = 4096  # pieces in an output batch

# Words of printable ASCII signs and western letters, which lower-casing changes sign by sign, and
# their parts, as the vocabulary's own pattern cuts them.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_MARKS = frozenset(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
# The vocabulary's sign for each byte: a byte that is no visible sign stands as a letter from U+0100 on.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)]
_SIGNS = {b: 256 + k for k, b in enumerate(_HIDDEN)}


class WordIds(dict):
    """Token ids of a word (UTF-8 bytes without ASCII white space) as little-endian 32-bit numbers.

    The vocabulary never joins signs across white space, so a text's ids are its words' ids in order.
    Plain words go part by part to the model, and a part is remembered like a word: it is its own only
    part, so many words share its ids. Other words, and those that may hold a special token, go
    through the whole tokenizer. When a generation of words is full, the words used since stay.
    """

    def __init__(self, path: str):
        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self._older.get(word)
        if ids is None:
            ids = self._ids(word)
        if len(word) <= LONG_WORD:
            if len(self) >= CACHED_WORDS:
                self._older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _ids(self, word: bytes) -> bytes:
        if len(word) <= LONG_WORD:
            # ASCII letters, alone or before one mark, need no pattern.
            low = word.lower()
            if low.isalpha():
                return self._part(low.decode()) if low == word else self[low]
            if word[-1] in _MARKS and low[:-1].isalpha():
                return self[low[:-1]] + self[word[-1:]]
        text = word.decode("utf-8")
        if len(word) > LONG_WORD or "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = _PARTS.findall(text.lower())
        return self._part(text) if parts == [text] else b"".join([self[part.encode("utf-8")] for part in parts])

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode("utf-8").decode("latin-1").translate(_SIGNS)
        ids = [t.id for t in self._model.tokenize(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def of(self, text: bytes) -> bytes:
        """The ids of a whole text."""
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=1)
def known_words(path: str) -> WordIds:
    """The words that this worker knows, kept from task to task."""
    return WordIds(path)


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER, keep_ids: bool = False) -> DataFrame:
    """The pieces of each document of ``docs`` (doc_id, text), written to the shared folder.

    A document is its text's ids and ``end_id``. Columns: doc_id, piece, start, length, ids_crc32, with
    ``keep_ids`` also ids; and part and nth: the piece is the nth of its length that this task wrote.
    """
    ddl = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint" + (", ids array<int>" if keep_ids else "")
    spark = docs.sparkSession
    schema = arrow_schema(spark, ddl)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, part = known_words(tokenizer), TaskContext.get().partitionId()
        written = np.zeros(capacity + 1, np.int64)
        rows: dict[str, list] = {f.name: [] for f in schema}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part_rows = batch.slice(at, SLICE_ROWS)
                for doc_id, text in zip(part_rows.column("doc_id").to_pylist(), part_rows.column("text"), strict=True):
                    ids = words.of(text.as_py()) + end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        length = len(own) // 4
                        values = (doc_id, piece, start // 4, length, zlib.crc32(own), part, int(written[length]))
                        for column, value in zip(rows.values(), values, strict=False):
                            column.append(value)
                        if keep_ids:
                            rows["ids"].append(np.frombuffer(own, "<i4"))
                        written[length] += 1
                        if len(rows["piece"]) >= ROWS_OUT:
                            yield to_batch(rows, schema)
                            rows = {name: [] for name in rows}
        if rows["piece"]:
            yield to_batch(rows, schema)

    return materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, ddl), "pieces")


def _places(packing: Packing) -> tuple[np.ndarray, ...]:
    """For each stretch of pieces of one length: its first number, the pieces in a bin, the first sequence, the offset there.

    Sorted by (length, first number). A packing has a few entries per length, so these arrays are bounded by the capacity.
    """
    taken: dict[int, int] = {}
    rows, base = [], 0
    for runs, times in packing.bins:
        offset = 0
        for length, each in runs:
            first = taken.get(length, 0)
            rows.append((length, first, each, base, offset))
            taken[length] = first + each * times
            offset += length * each
        base += times
    rows.sort()
    return tuple(np.array(rows, np.int64).reshape(-1, 5).T)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER, keep_ids: bool = False, width: int = WIDTH, nodes: int = NODES) -> DataFrame:
    """Pack the pieces of ``docs`` (doc_id, text) into few sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset, with
    ``keep_ids`` also ids. Only documents longer than a sequence are cut. A null or empty text, or one of
    white space, is one piece that holds ``end_id`` alone. Every row is a document of its own, whether its doc_id is null,
    repeated or neither. Other columns of ``docs`` are not read; no rows, no rows. ``width`` and
    ``nodes`` limit the search for a better packing; every piece is packed whatever they are.
    """
    pieces = cut_pieces(docs, capacity, end_id, tokenizer, keep_ids)
    by_part = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row per length
        counts[row["length"]] = row["n"]
    length, first, each, base, offset = _places(complete_bins(counts, capacity, width, nodes))
    # One row per writing task in each window.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "piece-offsets")
    numbered = pieces.join(offsets, ["part", "length"]).withColumn("number", F.col("before") + F.col("nth")).drop("before", "nth", "part")
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    numbered = numbered.select(*kept, "number")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name != "number") + ", sequence_id bigint, offset bigint"
    schema = arrow_schema(docs.sparkSession, ddl)
    key = (length << 48) + first if len(length) else length

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            at = np.searchsorted(key, (size << 48) + number, "right") - 1
            bin_, inside = np.divmod(number - first[at], each[at])
            columns = {c: batch.column(c) for c in kept}
            yield to_batch(columns | {"sequence_id": base[at] + bin_, "offset": offset[at] + inside * size}, schema)

    return numbered.mapInArrow(place, ddl)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences of a result with ids; one has at most ``capacity`` tokens."""
    pieces = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    return pieces.select("sequence_id", F.flatten(F.col("pieces.ids")).alias("ids"))
