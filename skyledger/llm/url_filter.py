"""URL rules in a sorted array of 64-bit digests, memory-mapped by every task.

A rule is a host and the beginning of a path. Its digest is probed by binary search
for all host suffixes and all path lengths that occur in the rules, a whole batch at
a time; a hit counts only if the stored string is equal. The file lies in the shared
folder and Spark copies it to each executor once.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import map_rows
from skyledger.session import scratch_path

ALLOW, BLOCK = "allow", "block"
# Verdict where no rule fits.
DEFAULT_VERDICT = ALLOW

_CAPITALS = {a: a + 32 for a in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty for null or without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    host, rest = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    stops = [i for i in map(rest.find, "?#") if i >= 0]
    return host.translate(_CAPITALS), rest[: min(stops)] if stops else rest


def _key(host: str, path: str) -> bytes:
    # A host holds no "/", so the first one ends it; a rule without a path ends in \0.
    return (host + "\0" + path).encode("utf-8", "surrogatepass")


def build_digests(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The array file of (verdict, host, path) rules: digests in order, then strings.

    Of rules with the same host and path the last one holds.
    """
    kept = {_key(host.translate(_CAPITALS), path): (verdict == BLOCK, len(path)) for verdict, host, path in rules}
    rows = sorted((xxhash.xxh3_64_intdigest(k), k, *v) for k, v in kept.items())
    digests = np.array([r[0] for r in rows], "<u8")
    blocks = np.array([r[2] for r in rows], np.uint8)
    ends = np.cumsum([0, *(len(r[1]) for r in rows)]).astype("<u8")
    lengths = np.array(sorted({r[3] for r in rows}), "<u4")
    hosts = np.array(sorted({len(r[1].decode("utf-8", "surrogatepass").partition("\0")[0]) for r in rows}), "<u4")
    return b"".join([struct.pack("<QQQ", len(rows), len(lengths), len(hosts)), digests.tobytes(), ends.tobytes(), lengths.tobytes(), hosts.tobytes(), blocks.tobytes(), *(r[1] for r in rows)])


class DigestArray:
    """A mapped array file."""

    def __init__(self, data: bytes | mmap.mmap):
        n, m, h = struct.unpack_from("<QQQ", data)
        at = 24
        self.digests = np.frombuffer(data, "<u8", n, at)
        at += 8 * n
        self.ends = np.frombuffer(data, "<u8", n + 1, at)
        at += 8 * (n + 1)
        self.lengths = np.frombuffer(data, "<u4", m, at).tolist()
        at += 4 * m
        self.hosts = np.frombuffer(data, "<u4", h, at).tolist()
        at += 4 * h
        self.blocks = np.frombuffer(data, np.uint8, n, at)
        self.strings, self.data = at + n, data

    @classmethod
    def mapped(cls, path: str) -> DigestArray:
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def string(self, row: int) -> bytes:
        return bytes(self.data[self.strings + int(self.ends[row]) : self.strings + int(self.ends[row + 1])])

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Row of each key, or -1; equal digests are told apart by the stored string."""
        if not len(self.digests):
            return np.full(len(keys), -1)
        probes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, probes)
        out = np.full(len(keys), -1)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == probes).tolist():
            row = int(at[i])
            while row < len(self.digests) and self.digests[row] == probes[i]:
                if self.string(row) == keys[i]:
                    out[i] = row
                    break
                row += 1
        return out


def probe_keys(host: str, path: str, lengths: list[int], hosts: list[int]) -> list[bytes]:
    """Keys of all rules that could fit, longest first: host suffixes by path lengths.

    Only suffixes and beginnings of lengths that occur in the rules are made, so the keys of one url are
    bounded by the rules, however long its host and path.
    """
    n = len(host)
    fitting = [size for size in hosts if size == n or size < n and host[n - size - 1] == "."]
    pairs = [(size, length) for size in fitting for length in lengths if length <= len(path)]
    return [_key(host[n - size :], path[:length]) for size, length in sorted(pairs, key=lambda p: (-p[0] - p[1], -p[0]))]


def ship_rules(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Write the array file to the shared folder and have Spark copy it to the executors; its name."""
    path = scratch_path(spark, "url-rules")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(build_digests(rules)))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = DEFAULT_VERDICT) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict.

    ``rules`` are (verdict, host, path). A rule fits its host and all subdomains if the
    path starts with the rule's; the longest fitting one gives the verdict, the longer host in a tie, and is shown as
    host + path. Without one ``rule`` is null and the verdict is ``default``. A null
    url or one without ``://`` has an empty host and path. Repeated rows give equal
    results; only page_id and url are read. The time for a url grows with its length, however many labels
    its host has; no rows, no rows.
    """
    name = ship_rules(pages.sparkSession, rules)
    state: dict = {}

    def work(batch: pa.RecordBatch) -> dict:
        if not state:
            state["array"] = DigestArray.mapped(SparkFiles.get(name))
        array: DigestArray = state["array"]
        parts = [split_url(u) for u in batch.column("url").to_pylist()]
        keys, owners = [], []
        for i, (host, path) in enumerate(parts):
            own = probe_keys(host, path, array.lengths, array.hosts) if host else []
            keys += own
            owners += [i] * len(own)
        found: list[str | None] = [None] * len(parts)
        verdict = [default] * len(parts)
        rows = array.find(keys)
        for k in np.flatnonzero(rows >= 0).tolist():
            if found[owners[k]] is None:
                host, _, path = keys[k].decode("utf-8", "surrogatepass").partition("\0")
                found[owners[k]] = host + path
                verdict[owners[k]] = BLOCK if array.blocks[rows[k]] else ALLOW
        return {"page_id": batch.column("page_id"), "host": [p[0] for p in parts], "path": [p[1] for p in parts], "rule": found, "verdict": verdict}

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return map_rows(rows, work, f"page_id {kind}, host string, path string, rule string, verdict string")
