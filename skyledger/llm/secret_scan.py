"""Secrets in texts: fixed patterns, and strings that a tokenizer can't compress.

Prose and identifiers cost few tokens for their length; random strings cost many.
A run of token signs with few characters per token is reported as ``random`` unless
it is a digest, a UUID, a number or an identifier whose words cost few tokens. Where a
fixed pattern covers part of a run, the rest of the run is tested by itself.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import map_rows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary's text is cut before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

KINDS = ("assign", "access", "hex", "random")
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Strings that the token test looks at, and the most characters per token of a random one.
LEAST_RUN = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
MOST_PER_TOKEN = 2.2

_DIGEST_SIZES = {32, 40, 48, 56, 64, 96, 128}
_HEXES = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_NUMBER = re.compile(r"[0-9+/_=-]+")
_IDENTIFIER = re.compile(r"[A-Za-z]+(?:[0-9]{0,4}[/_=+-]+[A-Za-z]+)*[0-9]{0,4}[/_=+-]*")


class Vocabulary:
    """A tiktoken vocabulary that travels as its file's bytes and is built once per worker."""

    def __init__(self, path: str = VOCABULARY, split: str = SPLIT):
        with open(path, "rb") as file:
            self.lines = file.read()
        self.split = split
        self.encoding: tiktoken.Encoding | None = None

    def __getstate__(self) -> dict:
        return {"lines": self.lines, "split": self.split, "encoding": None}

    def tokens(self, text: str) -> int:
        if self.encoding is None:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in self.lines.splitlines() if x)}
            self.encoding = tiktoken.Encoding("scan", pat_str=self.split, mergeable_ranks=ranks, special_tokens={})
        return len(self.encoding.encode_ordinary(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):  # every match holds one of them
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def known_string(run: str, vocabulary: Vocabulary, most: float = MOST_PER_TOKEN) -> bool:
    """True for digests, UUIDs, numbers and identifiers, which are no secrets by themselves.

    An identifier's parts look like words and have more than ``most`` letters per token together;
    the signs and digits between them don't count.
    """
    if _HEXES.fullmatch(run) and len(run) in _DIGEST_SIZES:
        return True
    if _UUID.fullmatch(run) or _NUMBER.fullmatch(run):
        return True
    if not _IDENTIFIER.fullmatch(run):
        return False
    parts = [p.rstrip("0123456789") for p in re.split(r"[/_=+-]+", run) if p]
    return all(map(_is_word, parts)) and sum(map(len, parts)) / sum(map(vocabulary.tokens, parts)) > most


def _is_word(part: str) -> bool:
    """Letters in one case, capitalised, or in camel case with humps of two letters and more."""
    return part.islower() or part.isupper() or bool(re.fullmatch(r"[a-z]*(?:[A-Z][a-z]{2,})*[A-Z]?[a-z]*", part))


def random_spans(text: str, taken: list[tuple[int, int, int]], vocabulary: Vocabulary, most: float = MOST_PER_TOKEN) -> list[tuple[int, int, int]]:
    """Spans that only the token test finds; none overlaps a span in ``taken``."""
    # Union of the taken spans as sorted, disjoint ranges.
    starts, ends = [], []
    for start, _, end in sorted(taken):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    out = []
    for m in CANDIDATE.finditer(text):
        # What the taken spans leave of the run.
        start, at = m.start(), bisect_right(ends, m.start())
        rests = []
        while at < len(starts) and starts[at] < m.end():
            rests.append((start, starts[at]))
            start, at = ends[at], at + 1
        rests.append((start, m.end()))
        for start, end in rests:
            run = text[start:end]
            if end - start < LEAST_RUN or len(run) / max(1, vocabulary.tokens(run)) > most:
                continue
            if not known_string(run, vocabulary, most):
                out.append((start, 3, end))
    return out


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_secrets(docs: DataFrame, vocabulary: str = VOCABULARY, most: float = MOST_PER_TOKEN) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_random, base_spans and spans.

    Spans are ``kind:start:end`` over the whole text in code points, end exclusive,
    by start and then kind (assign, access, hex, random), joined by commas. Matches of a
    kind are leftmost and do not overlap; kinds may, but random is only looked for outside
    the others. Null and empty texts have none.
    Repeated rows give equal results; only doc_id and text are read.
    """
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": batch.column("doc_id"), "n_assign": [], "n_access": [], "n_hex": [], "n_random": [], "base_spans": [], "spans": []}
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            more = random_spans(text, base, held.value, most)
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(s[1] == k for s in base))
            out["n_random"].append(len(more))
            out["base_spans"].append(spans_text(base))
            out["spans"].append(spans_text(base + more))
        return out

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_rows(rows, work, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_spans string, spans string")
