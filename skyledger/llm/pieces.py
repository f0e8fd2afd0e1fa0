"""SentencePiece encoding and decoding with a unigram model.

The pieces of a model file stand in a double-array trie over their bytes. The
segmentation with the highest sum of scores is found by Viterbi, for all new words of
a batch at a time. No piece holds a white-space marker after another sign, so the best
segmentation of a text is that of its words side by side, and each word is solved once.
Characters without a piece fall back to bytes.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from skyledger.llm.common import map_rows, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁".encode()  # stands for a space in pieces
UNKNOWN_PENALTY = 10.0  # below the lowest score
CACHE_PIECES = 300_000  # words whose pieces a worker remembers
LONG_WORD = 64  # bytes above which a word is solved alone and not remembered


class DoubleArray:
    """Trie in two arrays: from node ``s`` the byte ``c`` leads to ``base[s] + c`` if ``check`` there is ``s``."""

    def __init__(self, words: dict[bytes, int]):
        tree: dict = {}
        for word, value in words.items():
            node = tree
            for byte in word:
                node = node.setdefault(byte + 1, {})
            node[0] = value  # 0 is no byte code: codes are 1 to 256
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        # Nodes with one child fill the holes from the left; the others search on from
        # where the search last got long.
        queue, free, wide = [(tree, 0)], 258, 258
        for node, at in queue:
            value[at] = node.get(0, -1)
            codes = sorted(c for c in node if c)
            if not codes:
                continue
            while check[free] >= 0:
                free += 1
                if free + 600 >= len(check):
                    for cells, empty in ((base, 0), (check, -1), (value, -1)):
                        cells.extend([empty] * size)
            start = max(1, (free if len(codes) == 1 else max(free, wide)) - codes[0])
            tries = 0
            while True:
                if start + 600 >= len(check):
                    for cells, empty in ((base, 0), (check, -1), (value, -1)):
                        cells.extend([empty] * size)
                if all(check[start + c] < 0 for c in codes):
                    break
                start += 1
                tries += 1
            if tries > 50:
                wide = max(wide, start)
            base[at] = start
            for c in codes:
                check[start + c] = at
                queue.append((node[c], start + c))
        self.base, self.check, self.value = np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)
        self.depth = max(map(len, words), default=0)


class UnigramModel:
    """Pieces, scores and flags of a SentencePiece model file, as a unigram model."""

    def __init__(self, data: bytes):
        proto = model_pb2.ModelProto()
        proto.ParseFromString(data)
        normal = proto.normalizer_spec
        if normal.precompiled_charsmap or not normal.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models without character maps, with escaped leading white space, are supported")
        kinds = model_pb2.ModelProto.SentencePiece
        self.prefix, self.squeeze = normal.add_dummy_prefix, normal.remove_extra_whitespaces
        self.size, self.unknown = len(proto.pieces), 0
        self.bytes_of: list[bytes] = []  # what each id stands for in a text
        self.byte_ids = np.full(256, -1, np.int32)
        self.scores = np.zeros(len(proto.pieces))
        words: dict[bytes, int] = {}
        normal_scores = []
        for i, piece in enumerate(proto.pieces):
            surface = piece.piece.encode().replace(MARKER, b" ")
            if piece.type == kinds.BYTE:
                self.byte_ids[int(piece.piece[3:5], 16)] = i
                surface = bytes([int(piece.piece[3:5], 16)])
            elif piece.type in (kinds.NORMAL, kinds.USER_DEFINED):
                words[surface] = i
                normal_scores.append(piece.score)
            elif piece.type == kinds.UNKNOWN:
                self.unknown = i
                surface = proto.trainer_spec.unk_surface.encode()
            else:
                surface = b""
            self.bytes_of.append(surface)
            self.scores[i] = piece.score
        top = max(normal_scores, default=0.0)
        for i, piece in enumerate(proto.pieces):
            if piece.type == kinds.USER_DEFINED:
                self.scores[i] = len(piece.piece) * top - 0.1
        self.unknown_score = min(normal_scores, default=0.0) - UNKNOWN_PENALTY
        self.fallback = bool((self.byte_ids >= 0).all())
        # Words can be solved apart only if no piece runs over the beginning of a word,
        # lines only if no piece holds a line feed.
        self.by_word = not any(re.search(rb"[^ ] ", w) for w in words)
        self.by_line = self.by_word and not any(b"\n" in w for w in words)
        self.trie = DoubleArray(words)

    # Segmentation -----------------------------------------------------------

    def _emit(self, word: bytes, cuts: list[tuple[int, int, int]]) -> bytes:
        """Ids of (start, end, id) cuts as 32-bit numbers; an unknown character is its bytes, or one unknown id per run."""
        out: list[int] = []
        last_unknown = False
        for start, end, piece in cuts:
            if piece >= 0:
                out.append(piece)
                last_unknown = False
            elif self.fallback:
                out += self.byte_ids[list(word[start:end])].tolist()
            elif not last_unknown:
                out.append(self.unknown)
                last_unknown = True
        return array("i", out).tobytes()

    def _solve_one(self, word: bytes) -> bytes:
        """Best segmentation of one word, any length."""
        base, check, value, n = self.trie.base, self.trie.check, self.trie.value, len(word)
        best = [-np.inf] * (n + 1)
        best[0] = 0.0
        came: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        at = 0
        while at < n:
            here, node, j, width = best[at], 0, at, _char_bytes(word, at)
            single = False
            while j < n:
                to = int(base[node]) + word[j] + 1
                if check[to] != node or to == 0:
                    break
                node, j = to, j + 1
                piece = int(value[node])
                if piece >= 0:
                    score = here + self.scores[piece]
                    if score > best[j]:
                        best[j], came[j] = score, (at, piece)
                    single |= j - at == width
            if not single and here + self.unknown_score > best[at + width]:
                best[at + width], came[at + width] = here + self.unknown_score, (at, -1)
            at += width
        cuts, at = [], n
        while at:
            start, piece = came[at]
            cuts.append((start, at, piece))
            at = start
        return self._emit(word, cuts[::-1])

    def solve(self, words: list[bytes]) -> list[bytes]:
        """Best segmentations of many words of up to LONG_WORD bytes, side by side."""
        out = [b""] * len(words)
        lengths = np.array([len(w) for w in words])
        for low, high in ((0, 8), (8, 16), (16, 32), (32, LONG_WORD)):
            for group in np.array_split(part := np.flatnonzero((lengths > low) & (lengths <= high)), len(part) // 8192 + 1):
                if len(group):
                    self._solve_group([words[i] for i in group], lengths[group], group, out)
        return out

    def _solve_group(self, words: list[bytes], lengths: np.ndarray, places: np.ndarray, out: list) -> None:
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n, width = len(words), int(lengths.max())
        codes = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width).astype(np.int32) + 1
        starts = (codes - 1 & 0xC0) != 0x80
        # Bytes to the next start of a character.
        step = np.ones((n, width), np.int32)
        for i in range(width - 2, -1, -1):
            step[:, i] = np.where(starts[:, i + 1], 1, step[:, i + 1] + 1)
        step = np.minimum(step, lengths[:, None] - np.arange(width))
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        came = np.zeros((n, width + 1), np.int32)
        chosen = np.full((n, width + 1), -1, np.int32)
        for i in range(width):
            first = np.flatnonzero((lengths > i) & (starts[:, i] | (i == 0)))
            rows, node = first, np.zeros(len(first), np.int32)
            single = np.zeros(n, bool)
            for j in range(i, width):
                to = base[node] + codes[rows, j]
                ok = (check[to] == node) & (lengths[rows] > j)
                if not ok.any():
                    break
                rows, node = rows[ok], to[ok]
                piece = value[node]
                hit = piece >= 0
                at, piece = rows[hit], piece[hit]
                score = best[at, i] + self.scores[piece]
                better = score > best[at, j + 1]
                to_set = at[better]
                best[to_set, j + 1], came[to_set, j + 1], chosen[to_set, j + 1] = score[better], i, piece[better]
                single[at[step[at, i] == j + 1 - i]] = True
            rest = first[~single[first]]
            end = i + step[rest, i]
            score = best[rest, i] + self.unknown_score
            better = score > best[rest, end]
            rest, end = rest[better], end[better]
            best[rest, end], came[rest, end], chosen[rest, end] = score[better], i, -1
        came_l, chosen_l = came.tolist(), chosen.tolist()
        for r, (word, place) in enumerate(zip(words, places.tolist(), strict=True)):
            cuts, at = [], len(word)
            while at:
                start = came_l[r][at]
                cuts.append((start, at, chosen_l[r][at]))
                at = start
            out[place] = self._emit(word, cuts[::-1])

    # Texts ------------------------------------------------------------------

    def pieces_of(self, text: bytes) -> list[bytes]:
        """The parts of a text that can be solved one by one; joined they are the normal form."""
        text = text.replace(MARKER, b" ")
        if self.squeeze:
            text = re.sub(rb" +", b" ", text).strip(b" ")
        if not text:
            return []
        if self.prefix:
            text = b" " + text
        if not self.by_word:
            return [text]
        out: list[bytes] = []
        for k, line in enumerate(text.split(b"\n") if self.by_line else [text]):
            if k:
                out.append(b"\n")
            if b"  " in line or line.endswith(b" "):
                out += re.findall(rb" *[^ ]+| +", line)
            else:
                first, *rest = line.split(b" ")
                if first:
                    out.append(first)
                out += [b" " + w for w in rest]
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids: bytes joined, markers as spaces, without the first one."""
        text = b"".join(map(self.bytes_of.__getitem__, ids))
        return text[1:] if self.prefix and text.startswith(b" ") else text


def _char_bytes(word: bytes, at: int) -> int:
    end = at + 1
    while end < len(word) and word[end] & 0xC0 == 0x80:
        end += 1
    return end - at


class Encoder:
    """Encodes texts with one model and remembers the pieces of words, up to CACHE_PIECES."""

    def __init__(self, model: UnigramModel):
        self.model = model
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        parts = [self.model.pieces_of(t) for t in texts]
        known = self.known
        wanted = set().union(*parts) if parts else set()
        if len(known) + len(wanted) > CACHE_PIECES:
            known.clear()
        new = [w for w in wanted if w not in known]
        short = [w for w in new if len(w) <= LONG_WORD]
        known.update(zip(short, self.model.solve(short), strict=True))
        long = {w: self.model._solve_one(w) for w in new if len(w) > LONG_WORD}
        known.update(long)
        out = [np.frombuffer(b"".join(map(known.__getitem__, p)), np.int32) for p in parts]
        for w in long:
            del known[w]
        return out


def load_model(path: str = MODEL) -> UnigramModel:
    """Read a model file; the library checks that it is one."""
    sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as file:
        return UnigramModel(file.read())


def encode_texts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row: doc_id, ids, n_tokens, n_fallback, ids_sha256, round_trip.

    ``ids`` are the pieces of the whole text; null and empty have none. ``n_fallback``
    counts single-byte pieces, ``ids_sha256`` is the digest of the ids as 32-bit little
    endian numbers. ``round_trip`` tells whether decoding gives the text again; it is false only for texts
    with the marker sign itself, which decodes to a space, and for unknown pieces or
    squeezed white space if the model has those. Repeated rows give equal results; only doc_id and text are read.
    """
    # The broadcast value lives as long as a worker, and so do the words it knows.
    held = docs.sparkSession.sparkContext.broadcast(Encoder(load_model(model)))
    rows = docs.select("doc_id", text_bytes().alias("text"))

    def work(batch: pa.RecordBatch) -> dict:
        unigram = held.value.model
        single = np.zeros(unigram.size, bool)
        single[unigram.byte_ids[unigram.byte_ids >= 0]] = True
        texts = batch.column("text").to_pylist()
        ids = held.value.encode(texts)
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        return {
            "doc_id": batch.column("doc_id"),
            "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            "n_tokens": np.diff(ends).astype(np.int64),
            "n_fallback": [int(single[x].sum()) for x in ids],
            "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids],
            "round_trip": [unigram.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)],
        }

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_rows(rows, work, f"doc_id {kind}, ids array<int>, n_tokens bigint, n_fallback bigint, ids_sha256 string, round_trip boolean")


def decode_ids(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row: doc_id and the text of ``ids``; null and empty ids give an empty text.

    A null id or one outside the model fails. Bytes that are no UTF-8 become U+FFFD.
    """
    held = rows.sparkSession.sparkContext.broadcast(load_model(model))

    def work(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "text": [held.value.decode(x or []).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]}

    picked = rows.select("doc_id", "ids")
    return map_rows(picked, work, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, text string")
