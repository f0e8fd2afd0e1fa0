"""Quality rules: word statistics, two fixed rules and an isolation forest over the rest.

Each statistic counts by how far it lies outside the range of good documents, so
that rare but ordinary values are no anomaly. Trees of random splits are each grown on
a few rows drawn from all labelled documents; documents that the splits set apart early are
anomalous. Ranges and threshold come from all labelled documents. The score above which a document is rejected loses at most ``MAX_LOSS`` of
the labelled good rows and lies halfway to the bad rows that it rejects.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from skyledger.llm.common import SLICE_ROWS, map_rows, mix, small_batches, text_bytes
from skyledger.llm.line_dedup import mark_ids
from skyledger.operators.ordering import exact_percentiles, value_ranks
from skyledger.session import materialize

TREES, TREE_ROWS = 150, 256
DRIVER_ROWS = TREES * TREE_ROWS  # up to so many labelled rows are fitted on the driver, more of them by the cluster
MAX_LOSS = 0.002  # share of good labelled rows that may be rejected
SEED = 8
RANGE_TAIL = 0.001  # share of good rows beyond either end of a statistic's range
LEAST_WIDTH = 0.02  # narrowest range that excess is measured by
MOST_EXCESS = 10.0

SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_DIGIT = bytes(range(0x30, 0x3A))
_WHITE = b" \t\n\v\f\r"
_CONTINUED = bytes(range(0x80, 0xC0))
_ENDS = (b".", b"!", b"?", b":", b'"')

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("symbols", "dup_lines", "repeats", "capitals", "digits", "marks", "exclaims", "mean_word", "long_words", "unended", "vocabulary")


def _repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words in 3-word windows found twice or more, and distinct words."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(words) < 4:
        return 0, len(known)
    # Pairs are numbered again, so the codes stay small for any text.
    _, pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
    _, codes, counts = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[codes] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(again)] |= again
    return int(hit.sum()), len(known)


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """COUNTS and RATIOS of a UTF-8 text."""
    words = text.split()  # bytes: ASCII white space
    n = len(words)
    solid = text.translate(None, _WHITE)
    word_chars = len(solid) - (len(solid) - len(solid.translate(None, _CONTINUED)))
    n_symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    lines = [a for a in text.split(b"\n") if a.strip(_WHITE)]
    n_dup = len(lines) - len(set(lines))
    n_repeat, distinct = _repeat_words(words)
    upper, lower, digits = (len(solid) - len(solid.translate(None, x)) for x in (_UPPER, _LOWER, _DIGIT))
    ascii_signs = len(solid) - len(solid.translate(None, bytes(range(0x21, 0x7F))))
    marks = ascii_signs - upper - lower - digits
    chars = max(word_chars, 1)
    ratios = [
        n_symbols / chars,
        n_dup / max(len(lines), 1),
        n_repeat / max(n, 1),
        upper / max(upper + lower, 1),
        digits / chars,
        marks / chars,
        solid.count(b"!") / chars,
        min(word_chars / max(n, 1), 40.0),
        sum(len(w) > 25 for w in words) / max(n, 1),
        sum(not a.rstrip(_WHITE).endswith(_ENDS) for a in lines) / max(len(lines), 1),
        distinct / max(n, 1) ** 0.8,
    ]
    return [n, word_chars, n_symbols, n_dup, n_repeat], ratios


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


class IsolationForest:
    """Random-split trees in flat arrays; ``score`` is near 1 for what is set apart early.

    ``rows`` are all rows, of which each tree draws some, or have one more axis in front: the rows drawn for each tree.
    """

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        drawn = rows.ndim == 3
        self.size = rows.shape[1] if drawn else min(tree_rows, len(rows))
        limit = max(1, int(np.ceil(np.log2(max(self.size, 2)))))
        self.trees = []
        for k in range(len(rows) if drawn else trees):
            part = rows[k] if drawn else rows[rng.choice(len(rows), self.size, replace=False)]
            nodes: list[list[float]] = []  # feature or -1, split or path length, left, right
            self._grow(part, 0, limit, rng, nodes)
            table = np.array(nodes)
            self.trees.append((table[:, 0].astype(np.int32), table[:, 1], table[:, 2].astype(np.int32), table[:, 3].astype(np.int32)))
        self.limit = limit

    def _grow(self, rows: np.ndarray, depth: int, limit: int, rng: np.random.Generator, nodes: list) -> int:
        at = len(nodes)
        nodes.append([-1, depth + _mean_path(len(rows)), at, at])
        low, high = rows.min(axis=0), rows.max(axis=0)
        wide = np.flatnonzero(high > low)
        if depth >= limit or len(rows) < 2 or not len(wide):
            return at
        feature = int(rng.choice(wide))
        split = float(rng.uniform(low[feature], high[feature]))
        goes = rows[:, feature] < split
        left = self._grow(rows[goes], depth + 1, limit, rng, nodes) if goes.any() else None
        right = self._grow(rows[~goes], depth + 1, limit, rng, nodes) if not goes.all() else None
        if left is None or right is None:
            return at
        nodes[at] = [feature, split, left, right]
        return at

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        index = np.arange(len(rows))
        for feature, value, left, right in self.trees:
            node = np.zeros(len(rows), np.int32)
            for _ in range(self.limit):
                f = feature[node]
                node = np.where(f < 0, node, np.where(rows[index, np.maximum(f, 0)] < value[node], left[node], right[node]))
            total += value[node]
        return 2.0 ** (-total / len(self.trees) / max(_mean_path(self.size), 1e-9))


def _mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n < 2:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


@dataclass
class QualityModel:
    forest: IsolationForest | None
    threshold: float  # scores above are rejected
    low: np.ndarray | None = None  # range of each ratio in good documents
    high: np.ndarray | None = None

    def scores(self, ratios: np.ndarray) -> np.ndarray:
        if self.forest is None or not len(ratios):
            return np.zeros(len(ratios))
        return self.forest.score(excess(ratios, self.low, self.high))


def excess(ratios: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many widths of the good range each ratio lies outside it."""
    width = np.maximum(high - low, LEAST_WIDTH)
    return np.clip(np.maximum((ratios - high) / width, (low - ratios) / width), 0.0, MOST_EXCESS)


def calibrate(scores: np.ndarray, good: np.ndarray, max_loss: float = MAX_LOSS) -> float:
    """A threshold that at most ``max_loss`` of the good rows exceed; infinite without bad rows.

    From the lowest such value it is raised halfway to the bad rows above it.
    """
    if not good.any() or good.all():
        return float("inf")
    ordered = np.sort(scores[good])[::-1]
    lowest = float(ordered[int(max_loss * len(ordered))])
    caught = scores[~good & (scores > lowest)]
    return (lowest + float(np.quantile(caught, 0.01))) / 2 if len(caught) else lowest


def labelled_ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc, quality, ratios) of every labelled document that the fixed rules let pass, one row an id."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.min("quality").cast("int").alias("quality"))
    )
    chosen = materialize(chosen, "quality-labels")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc"), text_bytes().alias("text"))
    # Texts stay where they are: a map of the ids tells which to read, and only their statistics are joined.
    asked = mark_ids(texts, "doc", chosen.select("id"), "asked").where("asked").select("doc", F.xxhash64("text").alias("digest"), "text")

    def work(batch: pa.RecordBatch) -> dict:
        found = [statistics(t) for t in batch.column("text").to_pylist()]
        return {"doc": batch.column("doc"), "digest": batch.column("digest"), "failed": [base_failed(c[0], c[4]) for c, _ in found], "ratios": [r for _, r in found]}

    rows = map_rows(asked, work, "doc bigint, digest bigint, failed boolean, ratios array<double>").where("not failed")
    rows = rows.groupBy("doc").agg(F.min(F.struct("digest", "ratios")).alias("m"))
    return rows.join(chosen, F.col("doc") == F.col("id")).select("doc", "quality", "m.ratios")


def fit_quality(docs: DataFrame, labels: DataFrame, driver_rows: int = DRIVER_ROWS) -> QualityModel:
    """Grow the forest and set the ranges and the threshold on all labelled rows.

    Labels are (doc_id, quality); null ones and ids without a document are skipped, and of
    several labels of an id the smallest counts. Rows that the fixed rules reject are left out; of several
    rows of an id the one with the smallest text digest counts. Without
    both classes nothing is rejected beyond the fixed rules. More than ``driver_rows`` rows stay in the cluster:
    the driver gets the rows drawn for the trees, the ends of the ranges and the threshold.
    """
    rows = materialize(labelled_ratios(docs, labels), "quality-ratios")
    n, n_good, least, most = rows.agg(F.count("*"), F.count_if(F.col("quality") == 1), F.min("quality"), F.max("quality")).head()
    if not n_good or least == most:
        return QualityModel(None, float("inf"))
    if n > driver_rows:
        return _fit_apart(rows, n, n_good)
    # One order of the rows, whatever the partitions were.
    held = rows.toPandas().sort_values("doc")
    ratios = np.array(held["ratios"].tolist(), dtype=float)
    good = held["quality"].to_numpy() == 1
    low, high = np.quantile(ratios[good], [RANGE_TAIL, 1 - RANGE_TAIL], axis=0)
    model = QualityModel(IsolationForest(excess(ratios, low, high)), 0.0, low, high)
    model.threshold = calibrate(model.scores(ratios), good)
    return model


def _fit_apart(rows: DataFrame, n: int, n_good: int) -> QualityModel:
    """The model of :func:`fit_quality` over a stored table; the trees draw other rows than on the driver."""
    wide = rows.where("quality = 1").select(*[F.col("ratios")[i].alias(name) for i, name in enumerate(RATIOS)])
    ends = {(r["name"], r["p"]): r["value"] for r in exact_percentiles(wide, RATIOS, [RANGE_TAIL, 1 - RANGE_TAIL]).collect()}
    low, high = (np.array([ends[name, p] for name in RATIOS]) for p in (RANGE_TAIL, 1 - RANGE_TAIL))
    model = QualityModel(IsolationForest(excess(drawn_rows(rows, n), low, high)), 0.0, low, high)
    held = rows.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict:
        ratios = np.array(batch.column("ratios").to_pylist(), dtype=float)
        return {"quality": batch.column("quality"), "score": held.value.scores(ratios)}

    scores = materialize(map_rows(rows, work, "quality int, score double"), "quality-scores")
    # As calibrate does: the lowest value that no more than MAX_LOSS of the good rows exceed.
    place = n_good - 1 - int(MAX_LOSS * n_good)
    lowest = value_ranks(scores.where("quality = 1"), ["score"]).where((F.col("below") <= place) & (F.col("below") + F.col("n") > place)).head()["value"]
    caught = exact_percentiles(scores.where((F.col("quality") != 1) & (F.col("score") > lowest)), ["score"], [0.01]).head()
    model.threshold = lowest if caught is None else (lowest + caught["value"]) / 2
    return model


def drawn_rows(rows: DataFrame, n: int, trees: int = TREES, tree_rows: int = TREE_ROWS) -> np.ndarray:
    """Ratios of the rows drawn for each tree, (trees, tree_rows, ratios): those whose ids have the tree's smallest hashes.

    Any of the ``n`` rows may be drawn for any tree, and the partitions do not matter. Only hashes below a bound reach the driver, which
    some ``tree_rows`` + 12 root(``tree_rows``) rows a tree are expected to pass.
    """
    bound = np.uint64(min((tree_rows + 12 * tree_rows**0.5 + 40) / n, 1 - 2.0**-53) * 2.0**64)
    seeds = mix(np.arange(1, trees + 1, dtype=np.uint64) + np.uint64(SEED << 32))

    def work(batch: pa.RecordBatch) -> dict:
        ids = mix(batch.column("doc").to_numpy().view(np.uint64))
        hashes = mix(ids[None, :] ^ seeds[:, None])
        tree, at = np.nonzero(hashes < bound)
        return {"tree": tree, "hash": (hashes[tree, at] >> np.uint64(1)).view(np.int64), "doc": batch.column("doc").take(pa.array(at)), "ratios": batch.column("ratios").take(pa.array(at))}

    found = map_rows(rows, work, "tree int, hash bigint, doc bigint, ratios array<double>").toPandas()
    found = found.sort_values(["tree", "hash", "doc"])
    size = min(tree_rows, int(found.groupby("tree").size().min()))
    return np.array(found.groupby("tree").head(size)["ratios"].tolist(), dtype=float).reshape(trees, size, -1)


def quality_rules(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Input columns plus the COUNTS, ``base_failed``, ``anomaly`` and ``kept``.

    Words are runs without ASCII white space in the whole text; null has none. A row fails the base with under 50 words or
    with more than half of its words in repeated 3-word windows; then ``kept`` is
    false, else the forest decides. Repeated rows are judged alike, doc_id is not
    read, and extra columns pass through unless they have the names of the results.
    """
    names = [*COUNTS, "base_failed", "anomaly", "kept"]
    extra = [c for c in docs.columns if c not in names]
    # A text travels once: inside its row, unless it is no string.
    inside = isinstance(docs.schema["text"].dataType, StringType)
    rows = docs.select(F.struct(*extra).alias("row"), *([] if inside else [text_bytes().alias("text")]))
    held = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    schema = StructType([rows.schema["row"], *[StructField(c, LongType()) for c in COUNTS], StructField("base_failed", BooleanType()), StructField("anomaly", DoubleType()), StructField("kept", BooleanType())])

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(start, SLICE_ROWS)
                texts = batch.column("row").field("text").cast(pa.binary()) if inside else batch.column("text")
                found = [statistics(t or b"") for t in texts.to_pylist()]
                failed = np.array([base_failed(c[0], c[4]) for c, _ in found], bool)
                scores = held.value.scores(np.array([r for _, r in found], dtype=float).reshape(-1, len(RATIOS)))
                counts = [pa.array([c[k] for c, _ in found], pa.int64()) for k in range(len(COUNTS))]
                yield pa.RecordBatch.from_arrays([batch.column("row"), *counts, pa.array(failed), pa.array(scores), pa.array(~failed & (scores <= held.value.threshold))], names=["row", *names])

    return rows.mapInArrow(run, schema).select("row.*", *names)
