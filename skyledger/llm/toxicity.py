"""Toxicity scores: boosted trees over dense text features, with isotonic calibration.

The lexicon holds a short fixed list and the word beginnings that the labelled rows
tie to toxic documents. Its entries come from one part of the labelled sample, the
trees are fitted on a second and the calibration on a third, so no part grades itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import CACHE_WORDS, map_rows
from skyledger.session import materialize

# Labelled rows that the model is fitted on, the first by a hash of their id.
SAMPLE_ROWS = 20_000
# Learned lexicon entries, at most.
LEXICON_ENTRIES = 2_000
# How many times likelier an entry is in toxic documents.
LEAST_RATIO = 20.0
# Words between an entry and a second-person word that count as near.
NEAR = 5
# Share of the raw tree score in the result: keeps the order inside calibration steps.
RAW_SHARE = 0.01

# Insults and second-person words.
INSULTS = (
    "asshole", "bastard", "bitch", "clown", "coward", "creep", "cretin", "cunt", "degenerate", "dickhead", "disgusting",
    "dumbass", "dumb", "fool", "freak", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "pig",
    "retard", "scum", "scumbag", "shit", "slut", "stupid", "trash", "vermin", "whore", "worthless",
    "arschloch", "dummkopf", "schwein", "connard", "salaud", "idiota", "imbécil", "pendejo", "cabrón",
)
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "yourselves", "u", "ur", "you're", "youre",
    "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "ton", "ta", "tes", "vous", "votre", "vos",
    "tú", "ti", "te", "usted", "ustedes", "tuyo", "vosotros",
)

FEATURES = (
    "lexicon_density", "lexicon_hits", "lexicon_variety", "disguised_density", "second_person_density", "near_density",
    "capitals", "punctuation", "exclamation", "digits", "mixed_words", "mean_word", "log_words",
)

_LEX, _DISGUISED, _SECOND, _MIXED = 1, 2, 4, 8
# Signs that stand for letters.
_DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": "", ".": "", "-": "", "_": ""})
_PARTS = re.compile(r"[^\W_]+")
_EDGES = " \t\n.,;:!?\"'()[]{}<>«»„“”‘’…-*#$%&|"


def entries_of(word: str) -> list[str]:
    """Lexicon entries that a lower-case word can match: itself and its beginnings."""
    return ["=" + word, *(word[:n] for n in (4, 5, 6) if len(word) >= n)]


class WordKinds(dict):
    """Bits of a lower-case word, remembered up to ``CACHE_WORDS`` words."""

    def __init__(self, lexicon: frozenset[str]):
        super().__init__()
        self.lexicon = lexicon
        self.second = frozenset(SECOND_PERSON)

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        core = word.strip(_EDGES)
        parts = _PARTS.findall(core)
        kind = 0
        if any(e in self.lexicon for p in parts for e in entries_of(p)):
            kind |= _LEX
        elif core and not core.isalpha():
            plain = core.translate(_DISGUISE)
            if plain != core and any(e in self.lexicon for e in entries_of(plain)):
                kind |= _DISGUISED
        if core in self.second:
            kind |= _SECOND
        if core and not core.isalpha() and any(map(str.isalpha, core)) and any(c in "0134578@$*!" for c in core):
            kind |= _MIXED
        self[word] = kind
        return kind


def sign_kinds() -> np.ndarray:
    """For each code point below 65536: 1 capital, 2 other letter, 3 digit, 4 white space, 5 '!' or '?', 6 other."""
    out = np.full(65536, 6, np.uint8)
    for i in range(65536):
        c = chr(i)
        if c.isalpha():
            out[i] = 1 if c.isupper() else 2
        elif c.isdigit():
            out[i] = 3
        elif c.isspace():
            out[i] = 4
    out[[ord("!"), ord("?")]] = 5
    return out


def features_of(text: str, kinds: WordKinds, signs: np.ndarray) -> list[float]:
    """The values of FEATURES for one whole text."""
    words = text.lower().split()
    n = len(words)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    count = np.bincount(signs[np.minimum(points, 65535)], minlength=7) if len(points) else np.zeros(7, np.int64)
    codes = np.fromiter(map(kinds.__getitem__, words), np.uint8, n)
    hits = np.flatnonzero(codes & (_LEX | _DISGUISED))
    second = np.flatnonzero(codes & _SECOND)
    near = 0
    if len(hits) and len(second):
        after = np.searchsorted(second, hits)
        gap = np.minimum(np.abs(second[np.minimum(after, len(second) - 1)] - hits), np.abs(second[np.maximum(after - 1, 0)] - hits))
        near = int((gap <= NEAR).sum())
    words_or_one, points_or_one = max(n, 1), max(len(points), 1)
    letters = int(count[1] + count[2])
    return [
        len(hits) / words_or_one,
        math.log1p(len(hits)),
        float(len({words[i] for i in hits.tolist()})),
        float((codes & _DISGUISED != 0).sum()) / words_or_one,
        len(second) / words_or_one,
        near / words_or_one,
        float(count[1]) / max(letters, 1),
        float(count[6] + count[5]) / points_or_one,
        float(count[5]) / points_or_one,
        float(count[3]) / points_or_one,
        float((codes & _MIXED != 0).sum()) / words_or_one,
        (len(points) - float(count[4])) / words_or_one,
        math.log1p(n),
    ]


def held_out(id_column: str = "doc_id") -> F.Column:
    """True for the fold that is never learned from; a null id is in it."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(True))


@dataclass
class ToxicityModel:
    lexicon: frozenset[str]
    trees: GBTClassificationModel | None
    steps: IsotonicRegressionModel | None


def _with_features(rows: DataFrame, lexicon: frozenset[str]) -> DataFrame:
    """``rows`` (carried..., text) with ``features`` for ``text``, which goes."""
    carried = [c for c in rows.columns if c != "text"]
    held = rows.sparkSession.sparkContext.broadcast(lexicon)
    state: dict = {}

    def work(batch: pa.RecordBatch) -> dict:
        if not state:
            state.update(kinds=WordKinds(held.value), signs=sign_kinds())
        out = {c: batch.column(c) for c in carried}
        out["features"] = [features_of(t or "", state["kinds"], state["signs"]) for t in batch.column("text").to_pylist()]
        return out

    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried), "features array<double>"])
    return map_rows(rows, work, schema)


def learn_lexicon(rows: DataFrame) -> frozenset[str]:
    """Fixed insults and the word beginnings that go with ``label`` 1 in ``rows`` (text, label)."""

    def count(batch: pa.RecordBatch) -> dict:
        toxic: Counter = Counter()
        clean: Counter = Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            words = set(_PARTS.findall((text or "").lower()))
            (toxic if label else clean).update({e for w in words for e in entries_of(w)})
        names = list(toxic.keys() | clean.keys())
        return {"entry": names, "toxic": [toxic[e] for e in names], "clean": [clean[e] for e in names]}

    totals = rows.agg(F.sum("label"), F.count("*")).first()
    n_toxic, n_clean = totals[0] or 0, (totals[1] or 0) - (totals[0] or 0)
    fixed = {"=" + w for w in INSULTS}
    if not n_toxic or not n_clean:
        return frozenset(fixed)
    ratio = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    found = (
        map_rows(rows.select("text", "label"), count, "entry string, toxic bigint, clean bigint")
        .groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= max(3, math.ceil(0.005 * n_toxic)))
        .where(ratio >= LEAST_RATIO)
        .orderBy(F.desc("toxic"), "entry").limit(LEXICON_ENTRIES)
    )
    return frozenset(fixed | {r.entry for r in found.collect()})


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out fold.

    Labels are (doc_id, toxic); null ones and ids without a document are skipped, and
    of several labels of an id the largest counts, of several rows of an id the one with
    the smallest text digest. Without both classes in each part the trees or the calibration
    stay out, see ``score_toxicity``.
    """
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max("toxic").cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    )
    chosen = materialize(chosen.select("id", "label", F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(4)).alias("part")), "toxic-labels")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.col("text").cast("string").alias("text"))
    # At most sample_rows short rows are broadcast.
    sample = texts.join(F.broadcast(chosen), F.col("doc") == F.col("id"))
    # One row an id, so that the sample is no larger than the labels.
    sample = sample.groupBy("id", "label", "part").agg(F.min(F.struct(F.xxhash64("text").alias("digest"), "text")).alias("m"))
    sample = materialize(sample.select("m.text", "label", "part"), "toxic-sample")
    lexicon = learn_lexicon(sample.where("part < 2"))
    rows = materialize(_with_features(sample.where("part >= 2"), lexicon).select(F.col("label").cast("double").alias("label"), "part", array_to_vector("features").alias("vector")), "toxic-features")

    def both(part: DataFrame) -> bool:
        return part.select("label").distinct().count() == 2

    fitting, rest = rows.where("part = 2").coalesce(4), rows.where("part = 3")
    if not both(fitting):
        return ToxicityModel(lexicon, None, None)
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.25, maxBins=32, seed=5).fit(fitting)
    if not both(rest):
        return ToxicityModel(lexicon, trees, None)
    raw = trees.transform(rest.coalesce(4)).select("label", vector_to_array("probability")[1].alias("raw"))
    steps = IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw)
    return ToxicityModel(lexicon, trees, steps)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Every whole text is scored from its text alone; null counts as empty, and empty
    texts get the score of a text without words. Without fitted trees the score is
    0.9 for texts with a lexicon word and 0.1 for others; without calibration it is
    the trees' probability. Repeated rows get equal scores; other columns are not read.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = _with_features(rows, model.lexicon)
    if model.trees is None:
        scored = found.withColumn("score", F.when(F.col("features")[1] > 0, 0.9).otherwise(0.1))
    else:
        raw = model.trees.transform(found.withColumn("vector", array_to_vector("features"))).withColumn("raw", vector_to_array("probability")[1])
        if model.steps is None:
            scored = raw.withColumn("score", F.col("raw"))
        else:
            steps = model.steps.copy().setPredictionCol("step").transform(raw)
            scored = steps.withColumn("score", (1 - RAW_SHARE) * F.col("step") + RAW_SHARE * F.col("raw"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return scored.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
