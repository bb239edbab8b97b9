"""Toxicity by compression distance: which of two zstandard dictionaries shortens a window more.

A base dictionary is trained on ordinary text. Letter sequences that toxic documents use in far more
contexts than ordinary ones are found by their information gain; the words that hold them, all of them,
follow the base in the toxic dictionary, and as many neutral bytes follow it in the ordinary one. No
dictionary is trained on toxic text: most of a toxic document is ordinary, and the README has the figures
of both ways. So a margin mostly tells whether a window holds a telling word. A text is cut into
windows of a few words, each is compressed with both, and the margins in bytes are compared with margins
of labelled documents that took no part in building the dictionaries: a table of log likelihood ratios,
the largest margins and their density become a probability by a weighted logistic fit.

The model is fitted on a bounded sample of labelled rows: the ``FIT_DOCS`` documents of each class whose
ids hash lowest, of at most ``FIT_CHARS`` characters each. Scoring reads every text whole, in one pass
without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorkit.llm.common import small_batches

FIT_DOCS = 2000
FIT_CHARS = 20_000
WINDOW = 6
LEVEL = 3
BASE_BYTES = 100_000
THRESHOLD = 0.3

# A sequence tells if toxic text has it RATIO times as often and its gain is at least LEAST_GAIN, whatever others have.
RATIO = 20
LEAST_GAIN = 20.0
LEAST_CONTEXTS = 4
_EDGE = 20
_NOT_WORD = re.compile(r"\W+")


def tidy_words(text: str) -> list[str]:
    return _NOT_WORD.sub(" ", text.lower()).split()


def windows(text: str, width: int = WINDOW) -> list[bytes]:
    """Runs of ``width`` words over the whole text; one empty window for a text without words."""
    words = tidy_words(text)
    return [f" {' '.join(words[i:i + width])} ".encode("utf-8", "surrogatepass") for i in range(0, max(len(words), 1), width)]


def _contexts(texts: list[str]) -> tuple[dict[str, int], int]:
    """Number of distinct neighbourhoods of each word, so that copies of a text count once; number of words."""
    seen, total = defaultdict(set), 0
    for text in texts:
        words = tidy_words(text)
        total += len(words)
        for before, word, after in zip(["", *words[:-1]], words, [*words[1:], ""], strict=True):
            seen[word].add(hash((before, after)))
    return {word: len(found) for word, found in seen.items()}, max(total, 1)


def _sequences(word: str, longest: int = 8):
    word = f" {word} "
    return {word[i:i + n] for n in range(3, longest + 1) for i in range(len(word) - n + 1)}


def telling_words(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Words of toxic text that hold a telling letter sequence, rare ones first."""
    mine, n_mine = _contexts(toxic)
    other, n_other = _contexts(ordinary)
    count, against = Counter(), Counter()
    for word, n in mine.items():
        for sequence in _sequences(word):
            count[sequence] += n
    count = {sequence: n for sequence, n in count.items() if n >= LEAST_CONTEXTS}
    for word, n in other.items():
        for sequence in _sequences(word):
            if sequence in count:
                against[sequence] += n
    telling = set()
    for sequence, n in count.items():
        ratio = (n / n_mine) / ((against[sequence] + 1) / n_other)
        if ratio > RATIO and n * np.log(ratio) >= LEAST_GAIN:
            telling.add(sequence)
    return sorted((w for w in mine if not telling.isdisjoint(_sequences(w))), key=lambda w: (mine[w], w))


def _codec(content: bytes):
    import zstandard

    plain = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=plain)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=plain).compress


def logistic(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients, intercept first, by Newton steps."""
    x = np.column_stack([np.ones(len(rows)), rows])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weights * (p - labels)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class Model:
    """Two dictionaries and the calibration of their margins; ``constant`` where there was nothing to fit."""

    ordinary: bytes = b""
    toxic: bytes = b""
    ratios: np.ndarray = field(default_factory=lambda: np.zeros(2 * _EDGE + 1))
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    constant: float = 0.0

    def margins(self, codecs, text: str) -> np.ndarray:
        ordinary, toxic = codecs
        return np.array([len(ordinary(window)) - len(toxic(window)) for window in windows(text)])

    def codecs(self):
        return _codec(self.ordinary), _codec(self.toxic)

    def features(self, margins: np.ndarray) -> np.ndarray:
        n, high = len(margins), np.maximum(margins - 2, 0)
        top = np.sort(margins)[::-1]
        ratio = self.ratios[np.clip(margins, -_EDGE, _EDGE) + _EDGE].sum()
        return np.array([
            np.clip(ratio, -10, 20), top[0], high.sum() / n ** 0.5, np.log(n), (margins >= 5).sum() / n ** 0.5,
            np.log1p((margins >= 6).sum()), top[:3].sum(),
        ])

    def score(self, codecs, text: str) -> float:
        if self.weights is None:
            return self.constant
        row = (self.features(self.margins(codecs, text)) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + row @ self.weights[1:], -30, 30))))


def fit(sample: list[tuple[int, str, int]], shares: dict[int, float]) -> Model:
    """A model from (half, text, toxic) rows: half 0 builds the dictionaries, half 1 calibrates.

    ``shares`` maps a class to the part of all labelled rows of it that the sample holds.
    """
    import zstandard

    parts = {(half, toxic): [text for h, text, t in sample if (h, t) == (half, toxic)] for half in (0, 1) for toxic in (0, 1)}
    counts = {toxic: sum(t == toxic for _, _, t in sample) / max(shares.get(toxic, 1), 1e-12) for toxic in (0, 1)}
    if min(map(len, parts.values())) < 3:
        return Model(constant=counts[1] / max(counts[0] + counts[1], 1))
    plain = [window for text in parts[0, 0] for window in windows(text)]
    try:
        base = zstandard.train_dictionary(BASE_BYTES, plain[:: max(1, len(plain) // 40_000)]).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        base = b"".join(plain)[-BASE_BYTES:]
    telling = f" {' '.join(telling_words(parts[0, 1], parts[0, 0]))} ".encode("utf-8", "surrogatepass")
    model = Model(base + b"\0" * len(telling), base + telling)
    codecs = model.codecs()
    margins = {toxic: [model.margins(codecs, text) for text in parts[1, toxic]] for toxic in (0, 1)}

    def spread(toxic: int) -> np.ndarray:
        n = np.bincount(np.clip(np.concatenate(margins[toxic]), -_EDGE, _EDGE) + _EDGE, minlength=2 * _EDGE + 1) + 0.5
        return n / n.sum()

    model.ratios = np.log(spread(1) / spread(0))
    rows = np.array([model.features(m) for toxic in (0, 1) for m in margins[toxic]])
    labels = np.array([toxic for toxic in (0, 1) for _ in margins[toxic]], dtype=float)
    model.mean, model.scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    weights = np.where(labels == 1, 1 / max(shares.get(1, 1), 1e-12), 1 / max(shares.get(0, 1), 1e-12))
    weights *= len(weights) / weights.sum()
    model.weights = logistic((rows - model.mean) / model.scale, labels, weights)
    return model


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_model(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> Model:
    """Fit on labelled rows that are not held out; at most ``2 * fit_docs`` texts reach the driver."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    totals = {row.toxic: row["count"] for row in known.groupBy("toxic").count().collect()}  # two classes
    drawn = None
    for toxic in (0, 1):
        part = known.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
        drawn = part if drawn is None else drawn.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = (
        texts.filter(F.length("text") <= fit_chars).join(F.broadcast(drawn), "doc_id")  # at most 2 * fit_docs ids
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
        .select("doc_id", "text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) < 2).cast("int").alias("half"))
    )
    sample = sorted((r.doc_id, r.half, r.text, r.toxic) for r in rows.collect())  # bounded by fit_docs and fit_chars
    shares = {toxic: min(1.0, fit_docs / n) for toxic, n in totals.items()}
    return fit([(half, text, toxic) for _, half, text, toxic in sample], shares)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for each row."""
    import pyarrow as pa

    def rows(batches):
        codecs = model.codecs() if model.weights is not None else None
        for batch in batches:
            values = [model.score(codecs, text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], names=["doc_id", "score"])

    small_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(rows, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each document.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` needs ``doc_id`` and ``toxic``; other columns are
    ignored. A null or empty text is scored like a text without words. A null ``doc_id`` stays null and is
    not held out; several labels of one id count as toxic if one is; labels other than 0 and 1 are ignored.
    Equal texts have equal scores. With fewer than three usable labelled texts of a class in either half,
    every score is the share of toxic labels. An empty table gives no rows.
    """
    model = fit_model(docs, labels, fit_docs, fit_chars)
    return score(docs, model).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
