"""Language identification with a byte convolutional network in numpy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoardlens.llm.folds import held_out, sample_per_class
from hoardlens.llm.frames import append_columns, blobs

WINDOW = 128  # bytes
WIDTHS = (2, 3, 4, 5)
FILTERS = 8  # of each width
ROWS_PER_LANGUAGE = 1_500  # training rows, at most about so many
WINDOWS_PER_ROW = 2
EPOCHS = 6
BATCH = 64
RATE = 0.01
CHUNK = 2_048  # windows convolved at once
_LETTER = re.compile(r"[^\W\d_]")


def windows_of(text: bytes) -> np.ndarray:
    """A whole text as windows; the last one reaches back, a short text is padded with zeros."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= WINDOW:
        return np.pad(data, (0, WINDOW - len(data)))[None, :]
    whole = data[: len(data) // WINDOW * WINDOW].reshape(-1, WINDOW)
    if len(data) % WINDOW:
        whole = np.concatenate([whole, data[None, -WINDOW:]])
    return whole


def has_letter(text: bytes | None) -> bool:
    return bool(text) and _LETTER.search(text.decode("utf-8", "replace")) is not None


class ByteNetwork:
    """Filters of several widths over bytes, the greatest response of each, and a softmax.

    A filter of width w is w tables of 256 weights: a convolution over one-hot bytes is a sum of
    table rows.
    """

    def __init__(self, languages: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [
            [rng.normal(0, 0.3, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS
        ]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        features = FILTERS * len(WIDTHS)
        self.out = rng.normal(0, 0.1, (features, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def _pooled(self, x: np.ndarray, places: bool = False):
        """Greatest response of each filter in each window, at least 0; with places on request."""
        pooled, at = [], []
        for tables, bias, width in zip(self.tables, self.bias, WIDTHS):
            span = x.shape[1] - width + 1
            total = tables[0][x[:, :span]]
            for k in range(1, width):
                total += tables[k][x[:, k : k + span]]
            if places:
                best = total.argmax(axis=1)
                at.append(best)
                value = np.take_along_axis(total, best[:, None, :], axis=1)[:, 0, :]
            else:
                value = total.max(axis=1)
            pooled.append(np.maximum(value + bias, 0))
        return np.concatenate(pooled, axis=1), at

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for start in range(0, len(x), CHUNK):
            pooled, _ = self._pooled(x[start : start + CHUNK])
            parts.append(_softmax(pooled @ self.out + self.out_bias))
        return np.concatenate(parts) if parts else np.empty((0, len(self.languages)))

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 1) -> None:
        """Adam on cross-entropy; only the place of a filter's greatest response has a gradient."""
        rng = np.random.default_rng(seed)
        weights = [t for tables in self.tables for t in tables] + self.bias + [self.out, self.out_bias]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step = 0
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
                step += 1
                gradients = self._gradients(x[rows], y[rows])
                for w, g, m, v in zip(weights, gradients, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x, y):
        pooled, at = self._pooled(x, places=True)
        error = _softmax(pooled @ self.out + self.out_bias)
        error[np.arange(len(y)), y] -= 1
        error /= len(y)
        back = (error @ self.out.T) * (pooled > 0)
        tables, biases = [], []
        rows = np.arange(len(x))[:, None]
        for i, width in enumerate(WIDTHS):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            for k in range(width):
                g = np.zeros((256, FILTERS), np.float32)
                np.add.at(g, (x[rows, at[i] + k], np.arange(FILTERS)[None, :]), own)
                tables.append(g)
            biases.append(own.sum(axis=0))
        return [*tables, *biases, pooled.T @ error, error.sum(axis=0)]

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        """Language of greatest mean probability over all windows of each text."""
        answers: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.languages:
            return answers
        group, places, size = [], [], 0
        for i, text in enumerate([*texts, None]):
            last = i == len(texts)
            if not last and has_letter(text):
                group.append(windows_of(text))
                places.append(i)
                size += len(group[-1])
            if group and (last or size >= CHUNK):
                chances = self.probabilities(np.concatenate(group))
                starts = np.concatenate([[0], np.cumsum([len(g) for g in group])])
                means = np.add.reduceat(chances, starts[:-1], axis=0) / np.diff(starts)[:, None]
                for place, mean in zip(places, means):
                    best = int(mean.argmax())
                    answers[place] = (self.languages[best], float(min(mean[best], 1.0)))
                group, places, size = [], [], 0
        return answers


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> ByteNetwork:
    """A network trained on about ``rows_per_language`` rows of each language, none held out.

    A row gives WINDOWS_PER_ROW windows from places spread over its whole text. Rows whose text
    is null or has no letter teach nothing; without any labelled row no language is learned.
    """
    labelled = docs.select("doc_id", "lang", "text").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    chosen = sample_per_class(labelled, "lang", F.col("doc_id"), rows_per_language)
    place = lambda n: (
        F.pmod(F.xxhash64("doc_id", F.lit(n)), F.greatest(F.octet_length("text") - WINDOW + 1, F.lit(1))) + 1
    ).cast("int")
    data = F.col("text").cast("binary")
    pieces = F.array(*[F.substring(data, place(n), F.lit(WINDOW)) for n in range(WINDOWS_PER_ROW)])
    rows = chosen.select("doc_id", "lang", F.posexplode(pieces).alias("n", "piece")).collect()
    rows = sorted((r for r in rows if has_letter(bytes(r["piece"]))), key=lambda r: (r["doc_id"], r["n"], r["lang"]))
    languages = sorted({r["lang"] for r in rows})
    network = ByteNetwork(languages)
    if languages:
        x = np.concatenate([windows_of(bytes(r["piece"])) for r in rows])
        network.train(x, np.array([languages.index(r["lang"]) for r in rows]))
    return network


def identify(docs: DataFrame, network: ByteNetwork, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` of every whole text, in one narrow pass.

    A null text or one without a letter is ``und`` with score 0. Repeated rows get equal answers,
    an empty table gives no rows; other columns pass through under any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def make():
        def step(columns):
            found = shared.value.predict(blobs(columns[0]))
            return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

        return step

    return append_columns(docs, [text], make, "lang_pred string, lang_score double")


def language_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
