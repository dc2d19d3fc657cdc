"""Quality classifier: regularised quadratic discriminant over statistics of the text.

Every text becomes FEATURES numbers (shares, lengths and rates, transformed so that they are not
far from symmetric). Per class the learner needs the count, the sum and the sum of outer products,
which add up over the cluster in one pass of all labelled training rows. Each class covariance is
shrunk towards the pooled one and that towards its mean variance; the Cholesky factors are worked
out once and sent with the model, and a text's score comes from the difference of two Mahalanobis
log densities. The score is calibrated by the share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlines.llm.texts import held_out_remainder, map_texts

THRESHOLD = 0.3
HELD_OUT = 0
#: Share of the pooled covariance in a class covariance, and of a multiple of one in the pooled one.
TO_POOLED = 0.1
TO_SPHERE = 0.01
#: Log densities are tempered by this factor, for statistics are far from independent normals.
TEMPER = 0.1

_KIND = np.zeros(256, np.int64)
SPACE, UPPER, LOWER, DIGIT, SYMBOL, STOP, OTHER, LEAD, INNER = range(9)
_KIND[:] = OTHER
for _kind, _bytes in (
    (SPACE, b" \t\n\v\f\r"),
    (UPPER, bytes(range(65, 91))),
    (LOWER, bytes(range(97, 123))),
    (DIGIT, b"0123456789"),
    (SYMBOL, b"#*$%&|<>=+@^~_{}[]\\/"),
    (STOP, b".,;:!?"),
    (LEAD, bytes(range(0xC0, 256))),
    (INNER, bytes(range(0x80, 0xC0))),
):
    _KIND[list(_bytes)] = _kind

FEATURES = (
    "log_words", "log_lines", "word_length", "word_spread", "upper", "digits", "symbols", "stops", "non_ascii",
    "distinct_words", "distinct_lines", "top_word", "repeat_pairs", "line_length", "stop_variety", "exclamations",
)


def features(text: bytes | None) -> list[float]:
    """The statistics of one text; an empty one has those of no words."""
    text = text or b""
    words = text.split()
    bytes_of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, bytes_of, minlength=9)
    letters = kinds[UPPER] + kinds[LOWER] + kinds[LEAD]
    seen = letters + kinds[DIGIT] + kinds[SYMBOL] + kinds[STOP] + kinds[OTHER]
    n = len(words)
    lengths = np.fromiter(map(len, words), np.float64, n)
    lines = [line for line in text.split(b"\n") if line.strip()]
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    pairs = len(set(zip(words, words[1:])))

    def rate(part: float, whole: float) -> float:
        """A share on the logit scale, drawn in so that none and all stay finite."""
        share = (part + 0.5) / (whole + 1.0)
        return float(np.log(share / (1.0 - share))) if share < 1 else 20.0

    return [
        float(np.log1p(n)),
        float(np.log1p(len(lines))),
        float(np.log1p(lengths.mean())) if n else 0.0,
        float(np.log1p(lengths.std())) if n else 0.0,
        rate(kinds[UPPER], letters),
        rate(kinds[DIGIT], seen),
        rate(kinds[SYMBOL], seen),
        rate(kinds[STOP], seen),
        rate(kinds[LEAD], letters),
        float(np.sqrt(len(counts) / n)) if n else 1.0,
        len(set(lines)) / len(lines) if lines else 1.0,
        rate(max(counts.values(), default=0), n),
        pairs / (n - 1) if n > 1 else 1.0,
        float(np.log1p(n / len(lines))) if lines else 0.0,
        rate(bytes_of[ord(".")], kinds[STOP]),
        rate(bytes_of[ord("!")], seen),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Means, Cholesky factors and log determinants of both classes."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_odds: float

    def score(self, values: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row of features."""
        logs = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets):
            scaled = np.linalg.solve(factor, (values - mean).T)
            logs.append(-0.5 * ((scaled**2).sum(axis=0) + log_det))
        difference = TEMPER * (logs[1] - logs[0]) + self.log_odds
        return 1.0 / (1.0 + np.exp(-np.clip(difference, -500, 500)))


def discriminant(moments: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Discriminant:
    """The model from (count, sum, sum of outer products) of the labels 0 and 1.

    A class without rows takes the moments of the other one and gets odds by its count plus one;
    without any row every text scores one half.
    """
    width = len(FEATURES)
    means, scatters, counts = [], [], []
    for label in (0, 1):
        n, total, outer = moments.get(label) or moments.get(1 - label) or (1, np.zeros(width), np.eye(width))
        mean = total / n
        means.append(mean)
        scatters.append(outer / n - np.outer(mean, mean))
        counts.append(moments[label][0] if label in moments else 0)
    weights = (np.array(counts) + 1) / (sum(counts) + 2)
    pooled = weights[0] * scatters[0] + weights[1] * scatters[1]
    pooled = (1 - TO_SPHERE) * pooled + TO_SPHERE * (np.trace(pooled) / width + 1e-6) * np.eye(width)
    factors, log_dets = [], []
    for scatter in scatters:
        factor = np.linalg.cholesky((1 - TO_POOLED) * scatter + TO_POOLED * pooled)
        factors.append(factor)
        log_dets.append(2 * np.log(np.diag(factor)).sum())
    odds = float(np.log(weights[1] / weights[0]))
    return Discriminant(np.array(means), np.array(factors), np.array(log_dets), odds)


def text_features(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the array ``features`` of every whole text; see ``FEATURES`` for its order."""

    def compute(texts: list[bytes | None]) -> list:
        return [[features(t) for t in texts]]

    return map_texts(docs, compute, "features array<double>", text, keep)


def learn(rows: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Discriminant:
    """The model from all rows of ``text_features`` whose key has a label 0 or 1 and is not held out.

    Moments are summed per task and then over the tasks, so only their last digits depend on the
    partitioning. Rows with a null key or label teach nothing; a repeated row or label counts again.
    """
    marked = labels.where(F.col(label).isin(0, 1)).select(
        F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")
    )
    training = rows.where(held_out_remainder(key) != HELD_OUT).select(F.col(key).alias("_key"), "features")
    rows = training.join(marked, "_key").select("_label", "features")
    width = len(FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            of = batch.column("_label").to_numpy()
            values = batch.column("features").flatten().to_numpy().reshape(-1, width)
            for value in np.unique(of).tolist():
                x = values[of == value]
                old = found.get(value, [0, np.zeros(width), np.zeros((width, width))])
                found[value] = [old[0] + len(x), old[1] + x.sum(axis=0), old[2] + x.T @ x]
        kept = sorted(found)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kept, pa.int32()),
                pa.array([np.r_[found[k][0], found[k][1], found[k][2].ravel()].tolist() for k in kept], pa.list_(pa.float64())),
            ],
            ["label", "moments"],
        )

    parts = rows.mapInArrow(sums, "label int, moments array<double>")
    totals = parts.select("label", F.posexplode("moments").alias("place", "value")).groupBy("label", "place").agg(
        F.sum("value").alias("value")
    )
    size = 1 + width + width * width
    vectors: dict[int, np.ndarray] = {}
    for row in totals.collect():  # two labels, a fixed number of moments
        vectors.setdefault(row["label"], np.zeros(size))[row["place"]] = row["value"]
    return discriminant(
        {k: (int(v[0]), v[1 : 1 + width], v[1 + width :].reshape(width, width)) for k, v in vectors.items()}
    )


def score_quality(
    rows: DataFrame, model: Discriminant, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Adds score (probability of label 1) and predicted (1 if score >= ``threshold``) to ``keep``.

    ``rows`` come from ``text_features``; nothing but the text enters a score. Null and empty texts
    are scored by the statistics of no words. Repeated rows get equal scores; an empty table gives
    none. A kept column with the name of a result gives way to it.
    """
    kept = [name for name in keep if name not in ("score", "predicted")]
    source = rows.select(*kept, "features")
    schema = T.StructType([source.schema[name] for name in kept] + [T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(len(kept)).flatten().to_numpy().reshape(-1, len(FEATURES))
            passed = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*passed, pa.array(model.score(values))], names=schema.names)

    scored = source.mapInArrow(score, schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
