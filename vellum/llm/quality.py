"""Quality classifier by Bradley-Terry pairwise ranking.

Of each preference pair the document labelled 1 should win; scores are linear in a document's features and
learned by logistic loss on feature differences.  The threshold is a quantile of the scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import documents, pick, without
from vellum.llm.langid import held_out

#: Bound of the labelled sample that the ranking learns from.
SAMPLE = 8000
BINS = 12
PAIRS, STEPS = 2048, 600
#: A score of this much and over is predicted as label 1; the quantile's raw score is mapped to it.
CUT = 0.3

# fixed values: byte classes of ASCII
LOWER = np.arange(97, 123)
UPPER = np.arange(65, 91)
DIGIT = np.arange(48, 58)
BLANK = np.array([9, 10, 11, 12, 13, 32])
PLAIN = np.frombuffer(b".,;:?'\"()-", np.uint8)


def features(text: str | None) -> list[float]:
    """Shape of a whole text: lengths, shares of kinds of bytes, repetition of words and lines.  Null counts as empty."""
    text = text or ""
    words, lines = text.split(), text.split("\n")
    counts = Counter(words)
    kinds = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n, w = max(1, int(kinds.sum())), max(1, len(words))
    lower, upper, digit, blank, plain, high = (int(kinds[k].sum()) for k in (LOWER, UPPER, DIGIT, BLANK, PLAIN, slice(128, 256)))
    other = int(kinds.sum()) - lower - upper - digit - blank - plain - high
    top = counts.most_common(1)[0][1] if counts else 0
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        sum(map(len, counts)) / max(1, len(counts)),
        len(text) / w,
        lower / n,
        upper / n,
        digit / n,
        blank / n,
        plain / n,
        high / n,
        other / n,
        np.log1p(other),
        len(counts) / w,
        np.log1p(len(counts)) / np.log1p(w),
        top / w,
        len(set(lines)) / len(lines),
        max(map(len, lines)) / max(1, len(text)),
        len(words) / len(lines),
        int((kinds > 0).sum()) / np.log1p(n),
    ]


def matrix(rows: list[list[float]]) -> np.ndarray:
    return np.array(rows, float).reshape(len(rows), len(features(None)))


class Model:
    def __init__(self, edges: np.ndarray, weights: np.ndarray, slope: float, threshold: float):
        self.edges, self.weights, self.slope, self.threshold = edges, weights, slope, threshold


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each feature, how far it is past each edge: 0 or 1."""
    return (x[:, :, None] > edges[None]).reshape(len(x), -1).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Model | None:
    """None if the sample lacks one of the two labels."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    rng = np.random.default_rng(seed)
    part = np.linspace(0, 1, BINS + 2)[1:-1]
    edges = np.concatenate((np.quantile(x[good], part, axis=0), np.quantile(x[bad], part, axis=0), np.quantile(x[good], (0.0, 0.01, 0.99, 1.0), axis=0))).T
    b = binned(x, edges)
    w, m, v = np.zeros(b.shape[1]), np.zeros(b.shape[1]), np.zeros(b.shape[1])
    for step in range(1, STEPS + 1):
        difference = b[rng.choice(good, PAIRS)] - b[rng.choice(bad, PAIRS)]
        wrong = 1 / (1 + np.exp(np.clip(difference @ w, -50, 50)))
        gradient = -(wrong @ difference) / PAIRS + 2e-4 * w
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    raw = b @ w
    threshold = float(np.quantile(raw, len(bad) / len(y)))
    slopes = np.exp(np.linspace(np.log(0.02), np.log(5), 80))
    loss = [np.logaddexp(0, np.where(y == 1, -1, 1) * (s * (raw - threshold) + np.log(CUT / (1 - CUT)))).mean() for s in slopes]
    return Model(edges, w, float(slopes[int(np.argmin(loss))]), threshold)


def scores(model: Model | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    z = model.slope * (binned(x, model.edges) @ model.weights - model.threshold) + np.log(CUT / (1 - CUT))
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model | None:
    """Learns from about ``sample`` labelled documents at most, chosen by hash of their key, none of them held out.

    Null labels do not count, nor keys whose labels contradict each other.
    """
    known = pick(labels, key=key, label=label).filter(F.col("label").isin(0, 1) & F.col("key").isNotNull() & ~held_out(F.col("key")))
    total = known.count()
    draw = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.filter(draw < min(1.0, sample / max(1, total))).groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], ["key", "label", "x"])

    texts = pick(docs, key=key, text=text).join(F.broadcast(drawn), "key").select(F.col("key").cast("string").alias("key"), F.col("label").cast("int").alias("label"), "text")
    rows = sorted(texts.mapInArrow(measure, "key string, label int, x array<double>").collect())
    return train(matrix([r["x"] for r in rows]), np.array([r["label"] for r in rows]))


def score(docs: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score (0 to 1, higher: better) and predicted (0 or 1); columns of these names are replaced.  Null texts count as empty.

    Without labels of both kinds to learn from, every score is 0.5.
    """
    base = without(docs, *names)
    place = base.columns.index(text)
    schema = ", ".join(f"`{c}` {t}" for c, t in base.dtypes) + f", `{names[0]}` double, `{names[1]}` int"
    # broadcasts are pickled by reference, so only the model's values go: workers need not have this package
    shared = docs.sparkSession.sparkContext.broadcast(vars(model) if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**shared.value) if shared.value else None
        for batch in batches:
            rows = [features(value.as_py()) for value in batch.column(place)]
            s = scores(m, matrix(rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32), pa.int32())], [*batch.schema.names, *names])

    return base.mapInArrow(run, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
