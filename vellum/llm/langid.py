"""Language identification: averaged hashed subword embeddings under a linear softmax (Joulin et al., 2016),
trained by stochastic gradient descent in numpy, with calibrated confidence and rejection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import documents, pick, without

BUCKETS = 1 << 16
DIMENSIONS = 16
#: Characters featurised at once; a longer text is taken in pieces of this length, whose grams are added up.
PIECE = 1 << 20
UNDETERMINED = "und"
#: Bounds of the training sample: so many documents of each label, and so many in all, but one of each label at least.
SAMPLE_PER_LABEL = 600
SAMPLE = 4000
#: Of each document of the sample one stretch of so many characters, wherever a hash of the document says.
SAMPLE_CHARS = 50_000
#: Of labelled documents at most this share may be rejected, and none of a confidence of a half or more.
REJECTED = 0.001


def held_out(key: Column) -> Column:
    """Whether a document is kept from training: crc32 of the key's text is a multiple of 5 (null: as the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_ids(text: str, is_letter: np.ndarray) -> np.ndarray:
    """Buckets of all 2- and 3-grams of the lower-cased letters, each run of anything else read as one space."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = is_letter[points]
    points = np.where(letter, points, np.uint32(32))
    points = points[letter | np.concatenate(([True], letter[:-1]))].astype(np.uint32)
    if len(points) < 3:
        return np.empty(0, np.int64)
    two = points[:-1] * np.uint32(0x9E3779B1) ^ points[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) ^ points[2:] * np.uint32(0x27D4EB2F)
    return (np.concatenate((two, three * np.uint32(0x165667B1))) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int64)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """labels, and per bucket its embedding; for few labels the embedding times the softmax weights: as both are linear, that product is all that scoring needs."""

    def __init__(self, labels: list[str], table: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        few = table.shape[1] > len(labels)
        self.labels, self.bias, self.temperature, self.threshold = labels, bias, temperature, threshold
        self.table, self.weights = (table @ weights, np.eye(len(labels), dtype=np.float32)) if few else (table, weights)


def logits(model: Model, text: str, is_letter: np.ndarray) -> np.ndarray | None:
    """The mean score of a text's grams; None if it has no letter."""
    total, n = np.zeros(model.table.shape[1]), 0
    for at in range(0, len(text), PIECE):
        ids = gram_ids(text[at : at + PIECE], is_letter)
        n += len(ids)
        total += np.bincount(ids, minlength=BUCKETS) @ model.table if len(ids) > BUCKETS else model.table[ids].sum(axis=0, dtype=np.float64)
    return total / n @ model.weights + model.bias if n else None


def spans(text: str, rng: np.random.Generator, count: int) -> list[str]:
    """Training examples of one document: short and long stretches, and its first and last 2000 characters."""
    found = [text[:2000], text[-2000:]]
    for _ in range(count):
        length = int(np.exp(rng.uniform(np.log(10), np.log(400))))
        at = int(rng.integers(0, max(1, len(text) - length)))
        found.append(text[at : at + length])
    return found


def train(samples: list[tuple[str, str]], epochs: int = 4, rate: float = 0.6, seed: int = 7) -> Model:
    """Fits the model to (label, text) pairs; a fifth of them sets temperature and rejection threshold instead."""
    rng, is_letter = np.random.default_rng(seed), letters()
    samples = sorted(samples)
    order = rng.permutation(len(samples))
    aside = {int(i) for i in order[: len(samples) // 5]}
    labels = sorted({label for label, _ in samples})
    place = {label: k for k, label in enumerate(labels)}
    # two bytes an id: the driver holds the grams of all examples
    examples = [(place[samples[i][0]], ids.astype(np.uint16)) for i in range(len(samples)) if i not in aside for s in spans(samples[i][1], rng, 6) if len(ids := gram_ids(s, is_letter))]
    embedding = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    weights, bias = np.zeros((DIMENSIONS, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    steps, done = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            label, ids = examples[i]
            step = rate * (1 - done / steps)
            hidden = embedding[ids].mean(axis=0)
            error = softmax(hidden @ weights + bias)
            error[label] -= 1
            back = weights @ error
            weights -= step * np.outer(hidden, error)
            bias -= 0.1 * step * error
            at, n = np.unique(ids, return_counts=True)
            embedding[at] -= (step / len(ids)) * n[:, None].astype(np.float32) * back
            done += 1
    model = Model(labels, embedding, weights, bias.astype(np.float64))
    z, y, whole = [], [], []
    for i in sorted(aside):
        label, text = samples[i]
        for k, s in enumerate([text, *spans(text, rng, 3)]):
            if (v := logits(model, s, is_letter)) is not None:
                z.append(v), y.append(place[label]), whole.append(k == 0)
    if z:
        z, y, whole = np.array(z), np.array(y), np.array(whole)
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        model.temperature = float(min(grid, key=lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()))
        model.threshold = float(min(0.5, np.quantile(softmax(z[whole] / model.temperature).max(axis=1), REJECTED)))
    return model


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Learns from at most ``per_label`` documents, chosen by a hash of key and text, of each label, SAMPLE in all; of more labels than that, one of each.

    At most SAMPLE_CHARS characters of each count.  Only documents that are not held out and have a text with a letter and a non-null label count.
    """
    labelled = pick(docs, key=key, text=text, label=label).filter(~held_out(F.col("key")) & F.col("label").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("label").count().collect()
    if not counts:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0))
    per_label = max(1, min(per_label, SAMPLE // len(counts)))
    # a row a label, as the model has a column: of few documents of a label more are drawn than are needed, so that one is among them
    chances = docs.sparkSession.createDataFrame([(c["label"], min(1.0, (1.3 * per_label + 12) / c["count"])) for c in counts], "label string, chance double")
    mark = F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("")), "text")
    draw = F.pmod(mark, F.lit(1 << 30)) / float(1 << 30)
    drawn = labelled.join(F.broadcast(chances), "label").filter(draw < F.col("chance")).select("label", "text", draw.alias("draw"), mark.alias("mark"))
    start = F.pmod(F.col("mark"), F.greatest(F.lit(1), F.char_length("text") - SAMPLE_CHARS + 1)).cast("int") + 1
    drawn = drawn.select("label", F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("text"), "draw")
    taken: dict[str, list] = {}
    for row in drawn.collect():
        taken.setdefault(row["label"], []).append((row["draw"], row["text"]))
    return train([(k, t) for k, rows in taken.items() for _, t in sorted(rows)[:per_label] if any(map(str.isalpha, t))])


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with predicted language, its probability, and whether the prediction is rejected; columns of these names are replaced.

    A null text, one without a letter, or any text if there was nothing to learn from, is ``und``, score 0 and rejected.
    """
    base = without(docs, *names)
    place = base.columns.index(text)
    schema = ", ".join(f"`{c}` {t}" for c, t in base.dtypes) + f", `{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean"
    # broadcasts are pickled by reference, so only the model's values go: workers need not have this package
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, is_letter = Model(**shared.value), letters()
        for batch in batches:
            best, score = [], []
            for value in batch.column(place):
                t = value.as_py()
                z = logits(m, t, is_letter) if t and m.labels else None
                p = softmax(z / m.temperature) if z is not None else None
                best.append(UNDETERMINED if p is None else m.labels[int(p.argmax())])
                score.append(0.0 if p is None else float(p.max()))
            rejected = [b == UNDETERMINED or s < m.threshold for b, s in zip(best, score, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*batch.schema.names, *names])

    return base.mapInArrow(run, schema)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = predict(docs.select("doc_id", "text"), fit(docs))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
