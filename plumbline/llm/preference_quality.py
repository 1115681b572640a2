"""Quality classifier: Bradley-Terry strengths of documents, learned from pairs of a better and a worse one.

Every document is described by a few rates of its text.  Of the labelled documents
at most ``most`` of each label are taken, by hash of the id; in each of ``rounds``
every better document meets about one worse one, as both fall into the same of as
many buckets.  Logistic loss on the difference of their descriptions gives weights, so that the
strength of a text is a weighted sum.  The cut lies between low quantiles of the
better and high quantiles of the worse documents' strengths and is shown as a
score of 0.3.

Only ``features`` of the text enter a score.  Edge cases: null and empty texts
have no words, all their rates are zero, and they are scored like any other; null
labels and ids and documents with labels that disagree teach nothing; repeated
rows are scored alike; without pairs to learn from every score is 0.5; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import materialise

MOST, ROUNDS = 10_000, 8
CUT = 0.3
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>^~@_\\", b"|", b"!?", b".,;:", b"\"'()[]{}-/+="]
_MEMBER = np.zeros((256, len(_CLASSES) + 1))
for _k, _class in enumerate(_CLASSES):
    _MEMBER[list(_class), _k] = 1
_MEMBER[[*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], -1] = 1
FEATURES = 7 + _MEMBER.shape[1]


def features(text: str) -> list[float]:
    """Rates of a text: its characters by class, its words and its lines."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * FEATURES
    classes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _MEMBER
    size, n = sum(map(len, words)), len(words)
    lines = [line for line in raw.split(b"\n") if line]
    return [
        math.log1p(n), size / n / 10, len(set(words)) / math.sqrt(n) / 10, sum(len(w) == 1 for w in words) / n,
        len(lines) / n, len(set(lines)) / len(lines), min(1.0, n / 50), *(classes / size).tolist(),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def described(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t or "") for t in texts], dtype=object)


@dataclass(frozen=True)
class Strength:
    """Weights of the features, and what turns a strength into a score."""
    weights: np.ndarray
    cut: float
    scale: float

    def scores(self, rates: np.ndarray) -> np.ndarray:
        shown = (rates @ self.weights - self.cut) / self.scale + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(shown, -36, 36)))


def _bounded(labels: DataFrame, most: int) -> DataFrame:
    """About ``most`` ids of each label: those whose hash falls under the share that is wanted."""
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(1.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, most / n))).otherwise(share)
    return labels.filter(F.pmod(F.xxhash64("label_id", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", *,
          most: int = MOST, rounds: int = ROUNDS) -> Strength:
    """The strengths that the labels in ``labels`` (1 better, 0 worse) teach."""
    told = (
        labels.select(labels[id_col].alias("label_id"), labels[label].cast("int").alias("label"))
        .filter("label_id is not null and label in (0, 1)")
        .groupBy("label_id").agg(F.min("label").alias("label"), F.max("label").alias("high")).filter("label = high").drop("high")
    )
    chosen = F.broadcast(_bounded(told, most))
    own = docs.select(docs[id_col].alias("label_id"), docs[text].alias("text"))
    sample = materialise(own.join(chosen, "label_id").select("label_id", "label", described("text").alias("rates")), "labelled")
    worse_n = sample.filter("label = 0").count()
    dealt = sample.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn(
        "bucket", F.pmod(F.xxhash64("label_id", "round"), F.lit(max(worse_n, 1))))
    better = dealt.filter("label = 1").select("round", "bucket", F.col("rates").alias("better"), F.col("label_id").alias("b"))
    worse = dealt.filter("label = 0").select("round", "bucket", F.col("rates").alias("worse"), F.col("label_id").alias("w"))
    sign = F.pmod(F.xxhash64("b", "w", "round"), F.lit(2)) * 2 - 1
    pairs = materialise(better.join(worse, ["round", "bucket"]).select(
        F.zip_with("better", "worse", lambda x, y: (x - y) * sign).alias("rates"), ((sign + 1) / 2).cast("double").alias("label")), "pairs")
    if pairs.select("label").distinct().count() < 2:
        return Strength(np.zeros(FEATURES), math.log(CUT / (1 - CUT)), 1.0)
    model = LogisticRegression(featuresCol="x", labelCol="label", fitIntercept=False, regParam=1e-4, maxIter=60).fit(
        pairs.select(array_to_vector("rates").alias("x"), "label"))
    weights = model.coefficients.toArray()
    strength = F.aggregate(F.zip_with("rates", F.array(*map(F.lit, weights.tolist())), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    of = {r["label"]: r for r in sample.select("label", strength.alias("s")).groupBy("label").agg(
        F.percentile("s", F.array(F.lit(0.01), F.lit(0.25), F.lit(0.5))).alias("low"), F.percentile("s", F.lit(0.99)).alias("high")).collect()}
    cut = (of[1]["low"][0] + of[0]["high"]) / 2
    return Strength(weights, cut, max(1e-9, (of[1]["low"][2] - of[0]["low"][2]) / 8))


def scored(strength: Strength) -> Callable[[Column], Column]:
    """The score of a text as a column function."""
    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        rates = np.array([features(t or "") for t in texts]).reshape(len(texts), FEATURES)
        return pd.Series(strength.scores(rates))
    return run


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", *,
             most: int = MOST, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: its id, ``held_out``, ``score`` and ``predicted``; a fifth of the ids, by checksum, is held out of learning."""
    held = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))
    strength = learn(docs, labels.filter(~held(labels[id_col])), id_col, text, label, most=most, rounds=rounds)
    judged = docs.select(docs[id_col].alias("id"), held(docs[id_col]).alias("held_out"), scored(strength)(docs[text]).alias("score"))
    return judged.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
