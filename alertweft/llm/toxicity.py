"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers over words and word beginnings are fitted in numpy from
confirmed toxic documents (P) and unlabelled ones (U).  With the class prior
``pi`` the risk is

    pi E_P[l(g, +1)] + max(0, E_U[l(g, -1)] - pi E_P[l(g, -1)])

where the second part estimates the risk on clean text without clean labels.
Where it falls below zero the step goes against its gradient, which stops the
fit from treating hidden positives in U as negatives.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from alertweft.llm.common import text_bytes
from alertweft.llm.labelled import draw, labelled, platt, with_text
from alertweft.session import materialise, ship

ship(__name__)

#: bounds of the samples that are fitted on
POSITIVES, UNLABELLED, CALIBRATION = 3000, 6000, 4000
#: most features of a classifier, smallest share of toxic documents that must have one, and least standardised contrast
FEATURES, SHARE, CONTRAST = 3000, 0.005, 2.0
#: different words of a document that count for one beginning at most
OFTEN = 20
#: lengths of word beginnings that are features beside the whole word
BEGINNINGS = (4, 5, 7)
#: classifiers averaged
MEMBERS = 3
THRESHOLD = 0.3

_EDGE = b".,;:!?\"'()[]{}<>*#&%$|_=+~`^/\\-"


def features_of(word: bytes) -> tuple[str, ...]:
    """Features of one raw word."""
    low = word.strip(_EDGE).decode("utf-8", "ignore").lower()
    return () if len(low) < 2 else (low, *[f"{low[:n]}-" for n in BEGINNINGS if len(low) > n])


class Reader:
    """Counts the different words of a text that have a feature, so repetition weighs nothing.

    The features of a word are remembered, only those of ``vocabulary`` if it is given.
    """

    def __init__(self, vocabulary: dict[str, int] | None = None, most: int = 500_000):
        self.seen: dict[bytes, tuple] = {}
        self.vocabulary, self.most = vocabulary, most

    def counts(self, text: bytes | None) -> Counter:
        seen, known = self.seen, self.vocabulary
        if len(seen) > self.most:
            seen.clear()
        out: Counter = Counter()
        for word in set((text or b"").split()):
            found = seen.get(word)
            if found is None:
                found = features_of(word)
                if known is not None:
                    found = tuple(known[f] for f in found if f in known)
                seen[word] = found
            for f in found:
                out[f] += 1
        return out


def strength(n):
    """What a feature of ``n`` different words counts for."""
    return np.log1p(np.minimum(n, OFTEN))


@dataclass
class Model:
    """Weights by feature, and the scale and offset of the calibrated score."""

    weights: dict[str, float]
    bias: float
    scale: float
    offset: float

    def logits(self, texts: list[bytes | None]) -> np.ndarray:
        names = list(self.weights)
        value = np.array([self.weights[n] for n in names])
        reader = Reader({n: i for i, n in enumerate(names)})
        out = np.empty(len(texts))
        for row, text in enumerate(texts):
            found = reader.counts(text)
            at, n = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.float64, len(found))
            out[row] = self.bias + (strength(n) @ value[at] if len(at) else 0.0)
        return out

    def probabilities(self, texts: list[bytes | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(texts) + self.offset, -60, 60)))


def choose(sample: DataFrame, n: int, m: int) -> list[str]:
    """Features of enough toxic documents that stand out against the unlabelled ones, the clearest first.

    ``sample`` has (text, toxic) of ``n`` toxic and ``m`` unlabelled documents.
    Tasks add up in how many documents a feature is; at most FEATURES rows come
    back.  Toxicity is shown by what is there, so features that speak for clean
    text are left out: in a long document their sum would outweigh a single insult.
    """
    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, p, u = Reader(), Counter(), Counter()

        def rows() -> pa.RecordBatch:
            names = list(p | u)
            columns = [pa.array(names, pa.string()), pa.array([p[f] for f in names], pa.int64()), pa.array([u[f] for f in names], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["feature", "p", "u"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (p if toxic else u).update(reader.counts(text).keys())
                if len(p) + len(u) > 300_000:
                    yield rows()
                    p.clear()
                    u.clear()
        yield rows()

    sums = sample.mapInArrow(presence, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    mean = (F.col("p") + F.col("u")) / (n + m)
    contrast = (F.col("p") / n - F.col("u") / m) / F.sqrt(mean * (1 - mean) * (1 / n + 1 / m) + 1e-12)
    top = sums.where(F.col("p") >= max(3, SHARE * n)).withColumn("contrast", contrast).where(F.col("contrast") >= CONTRAST)
    return [r.feature for r in top.orderBy(F.desc("contrast"), "feature").limit(FEATURES).collect()]


def matrices(sample: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(toxic, unlabelled) strengths of the chosen features; tasks send the non-zero ones."""
    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader({f: i for i, f in enumerate(names)})
        for batch in batches:
            at, value = [], []
            for text in batch.column(0).to_pylist():
                found = reader.counts(text)
                at.append(np.fromiter(found.keys(), np.int32, len(found)).tobytes())
                value.append(strength(np.fromiter(found.values(), np.float64, len(found))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(at, pa.binary()), pa.array(value, pa.binary())], names=["toxic", "at", "value"])

    rows = sample.mapInArrow(sparse, "toxic boolean, at binary, value binary").collect()
    rows.sort(key=lambda r: (bytes(r.at), bytes(r.value)))
    out = []
    for kind in (True, False):
        mine = [r for r in rows if r.toxic == kind]
        x = np.zeros((len(mine), len(names)), dtype=np.float32)
        for row, r in enumerate(mine):
            x[row, np.frombuffer(r.at, np.int32)] = np.frombuffer(r.value, np.float32)
        out.append(x)
    return out[0], out[1]


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, seed: int, epochs: int = 40, batches: int = 12,
             rate: float = 0.02, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of one linear classifier under the non-negative risk, by Adam on minibatches."""
    rng = np.random.default_rng(seed)
    w, first, second, step = np.zeros(p.shape[1] + 1), 0.0, 0.0, 0
    w[-1] = np.log(prior / (1 - prior))

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def pull(x: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(x.T @ slope, slope.sum()) / max(1, len(slope))

    for _ in range(epochs):
        parts = zip(np.array_split(rng.permutation(len(p)), batches), np.array_split(rng.permutation(len(u)), batches))
        for at_p, at_u in parts:
            if not len(at_p) or not len(at_u):
                continue
            xp, xu = p[at_p], u[at_u]
            zp, zu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
            # logistic loss: l(z, +1) = log(1 + e^-z), l(z, -1) = log(1 + e^z)
            clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            on_clean = pull(xu, sigmoid(zu)) - prior * pull(xp, sigmoid(zp))
            grad = -on_clean if clean < 0 else prior * pull(xp, sigmoid(zp) - 1) + on_clean
            grad[:-1] += decay * w[:-1]
            step += 1
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
            w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", mod: int = 4, held_out: int = 2,
          id_col: str = "doc_id", text_col: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on bounded samples: at most about ``positives`` toxic and ``unlabelled`` documents.

    The class prior is the toxic share of the labelled rows outside the held-out
    fold; these rows also calibrate the score.  Clean labels are not used to fit
    the classifiers.  Without any toxic document the score is constant.
    """
    known = labelled(labels, target, mod, held_out, id_col)
    totals = known.agg(F.count(F.lit(1)), F.sum("target")).first()
    prior = min(0.9, max(1e-3, (totals[1] or 0) / max(1, totals[0])))
    toxic = with_text(docs, draw(known.where("target = 1"), positives, F.col("id")), id_col, text_col)
    pool = draw(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), unlabelled, F.col("id"), salt=1)
    sample = materialise(
        toxic.select(text_bytes().alias("text"), F.lit(True).alias("toxic")).unionByName(
            pool.select(text_bytes().alias("text"), F.lit(False).alias("toxic"))), "toxicity-sample")
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    names = choose(sample, sizes[True], sizes[False]) if len(sizes) == 2 else []
    if not names:
        return Model({}, float(np.log(prior / (1 - prior))), 1.0, 0.0)
    xp, xu = matrices(sample, names)
    fits = [fit_nnpu(xp, xu, prior, seed) for seed in range(MEMBERS)]
    weights, bias = np.mean([f[0] for f in fits], axis=0), float(np.mean([f[1] for f in fits]))
    model = Model({n: float(w) for n, w in zip(names, weights) if abs(w) > 1e-4}, bias, 1.0, 0.0)
    judged = with_text(docs, draw(known, CALIBRATION, F.col("id"), salt=2), id_col, text_col).select(text_bytes().alias("text"), "target")

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.logits(batch.column(0).to_pylist())), batch.column(1)], names=["z", "y"])

    pairs = sorted((r.z, r.y) for r in judged.mapInArrow(raw, "z double, y int").collect())
    model.scale, model.offset = platt([z for z, _ in pairs], [y for _, y in pairs])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row over its whole text; a null or empty text scores by the bias alone.

    Repeated rows score alike, other columns are not read, an empty table gives no rows.
    """
    narrow = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    schema = T.StructType([narrow.schema["id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.probabilities(batch.column(1).to_pylist()))], names=["id", "score"])

    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below ``threshold``, with all their columns, whatever their names; repeated rows score alike."""
    place, names = docs.columns.index(text_col), docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else t.encode() for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(model.probabilities(texts) < threshold))

    return rows.mapInArrow(run, rows.schema).toDF(*names)
