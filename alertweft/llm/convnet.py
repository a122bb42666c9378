"""Document quality by a byte-level convolutional network in numpy.

Every byte becomes a fixed vector (its character class and a few hash signs).
Learned filters of WIDTH bytes slide over the text with a stride; each
overlapping chunk keeps the largest response per filter.  The document is the
largest and the mean chunk response of every filter, joined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from alertweft.llm.common import text_bytes
from alertweft.llm.labelled import draw, labelled, platt, with_text
from alertweft.session import ship

ship(__name__)

#: bytes of a chunk and from one chunk to the next; both are multiples of the stride
CHUNK, STEP = 512, 448
WIDTH, STRIDE, FILTERS = 12, 4, 24
#: chunks convolved at a time, which bounds the memory for long texts
GROUP = 256
#: bound of the labelled sample; its texts are read whole
SAMPLE = 6000


def byte_vectors() -> np.ndarray:
    """256 rows: character classes and four hash signs."""
    code = np.arange(256)
    classes = [
        (code >= 97) & (code <= 122), (code >= 65) & (code <= 90), (code >= 48) & (code <= 57), code == 32, (code == 10) | (code == 9),
        np.isin(code, list(b".,;:'\"-")), (code > 32) & (code < 127) & ~np.isin(code, list(b".,;:'\"-"))
        & ~((code >= 97) & (code <= 122)) & ~((code >= 65) & (code <= 90)) & ~((code >= 48) & (code <= 57)), code >= 128,
    ]
    signs = np.random.default_rng(11).choice([-0.5, 0.5], size=(4, 256))
    out = np.vstack([np.array(classes, dtype=np.float32), signs]).T.astype(np.float32)
    out[0] = 0  # padding
    return np.ascontiguousarray(out)


def patches(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(..., positions, WIDTH * dims) of byte rows whose length is a multiple of the stride plus the filter's overhang."""
    wide = table[raw]
    lead, n, dims = wide.shape[:-2], wide.shape[-2], wide.shape[-1]
    positions = (n - WIDTH) // STRIDE + 1
    s = wide.strides
    view = np.lib.stride_tricks.as_strided(wide, (*lead, positions, WIDTH * dims), (*s[:-2], STRIDE * s[-2], s[-1]))
    return view


@dataclass
class Model:
    """Filters and the weights over pooled responses."""

    filters: np.ndarray
    shift: np.ndarray
    top: np.ndarray
    mean: np.ndarray
    bias: float
    scale: float = 1.0
    offset: float = 0.0

    def logit(self, text: bytes | None, table: np.ndarray) -> float:
        raw = np.frombuffer(text or b"", dtype=np.uint8)
        chunks = max(1, -(-max(0, len(raw) - CHUNK) // STEP) + 1)
        best = np.full(len(self.shift), -np.inf, dtype=np.float32)
        total = np.zeros(len(self.shift))
        per, hop = (CHUNK - WIDTH) // STRIDE + 1, STEP // STRIDE
        for at in range(0, chunks, GROUP):
            n = min(GROUP, chunks - at)
            span = (n - 1) * STEP + CHUNK
            part = raw[at * STEP : at * STEP + span]
            if len(part) < span:
                part = np.concatenate([part, np.zeros(span - len(part), dtype=np.uint8)])
            out = patches(part, table) @ self.filters
            starts = np.arange(n) * hop
            ends = starts + per
            rows = np.stack([starts, np.minimum(ends, len(out))], axis=1).ravel()
            out = np.vstack([out, out[-1:]])
            pooled = np.maximum.reduceat(out, rows, axis=0)[::2] + self.shift
            pooled = np.maximum(pooled, 0)
            best = np.maximum(best, pooled.max(axis=0))
            total += pooled.sum(axis=0)
        return float(self.bias + best @ self.top + (total / chunks) @ self.mean)

    def probabilities(self, texts: list[bytes | None]) -> np.ndarray:
        table = byte_vectors()
        z = np.array([self.logit(t, table) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.offset, -60, 60)))


def chunks_of(text: bytes | None) -> np.ndarray:
    """All chunks of a text, zero-padded."""
    raw = text or b""
    chunks = max(1, -(-max(0, len(raw) - CHUNK) // STEP) + 1)
    padded = np.frombuffer(raw.ljust((chunks - 1) * STEP + CHUNK, b"\0"), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


def fit(docs: list[bytes | None], y: np.ndarray, epochs: int = 16, batch: int = 32, rate: float = 0.01, seed: int = 1) -> Model:
    """Adam on the logistic loss; the gradient reaches a filter through the patches that won the pooling.

    Every chunk of a text takes part; GROUP of them are convolved at a time, which bounds the memory.
    """
    rng, table = np.random.default_rng(seed), byte_vectors()
    size = WIDTH * table.shape[1]
    share = y.mean() if len(y) else 0.5
    params = {
        "filters": rng.normal(scale=size**-0.5, size=(size, FILTERS)), "shift": np.zeros(FILTERS), "top": rng.normal(scale=0.1, size=FILTERS),
        "mean": rng.normal(scale=0.1, size=FILTERS), "bias": np.array(np.log((share + 1e-3) / (1 - share + 1e-3))),
    }
    first, second, step = {k: 0.0 for k in params}, {k: 0.0 for k in params}, 0
    for epoch in range(epochs if len(docs) else 0):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            mine = order[at : at + batch]
            pieces = [chunks_of(docs[i]) for i in mine]
            sizes = np.array([len(p) for p in pieces])
            owner, cuts = np.repeat(np.arange(len(mine)), sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            raw, kernel = np.concatenate(pieces), params["filters"].astype(np.float32)
            pooled, won = np.empty((len(raw), FILTERS)), np.empty((len(raw), FILTERS), dtype=np.int64)
            for lo in range(0, len(raw), GROUP):
                out = patches(raw[lo : lo + GROUP], table) @ kernel
                won[lo : lo + GROUP] = out.argmax(axis=1)
                pooled[lo : lo + GROUP] = out.max(axis=1)
            pooled += params["shift"]
            live = pooled > 0
            pooled = pooled * live
            best = np.maximum.reduceat(pooled, cuts, axis=0)
            mean = np.add.reduceat(pooled, cuts, axis=0) / sizes[:, None]
            z = best @ params["top"] + mean @ params["mean"] + params["bias"]
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[mine]) / len(mine)
            # each chunk gets its share of the mean, and the first chunk with the largest response that of the maximum
            is_best = pooled == best[owner]
            taken = np.add.reduceat(is_best.astype(float), cuts, axis=0)[owner]
            back = (slope[:, None] * params["mean"] / sizes[:, None])[owner] + (slope[:, None] * params["top"])[owner] * is_best / taken
            back = back * live
            pull = np.zeros_like(params["filters"])
            for lo in range(0, len(raw), GROUP):
                x = patches(raw[lo : lo + GROUP], table)
                best_patches = x[np.arange(len(x))[:, None], won[lo : lo + GROUP]].astype(np.float64)
                pull += np.einsum("cfs,cf->sf", best_patches, back[lo : lo + GROUP], optimize=True)
            grad = {
                "top": best.T @ slope, "mean": mean.T @ slope, "bias": slope.sum(), "shift": back.sum(axis=0),
                "filters": pull + 1e-4 * params["filters"],
            }
            step += 1
            for k, g in grad.items():
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
                pace = rate * (0.5 ** (2 * epoch / max(1, epochs)))
                params[k] = params[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(params["filters"].astype(np.float32), params["shift"].astype(np.float32), params["top"], params["mean"], float(params["bias"]))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", mod: int = 5, held_out: int = 0,
          id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on the whole texts of about ``sample`` labelled documents outside the held-out fold.

    The texts of the sample are held by the driver.  A last part of the sample is
    kept back to calibrate the score, on whole texts as they are scored.
    """
    known = draw(labelled(labels, target, mod, held_out, id_col), sample, F.col("id"))
    rows = with_text(docs, known, id_col, text_col).select(F.col("id"), "target", text_bytes().alias("text"))
    found = sorted(rows.collect(), key=lambda r: (r.id, r.target, r.text or b""))
    order = np.random.default_rng(7).permutation(len(found))
    texts = [None if found[i].text is None else bytes(found[i].text) for i in order]
    y = np.array([found[i].target for i in order], dtype=float)
    kept = len(texts) - len(texts) // 5
    model = fit(texts[:kept], y[:kept])
    if len(texts) - kept >= 10:
        table = byte_vectors()
        model.scale, model.offset = platt([model.logit(t, table) for t in texts[kept:]], y[kept:])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; chunks cover the whole text, and a null or empty text is one chunk of padding.

    Repeated rows score alike, other columns are not read, an empty table gives no rows.
    """
    narrow = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    schema = T.StructType([narrow.schema["id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.probabilities(batch.column(1).to_pylist()))], names=["id", "score"])

    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)
