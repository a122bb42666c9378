"""Bounded, repeatable samples of rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertweft.llm.common import bucket_of


def draw(rows: DataFrame, most: int, by: Column, salt: int = 0) -> DataFrame:
    """About ``most`` rows, chosen by a hash of ``by``: all rows if there are fewer.

    The share is set from a count, so every task keeps its own part and nothing is sorted.
    """
    total = rows.count()
    if total <= most:
        return rows
    place = F.shiftrightunsigned(F.xxhash64(by, F.lit(salt)), 12) / F.lit(float(1 << 52))
    return rows.where(place < most / total)


def labelled(labels: DataFrame, target: str, mod: int, held_out: int, id_col: str = "doc_id") -> DataFrame:
    """(id, target) of the labelled documents outside the held-out fold.

    A document with several labels takes the larger; rows without an id or a label are left out.
    """
    known = labels.where(F.col(target).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(target).cast("int").alias("target"))
    return known.where(bucket_of(F.col("id"), mod) != held_out)


def with_text(docs: DataFrame, drawn: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, target) of a drawn sample, whose size is a parameter, so it is sent to the documents."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id")


def platt(z, y, steps: int = 50) -> tuple[float, float]:
    """Scale and offset that make sigmoid(scale * z + offset) fit 0/1 outcomes, by damped Newton steps."""
    import numpy as np

    z, y = np.asarray(z, float), np.asarray(y, float)
    x = np.stack([z, np.ones_like(z)], axis=1)
    # smoothed outcomes keep the fit finite when the classes are apart
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, x.T @ (p - goal) + 1e-4 * (w - [1.0, 0.0])), -5, 5)
    return float(w[0]), float(w[1])
