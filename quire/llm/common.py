"""Pieces shared by the operators on pages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def book_facts(books: DataFrame) -> DataFrame:
    """One row a book: ``(book_id, source, title)``, of repeated rows the earliest; blank titles are null."""
    t = F.trim(F.col("metadata")["title"])
    rows = books.where("book_id IS NOT NULL").select("book_id", F.struct("ingested_at", F.col("source_path").alias("source"), F.when(t != "", t).alias("title")).alias("r"))
    return rows.groupBy("book_id").agg(F.min("r").alias("r")).select("book_id", "r.source", "r.title")


def logistic(features: list[list[str]], labels: list[int], weights: list[float] | None = None, rounds: int = 300) -> dict[str, float]:
    """Weights of a logistic model over named features (Adagrad on all examples at once)."""
    at = {x: i for i, x in enumerate(sorted({x for f in features for x in f}))}
    if not at:
        return {}
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    col = np.array([at[x] for f in features for x in f])
    y, weight = np.array(labels, float), np.array(weights or [1.0] * len(labels))
    w, size = np.zeros(len(at)), np.zeros(len(at))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(y)), -30, 30)))
        g = np.bincount(col, (weight * (p - y))[row], len(at)) / len(y) + 1e-4 * w
        size += g * g
        w -= 0.3 * g / np.sqrt(size + 1e-12)
    return {x: float(w[i]) for x, i in at.items()}
