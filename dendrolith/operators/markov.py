"""Transition probabilities and site rates for columns of times and shapes; the model goes to every task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendrolith.functions.models import SiteRates, SubstitutionModel


def taylor_exponential(q: np.ndarray, t: float, terms: int = 24) -> np.ndarray:
    """exp(q t) by a series on a scaled-down matrix, squared back up: for matrices that have no eigenvectors to go by."""
    a = np.asarray(q, dtype=float) * t
    halvings = max(0, int(np.ceil(np.log2(max(np.abs(a).sum(axis=1).max(initial=0.0), 1e-300)))) + 1)
    a = a / 2.0**halvings
    out = term = np.eye(len(a))
    for k in range(1, terms):
        term = term @ a / k
        out = out + term
    for _ in range(halvings):
        out = out @ out
    return out


def _cells(df: DataFrame, key: str, value: str, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(key, i, j, p): the matrix that ``work`` gives for each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p = work(b.column("v").to_numpy(zero_copy_only=False))
            n = p.shape[-1]
            place = np.tile(np.arange(n * n, dtype=np.int32), len(p))
            keys = b.column("key").take(pa.array(np.repeat(np.arange(len(p)), n * n)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(place // n), pa.array(place % n), pa.array(p.reshape(-1))], names=["key", "i", "j", "p"])

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(value).cast("double").alias("v"))
    return rows.mapInArrow(run, "key long, i int, j int, p double").withColumnRenamed("key", key)


def transitions(df: DataFrame, key: str, time: str, model: SubstitutionModel, order: int = 0) -> DataFrame:
    """(key, i, j, p): P(t) of every row's time, or its derivative by t."""
    return _cells(df, key, time, lambda t: model.dp(t, order) if order else model.p(t))


def exponentials(df: DataFrame, key: str, time: str, q: np.ndarray) -> DataFrame:
    """(key, i, j, p): exp(q t) by the series."""
    return _cells(df, key, time, lambda t: np.array([taylor_exponential(q, x) for x in t]))


def categories(df: DataFrame, key: str, shape: str, rates: Callable[[float], SiteRates]) -> DataFrame:
    """(key, category, rate, weight) of every row's shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [rates(x) for x in b.column("v").to_pylist()]
            sizes = [len(f.rates) for f in found]
            keys = b.column("key").take(pa.array(np.repeat(np.arange(len(found)), sizes), pa.int64()))
            flat = lambda get: pa.array(np.concatenate([get(f) for f in found]) if found else np.zeros(0))
            place = pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) if found else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([keys, place, flat(lambda f: f.rates), flat(lambda f: f.weights)], names=["key", "category", "rate", "weight"])

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(shape).cast("double").alias("v"))
    return rows.mapInArrow(run, "key long, category int, rate double, weight double").withColumnRenamed("key", key)


def branch_lengths(durations: DataFrame, rates: DataFrame, on: Sequence[str], duration: str = "duration", rate: str = "rate") -> DataFrame:
    """Adds ``length``: each branch's duration times the rate of its class."""
    return durations.join(rates, list(on)).withColumn("length", F.col(duration) * F.col(rate))
