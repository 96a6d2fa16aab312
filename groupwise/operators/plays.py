"""Ranked choices and comparisons of two groups, with delta-method errors from a choice model's covariance."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _shares(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    u = x @ theta
    u -= u.max(axis=1, keepdims=True)
    q = np.exp(u)
    return q / q.sum(axis=1, keepdims=True)


def _priced(x: np.ndarray, theta: np.ndarray, prices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shares, contributions a hundred, their gradients in theta) of each choice of each row."""
    q = _shares(x, theta)
    mean = np.einsum("nk,nkp->np", q, x)
    gradient = 100 * prices[None, :, None] * q[:, :, None] * (x - mean[:, None, :])
    return q, 100 * prices * q, gradient


def _bands(value: np.ndarray, gradient: np.ndarray, covariance: np.ndarray, z: float) -> np.ndarray:
    """Band numbers from 1, best first: a choice opens a band if it is separable from all of the current one, by the error of the difference."""
    order = np.lexsort((np.arange(len(value)), -value))
    band, current, out = 0, [], np.zeros(len(value), int)
    for i in order:
        apart = all(abs(value[i] - value[j]) > z * np.sqrt(max(0.0, (d := gradient[i] - gradient[j]) @ covariance @ d)) for j in current)
        if apart:
            band, current = band + 1, []
        current.append(i)
        out[i] = band
    return out


def rank_plays(df: DataFrame, request: str, design: str, names: list[str], theta: np.ndarray, covariance: np.ndarray, prices: list[float], confidence: float = 0.8, floor: float = 0.01, usual: list[float] | None = None) -> DataFrame:
    """(request, choice, share, value, error, band): what each choice is worth a hundred times beyond its usual share, in bands that the evidence separates.

    usual are the shares of an average mix, none if not given; they are fixed, so errors are those of the shares.

    Choices below the floor share are left out of the ranking, with band null. Requests are worked on in batches, no rows meet.
    """
    n, p, z = len(names), len(theta), NormalDist().inv_cdf(0.5 + confidence / 2)
    theta, covariance, price = np.asarray(theta, float), np.asarray(covariance, float), np.asarray(prices, float)
    worth = 100 * price * np.asarray(usual if usual is not None else np.zeros(n), float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            q, value, gradient = _priced(np.stack(batch["x"].to_numpy()).astype(float).reshape(-1, n, p), theta, price)
            value = value - worth
            error = np.sqrt(np.maximum(np.einsum("nkp,pq,nkq->nk", gradient, covariance, gradient), 0))
            band = np.full(q.shape, np.nan)
            for i in range(len(q)):
                kept = np.flatnonzero(q[i] >= floor)
                band[i, kept] = _bands(value[i, kept], gradient[i, kept], covariance, z)
            yield pd.DataFrame({"request": np.repeat(batch["request"].to_numpy(), n), "choice": names * len(q), "share": q.ravel(), "value": value.ravel(), "error": error.ravel(), "band": pd.array(band.ravel(), "Int64")})

    of = df.schema[request].dataType.simpleString()
    return df.select(F.col(request).alias("request"), F.col(design).cast("array<double>").alias("x")).mapInPandas(run, f"request {of}, choice string, share double, value double, error double, band long")


def compare(df: DataFrame, request: str, left: str, right: str, names: list[str], theta: np.ndarray, covariance: np.ndarray, prices: list[float], confidence: float = 0.8) -> DataFrame:
    """(request, choice, delta_share, delta, error, separable): what the left group's design is worth more than the right's, by choice and in all ("total").

    Errors are those of the difference, so what both sides share cancels; a group against itself is exactly zero.
    """
    n, p, z = len(names), len(theta), NormalDist().inv_cdf(0.5 + confidence / 2)
    theta, covariance, price = np.asarray(theta, float), np.asarray(covariance, float), np.asarray(prices, float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = (_priced(np.stack(batch[s].to_numpy()).astype(float).reshape(-1, n, p), theta, price) for s in ("l", "r"))
            share, value, gradient = (np.concatenate((x - y, (x - y).sum(axis=1, keepdims=True)), axis=1) for x, y in zip(a, b, strict=True))
            error = np.sqrt(np.maximum(np.einsum("nkp,pq,nkq->nk", gradient, covariance, gradient), 0))
            yield pd.DataFrame({"request": np.repeat(batch["request"].to_numpy(), n + 1), "choice": [*names, "total"] * len(value), "delta_share": share.ravel(), "delta": value.ravel(), "error": error.ravel(), "separable": (np.abs(value) > z * error).ravel()})

    of = df.schema[request].dataType.simpleString()
    cast = lambda c, n: F.col(c).cast("array<double>").alias(n)
    return df.select(F.col(request).alias("request"), cast(left, "l"), cast(right, "r")).mapInPandas(run, f"request {of}, choice string, delta_share double, delta double, error double, separable boolean")
