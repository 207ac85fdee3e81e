"""BG/NBD model of repeat buying, fitted on executors (ML-14, UDF-02).

A history is (x, t_x, t): repeat purchases, time of the last one, time watched.
The likelihood is the published one with its gamma and beta functions of whole
counts written as rising factorials, (v)_x = v (v + 1) ... (v + x - 1):

    L = (r)_x alpha^r (alpha + t)^-(r+x) * (b)_x / (a+b)_x * (1 + q)
    q = a / (b + x - 1) * ((alpha + t) / (alpha + t_x))^(r+x)  for x > 0, else 0

so one table of running sums by frequency serves all histories of a task, and
its derivatives need no special function either. Equal histories are counted
first. Every evaluation is one job whose tasks return a partial sum of the
value and of the four slopes for each candidate; the driver holds only those.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopledger.session import cut_lineage

PARAMS = ("r", "alpha", "a", "b")
SLOPES = tuple(f"d_{p}" for p in PARAMS)
STEPS = (1.0, 0.5, 0.25, 0.0625)
LONGEST_MOVE = 2.0
#: Logarithms of parameters stay within this bound: customers who all buy at one rate have no finite best r and alpha.
BOUND = 12.0
#: A fit ends without convergence after so many rounds in a row that gain less than this per customer.
FLAT_ROUNDS, LEAST_GAIN = 3, 1e-9


class Fit(NamedTuple):
    """Parameters, negative log likelihood, largest slope per customer of a log parameter, and whether that is under the tolerance."""

    params: dict[str, float]
    nll: float
    slope: float
    converged: bool
    rounds: int
    customers: int


def rising(base: float, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of (base)_x for x = 0..top, and their derivatives by base."""
    terms = base + np.arange(top)
    return np.append(0.0, np.cumsum(np.log(terms))), np.append(0.0, np.cumsum(1.0 / terms))


def negative_log_likelihood(x: np.ndarray, t_x: np.ndarray, t: np.ndarray, n: np.ndarray, p: Sequence[float]) -> np.ndarray:
    """Sum over histories that stand for n customers each, and its derivatives by r, alpha, a and b."""
    r, alpha, a, b = p
    top = int(x.max(initial=0))
    (log_r, by_r), (log_b, by_b), (log_ab, by_ab) = rising(r, top), rising(b, top), rising(a + b, top)
    repeat = x > 0
    spread = np.log1p((t - t_x) / (alpha + t_x))
    far = np.log1p(t / alpha)
    beyond = np.where(repeat, b + x - 1.0, 1.0)
    log_q = np.where(repeat, np.log(a) - np.log(beyond) + (r + x) * spread, -np.inf)
    gone = np.where(repeat, np.exp(-np.logaddexp(0.0, -np.where(repeat, log_q, 0.0))), 0.0)  # q / (1 + q)
    value = log_r[x] - x * np.log(alpha + t) - r * far + log_b[x] - log_ab[x] + np.logaddexp(0.0, log_q)
    slopes = (
        by_r[x] - far + gone * spread,
        (r * t / alpha - x) / (alpha + t) - gone * (r + x) * (t - t_x) / ((alpha + t) * (alpha + t_x)),
        gone / a - by_ab[x],
        by_b[x] - by_ab[x] - gone / beyond,
    )
    return -np.array([float((n * v).sum()) for v in (value, *slopes)])


def histories(df: DataFrame, x: str = "x", t_x: str = "t_x", t: str = "t") -> DataFrame:
    """Different histories and how many customers have each."""
    return df.groupBy(F.col(x).cast("int").alias("x"), F.col(t_x).cast("double").alias("t_x"), F.col(t).cast("double").alias("t")).agg(F.count("*").alias("n"))


def evaluated(packed: DataFrame, candidates: Sequence[Sequence[float]]) -> DataFrame:
    """nll and its slopes for every candidate (r, alpha, a, b)."""
    cands = [tuple(float(v) for v in c) for c in candidates]

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(cands), 1 + len(PARAMS)))
        for pdf in batches:
            columns = [pdf[c].to_numpy() for c in ("x", "t_x", "t", "n")]
            for k, c in enumerate(cands):
                sums[k] += negative_log_likelihood(*columns, c)
        yield pd.DataFrame({"candidate": range(len(cands))} | {name: sums[:, k] for k, name in enumerate(("nll", *SLOPES))})

    schema = "candidate int, " + ", ".join(f"{c} double" for c in ("nll", *SLOPES))
    return packed.mapInPandas(part, schema).groupBy("candidate").agg(*[F.sum(c).alias(c) for c in ("nll", *SLOPES)])


def bgnbd_nll(df: DataFrame, candidates: Sequence[Sequence[float]], x: str = "x", t_x: str = "t_x", t: str = "t") -> DataFrame:
    """ML-14, UDF-02: negative log likelihood of every candidate (r, alpha, a, b)."""
    return evaluated(histories(df, x, t_x, t), candidates).select("candidate", "nll")


def moment_start(packed: DataFrame) -> tuple[int, np.ndarray]:
    """Customers, and a start from moments: the spread of the counts gives r, their rate alpha, their mean how soon customers leave."""
    n, x = F.sum("n"), F.col("x").cast("double")
    row = packed.agg(n.alias("n"), F.sum(F.col("n") * x).alias("x"), F.sum(F.col("n") * x * x).alias("xx"), F.sum(F.col("n") * F.col("t")).alias("t")).first()
    if not row["n"]:
        return 0, np.ones(4)
    mean, watched = max(row["x"] / row["n"], 1e-3), max(row["t"] / row["n"], 1e-3)
    extra = max(row["xx"] / row["n"] - mean * mean - mean, 0.05 * mean * mean)
    r = float(np.clip(mean * mean / extra, 0.05, 20.0))
    return int(row["n"]), np.array([r, r * watched / mean, 1.0, 1.0 + mean])


def bgnbd_fit(df: DataFrame, x: str = "x", t_x: str = "t_x", t: str = "t", tolerance: float = 1e-6, most: int = 200) -> Fit:
    """ML-14: maximum likelihood by a quasi-Newton method on the logarithms of the parameters.

    Each round is one job that evaluates several lengths of the next step, with
    slopes. It ends when no slope per customer exceeds ``tolerance``, where a
    parameter that has reached BOUND and would go on counts as settled; ``most``
    rounds, or several that gain nothing, end it without convergence.
    """
    packed = cut_lineage(histories(df, x, t_x, t))
    customers, start = moment_start(packed)
    if not customers:
        return Fit(dict(zip(PARAMS, start.tolist())), 0.0, 0.0, True, 0, 0)

    def at(points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        rows = {r["candidate"]: r for r in evaluated(packed, [np.exp(p) for p in points]).collect()}
        return [(rows[k]["nll"] / customers, np.array([rows[k][s] for s in SLOPES]) * np.exp(p) / customers) for k, p in enumerate(points)]

    def settled(point: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return ((point >= BOUND) & (slope < 0)) | ((point <= -BOUND) & (slope > 0))

    here = np.clip(np.log(start), -BOUND, BOUND)
    (value, slope), curve, rounds, flat = at([here])[0], np.eye(4), 0, 0
    while np.abs(slope[~settled(here, slope)]).max(initial=0.0) > tolerance and rounds < most and flat < FLAT_ROUNDS:
        free = ~settled(here, slope)
        move = -(curve @ np.where(free, slope, 0.0)) * free
        if move @ slope >= 0:
            curve, move = np.eye(4), -slope * free
        move *= min(1.0, LONGEST_MOVE / np.abs(move).max())
        rounds += 1
        points = [np.clip(here + s * move, -BOUND, BOUND) for s in STEPS]
        tried = [(v, g, p) for p, (v, g) in zip(points, at(points), strict=True) if v <= value + 1e-4 * ((p - here) @ slope)]
        if not tried:
            curve, flat = curve / 64.0, flat + 1  # a shorter step along the same way
            continue
        best, new_slope, point = min(tried, key=lambda k: k[0])
        flat = flat + 1 if value - best < LEAST_GAIN else 0
        step, change = point - here, new_slope - slope
        bend = step @ change
        if bend > 1e-14:
            if rounds == 1:
                curve = np.eye(4) * bend / (change @ change)
            keep = np.eye(4) - np.outer(step, change) / bend
            curve = keep @ curve @ keep.T + np.outer(step, step) / bend
        here, value, slope = point, best, new_slope
    slope = slope[~settled(here, slope)]
    largest = float(np.abs(slope).max(initial=0.0))
    return Fit(dict(zip(PARAMS, np.exp(here).tolist(), strict=True)), value * customers, largest, largest <= tolerance, rounds, customers)
