"""Shrink anomalies: robust z, isolation forest, label-free checks (ML-10..12)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopledger.functions import nonzero, safe_div
from shopledger.operators.aggregates import argmax_of
from shopledger.operators.ordered import exact_quantiles
from shopledger.session import cut_lineage

# MAD to deviation, thresholds.
MAD_SCALE = 1.4826
Z_FLAG = 3.5
CONTAMINATION = 0.02
SAMPLE_ROWS = 256
#: So many times SAMPLE_ROWS are drawn for a tree on average, so that SAMPLE_ROWS are there in nearly every draw.
SAMPLE_MARGIN = 1.5
FOREST_BYTES = 64 << 20


def shrink_cells(log: DataFrame, sales: DataFrame, min_sales: float) -> DataFrame:
    """Store x category x month cells with a shrink rate and its main reason."""
    keys = ["store_id", "category", "yyyymm"]
    g = log.groupBy(*keys).agg(F.sum("qty_lost").alias("shrink_units"), F.sum("shrink_value").alias("shrink_value"), F.count("*").alias("shrink_events"))
    top = argmax_of(log, keys, "reason", F.col("shrink_value"), "top_reason")
    j = g.join(sales, keys, "left").join(top, keys).withColumn("sales_value", F.coalesce("sales_value", F.lit(0)))
    j = j.where(F.col("sales_value") >= min_sales)
    return j.select(
        *keys, "shrink_units", F.col("shrink_value").cast("double").alias("shrink_value"), "shrink_events", F.col("sales_value").cast("double").alias("sales_value"), "top_reason",
        (F.col("measure").cast("double") / F.col("shrink_value").cast("double")).alias("top_reason_share"), (F.col("shrink_value").cast("double") / F.col("sales_value").cast("double")).alias("shrink_rate"),
    )


def robust_z(df: DataFrame, grp: Sequence[str], col: str) -> DataFrame:
    """ML-10: distance from the group median in scaled median deviations; the
    population deviation where the MAD is zero, 0 where both are."""
    grp = list(grp)
    df = cut_lineage(df)
    med = exact_quantiles(df, col, {"peer_median": 0.5}, grp)
    j = df.join(med, grp).withColumn("_dev", F.abs(F.col(col) - F.col("peer_median")))
    mad = exact_quantiles(j, "_dev", {"_mad": 0.5}, grp)
    sd = df.groupBy(*grp).agg(F.stddev_pop(col).alias("_sd"))
    s = j.drop("_dev").join(mad, grp).join(sd, grp)
    scale = F.when(F.col("_mad") * MAD_SCALE > 1e-9, F.col("_mad") * MAD_SCALE).when(F.col("_sd") > 1e-9, F.col("_sd"))
    return s.withColumn("robust_z", F.coalesce((F.col(col) - F.col("peer_median")) / scale, F.lit(0.0))).drop("_mad", "_sd")


def grow_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, float, int, int, int]]:
    """One isolation tree as rows (feature, cut, left, right, size)."""
    nodes: list[tuple[int, float, int, int, int]] = []

    def split(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, len(rows)))
        if depth >= limit or len(rows) <= 1:
            return at
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if not len(usable):
            return at
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        right = x[rows, f] >= cut
        nodes[at] = (f, cut, split(rows[~right], depth + 1), split(rows[right], depth + 1), len(rows))
        return at

    split(np.arange(len(x)), 0)
    return nodes


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Expected path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    c = 2.0 * (np.log(safe - 1.0) + 0.5772156649015329) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def path_scores(x: np.ndarray, trees: Sequence[np.ndarray], expected: float) -> np.ndarray:
    """Anomaly score of each row: 2 ** (-mean path / expected path)."""
    total = np.zeros(len(x))
    for t in trees:
        at = np.zeros(len(x), dtype=int)
        depth = np.zeros(len(x))
        feature = t[:, 0].astype(int)
        while True:
            f = feature[at]
            live = f >= 0
            if not live.any():
                break
            here = at[live]
            right = x[live, f[live]] >= t[here, 1]
            at[live] = np.where(right, t[here, 3], t[here, 2]).astype(int)
            depth[live] += 1
        total += depth + mean_path(t[at, 4])
    return 2.0 ** (-(total / len(trees)) / max(expected, 1e-9))


def tree_samples(clean: DataFrame, cols: Sequence[str], key: Sequence[str], trees: int, seed: int) -> DataFrame:
    """Rows (tree, h, features): for each tree the rows whose hash for that tree is small, some more than SAMPLE_ROWS.

    One pass and one count; what it gives depends on the number of trees, not on
    the number of rows.
    """
    share = min(1.0, SAMPLE_MARGIN * SAMPLE_ROWS / max(clean.count(), 1))
    below = F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(*key, F.lit(seed), t).alias("h")))
    # outer, or the planner would ask for the size of the drawn list once more
    rows = clean.select(*cols, F.explode_outer(F.filter(drawn, lambda d: d["h"] <= below)).alias("d"))
    return rows.where("d IS NOT NULL").select("d.tree", "d.h", *cols)


def grown_forest(samples: DataFrame, cols: Sequence[str], seed: int) -> DataFrame:
    """One tree for each group, grown where its sample is: (tree, size, nodes)."""
    cols = list(cols)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(["h", *cols]).head(SAMPLE_ROWS)[cols].to_numpy(dtype=float)
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        nodes = np.array(grow_tree(x, np.random.default_rng([seed, tree]), limit), dtype=float)
        return pd.DataFrame({"tree": [tree], "size": [len(x)], "nodes": [nodes.tobytes()]})

    return samples.groupBy("tree").applyInPandas(grow, "tree int, size int, nodes binary")


def iforest(df: DataFrame, feats: Sequence[str], key: Sequence[str], trees: int = 300, seed: int = 42, out: str = "iforest_score") -> DataFrame:
    """ML-11: isolation-forest score.

    Every tree has its own sample of SAMPLE_ROWS rows, the ones with the smallest
    hash of key and tree, and is grown in a task of its own. Only the grown
    forest, at most 2 * SAMPLE_ROWS nodes for each tree, is sent to the
    executors, which score every row in Arrow batches.
    """
    spark = df.sparkSession
    feats, key = list(feats), list(key)
    clean = cut_lineage(df.select("*", *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_f{i}") for i, c in enumerate(feats)]))
    cols = [f"_f{i}" for i in range(len(feats))]
    forest = grown_forest(tree_samples(clean, cols, key, trees, seed), cols, seed).orderBy("tree").collect()
    if sum(len(t["nodes"]) for t in forest) > FOREST_BYTES:
        raise ValueError(f"a forest of {trees} trees is too large to be sent; use fewer")
    grown = [np.frombuffer(t["nodes"]).reshape(-1, 5) for t in forest]
    expected = float(np.mean([mean_path(t["size"]) for t in forest])) if forest else 0.0
    shipped = spark.sparkContext.broadcast((grown, expected))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns=cols).assign(**{out: path_scores(pdf[cols].to_numpy(dtype=float), *shipped.value)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return clean.mapInPandas(score, f"{fields}, {out} double")


def flag_cells(df: DataFrame) -> DataFrame:
    """Both flags, their union and its source, with an exact contamination cut."""
    cut = exact_quantiles(df, "iforest_score", {"c": 1 - CONTAMINATION}).scalar()
    z, iso = F.col("robust_z") >= Z_FLAG, F.col("iforest_score") >= F.col("_cut")
    out = df.withColumn("_cut", cut)
    source = F.when(z & iso, "both").when(z, "robust_z").when(iso, "isolation_forest").otherwise("none")
    return out.withColumn("flag_source", source).withColumn("flagged", F.when(F.col("flag_source") != "none", "Y").otherwise("N")).drop("_cut")


def flag_stability(df: DataFrame, mid: int, pair: Sequence[str] = ("store_id", "category")) -> DataFrame:
    """ML-12: without labels: how often flagged pairs repeat in the second half
    against chance, the separation of means and the concentration of value."""
    pair = list(pair)
    per = df.groupBy(*pair).agg(
        F.max(F.when((F.col("yyyymm") <= mid) & (F.col("flagged") == "Y"), 1).otherwise(0)).alias("f1"),
        F.max(F.when((F.col("yyyymm") > mid) & (F.col("flagged") == "Y"), 1).otherwise(0)).alias("f2"), F.max(F.when(F.col("yyyymm") > mid, 1).otherwise(0)).alias("in2"),
    )
    halves = per.agg(F.sum("f1").alias("h1_flagged"), F.sum("f2").alias("h2_flagged"), F.sum(F.col("f1") * F.col("f2")).alias("repeated"), F.sum("in2").alias("h2_pairs"))
    fl = F.col("flagged") == "Y"
    dec = "decimal(28,8)"
    v, r = F.col("shrink_value").cast(dec), F.col("shrink_rate").cast(dec)
    one = df.agg(
        F.count("*").alias("cells"), F.count_if(fl).alias("flagged_cells"), safe_div(F.sum(F.when(fl, r)), F.count_if(fl), 6).alias("flagged_mean_rate"), safe_div(F.sum(F.when(~fl, r)), F.count_if(~fl), 6).alias("unflagged_mean_rate"),
        safe_div(F.sum(F.when(fl, v)), F.sum(v), 6).alias("flagged_share_of_value"), safe_div(F.count_if(fl), F.count("*"), 6).alias("flagged_share_of_cells"),
    )
    from shopledger.operators.joins import with_scalars

    both = with_scalars(one, halves)
    repeat, chance = safe_div(F.col("repeated"), F.col("h1_flagged"), 6), safe_div(F.col("h2_flagged"), F.col("h2_pairs"), 6)
    return both.select("*", repeat.alias("repeat_rate"), chance.alias("chance_rate"))
