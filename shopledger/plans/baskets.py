"""Market-basket analytics (ML-01..04)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopledger.functions import fixed, md5_bucket, safe_div
from shopledger.operators.joins import basket_pairs
from shopledger.operators.ranking import topk_per_key
from shopledger.session import cut_lineage

SCORE = "decimal(12,9)"


def item_counts(items: DataFrame, cutoff: str) -> DataFrame:
    """Baskets per item before the cutoff; the popularity baseline."""
    train = items.where(F.col("sale_date") < F.lit(cutoff).cast("date")).select("basket", "plu").distinct()
    return train.groupBy("plu").agg(F.count("*").alias("baskets"))


def pair_counts(items: DataFrame, cutoff: str, low: int = 2, high: int | None = None) -> DataFrame:
    """ML-01: co-occurrence counts of item pairs in baskets before the cutoff, whatever their size."""
    train = items.where(F.col("sale_date") < F.lit(cutoff).cast("date"))
    return basket_pairs(train, "basket", "plu", low, high).groupBy("item_a", "item_b").agg(F.count("*").alias("pair_baskets"))


def pair_scores(pairs: DataFrame, counts: DataFrame, min_support: int = 30) -> DataFrame:
    """ML-02: cosine, lift (only with enough support) and support, both ways."""
    a = counts.select(F.col("plu").alias("item_a"), F.col("baskets").alias("na"))
    b = counts.select(F.col("plu").alias("item_b"), F.col("baskets").alias("nb"))
    total = counts.agg(F.sum("baskets").cast("double").alias("t")).scalar()
    co, na, nb = (F.col(c).cast("double") for c in ("pair_baskets", "na", "nb"))
    one = pairs.join(a, "item_a").join(b, "item_b").withColumn("total", total)
    scored = one.select(
        "item_a", "item_b", "pair_baskets", fixed(co / F.sqrt(na * nb), 9).cast(SCORE).alias("cosine"),
        F.when(F.col("pair_baskets") >= min_support, fixed(co * F.col("total") / (na * nb), 6)).otherwise(F.lit(0.0)).alias("lift"),
        fixed(F.lit(100.0) * co / F.col("total"), 6).alias("support_pct"),
    )
    # both directions from one pass
    sides = F.array(
        F.struct(F.col("item_a").alias("plu"), F.col("item_b").alias("rec_plu")), F.struct(F.col("item_b").alias("plu"), F.col("item_a").alias("rec_plu"))
    )
    return scored.select("pair_baskets", "cosine", "lift", "support_pct", F.inline(sides)).select("plu", "rec_plu", "pair_baskets", "cosine", "lift", "support_pct")


def recommend(scores: DataFrame, products: DataFrame, n: int = 10, score: str = "cosine") -> DataFrame:
    """ML-03: best companions of each product with names and the same-category flag."""
    top = topk_per_key(scores, "plu", score, n, "rec_plu")
    own = products.select("plu", F.col("category").alias("_c"))
    rec = products.select(F.col("plu").alias("rec_plu"), F.col("product_name").alias("rec_product_name"), F.col("category").alias("rec_category"))
    out = top.join(own, "plu", "left").join(rec, "rec_plu", "left")
    return out.withColumn("same_category", F.when(F.col("_c") == F.col("rec_category"), "Y").otherwise("N")).drop("_c")


def hidden_items(items: DataFrame, cutoff: str, salt: str = "hide") -> DataFrame:
    """One hidden item per held-out basket, picked by hash: flags every row."""
    test = items.where(F.col("sale_date") >= F.lit(cutoff).cast("date")).select("basket", "plu").distinct()
    h = F.md5(F.concat_ws("|", F.col("basket").cast("string"), F.col("plu").cast("string"), F.lit(salt)).cast("binary"))
    pick = test.groupBy("basket").agg(F.count("*").alias("n"), F.min(F.struct(h.alias("h"), "plu")).alias("p")).where("n >= 2")
    return test.join(pick.select("basket", F.col("p.plu").alias("target")), "basket")


def shared_sets(visible: DataFrame) -> DataFrame:
    """(basket, rep): baskets that show the same items share ``rep``, the smallest of them.

    A set is named by its size and two sums of item hashes, which no task needs
    the whole set for.
    """
    name = [F.sum(F.xxhash64(F.lit(salt), "plu").cast("decimal(38,0)")).alias(f"_s{salt}") for salt in (1, 2)]
    sets = visible.groupBy("basket").agg(F.count("*").alias("_s0"), *name)
    keys = ["_s0", "_s1", "_s2"]
    return sets.join(sets.groupBy(*keys).agg(F.min("basket").alias("rep")), keys).select("basket", "rep")


def target_ranks(visible: DataFrame, scores: DataFrame) -> DataFrame:
    """(basket, rank) of the target among all items that the visible ones point to; baskets whose target nothing points to are left out.

    ``visible`` has basket, plu, target. The target's own score is one join on
    (visible item, target). Companions are ranked once for each different set of
    visible items that has a target with a score, and only counted above it.
    """
    pairs = scores.select("plu", "rec_plu", "cosine")
    own = visible.join(pairs.withColumnRenamed("rec_plu", "target"), ["plu", "target"]).groupBy("basket", "target").agg(F.sum("cosine").alias("own"))
    own = cut_lineage(own)
    wanted = cut_lineage(shared_sets(visible.join(own.select("basket"), "basket", "left_semi")))
    asked = own.join(wanted, "basket")
    members = visible.join(wanted.where("basket = rep").select("basket"), "basket", "left_semi").select(F.col("basket").alias("rep"), "plu")
    cand = members.join(pairs, "plu").groupBy("rep", "rec_plu").agg(F.sum("cosine").alias("score"))
    cand = cand.join(members.withColumnRenamed("plu", "rec_plu"), ["rep", "rec_plu"], "left_anti")
    above = (F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col("rec_plu") < F.col("target")))
    ranks = cand.join(asked.select("rep", "target", "own").distinct(), "rep").groupBy("rep", "target").agg((F.count_if(above) + 1).alias("rank"))
    return asked.join(ranks, ["rep", "target"]).select("basket", "rank")


def evaluate_reco(items: DataFrame, scores: DataFrame, counts: DataFrame, cutoff: str) -> DataFrame:
    """ML-04: leave-one-out hit@k and MRR of the cosine scorer against popularity.

    A target no visible item points to is ranked last.  Popularity ranks are
    read from one rank per item, less the visible items that rank higher.
    """
    flagged = cut_lineage(hidden_items(items, cutoff))
    counts, scores = cut_lineage(counts), cut_lineage(scores)
    visible = flagged.where("plu <> target")
    targets = flagged.where("plu = target").select("basket", "target")
    n_items = counts.agg(F.count("*").alias("n")).scalar()
    rank = target_ranks(visible, scores)
    seen = flagged.groupBy("basket").agg(F.count("*").alias("n"))
    mine = targets.join(rank, "basket", "left").join(seen, "basket").select(F.coalesce("rank", n_items - F.col("n") + 1).alias("rank"), F.lit("cosine").alias("scorer"))
    from shopledger.operators.ordered import exact_row_number

    pop = exact_row_number(counts.withColumn("neg", -F.col("baskets")), ["neg", "plu"], out="pop_rank").select("plu", "pop_rank")
    tr = targets.join(pop.select(F.col("plu").alias("target"), F.col("pop_rank").alias("tr")), "target", "left")
    vis = visible.select("basket", "plu").join(pop, "plu").join(tr.select("basket", "tr"), "basket").groupBy("basket").agg(F.count_if(F.col("pop_rank") < F.col("tr")).alias("ahead"))
    base = tr.join(vis, "basket", "left").join(seen, "basket").select(
        F.coalesce(F.col("tr") - F.coalesce("ahead", F.lit(0)), n_items - F.col("n") + 1).alias("rank"), F.lit("popularity").alias("scorer")
    )
    both = mine.unionByName(base)
    r = F.col("rank")
    mrr = F.sum(fixed(F.lit(1.0) / r.cast("double"), 9).cast(SCORE))
    return both.groupBy("scorer").agg(
        F.count("*").alias("n"), *[safe_div(F.count_if(r <= k), F.count("*"), 6).alias(f"hit_{k}") for k in (1, 5, 10)], safe_div(mrr, F.count("*"), 6).alias("mrr")
    )
