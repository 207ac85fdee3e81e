"""Access-log reports (USE-01..04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopledger.functions import class_tail, safe_div


def text_time(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def usage_top(events: DataFrame, since, n: int) -> DataFrame:
    """USE-01: most used resources with distinct users and last access."""
    e = events.where(F.col("ts") >= since)
    g = e.groupBy("resource", "kind").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.max("ts").alias("t"))
    return g.orderBy(F.col("events").desc(), F.col("t").desc(), "resource").limit(n).select("resource", class_tail(F.col("kind")).alias("type"), "events", "users", text_time(F.col("t")).alias("last_access"))


def usage_users(events: DataFrame, n: int) -> DataFrame:
    """USE-02: most active users."""
    g = events.groupBy("user_id").agg(F.count("*").alias("events"), F.countDistinct("resource").alias("resources"), F.max("ts").alias("t"))
    return g.orderBy(F.col("events").desc(), "user_id").limit(n).select("user_id", "events", "resources", text_time(F.col("t")).alias("last_active"))


def usage_resource(events: DataFrame, resource: str) -> DataFrame:
    """USE-02: who used one resource, and when."""
    return events.where(F.col("resource") == resource).groupBy("user_id").agg(
        F.count("*").alias("events"), text_time(F.min("ts")).alias("first_access"), text_time(F.max("ts")).alias("last_access")
    )


def usage_recent(events: DataFrame, n: int) -> DataFrame:
    """USE-02: the latest events."""
    return events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n).select("event_id", "user_id", "resource", class_tail(F.col("kind")).alias("type"), "updating")


def inventory(resources: DataFrame, events: DataFrame) -> DataFrame:
    """USE-03: every resource with owner, last access and count; unseen ones
    are kept.  The owner is the first editor, else the first reader."""
    at = F.struct("ts", "event_id")
    seen = events.groupBy("resource").agg(F.max("ts").alias("t"), F.max_by("user_id", at).alias("last_user"), F.min_by("user_id", at).alias("first_user"), F.count("*").alias("access_count"))
    owner = events.where("updating").groupBy("resource").agg(F.min_by("user_id", at).alias("editor"))
    out = resources.join(seen, "resource", "left").join(owner, "resource", "left")
    return out.select(
        "resource", "label", F.coalesce(F.col("editor").cast("string"), F.col("first_user").cast("string"), F.lit("n/a")).alias("owner"), text_time(F.col("t")).alias("last_accessed"),
        F.coalesce(F.col("last_user").cast("string"), F.lit("-")).alias("last_accessed_by"), F.coalesce("access_count", F.lit(0)).alias("access_count"),
    ).orderBy(F.col("last_accessed").desc_nulls_last(), "label")


def usage_metric(events: DataFrame, resources: DataFrame, name: str, as_of=None, stale_days: int = 7) -> DataFrame:
    """USE-04: usage metrics by name."""
    if name == "peak_usage_hours":
        return events.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("events"))
    if name == "unique_viewers_per_content":
        return events.groupBy("resource").agg(F.countDistinct("user_id").alias("viewers"))
    if name == "avg_views_per_content":
        return events.agg(safe_div(F.count("*"), F.countDistinct("resource"), 4).alias("avg_views"))
    if name == "user_last_active":
        return events.groupBy("user_id").agg(text_time(F.max("ts")).alias("last_active"))
    if name == "never_accessed":
        return resources.join(events, "resource", "left_anti").select("resource", "label")
    if name == "stale_content":
        last = events.groupBy("resource").agg(F.max(F.to_date("ts")).alias("d"))
        return last.select("resource", F.datediff(as_of, "d").alias("days_idle")).where(F.col("days_idle") >= stale_days)
    if name == "content_by_owner":
        return inventory(resources, events).groupBy("owner").agg(F.count("*").alias("items"))
    if name == "items_per_folder":
        return resources.groupBy(F.substring_index("resource", "/", 2).alias("folder")).agg(F.count("*").alias("items"))
    raise ValueError(f"unknown usage metric {name}")
