"""Source tables, assets and edges from a column of SQL texts (LIN-01..03)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A query text as words: bind points and quoted texts whole, dotted names whole,
# every other sign by itself.
WORD = r"\$\w+!?\{[^}]*\}|'[^']*'|[\w$]+(?:\.[\w$]+)*|\S"
# Words that are never tables.
NOISE = ["select", "where", "lateral", "unnest", "values", "dual"]
# Words that may follow a table and are no alias.
AFTER_TABLE = ["on", "join", "left", "right", "inner", "full", "cross", "natural", "using", "where", "group", "order", "union", "having", "limit", "as"]


def source_tables(df: DataFrame, asset: str, sql: str) -> DataFrame:
    """LIN-01: distinct tables of each text, the names that follow FROM or JOIN;
    'inferred' where a bracket follows one, so that the list may be incomplete."""
    words = F.filter(F.regexp_extract_all(F.col(sql), F.lit(WORD), F.lit(0)), lambda w: ~w.startswith("$"))
    heads = F.filter(
        F.transform(F.col("_w"), lambda w, i: F.struct(i.alias("at"), w.alias("name"), F.lower(F.get("_w", i - 1)).alias("lead"))),
        lambda h: h["lead"].isin("from", "join"),
    )
    d = df.select(asset, words.alias("_w")).select(asset, heads.alias("_h"))
    doubt = F.when(F.exists("_h", lambda h: h["name"] == "("), "inferred").otherwise("parsed")
    d = d.select(asset, doubt.alias("confidence"), F.explode_outer("_h").alias("_h"))
    # an outer explode, whose null names the next filter drops: a plain one lets the planner ask for the
    # size of the list below the projection, where the pattern would run again for every word
    low = F.lower("_h.name")
    named = d.where(F.col("_h.name").rlike("^[A-Za-z_]") & ~low.isin(NOISE))
    # the first spelling of a name stands for it
    return named.groupBy(asset, low.alias("_k"), "confidence").agg(F.min_by("_h.name", "_h.at").alias("table_name")).drop("_k")


def source_columns(df: DataFrame, asset: str, sql: str) -> DataFrame:
    """LIN-03: the columns that a text reads by ``name.column``, where the name is a table of its FROM and JOIN list or its alias.

    A table without an alias goes by the last part of its name.
    """
    words = F.filter(F.regexp_extract_all(F.col(sql), F.lit(WORD), F.lit(0)), lambda w: ~w.startswith("$"))
    at = lambda i: F.lower(F.get("_w", i))
    follows = lambda i: F.when(at(i + 1) == "as", at(i + 2)).otherwise(at(i + 1))
    every = F.transform(F.col("_w"), lambda w, i: F.struct(w.alias("name"), at(i - 1).alias("lead"), follows(i).alias("next")))
    tables = F.filter("_a", lambda h: h["lead"].isin("from", "join") & h["name"].rlike("^[A-Za-z_]") & ~F.lower(h["name"]).isin(NOISE))
    alias = lambda h: F.when(h["next"].rlike("^[a-z_][a-z0-9_]*$") & ~h["next"].isin(AFTER_TABLE), h["next"]).otherwise(F.lower(F.element_at(F.split(h["name"], r"\."), -1)))
    named = F.transform(tables, lambda h: F.struct(h["name"].alias("table_name"), alias(h).alias("alias")))
    dotted = F.filter("_a", lambda h: ~F.coalesce(h["lead"], F.lit("")).isin("from", "join") & h["name"].rlike(r"^[A-Za-z_]\w*\.[A-Za-z_]\w*$"))
    d = df.select(asset, words.alias("_w")).select(asset, every.alias("_a")).select(asset, named.alias("_t"), F.explode_outer(F.array_distinct(F.transform(dotted, lambda h: h["name"]))).alias("_c"))
    prefix, column = F.lower(F.substring_index("_c", ".", 1)), F.substring_index("_c", ".", -1)
    found = d.where("_c IS NOT NULL").select(asset, "_t", prefix.alias("_p"), column.alias("column_name"))
    table = F.get(F.filter("_t", lambda t: t["alias"] == F.col("_p")), 0)["table_name"]
    return found.select(asset, table.alias("table_name"), "column_name").where("table_name IS NOT NULL").distinct()


def lineage_edges(tables: DataFrame, asset: str) -> DataFrame:
    """LIN-02: edges, one per (source, target, type, detail)."""
    return tables.select(
        F.col(asset).alias("source"), F.col("table_name").alias("target"), F.lit("query->table").alias("type"), F.lit("").alias("detail"), "confidence"
    ).groupBy("source", "target", "type", "detail").agg(F.min("confidence").alias("confidence"))


def lineage_assets(edges: DataFrame) -> DataFrame:
    """LIN-02: one row per asset: queries with the number of tables they read, tables with the number of queries that read them."""
    queries = edges.groupBy(F.col("source").cast("string").alias("name")).agg(F.countDistinct("target").alias("links")).withColumn("type", F.lit("query"))
    tables = edges.groupBy(F.col("target").alias("name")).agg(F.countDistinct("source").alias("links")).withColumn("type", F.lit("table"))
    return queries.unionByName(tables).select("name", "type", "links")


def edge_counts(edges: DataFrame) -> DataFrame:
    """LIN-02: edges and distinct ends by type and confidence."""
    return edges.groupBy("type", "confidence").agg(F.count("*").alias("edges"), F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets"))


def lineage_events(edges: DataFrame, namespace: str, columns: DataFrame | None = None) -> DataFrame:
    """LIN-03: one nested JSON event per asset with its inputs and output.

    With ``columns`` (source, table_name, column_name) the output carries a facet:
    for each column name the input fields it comes from.
    """
    side = F.struct(F.lit(namespace).alias("namespace"), F.col("target").alias("name"))
    # the inputs of one query text: as many as the text names
    g = edges.groupBy("source").agg(F.sort_array(F.collect_set(side)).alias("inputs"))
    named = [F.lit(namespace).alias("namespace"), F.col("source").alias("name")]
    if columns is not None:
        field = F.struct(F.lit(namespace).alias("namespace"), F.col("table_name").alias("name"), F.col("column_name").alias("field"))
        per = columns.groupBy("source", "column_name").agg(F.struct(F.sort_array(F.collect_set(field)).alias("inputFields")).alias("f"))
        per = per.groupBy("source").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("column_name", "f")))).alias("fields"))
        g = g.join(per, "source", "left")
        named.append(F.struct(F.struct(F.col("fields").alias("fields")).alias("columnLineage")).alias("facets"))
    event = F.struct(F.lit("COMPLETE").alias("eventType"), F.struct(*named[:2]).alias("job"), F.col("inputs"), F.array(F.struct(*named)).alias("outputs"))
    return g.select("source", F.size("inputs").alias("n_inputs"), F.to_json(event).alias("event"))
