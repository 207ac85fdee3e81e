"""Reading, typing, rebuilding and exporting tables (SRC-01..12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopledger.functions import finite
from shopledger.session import cut_lineage

VERSION = "version-"
#: Size of a bucket as written, and the fewest buckets of a table.
BUCKET_BYTES, LEAST_BUCKETS = 128 << 20, 8


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """SRC-01: a parquet table; columns and filters are pruned by Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The same table as a stream: a folder of part files by its own path, a single file by its name in the parent."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    stream = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return stream.parquet(f"{folder}/{name}.parquet")
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def read_csv(spark: SparkSession, path: str, schema, header: bool = True, sep: str = ",") -> DataFrame:
    """SRC-02: a delimited file bound to a declared schema, first row a header."""
    return (
        spark.read.schema(schema)
        .option("header", header)
        .option("sep", sep)
        .option("enforceSchema", False)
        .csv(path)
    )


def typed_from_staging(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """SRC-03: all-text staging columns to typed ones, blank first to NULL."""
    return df.select(
        *[
            F.nullif(F.trim(F.col(c)), F.lit("")).try_cast(t).alias(c)
            for c, t in types.items()
        ]
    )


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a maker of paths below it."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    return path_of(path).getFileSystem(spark._jsc.hadoopConfiguration()), path_of


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions of a rebuilt table, in order; one that was not written to its end does not count."""
    files, path_of = _files(spark, path)
    if not files.exists(path_of(path)):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path_of(path)) if s.isDirectory()]
    numbers = sorted(int(n.removeprefix(VERSION)) for n in names if n.startswith(VERSION))
    return [n for n in numbers if files.exists(path_of(f"{path}/{VERSION}{n}/_SUCCESS"))]


def read_rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """SRC-04: the newest finished version of a rebuilt table; what is read stays that version."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"{path} has no finished version")
    return spark.read.parquet(f"{path}/{VERSION}{known[-1]}")


def rebuild(df: DataFrame, path: str, partition_by: list[str] | None = None, keep: int = 2) -> DataFrame:
    """SRC-04: idempotent full refresh of a parquet table, seen whole or not at all.

    The new version is written beside the old one and counts from the moment its
    commit mark is there. ``df`` may read the table itself; a write that fails
    leaves the old version, and readers of it go on. The newest ``keep`` versions stay;
    two writers that take the same number do not mix, as the second one fails.
    """
    spark = df.sparkSession
    known = versions(spark, path)
    files, path_of = _files(spark, path)
    taken = [int(s.getPath().getName().removeprefix(VERSION)) for s in files.listStatus(path_of(path)) if s.getPath().getName().startswith(VERSION)] if files.exists(path_of(path)) else []
    number = max(taken, default=0) + 1
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/{VERSION}{number}")
    for old in known[: max(0, len(known) + 1 - max(keep, 1))]:
        files.delete(path_of(f"{path}/{VERSION}{old}"), True)
    return spark.read.parquet(f"{path}/{VERSION}{number}")


def measured_buckets(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` written once, and a power of two of buckets of about BUCKET_BYTES by what was written."""
    cut = cut_lineage(df)
    files, path_of = _files(df.sparkSession, cut.inputFiles()[0]) if cut.inputFiles() else (None, None)
    size = sum(files.getFileStatus(path_of(f)).getLen() for f in cut.inputFiles()) if files else 0
    return cut, max(LEAST_BUCKETS, 1 << max(0, -(-size // BUCKET_BYTES) - 1).bit_length())


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """SRC-05: hash-bucketed, sorted table, so joins on ``key`` need no shuffle.

    Rows are dealt by the key before the write, so each bucket is one file. The
    number of buckets follows the size of the rows unless it is given; it is a
    power of two, and a session that ``session.tune`` has set reads the finer
    table of a join in the coarser one's buckets.
    """
    if buckets is None:
        df, buckets = measured_buckets(df)
    (
        df.repartition(buckets, key)
        .write.mode("overwrite")
        .format("parquet")
        .bucketBy(buckets, key)
        .sortBy(key)
        .saveAsTable(name)
    )
    return df.sparkSession.table(name)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """SRC-06: a named view for SQL readers."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def analyze(spark: SparkSession, name: str) -> DataFrame:
    """SRC-07: statistics for the optimizer, and the stored figures."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
    return spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Statistics'")


def typed_scores(df: DataFrame, ddl: str, decimals: int = 4) -> DataFrame:
    """SRC-08: the declared score schema; NaN and infinities NULL, fixed rounding."""
    schema = T.StructType.fromDDL(ddl)
    cols = []
    for field in schema.fields:
        c: Column = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            scale = field.dataType.scale if isinstance(field.dataType, T.DecimalType) else decimals
            c = F.round(finite(c), scale)
        cols.append(c.try_cast(field.dataType).alias(field.name))
    return df.select(*cols)


def write_scores(df: DataFrame, ddl: str, path: str) -> DataFrame:
    """SRC-08: typed score write-back, whole table at once."""
    return rebuild(typed_scores(df, ddl), path)


def backfill(target: DataFrame, source: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """SRC-09: fill columns of a table from another one by key."""
    src = source.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_s_{c}") for c in cols])
    joined = target.join(src, target[key] == src["_k"], "left")
    kept = [
        F.coalesce(F.col(f"_s_{c}"), target[c]).alias(c) if c in cols else target[c]
        for c in target.columns
    ]
    fresh = [F.col(f"_s_{c}").alias(c) for c in cols if c not in target.columns]
    return joined.select(*kept, *fresh)


def relabel(df: DataFrame, cols: list[str], labels: DataFrame, code: str = "code", label: str = "label") -> DataFrame:
    """SRC-10: codes to labels through a lookup table, blank codes to NULL."""
    def one(acc: DataFrame, c: str) -> DataFrame:
        side = labels.select(F.col(code).alias("_code"), F.col(label).alias("_label"))
        return (
            acc.join(side, F.col(c) == F.col("_code"), "left")
            .withColumn(c, F.coalesce("_label", F.nullif(F.trim(F.col(c)), F.lit(""))))
            .drop("_code", "_label")
        )

    return reduce(one, cols, df)


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """SRC-11: a constant table kept in the program."""
    return spark.createDataFrame(rows, schema)


def export(df: DataFrame, path: str, fmt: str = "json") -> None:
    """SRC-12: a result as JSON lines or as CSV with a header."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown format {fmt}")
