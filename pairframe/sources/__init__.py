"""Reading event and detail tables, and writing features, profiles and models."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType


def nan_to_null(df: DataFrame) -> DataFrame:
    """Files written by dataframe libraries hold NaN for missing numbers; SQL functions want null."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType | FloatType)}
    return df.select([F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A table by its suffix: csv (with a header) or parquet. An absent path is an error that names it."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if path.endswith(".csv"):
        reader = reader.option("header", True)
        return nan_to_null((reader if schema is not None else reader.option("inferSchema", True)).csv(path))
    return nan_to_null(reader.parquet(path))


def read_optional(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """read_table, but an empty table of the schema where the path doesn't exist."""
    try:
        return read_table(spark, path, schema)
    except AnalysisException as absent:
        if absent.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def of_seasons(df: DataFrame, seasons: Iterable[int], column: str = "season") -> DataFrame:
    """Rows of the seasons; on a table partitioned by season only their files are read."""
    return df.filter(F.col(column).isin(list(seasons)))


def upcoming(schedule: DataFrame, season: int | None = None, week: int | None = None, result: str = "result") -> DataFrame:
    """Events without a result, of one season and week where given."""
    keep: Column = F.col(result).isNull()
    if season is not None:
        keep &= F.col("season") == season
    if week is not None:
        keep &= F.col("week") == week
    return schedule.filter(keep)


def ensure_columns(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """df with every missing column added at its default; decided on the schema, without a job."""
    missing = {name: F.lit(value) for name, value in defaults.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def with_event_key(df: DataFrame, key: str = "game_id", season: str = "season", week: str = "week", home: str = "home_team", away: str = "away_team") -> DataFrame:
    """Adds season_week_home_away as key, the week in two digits, unless df has one."""
    if key in df.columns:
        return df
    parts = [F.col(season).cast("string"), F.lpad(F.col(week).cast("string"), 2, "0"), F.col(home).cast("string"), F.col(away).cast("string")]
    return df.withColumn(key, F.concat_ws("_", *parts))


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """Chosen columns in their order, as csv or parquet by the path's suffix."""
    writer = df.select(columns or df.columns).write.mode(mode).partitionBy(*partition_by)
    if path.endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def write_profile(profile: DataFrame, path: str) -> None:
    profile.write.mode("overwrite").json(path)


def feature_names(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """All columns but the excluded ones, sorted."""
    return sorted(set(df.columns) - set(exclude))


def write_feature_names(df: DataFrame, path: str, exclude: Iterable[str] = ()) -> None:
    """One name a line; as many rows as df has columns, so one file."""
    names = df.sparkSession.createDataFrame([(n,) for n in feature_names(df, exclude)], "name string")
    names.coalesce(1).sortWithinPartitions("name").write.mode("overwrite").text(path)


#: Rows of a table that one task holds where tables are dealt out by a key.
PIECE = 250_000
#: Rows up to which a table of a key and a few numbers is broadcast.
SMALL = 500_000


def pieces(spark: SparkSession, rows: int, each: int = PIECE) -> int:
    """In how many parts a table of so many rows is dealt out: a task's rows, and so its memory, stay the same however large the table; a small table has a part a core."""
    cores = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(1, cores, -(-rows // each))


def counts(tables: Mapping[str, DataFrame]) -> dict[str, int]:
    """The rows of tables, from one job that reads no column."""
    found = [df.agg(F.count("*").alias("n")).withColumn("name", F.lit(name)) for name, df in tables.items()]
    return {r.name: r.n for r in reduce(DataFrame.unionAll, found).collect()}


def looked_up(rows: DataFrame, of: DataFrame, left: str, right: str, n_rows: int, n_of: int) -> DataFrame:
    """rows joined with a table of one row a key: by broadcast if it is small, else both are dealt out by the key."""
    on = F.col(left) == F.col(right)
    if n_of <= SMALL:
        return rows.join(F.broadcast(of), on)
    n = pieces(rows.sparkSession, max(n_rows, n_of))
    return rows.repartition(n, left).join(of.repartition(n, right), on)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session on one machine may go without; it gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pairframe-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/pairframe-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: worked out once, however often it is read, and safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
