"""Readers and writers (parquet tables, delimited files, split catalogue)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Options that make delimited text round-trip exactly: RFC quoting with doubled
# quotes, quoted newlines, and no trimming of leading/trailing blanks.
_DELIMITED_READ = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "mode": "FAILFAST"}
_DELIMITED_WRITE = {"header": "true", "quote": '"', "escape": '"',
                    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

PAIR_SCHEMA = T.StructType([
    T.StructField("original", T.StringType()),
    T.StructField("simplification", T.StringType()),
    T.StructField("label", T.DoubleType()),
])


#: Stands for a quoted empty field while a file is parsed (an unquoted empty field is NULL).
_EMPTY = "\u0001empty\u0001"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column (pandas never matches NaN keys,
    Spark does; NULL keeps the pandas semantics for joins and averages)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`")
            cols.append(F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One of the driver's parquet tables, NaN cleaned; optionally column-pruned."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return nan_to_null(df)


def read_delimited(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None,
                   sep: str = ",", **options) -> DataFrame:
    """CSV/TSV scan with header and RFC quoting.  Pass an explicit schema for
    production reads (no inference pass over the data)."""
    reader = spark.read.options(**_DELIMITED_READ).option("sep", sep).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", "true")
    out = reader.option("emptyValue", _EMPTY).csv(path)
    texts = {f.name for f in out.schema.fields if isinstance(f.dataType, T.StringType)}
    return nan_to_null(out.select(*[
        F.when(F.col(f"`{c}`") == _EMPTY, F.lit("")).otherwise(F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`")
        for c in out.columns]))


def write_delimited(df: DataFrame, path: str, sep: str = "\t", mode: str = "errorifexists",
                    partition_by: str | None = None, **options) -> None:
    """TSV/CSV sink with header; exact round trip of blanks, quotes, empty strings
    (written as "") and NULL (written as nothing)."""
    writer = df.write.mode(mode).options(**_DELIMITED_WRITE).option("sep", sep).options(**options)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.csv(path)


def union_all(*dfs: DataFrame) -> DataFrame:
    """Bag union by column name; columns absent on one side become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def split_folders(df: DataFrame, column: str, path: str) -> dict[str | None, str]:
    """Value of ``column`` (a handful of split names, NULL included) -> its folder below ``path``, as
    ``write_delimited(..., partition_by=column)`` names it."""
    names = [r[0] for r in df.select(F.col(column).cast("string")).distinct().collect()]
    utils = df.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    folder = lambda v: utils.escapePathName(v) if v else "__HIVE_DEFAULT_PARTITION__"
    return {v: f"{path}/{column}={folder(v)}" for v in names if v != "" or None not in names}


def read_split(spark: SparkSession, catalog: Mapping[str, Mapping[str, str]], config: str, split: str = "full",
               schema: T.StructType | None = PAIR_SCHEMA, sep: str = "\t") -> DataFrame:
    """Named table source: (config, split) -> DataFrame.

    ``catalog`` maps config -> {split -> path}.  ``split="full"`` is the union of
    all splits of the config, each row tagged with its split name (None: NULL).
    """
    splits = catalog[config]
    names = list(splits) if split == "full" else [split]
    frames = [read_delimited(spark, splits[s], schema=schema, sep=sep).withColumn("split", F.lit(s).cast("string")) for s in names]
    return union_all(*frames)
