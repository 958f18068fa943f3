"""File sources and sinks: Parquet, CSV/TSV and raw files mounted under a prefix; CSV and byte output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..model import KEY, col, value_columns

# Types that a CSV header may name after a colon.
HEADER_TYPES = {"int": "int", "integer": "int", "long": "bigint", "float": "float", "double": "double", "boolean": "boolean", "date": "date", "string": "string", "binary": "string"}
PAGE_BYTES = 4096


def _numbered(df: DataFrame) -> DataFrame:
    """A key for rows that have none: their number within the order that Spark reads the files in."""
    marked = df.withColumn("keyloom_part", F.spark_partition_id()).withColumn("keyloom_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = marked.groupBy("keyloom_part").agg(F.count("*").alias("n"))
    before = sizes.select("keyloom_part", F.coalesce(F.sum("n").over(Window.orderBy("keyloom_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("keyloom_before"))
    return marked.join(F.broadcast(before), "keyloom_part").select((F.col("keyloom_before") + F.col("keyloom_at")).alias(KEY), *map(col, df.columns))


def read_parquet(spark: SparkSession, path: str, prefix: str | None = None, key: str | None = None) -> DataFrame:
    return mounted(spark.read.parquet(path), prefix, key)


def read_csv(spark: SparkSession, path: str, prefix: str | None = None, key: str | None = None, header: bool = True, infer: bool = False, sep: str | None = None, date_format: str = "yyyy-MM-dd", **options) -> DataFrame:
    """A CSV or TSV file; header cells may be ``name:type``.  Without types or ``infer`` all columns are text."""
    sep = sep or ("\t" if path.lower().endswith(".tsv") else ",")
    df = spark.read.csv(path, header=header, sep=sep, inferSchema=infer, **options)
    out = []
    for i, name in enumerate(df.columns):
        path_name, _, kind = name.partition(":")
        c = df[df.columns[i]]
        kind = HEADER_TYPES.get(kind.lower()) if kind else None
        out.append((F.to_date(c, date_format) if kind == "date" else c.cast(kind) if kind else c).alias(path_name if kind else name))
    return mounted(df.select(*out), prefix, key)


def _leaves(c: Column, name: str, kind: DataType) -> list[Column]:
    if isinstance(kind, StructType):
        return [x for f in kind.fields for x in _leaves(c.getField(f.name), f"{name}.{f.name}", f.dataType)]
    return [(F.to_json(c) if isinstance(kind, (ArrayType, MapType)) else c).alias(name)]


def read_json(spark: SparkSession, path: str, prefix: str | None = None, key: str | None = None, **options) -> DataFrame:
    """Documents: fields of nested objects become dotted paths, arrays are kept as JSON text; rows are numbered unless ``key`` names their key."""
    df = spark.read.json(path, **options)
    flat = df.select(*(x for f in df.schema.fields for x in _leaves(col(f.name), f.name, f.dataType)))
    return mounted(flat if key else _numbered(flat), prefix, key)


def read_raw(spark: SparkSession, path: str, prefix: str = "file", page: int = PAGE_BYTES) -> DataFrame:
    """Raw files as pages of bytes: (key, prefix.path, prefix.bytes); the key is the page's offset over the page size in its file."""
    files = spark.read.format("binaryFile").load(path)
    pages = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("length") - 1) / page)))
    cut = files.select("path", "content", F.explode(pages).alias(KEY))
    return cut.select(KEY, F.col("path").alias(f"{prefix}.path"), F.substring("content", (F.col(KEY) * page + 1).cast("int"), F.lit(page)).alias(f"{prefix}.bytes"))


def read_jdbc(spark: SparkSession, url: str, dbtable: str, prefix: str | None = None, key: str | None = None, **options) -> DataFrame:
    """A relational table; filters, limits and aggregates are pushed to the database."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=dbtable, pushDownPredicate="true", pushDownAggregate="true", pushDownLimit="true", **options)
    return mounted(reader.load(), prefix, key)


def mounted(df: DataFrame, prefix: str | None = None, key: str | None = None) -> DataFrame:
    """A source's columns under a prefix; ``key`` names the column that is the row key."""
    if key and key != KEY:
        df = df.select(col(key).cast("long").alias(KEY), *(col(c) for c in df.columns if c != key))
    return df.select(*(col(c).alias(c if c == KEY or not prefix else f"{prefix}.{c}") for c in df.columns))


def load_csv(spark: SparkSession, path: str, columns: list[str] | None, header: bool, key: str | None = None, base: int = 0, **options) -> DataFrame:
    """Rows for LOAD DATA: the first column is the key unless ``key`` names one, or rows are numbered from ``base``."""
    df = spark.read.csv(path, header=header, inferSchema=True, **options)
    if columns is not None:
        df = df.toDF(KEY, *columns) if len(df.columns) == len(columns) + 1 else _numbered(df.toDF(*columns))
    elif key:
        df = df.withColumnRenamed(key, KEY)
    else:
        df = _numbered(df)
    return df.select((F.col(KEY).cast("long") + base).alias(KEY), *map(col, value_columns(df)))


def write_csv(df: DataFrame, path: str, header: bool = False, **options) -> None:
    df.write.csv(path, header=header, **options)


def write_streams(df: DataFrame, path: str) -> None:
    """One folder for each column, with its values in key order as text lines."""
    for name in value_columns(df):
        rows = df.where(col(name).isNotNull())
        rows = rows.orderBy(KEY) if KEY in df.columns else rows
        rows.select(col(name).cast("string")).write.text(f"{path}/{name}")
