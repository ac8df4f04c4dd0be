"""Helpers shared by the operators: tables in the shared folder, ranks, and re-keying."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as the contracts define it: a blank and the characters 9 to 13.
WHITE = " \t\n\x0b\x0c\r"
#: A word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master where none is set (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="affinia-")
    return _local[context.applicationId]


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/affinia/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has stored: call it once the results are written elsewhere."""
    _delete(spark, _own_dir(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, by: str, parts: int, dealt: bool = False) -> DataFrame:
    """df, written to the shared folder in parts by a column's hash and sorted by it: joins by it need no further shuffle.

    Only the files stay; the catalog's entry goes once the table is read. With dealt, df already lies in so many
    parts by the column, but for a few rows, and isn't dealt again.
    """
    spark, table = df.sparkSession, f"affinia_{uuid.uuid4().hex}"
    (df if dealt else df.repartition(parts, by)).write.bucketBy(parts, by).sortBy(by).option("path", new_path(spark, name)).saveAsTable(table)
    found = spark.table(table)
    found.schema  # resolved while the entry is there
    spark.sql(f"DROP TABLE {table}")
    return found


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, stored with a number for each row, and that column's name, which is free in docs.

    The numbers are written with the rows: a later read gives the same ones, however it is split.
    """
    name = "__row"
    while name in docs.columns:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "keyed"), name


def path_of(sf_dir: str, table: str) -> str:
    return f"{sf_dir}/{table}.parquet"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(path_of(sf_dir, table))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_of(df: DataFrame, name: str = "doc_id") -> Column:
    """The column of ids as long. A column that is long already stays as it is: an alias more in one
    branch of a plan than in another would keep Spark from using an exchange twice."""
    return F.col(name) if dict(df.dtypes)[name] == "bigint" else F.col(name).cast("long").alias(name)


def without_white(text: Column) -> Column:
    """text without its white space; a null text is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def ranked(df: DataFrame, order: Column, name: str = "rank") -> DataFrame:
    """df with each row's place (from 0) in the order of a column, without bringing rows to one task.

    Rows are dealt by range, numbered within their partition, and shifted by the sizes of the
    partitions before; only one row per partition meets in a single task.
    """
    dealt = stored(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy("__part").orderBy(order)
    return (
        dealt.withColumn("__at", F.row_number().over(inside))
        .join(F.broadcast(shift), "__part")  # one row per partition
        .withColumn(name, (F.col("__shift") + F.col("__at") - 1).cast("long"))
        .drop("__part", "__at", "__shift")
    )
