"""What several operators of this subpackage need: shared folders, lineage cuts, word and byte conventions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of all contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where that is unset, a local one is made in local mode
    (tests); on a cluster it is an error, as executors could not read what others wrote."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read back, and the path."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: it is computed once, and lost executors cost no recomputation."""
    return written(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of written() that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows sent to a Python worker at once: whole texts, of which Spark's 10,000 are tens of MB a worker, held several times over.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on Python workers get BATCH_ROWS rows at a time. No result depends on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


#: Rows of one key from which a join deals them apart from the others.
HOT_ROWS = 10_000


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], count: str = "rows", hot_rows: int = HOT_ROWS) -> DataFrame:
    """left joined with right, which has one row per key and the number of rows that share the key in the column count.

    Keys of at least hot_rows rows are broadcast, so that no task gets all of a key's rows: there are at most the rows of
    left / hot_rows of them. All others meet by a shuffle. left is read twice and should be a written table.
    """
    hot = F.broadcast(right.filter(F.col(count) >= hot_rows).drop(count))
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.filter(F.col(count) < hot_rows).drop(count), keys)
    return left.join(hot, keys).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A to Z only; lower() would change other alphabets as well."""
    return F.translate(c, UPPER, LOWER)


def ascii_strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def word_count(c: Column) -> Column:
    """Number of maximal runs of characters that are no ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def utf8_bytes(c: Column) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
