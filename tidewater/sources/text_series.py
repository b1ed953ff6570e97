"""Text recordings of nights: labels, motion, heart rate and steps, found by file name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder, file suffix and columns of each kind; steps are optional.
KINDS = {"labels": ("_labeled_sleep.txt", 2), "motion": ("_acceleration.txt", 4), "heart_rate": ("_heartrate.txt", 2), "steps": ("_steps.txt", 2)}
OPTIONAL = ("steps",)


def parse_lines(lines: DataFrame, columns: int, keys: list[str]) -> DataFrame:
    """keys, line, t, v: numbers parted by white space or commas; # starts a comment; what is no number is null.

    Rows whose time is null go. A line of too few columns has nulls, a file in which no line has enough is an error of
    require_columns. lines has keys, line (number in file) and value.
    """
    bare = F.trim(F.regexp_replace("value", "#.*", ""))
    cells = F.split(bare, r"\s*,\s*|\s+")
    number = F.transform(F.slice(cells, 1, columns), lambda x: x.try_cast("double"))
    rows = lines.filter(bare != "").select(*keys, "line", number.alias("__n"), F.size(cells).alias("__k"))
    kept = rows.select(*keys, "line", F.get("__n", F.lit(0)).alias("t"), F.slice(F.concat("__n", F.array_repeat(F.lit(None).cast("double"), columns)), 2, columns - 1).alias("v"), (F.col("__k") >= columns).alias("whole"))
    return kept.filter("t is not null and not isnan(t)")


def require_columns(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of the files in which no line has all columns."""
    return rows.groupBy(*keys).agg(F.max("whole").alias("any")).filter("not any").select(*keys)


def read_kind(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """client_id, kind, line, t, v of all files of a kind; no folder, no rows. Lines are read in parallel; their order in
    a file (the tie-breaker of equal times) is the text reader's running id within the file."""
    suffix, columns = KINDS[kind]
    raw = spark.read.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").text(f"{root}/{kind}")
    name = F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*){suffix.replace('.', '[.]')}$", 1)
    lines = raw.select(F.concat(F.lit("SLEEP_"), name).alias("client_id"), F.lit(kind).alias("kind"), F.monotonically_increasing_id().alias("line"), "value")
    return parse_lines(lines, columns, ["client_id", "kind"])


def subjects(spark: SparkSession, root: str) -> DataFrame:
    """client_id and whether each file is there; a missing mandatory one is told in missing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(root).select("path")
    found = None
    for kind, (suffix, _) in KINDS.items():
        part = files.filter(F.col("path").contains(f"/{kind}/") & F.col("path").endswith(suffix)).select(F.concat(F.lit("SLEEP_"), F.regexp_extract("path", rf"([^/]+){suffix.replace('.', '[.]')}$", 1)).alias("client_id"), F.lit(True).alias(kind))
        found = part if found is None else found.join(part, "client_id", "left")
    gone = F.filter(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in KINDS if k not in OPTIONAL]), lambda x: x.isNotNull())
    return found.select("client_id", *[F.coalesce(F.col(k), F.lit(False)).alias(k) for k in KINDS], gone.alias("missing"))
