"""Line deduplication on DataFrame functions alone: repeated lines stay in one document, told by keep bitmaps.

Lines are known by 128-bit hashes of their keys; no text is shuffled to find the repeated ones. All occurrences of lines
long enough are range-partitioned by hash and document and sorted, within a hash, by document and position: one sorted
stream, written once. In it the first occurrence of a hash in a document stands for the document, so counting those
(first in each part of the stream, so that a key which every document holds is no load) gives the number of documents and
the largest. The other documents' occurrences are streamed out of the table again, keys of very many documents met by a
broadcast, and the positions of lines to drop return to their documents as a run-length compressed keep bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, ascii_strip, cut, skew_join, table

MIN_CHARS, MIN_DOCS = 40, 5


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, row (hash of the text), pos (from 1) and the two halves of the key's hash, of each line long enough."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = lines.filter(F.length("line") >= min_chars).select("doc_id", "row", (F.col("pos") + 1).alias("pos"), ascii_lower(ascii_strip(F.col("line"))).alias("key"))
    return keyed.filter(F.length("key") >= min_chars).select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def stream(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """occurrences() range-partitioned by hash and document, sorted by hash, document and position, with first: whether
    the row is the first of its hash in its document. Rows that repeat a doc_id are one document here."""
    key = ["h1", "h2", "doc_id"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("pos", "row"))
    found = occurrences(docs, min_chars).repartitionByRange(*key).withColumn("first", nth == 1)
    return cut(found, "lines")


def repeated(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lines: stream(). h1, h2, rows (the number of documents) and last, the largest doc_id, of the hashes found in at
    least min_docs documents (rows without doc_id aside)."""
    named = lines.filter(F.col("first") & F.col("doc_id").isNotNull())
    return named.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("rows"), F.max("doc_id").alias("last")).filter(F.col("rows") >= min_docs)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, row and dropped (sorted line numbers from 1), for rows that lose lines. Repeated rows have one entry."""
    lines = stream(docs, min_chars)
    keys = cut(repeated(lines, min_docs), "keys")
    lost = skew_join(lines.drop("first"), keys, ["h1", "h2"]).filter(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("last")))
    return lost.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def keep_runs(dropped: Column, lines: Column) -> Column:
    """The runs (start from 1, size) of lines to keep: a run-length coded bitmap. Linear in both arrays."""
    at = lambda i: F.when(i < F.size(dropped), F.get(dropped, i)).otherwise(F.size(lines) + 1)
    before = lambda i: F.when(i > 0, F.get(dropped, i - 1)).otherwise(F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.size(dropped)), lambda i: F.struct((before(i) + 1).alias("start"), (at(i) - before(i) - 1).alias("size")))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs (doc_id, text) with keep (runs of kept lines), n_lines, n_dropped and kept (the text that stays).

    A null or empty text is one empty line; texts are read whole, however long. Documents are told apart by doc_id: rows
    that repeat an id count once and are treated alike; rows without an id count for no key and lose all repeated lines.
    Of documents that tie in a key the largest doc_id keeps it. An empty table gives no rows. Other columns are not read,
    so clashing names do no harm.
    """
    plain = docs.select("doc_id", "text")
    marks = keep_bitmaps(plain, min_chars, min_docs)
    left = plain.withColumn("row", F.xxhash64("text"))
    met = left.join(marks, left["doc_id"].eqNullSafe(marks["doc_id"]) & (left["row"] == marks["row"]), "left")
    cut_up = met.select(left["doc_id"], lines_of(F.col("text")).alias("lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    runs = cut_up.withColumn("keep", keep_runs(F.col("dropped"), F.col("lines")))
    kept = F.flatten(F.transform("keep", lambda r: F.slice("lines", r["start"], r["size"])))
    return runs.select("doc_id", "keep", F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept"))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = f"""
WITH lines AS (
  SELECT doc_id, pos, line,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), repeated AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), marked AS (
  SELECT l.*, (r.key IS NOT NULL AND l.doc_id <> r.last) AS dropped FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
