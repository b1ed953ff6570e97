"""Mixing sources to target weights by weighted fair queueing, on DataFrame functions alone.

Each source's documents are shuffled by a hash of their ids; three rounds over them form its queue. A queued document's
virtual finish time is the source's cumulative words up to and with it, divided by the source's target. All queues are
range-sorted by finish time and cut where their words reach the total budget: sums of the sorted parts name the part that
holds the cut, and running sums within that part the first document beyond it. A document is taken as often as its finish
times come before that one's, so only numbers are sorted and no row comes back by a join. Sources advance in
proportion to their targets, so the cut leaves each within about a document of its target. What a source then has beyond
its target (finish times above 1) it gives back; what is short goes, in two more passes of the same queue, to documents
small enough to fit.

Running sums over a source never meet in one task: a source's queue is split by the hash into BUCKETS parts, whose
sums are added up first. The table of sources, a row for each, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, word_count

ROUNDS = 3
WEIGHTS = 3
#: Hex digits of the shuffling hash that name a bucket: 4096 buckets for each source.
DIGITS = 3
FILLS = 2
#: Sources up to which the table of sources is broadcast, and salts of the join beyond.
BROADCAST_SOURCES, SALTS = 20_000, 64


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (sid, source, size): a row per source with its size, weight and target; a table of as many rows as sources.

    Targets share the total size by weight and stop at ROUNDS times the source's size: the level by which weights are
    multiplied is found along the sources sorted by the level at which they stop.
    """
    total = sizes.groupBy("sid").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    weighed = total.withColumn("weight", F.pmod(F.row_number().over(by_name) - 1, F.lit(WEIGHTS)) + 1).withColumn("cap", ROUNDS * F.col("source_size"))
    by_level = everything.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    stopped = weighed.select(
        "*",
        F.sum("source_size").over(everything).alias("budget"),
        F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"),
        F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("above"),
        F.row_number().over(by_level).alias("at"),
    ).withColumn("level", (F.col("budget") - F.col("below")).cast("double") / F.col("above"))
    reached = stopped.withColumn("stop", F.min(F.when(F.col("level") <= F.col("cap").cast("double") / F.col("weight"), F.col("at"))).over(everything))
    level = F.max(F.when(F.col("at") == F.col("stop"), F.col("level"))).over(everything)
    return reached.select("sid", "source_size", "weight", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def _running(rows: DataFrame, amount: str, name: str) -> DataFrame:
    """rows with name: the sum of amount over the source's queue up to and with the row."""
    parts = rows.groupBy("sid", "bucket").agg(F.sum(amount).alias("part"))
    before = F.coalesce(F.sum("part").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = parts.select("sid", "bucket", before.alias("base")).repartition("sid", "bucket")
    inside = F.sum(amount).over(Window.partitionBy("sid", "bucket").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("inside", inside).join(base, ["sid", "bucket"]).withColumn(name, F.col("base") + F.col("inside")).drop("base", "inside")


def _with_source(rows: DataFrame, facts: DataFrame, sources: int) -> DataFrame:
    """rows joined with a row per source. Few sources are broadcast; of many, each one's row is copied for SALTS salts,
    so that a source that holds a third of all rows is never dealt to one task."""
    if sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(facts), "sid")
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.pmod(F.xxhash64("bucket"), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", own).join(salted, ["sid", "salt"]).drop("salt")


def _finish(e: int) -> Column:
    """Virtual finish time in the round e; a source without words has none to wait for."""
    return F.when(F.col("target") > 0, (F.col("reach") + e * F.col("source_size")).cast("double") / F.col("target")).otherwise(0.0)


def cut_at_budget(queued: DataFrame) -> tuple[float, str, str] | None:
    """(finish, turn, sid) of the first queued document at which the words sorted by them exceed all sources' words."""
    key = ["finish", "turn", "sid"]
    entries = queued.select("turn", "sid", "size", F.explode(F.array(*[_finish(e) for e in range(ROUNDS)])).alias("finish"))
    line = cut(entries.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id()), "line")
    budget = queued.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = line.groupBy("part").agg(F.sum("size").alias("words"))  # a row for each part
    reached = parts.withColumn("upto", F.sum("words").over(Window.orderBy("part")))
    edge = reached.filter(F.col("upto") > budget).orderBy("part").select("part", (F.col("upto") - F.col("words")).alias("before")).limit(1)
    found = edge.first()
    if not found:
        return None
    within = line.filter(F.col("part") == found["part"]).withColumn("upto", F.lit(found["before"]) + F.sum("size").over(Window.partitionBy("part").orderBy(*key).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    stop = within.filter(F.col("upto") > budget).agg(F.min(F.struct(*key)).alias("stop")).first()["stop"]
    return tuple(stop)


def _before(finish: Column, stop: tuple[float, str, str] | None) -> Column:
    """1 if the cut takes a document of this finish time and it is none that its source gives back, else 0."""
    kept = finish <= 1
    if stop is not None:
        f, turn, sid = (F.lit(x) for x in stop)
        tied = (F.col("turn") < turn) | ((F.col("turn") == turn) & (F.col("sid") < sid))
        kept &= (finish < f) | ((finish == f) & tied)
    return kept.cast("int")


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, times (0 to 3), finish (virtual finish time of the first round) and row,
    a hash of the document's id, source and text.

    Size is the number of words of the whole text, however long; a null or empty text has none. A null source is a source
    of its own, the last. Documents of no words are taken as often as their queue position comes up, which adds no words.
    Ties in the queue are ordered by the id's hash, then source. Rows that repeat a doc_id are documents of their own,
    rows without an id are queued first. An empty table gives no rows. Other columns are not read, so clashing names do
    no harm.
    """
    own = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))
    turn = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = cut(docs.select("doc_id", "source", own.alias("sid"), word_count(F.col(text)).alias("size"), turn.alias("turn"), row_hash(text).alias("row")), "sizes").withColumn("bucket", F.substring("turn", 1, DIGITS))
    goal = cut(targets(sized), "targets")
    sources = goal.count()
    queued = cut(_with_source(_running(sized, "size", "reach"), goal, sources), "queued")
    stop = cut_at_budget(queued)
    taken = queued.withColumn("times", sum((_before(_finish(e), stop) for e in range(ROUNDS)), F.lit(0)))
    for _ in range(FILLS):
        done = cut(taken, "taken")
        short = done.groupBy("sid").agg((F.first("target") - F.sum(F.col("times") * F.col("size"))).alias("short"))
        fits = (F.col("times") < ROUNDS) & (F.col("size") <= F.col("short"))
        offered = _with_source(done, short, sources).withColumn("offer", F.when(fits, F.col("size")).otherwise(0))
        filled = _running(offered, "offer", "sum")
        taken = filled.withColumn("times", F.col("times") + F.when(fits & (F.col("sum").cast("double") <= F.col("short")), 1).otherwise(0)).drop("short", "offer", "sum")
    return taken.select("doc_id", "source", "size", "source_size", "target", "times", _finish(0).alias("finish"), "row")


def row_hash(text: str = "text") -> Column:
    return F.xxhash64("doc_id", "source", text)


def mixed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, each row as often as the mix takes it, with all columns as they are.

    Rows equal in doc_id, source and text share their counts: of such rows as many are taken once, twice and three times
    as the mix has it.
    """
    times = F.col("times")
    counts = mix(docs, text).groupBy("row").agg(*[F.count_if(times >= n).alias(f"n{n}") for n in range(1, ROUNDS + 1)]).filter("n1 > 0")
    packed = docs.select(F.struct("*").alias("doc"), row_hash(text).alias("row"))
    nth = F.row_number().over(Window.partitionBy("row").orderBy("row"))
    numbered = packed.join(counts, "row").withColumn("nth", nth)
    often = sum((F.col("nth") <= F.col(f"n{n}")).cast("int") for n in range(1, ROUNDS + 1))
    return numbered.select("doc", often.alias("often")).filter("often > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("often")))).select("doc.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def _sql_fill(n: int) -> str:
    last = f"t{n - 1}"
    return f"""
, f{n} AS (SELECT x.*, s.short, (times < {ROUNDS} AND size <= s.short) AS fits FROM {last} x
  JOIN (SELECT sid, first(target) - sum(times * size) AS short FROM {last} GROUP BY sid) s USING (sid))
, t{n} AS (SELECT * EXCLUDE (times, short, fits, sum), times + CASE WHEN fits AND sum::DOUBLE <= short THEN 1 ELSE 0 END AS times
  FROM (SELECT *, sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY sid ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS sum FROM f{n}))"""


OP10_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS sid, md5(coalesce(doc_id::VARCHAR, '')) AS turn,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), total AS (SELECT sid, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY sid
), weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {WEIGHTS} + 1 AS weight, {ROUNDS} * source_size AS cap FROM total
), stopped AS (SELECT *, sum(source_size) OVER ()::BIGINT AS budget,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS above,
    row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth FROM weighed
), levels AS (SELECT *, (budget - below)::DOUBLE / above AS level FROM stopped
), goal AS (SELECT sid, source_size, least(cap::DOUBLE, (SELECT level FROM levels WHERE level <= cap::DOUBLE / weight ORDER BY nth LIMIT 1) * weight) AS target FROM levels
), queued AS (SELECT *, sum(size) OVER (PARTITION BY sid ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS reach FROM sized JOIN goal USING (sid)
), entries AS (SELECT turn, sid, size, CASE WHEN target > 0 THEN (reach + e * source_size)::DOUBLE / target ELSE 0 END AS finish FROM queued, range(0, {ROUNDS}) r(e)
), line AS (SELECT finish, turn, sid, sum(size) OVER (ORDER BY finish, turn, sid RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM entries
), stop AS (SELECT finish AS f, turn AS t, sid AS s FROM line WHERE upto > (SELECT sum(size) FROM sized) ORDER BY finish, turn, sid LIMIT 1
), finishes AS (SELECT *, {', '.join(f'CASE WHEN target > 0 THEN (reach + {e} * source_size)::DOUBLE / target ELSE 0 END AS f{e}' for e in range(ROUNDS))} FROM queued LEFT JOIN stop ON true
), t0 AS (SELECT * EXCLUDE (f, t, s, {', '.join(f'f{e}' for e in range(ROUNDS))}), {' + '.join(f'CASE WHEN f{e} <= 1 AND (f IS NULL OR f{e} < f OR (f{e} = f AND (turn < t OR (turn = t AND sid < s)))) THEN 1 ELSE 0 END' for e in range(ROUNDS))} AS times FROM finishes)
{''.join(_sql_fill(n + 1) for n in range(FILLS))}
SELECT doc_id, size, source_size, target, (times * size)::BIGINT AS taken FROM t{FILLS}
"""
