"""SimHash fingerprints, linked by multi-index hashing over Hamming balls in fingerprint halves.

Two 64-bit fingerprints that differ in at most three bits differ in at most one bit in one of their two 32-bit
segments. The table side stores each distinct fingerprint under its two segments; the probe side enumerates the ball
of radius one around each segment and fetches the table's entries, whose complete distance is then verified.
Of two segments one bit apart just one has that bit clear, so a probe sets clear bits only: half the ball finds each pair.

Buckets of more than HOT_BUCKET different fingerprints are linked without pairs: in such a bucket the other segments
of x and y are at most three bits apart exactly if some z lies within two bits of one and one bit of the other.
Each z, around which at most 529 + 32 * 33 fingerprints exist, links all its members to one inner member.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, remove, skew_join, table, written
from .components import components

SEED = 42
BITS = 3
#: Table entries of one bucket above which pairs are replaced by stars; results are the same either way.
HOT_BUCKET = 256
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a whole text; zero if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts, stops = (ends - sizes)[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        part = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: str, shingle: int = 3) -> Column:
    """A signed long with the fingerprint's bits."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return run(F.col(text))


def links(prints: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """prints (fp long, distinct); returns edges (u, v) that connect exactly what lies within three bits."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    halves = F.array(F.shiftrightunsigned("fp", 32), low)
    key = lambda part, at: part.bitwiseOR(at.cast("long") * F.lit(1 << 32))  # noqa: E731  33 bits: segment number and value
    stored = prints.select("fp", F.posexplode(halves).alias("at", "part")).select(key(F.col("part"), F.col("at")).alias("key"), "fp")
    flips = F.expr("transform(filter(sequence(0L, 31L), i -> (part & shiftleft(1L, cast(i as int))) = 0), i -> part | shiftleft(1L, cast(i as int)))")
    probes = (
        prints.select("fp", F.posexplode(halves).alias("at", "part"))
        .select("fp", "at", "part", F.explode(F.concat(F.array("part"), flips)).alias("near"))
        .select(key(F.col("near"), F.col("at")).alias("key"), F.col("fp").alias("x"), (F.col("near") != F.col("part")).alias("flipped"))
    )
    hot = stored.groupBy("key").count().filter(F.col("count") > hot_bucket).select("key")
    entries = stored.join(hot, "key", "left_anti").select("key", F.col("fp").alias("y")).unionByName(hot.select("key", F.lit(None).cast("long").alias("y")))
    # merge: a planner that goes by the size of the file would send the probes, 68 a fingerprint, through the driver
    met = probes.join(entries.hint("merge"), "key")
    near = met.filter(F.col("y").isNotNull() & (F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= BITS)).select(F.col("x").alias("u"), F.col("y").alias("v"))
    return near.unionByName(_stars(met.filter(F.col("y").isNull())))


def _stars(members: DataFrame) -> DataFrame:
    """members (key, x, flipped) of hot buckets; links what is within three bits, by common neighbours of the other segment."""
    rest = F.when(F.shiftrightunsigned("key", 32) == 0, F.col("x").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("x", 32))
    one = [1 << i for i in range(32)]
    two = [a | b for k, a in enumerate(one) for b in one[:k]]
    masks = lambda xs: F.expr(f"array({', '.join(f'{x}L' for x in xs)})")
    around = members.select("key", "x", "flipped", rest.alias("rest")).select(
        "key", "x", "rest", F.explode(F.when(F.col("flipped"), F.transform(masks([0, *one]), lambda m: F.struct(m.alias("m"), F.lit(False).alias("inner")))).otherwise(
            F.concat(F.transform(masks([0, *one]), lambda m: F.struct(m.alias("m"), F.lit(True).alias("inner"))), F.transform(masks(two), lambda m: F.struct(m.alias("m"), F.lit(False).alias("inner"))))
        )).alias("s"),
    ).select("key", "x", F.col("rest").bitwiseXOR(F.col("s.m")).alias("z"), F.col("s.inner").alias("inner"))
    centre = F.min(F.when(F.col("inner"), F.col("x"))).over(Window.partitionBy("key", "z"))
    return around.withColumn("c", centre).filter("c is not null and c <> x").select(F.col("x").alias("u"), F.col("c").alias("v")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable over links).

    Null and wordless texts have fingerprint zero and are linked like others. Repeated rows stay repeated. Rows with a
    null id keep it; they link others but never name a component unless all its ids are null (then it is null).
    Exact copies meet in a partial aggregation by fingerprint, so groups of copies never form pairs. A bit that half of
    the shingles set is a tie and stays clear. Texts are read whole, however long. An empty table gives no rows.
    Columns beside the two named are not read, so clashing names do no harm.
    """
    marked = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprint_column(text, shingle).alias("fp")), "fingerprints")
    prints = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "prints")
    roots = components(links(prints.select("fp"), hot_bucket))
    rooted = cut(prints.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    named = skew_join(rooted, cut(names, "names"), ["root"]).select("fp", "component_id", F.col("copies").alias("rows"))
    return skew_join(marked, cut(named, "named"), ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Copies are texts whose sets of five-word shingles have a Jaccard similarity of at least 4 / 5.
COPY_SHINGLE = 5
#: Shingles in at least COMMON_COUNT texts of a drawn sixteenth are looked up last, at most COMMON of them. This and the
#: draw set an order, which decides how fast copies are found and never which.
COMMON, COMMON_COUNT, COMMON_SHARE = 250_000, 4, 16
#: Texts that hold a shingle, as the draw has it, from which they are dealt to SALTS parts. The plan alone depends on it.
HOT_TOKEN, SALTS = 10_000, 64
#: Buckets of hashes by which texts that meet are first compared; the fewer, the more pairs have their sets compared.
MARKS = 1024


def shingle_hashes(text: str | None, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """The different hashes of a text's shingles, ascending; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts, stops = [0, *(ends[: n - 1] + 1).tolist()], ends[min(shingle, len(words)) - 1 :].tolist() if words else [0]
    digest = xxhash.xxh64_intdigest
    return np.array(sorted({digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)}), dtype=np.uint64).view(np.int64)


def _shingles_column(text: str) -> Column:
    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_hashes(t) for t in texts], dtype=object)

    return run(F.col(text))


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common shingles, ascending, their ranks from 1, the rarest first, and whether so many texts hold one that it is salted."""
    drawn = texts.filter(F.pmod("node", F.lit(COMMON_SHARE)) == 0).select("node", F.explode(_shingles_column("text")).alias("token"))
    counts = drawn.groupBy("token").agg(F.count_distinct("node").alias("n")).filter(F.col("n") >= COMMON_COUNT).orderBy(F.desc("n"), "token").limit(COMMON)
    found = counts.toArrow()
    tokens, n = found.column("token").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], len(tokens) - order, n[order] * COMMON_SHARE >= HOT_TOKEN


def _prefixes(texts: DataFrame, common: np.ndarray, rank: np.ndarray, hot: np.ndarray) -> DataFrame:
    """(token, salt, node, n, at): of each text's n shingles the n // 5 + 1 first, with their places from 0; uncommon ones
    by hash, then common ones. salt is 0, or a part of a hot shingle's texts."""
    names = ["token", "salt", "node", "n", "at"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()  # copies in one task are looked up once
        for batch in batches:
            rows, held = [], 0
            for node, text in zip(batch["node"].tolist(), batch["text"], strict=True):
                if node in seen:
                    continue
                seen.add(node)
                own = shingle_hashes(text)
                late, salted = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=bool)
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    known = common[at] == own
                    late, salted = np.where(known, rank[at], 0), known & hot[at]
                first = np.argsort(late, kind="stable")[: len(own) // 5 + 1]
                salt = np.where(salted[first], 1 + node % SALTS, 0)
                rows.append((own[first], salt, np.full(len(first), node), np.full(len(first), len(own)), np.arange(len(first))))
                held += len(first)
                if held > _CHUNK:
                    yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*rows, strict=True)), strict=True)))
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*rows, strict=True)), strict=True)))

    return texts.mapInPandas(run, "token long, salt int, node long, n long, at long")


def _possible(n: Column, at: Column, m: Column, by: Column) -> Column:
    """Whether texts of n and m shingles, whose first common shingle is at these places, can share 4 / 9 of n + m."""
    return 9 * F.least(n - at, m - by) >= 4 * (n + m)


def _marks_column(text: str) -> Column:
    """For each of MARKS buckets of hashes whether a text has an odd number of its shingles there, as longs of 64 bits."""

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            odd = (np.bincount(shingle_hashes(t).view(np.uint64) % np.uint64(MARKS), minlength=MARKS) % 2 for t in texts)
            yield pd.Series([np.packbits(x.astype(bool), bitorder="little").view("<i8") for x in odd], dtype=object)

    return run(F.col(text))


def _close(n: Column, marks: Column, m: Column, others: Column) -> Column:
    """Whether texts of n and m shingles with these marks can be copies: a bucket that is odd in one of them only holds a
    shingle that one of them lacks, and copies have at most a ninth of n + m such shingles."""
    return 9 * reduce(add, (F.bit_count(F.get(marks, F.lit(i)).bitwiseXOR(F.get(others, F.lit(i)))) for i in range(MARKS // 64))) <= n + m


def _pairs(met: DataFrame) -> DataFrame:
    """The different pairs of met (u, nu, v, nv), whichever of both comes first."""
    ordered = F.when(F.col("u") < F.col("v"), F.struct("u", "nu", "v", "nv")).otherwise(F.struct(F.col("v").alias("u"), F.col("nv").alias("nu"), F.col("u").alias("v"), F.col("nu").alias("nv")))
    return met.select(ordered.alias("p")).select("p.*").distinct()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (u, v), a written table: those of a Jaccard similarity of at least 4 / 5, by their whole sets of shingles."""
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    own = texts.join(nodes.hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets, path = written(own.select("node", _shingles_column("text").alias("shingles")), "sets")
    x, y = (sets.select(F.col("node").alias(k), F.col("shingles").alias(s)).hint("merge") for k, s in (("u", "su"), ("v", "sv")))
    shared = pairs.join(x, "u").join(y, "v").select("u", "v", F.size(F.array_intersect("su", "sv")).alias("shared"), (F.size("su") + F.size("sv")).alias("both"))
    verified = cut(shared.filter(9 * F.col("shared") >= 4 * F.col("both")).select("u", "v"), "verified")
    remove(texts.sparkSession, path)
    return verified


def _met(rows: DataFrame) -> DataFrame:
    """rows of _prefixes with three texts of each shingle that several hold: the least and the greatest node, and the
    text with the fewest shingles before it, to which most others are alike."""
    one = F.struct("node", "n", "at")
    ends = {"least": F.min(one), "most": F.max(one), "pure": F.min(F.struct((F.col("at") / F.col("n")).alias("share"), "node", "n", "at"))}
    by_part = Window.partitionBy("token", "salt")
    parts = rows.repartition("token", "salt").dropDuplicates(["token", "salt", "node"]).withColumns({k: f.over(by_part) for k, f in ends.items()})
    found = cut(parts.filter((F.col("salt") > 0) | (F.col("least.node") != F.col("most.node"))), "met")
    # of shingles in at least HOT_TOKEN texts, so at most the rows / HOT_TOKEN
    whole = found.filter("salt > 0").groupBy("token").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min("pure").alias("pure"))
    hot = found.filter("salt > 0").drop(*ends).join(F.broadcast(whole), "token").filter(F.col("least.node") != F.col("most.node"))
    return found.filter("salt = 0").unionByName(hot)


def similar_links(texts: DataFrame, known: DataFrame) -> DataFrame:
    """texts (node long, text), one text per node, repeats allowed; known edges (u, v). Returns known and further edges,
    which together connect all texts of a Jaccard similarity of at least 0.8, and none by less.

    Two such sets share at least 4 / 5 of either, so under any common order of shingles they share one of the n // 5 + 1
    first of each, and what follows the first one they share is enough for 4 / 5: no pair is missed, at any size.
    Shingles of common passages come last in the order, so texts that share no more than a passage do not meet, or meet
    too late. Texts that meet under a shingle are first compared with three of them; then all pairs that meet and are not
    yet connected are compared, so a group of near copies is not expanded into pairs unless those comparisons leave it
    in pieces. Marks of whole sets (odd sketches) bound what two texts share, so texts with a passage in common are told
    apart as they meet. Each candidate's exact similarity decides.
    """
    met = _met(_prefixes(texts, *_common(texts)))
    centre = F.explode(F.array(*[F.struct(f"{k}.node", f"{k}.n", f"{k}.at") for k in ("least", "most", "pure")]))
    stars = met.select("node", "n", "at", centre.alias("c")).filter((F.col("node") != F.col("c.node")) & _possible(F.col("n"), F.col("at"), F.col("c.n"), F.col("c.at")))
    marks = cut(texts.select("node", _marks_column("text").alias("marks")).groupBy("node").agg(F.first("marks").alias("marks")), "marks")
    mu, mv = (marks.select(F.col("node").alias(k), F.col("marks").alias(m)).hint("merge") for k, m in (("u", "mu"), ("v", "mv")))
    found = _pairs(stars.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("c.node").alias("v"), F.col("c.n").alias("nv")))
    pairs = found.join(mu, "u").join(mv, "v").filter(_close(F.col("nu"), F.col("mu"), F.col("nv"), F.col("mv"))).select("u", "v")
    linked = known.unionByName(_verified(cut(pairs, "pairs"), texts))
    roots = components(linked).withColumnRenamed("u", "node")
    here = cut(met.select("token", "salt", "node", "n", "at").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), "here")
    # of shingles whose texts are not all connected: the largest piece under each is main
    pieces = here.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"))
    parted = pieces.groupBy("token").agg(F.sum("k").alias("rows"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct("k", "root"))["root"].alias("main"))
    apart = cut(skew_join(here, cut(parted.filter("lo <> hi").drop("lo", "hi"), "parted"), ["token"], hot_rows=HOT_TOKEN), "apart")
    left = cut(apart.join(marks.hint("merge"), "node"), "left")
    a, b = left.filter("root <> main").alias("a"), left.alias("b").hint("merge")
    once = (F.col("b.root") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))
    near = _possible(F.col("a.n"), F.col("a.at"), F.col("b.n"), F.col("b.at"))
    close = _close(F.col("a.n"), F.col("a.marks"), F.col("b.n"), F.col("b.marks"))
    crossed = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.root") != F.col("b.root")) & once & near & close)
    pairs = _pairs(crossed.select(F.col("a.node").alias("u"), F.col("a.n").alias("nu"), F.col("b.node").alias("v"), F.col("b.n").alias("nv")))
    return linked.unionByName(_verified(cut(pairs.select("u", "v"), "pairs"), texts))


def _copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, node (a hash of the text), root and component_id of each row."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    marked = cut(texts.select("doc_id", "node", fingerprint_column("text").alias("fp")), "marked")
    prints = cut(marked.groupBy("node", "fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "prints")
    # nodes of one fp are one for links()
    narrow = prints.groupBy("fp").agg(F.min("node").alias("least"))
    same = prints.join(narrow, "fp").filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    a, b = (narrow.select(F.col("fp").alias(k), F.col("least").alias(n)) for k, n in (("u", "nu"), ("v", "nv")))
    close = links(narrow.select("fp")).join(a.hint("merge"), "u").join(b.hint("merge"), "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"))
    known = cut(same.unionByName(close), "known")
    roots = components(similar_links(texts.select("node", "text"), known)).withColumnRenamed("u", "node")
    rooted = cut(prints.join(roots, "node", "left").select("node", "first", "copies", F.coalesce("root", "node").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    named = skew_join(rooted, cut(names, "names"), ["root"]).select("node", "root", "component_id", F.col("copies").alias("rows"))
    return skew_join(marked, cut(named, "named"), ["node"]).select("doc_id", "node", "root", "component_id")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and component_id by a Jaccard similarity of 0.8 over five-word shingles and by the links of near_duplicates,
    whichever join.

    Null and wordless texts are copies of each other. Null ids are kept and name no component.
    """
    return _copies(docs, doc_id, text).select("doc_id", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: of each component one document with all its columns, that of the smallest doc_id.

    Rows are told apart by doc_id and text: of rows that repeat an id with different texts, the least by the text's hash
    stands for the id, and rows of one id and text stay once. Rows without an id come last: one stays only if no row of
    its component has an id.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "node")
    rows = _copies(docs).groupBy("root", "doc_id", "node").agg(F.count(F.lit(1)).alias("rows"))
    best = rows.groupBy("root").agg(F.min(rank).alias("best"), F.min_by("rows", rank).alias("rows"))
    kept = cut(best.select(_place(F.col("best.doc_id"), F.col("best.node")).alias("at"), "rows"), "kept")
    packed = docs.select(F.struct("*").alias("doc"), _place(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))).alias("at")).join(kept.select("at"), "at", "left_semi")
    if kept.filter("rows > 1").take(1):  # else no row has an equal
        packed = packed.withColumn("nth", F.row_number().over(Window.partitionBy("at").orderBy("at"))).filter("nth = 1")
    return packed.select("doc.*")


def _place(doc_id: Column, node: Column) -> Column:
    """A document's id and text, comparable where the id is null."""
    return F.struct(doc_id.isNull().alias("late"), F.coalesce(doc_id, F.lit(0)).alias("id"), node.alias("node"))
