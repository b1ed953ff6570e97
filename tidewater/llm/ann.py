"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Trees are fitted on a bounded sample; each level of a tree has one random direction (of a few drawn the one along which
the sample spreads furthest), each node the median of its sample's projections, so a tree is small however many rows it
will hold. All rows are indexed in the leaves of all trees. A query walks the trees through one shared priority queue,
nearest boundaries first, until it has as many leaves as a trial on the sample has shown to be enough; the vectors in
them are reranked by the exact inner product, leaf by leaf as matrix products.

Leaves are dealt to tasks by cells, subtrees of about CELL rows. A query is sent once to each cell of which it visits
leaves, and a cell returns one list of its K + 1 nearest for it. Cells of more rows or probes are divided, so that a task
holds at most about CELL rows and PROBES queries; leaves larger than LEAF, which the sample is too small to split, are
searched whole.

Vectors are lifted to one more dimension, sqrt(M^2 - |x|^2), which turns largest inner product into nearest direction.
Equal vectors are indexed once, with the smallest K + 1 of their ids: more could never be among K nearest, as ties go to
the smaller id. So groups of copies cost nothing, neither as rows nor as queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

K, EVERY = 20, 20
#: Different vectors (about so many, drawn by hash) the trees are fitted on, trees, wanted rows of a leaf.
SAMPLE, TREES, LEAF = 32_768, 4, 512
#: Directions drawn for a level, of which the widest is taken.
DRAWN = 8
#: A query visits as many leaves as give this recall among TUNE queries of the sample, whose neighbours lie further
#: apart than those of all rows.
RECALL, TUNE = 0.95, 200
#: Rows and queries that meet in one call at most (about: they are dealt by hash), and lists merged in one call.
CELL, PROBES, LISTS = 16_384, 1024, 8192


@dataclass
class Forest:
    bound: float  # largest norm
    directions: np.ndarray  # (trees, levels, dimensions + 1)
    medians: np.ndarray  # (trees, inner nodes), breadth first

    @property
    def levels(self) -> int:
        return self.directions.shape[1]

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.bound**2 - (x * x).sum(1), 0.0))
        return np.column_stack([x, rest])

    def project(self, lifted: np.ndarray) -> np.ndarray:
        return np.einsum("nd,tld->ntl", lifted, self.directions, optimize=True)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each row in each tree."""
        at = self.project(self.lift(x))
        node = np.zeros(at.shape[:2], dtype=np.int64)
        tree = np.arange(at.shape[1])
        for level in range(self.levels):
            node = 2 * node + 1 + (at[:, :, level] > self.medians[tree, node])
        return node - (2**self.levels - 1)

    def search(self, x: np.ndarray, leaves: int) -> Iterator[list[tuple[int, int]]]:
        """The (tree, leaf) pairs each query visits, through one queue for all trees, least boundary distance first."""
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) * self.bound
        at = self.project(np.column_stack([unit, np.zeros(len(x))]))
        inner = 2**self.levels - 1
        for row in at:
            queue, found = [(0.0, t, 0, 0) for t in range(len(row))], []
            while queue and len(found) < leaves:
                far, t, node, level = heapq.heappop(queue)
                while node < inner:
                    gap = row[t, level] - self.medians[t, node]
                    side = int(gap > 0)
                    heapq.heappush(queue, (far + gap * gap, t, 2 * node + 2 - side, level + 1))
                    node, level = 2 * node + 1 + side, level + 1
                found.append((t, node - inner))
            yield found


def fit(sample: np.ndarray, bound: float, rows: int, trees: int = TREES, leaf: int | None = None, seed: int = 0) -> Forest:
    """Trees as deep as rows need for leaves of the wanted size, and as the sample can tell medians apart."""
    levels = max(0, int(np.ceil(np.log2(max(rows, 1) / (leaf or LEAF)))))
    levels = min(levels, max(0, int(np.log2(max(len(sample), 1) / 4))))
    rng, width = np.random.default_rng(seed), sample.shape[1] + 1
    forest = Forest(bound, np.zeros((trees, levels, width)), np.zeros((trees, 2**levels - 1)))
    lifted = forest.lift(sample)
    for t in range(trees):
        node = np.zeros(len(sample), dtype=np.int64)
        for level in range(levels):
            drawn = rng.standard_normal((DRAWN, width))
            drawn /= np.linalg.norm(drawn, axis=1, keepdims=True)
            along = lifted @ drawn.T
            best = int(along.std(axis=0).argmax())
            forest.directions[t, level], at = drawn[best], along[:, best]
            order = np.lexsort((at, node))
            first = np.searchsorted(node[order], np.arange(2**level - 1, 2 ** (level + 1)))
            for k in range(2**level):
                part = order[first[k] : first[k + 1]]
                if len(part):
                    forest.medians[t, 2**level - 1 + k] = np.median(at[part])
            node = 2 * node + 1 + (at > forest.medians[t, node])
    return forest


def tune(forest: Forest, sample: np.ndarray, k: int = K, recall: float = RECALL) -> int:
    """Leaves a query must visit for the wanted recall of its k nearest others within the sample."""
    everything = forest.medians.shape[0] * 2**forest.levels
    if len(sample) < 2 or everything <= forest.medians.shape[0]:
        return everything
    asked = np.linspace(0, len(sample) - 1, min(TUNE, len(sample))).astype(int)
    queries = sample[asked]
    near = -(queries @ sample.T)
    near[np.arange(len(asked)), asked] = np.inf
    k = min(k, len(sample) - 1)
    best = np.argpartition(near, k - 1, axis=1)[:, :k]
    leaf = forest.leaves(sample)
    # after how many visits a query has met each of its neighbours
    met = []
    for order, found in zip(forest.search(queries, everything), best, strict=True):
        turn = {x: i + 1 for i, x in enumerate(order)}
        met += [min(turn[t, int(leaf[n, t])] for t in range(leaf.shape[1])) for n in found]
    return int(np.quantile(met, recall, method="higher"))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and vec of the rows that take part: an id, finite components, not all zero; shorter vectors are filled up
    with zeros, so that a product is the sum over the components both have."""
    v = F.col(embedding)
    good = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).filter(F.forall("vec", lambda x: x.isNotNull()))
    good = good.filter(F.forall("vec", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0))
    sizes = good.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if sizes[0] == sizes[1]:
        return good
    kind = good.schema["vec"].dataType
    return good.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0).cast(kind.elementType), F.lit(sizes[1]) - F.size("vec"))))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(float) if len(column) else np.zeros((0, 1))


def leaf_column(spark: SparkSession, forest: Forest) -> Column:
    sent = spark.sparkContext.broadcast(forest)  # bounded by the sample

    @F.pandas_udf("array<int>")
    def run(vec: pd.Series) -> pd.Series:
        return pd.Series(list(sent.value.leaves(_matrix(vec)).astype(np.int32)), dtype=object) if len(vec) else pd.Series([], dtype=object)

    return run(F.col("vec"))


def visit_column(spark: SparkSession, forest: Forest, leaves: int, deep: int) -> Column:
    """The visited leaves by tree and cell; a cell is the leaves that share all but the last deep turns."""
    sent = spark.sparkContext.broadcast(forest)

    def by_cell(found: list[tuple[int, int]]) -> list[dict]:
        cells: dict[tuple[int, int], list[int]] = {}
        for t, x in found:
            cells.setdefault((t, x >> deep), []).append(x)
        return [{"tree": t, "cell": c, "leaves": xs} for (t, c), xs in cells.items()]

    @F.pandas_udf("array<struct<tree:int,cell:int,leaves:array<int>>>")
    def run(vec: pd.Series) -> pd.Series:
        return pd.Series([by_cell(found) for found in (sent.value.search(_matrix(vec), leaves) if len(vec) else [])], dtype=object)

    return run(F.col("vec"))


def _lists(q: np.ndarray, score: np.ndarray, first: np.ndarray, k: int) -> pd.DataFrame:
    """Of candidates (q, score, first), repeats allowed, the k best different ones of each q as a row of lists."""
    order = np.lexsort((first, -score, q))
    q, score, first = q[order], score[order], first[order]
    # repeats of a pair have one score, so they are neighbours in this order
    new = np.ones(len(q), dtype=bool)
    new[1:] = (q[1:] != q[:-1]) | (first[1:] != first[:-1])
    q, score, first = q[new], score[new], first[new]
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, dtype=int)
    stops = np.minimum(np.append(starts[1:], len(q)), starts + k) if len(q) else starts
    return pd.DataFrame({"q": q[starts], "score": pd.Series([score[a:b] for a, b in zip(starts, stops, strict=True)], dtype=object), "first": pd.Series([first[a:b] for a, b in zip(starts, stops, strict=True)], dtype=object)})


LISTS_SCHEMA = "q long, score array<double>, first array<bigint>"


def nearest(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, its k nearest of all other rows.

    Scores are inner products of the original vectors in double precision; ties go to the smaller vec_id. Rows whose
    vector is null, zero, or holds a null or non-finite component take no part, nor do rows without an id; vectors
    shorter than others count as filled up with zeros. A repeated vec_id is one candidate for each row, and as a query is answered once. Columns beside
    the two named are not read. With k or fewer candidates all are returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = cut(usable(vectors, vec_id, embedding), "vectors")
    # the k + 1 smallest ids of each different vector; row_number <= k + 1 is limited before the shuffle as well
    few = rows.withColumn("nth", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).filter(F.col("nth") <= k + 1)
    unlike = cut(few.groupBy("vec").agg(F.min("vec_id").alias("first"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "unlike")
    facts = unlike.agg(F.count(F.lit(1)), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()
    if not facts[0]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, SAMPLE / facts[0])
    sample = _matrix(unlike.filter(F.pmod(F.xxhash64("first"), F.lit(1 << 30)) < share * (1 << 30)).orderBy("first").select("vec").toPandas()["vec"])
    if not len(sample):  # of so few vectors that the draw can miss all
        sample = _matrix(unlike.select("vec").limit(1).toPandas()["vec"])
    forest = fit(sample, float(np.sqrt(facts[1])), facts[0])
    leaves = tune(forest, sample, k)

    asked = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "vec").distinct()
    queries = cut(asked.join(unlike.select("vec", "first"), "vec").select(F.col("vec_id").alias("query_id"), F.col("first").alias("q")), "queries")
    different = unlike.join(queries.select(F.col("q").alias("first")).distinct(), "first", "left_semi")
    deep = min(forest.levels, max(0, int(np.log2(max(1, CELL * 2**forest.levels / facts[0])))))
    where = ["tree", "cell"]
    held = unlike.select("first", "vec", F.posexplode(leaf_column(spark, forest)).alias("tree", "leaf")).withColumn("cell", F.shiftright("leaf", deep))
    visits = cut(different.select(F.col("first").alias("q"), F.col("vec").alias("probe"), F.explode(visit_column(spark, forest, leaves, deep)).alias("at")).select("q", "probe", "at.tree", "at.cell", "at.leaves"), "visits")
    parts = lambda n, most: F.ceil(n / most).cast("int")
    rows_of = held.groupBy(*where).agg(parts(F.count(F.lit(1)), CELL).alias("chunks"))
    grid = cut(visits.groupBy(*where).agg(parts(F.count(F.lit(1)), PROBES).alias("blocks")).join(rows_of, where), "grid")
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n).cast("long")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    here = held.join(grid, where).withColumn("chunk", dealt("first", "chunks")).withColumn("block", each("blocks")).drop("chunks", "blocks")
    probes = visits.join(grid, where).withColumn("block", dealt("q", "blocks")).withColumn("chunk", each("chunks")).drop("chunks", "blocks")

    def rerank(part: pd.DataFrame, probe: pd.DataFrame) -> pd.DataFrame:
        """For each query the k + 1 different vectors nearest to it in the leaves it visits."""
        if not len(part) or not len(probe):
            return _lists(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64), k + 1)
        part = part.sort_values(["leaf", "first"], ignore_index=True)
        leaf, first, x = part["leaf"].to_numpy(), part["first"].to_numpy(np.int64), _matrix(part["vec"])
        y, q = _matrix(probe["probe"]), probe["q"].to_numpy(np.int64)
        asked = np.concatenate(probe["leaves"].to_list())
        who = np.repeat(np.arange(len(q)), probe["leaves"].map(len).to_numpy())
        order = np.argsort(asked, kind="stable")
        asked, who = asked[order], who[order]
        found = []
        for number in np.unique(leaf):
            a, b = np.searchsorted(leaf, [number, number + 1])
            rows = who[slice(*np.searchsorted(asked, [number, number + 1]))]
            for at in range(0, len(rows), 512):
                some = rows[at : at + 512]
                chosen, score = nearest_rows(x[a:b], y[some], first[a:b], k + 1)
                found.append((np.repeat(q[some], chosen.shape[1]), score.ravel(), first[a:b][chosen].ravel()))
            if sum(len(f[0]) for f in found[1:]) > 2_000_000:
                found = [_flat(_lists(*(np.concatenate(c) for c in zip(*found, strict=True)), k + 1))]
        if not found:
            return _lists(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64), k + 1)
        return _lists(*(np.concatenate(c) for c in zip(*found, strict=True)), k + 1)

    by = [*where, "chunk", "block"]
    met = cut(here.groupBy(*by).cogroup(probes.groupBy(*by)).applyInPandas(rerank, LISTS_SCHEMA), "lists")
    groups = max(1, -(-met.count() // LISTS))
    merged = met.withColumn("group", F.pmod(F.xxhash64("q"), F.lit(groups))).groupBy("group").applyInPandas(lambda part: _lists(*_flat(part), k + 1), LISTS_SCHEMA)
    picked = merged.select("q", F.explode(F.arrays_zip("score", "first")).alias("b")).select("q", "b.score", "b.first")
    spread = picked.join(unlike.select("first", "ids"), "first").select("q", "score", F.explode("ids").alias("vec_id"))
    near = spread.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))).filter(F.col("nth") <= k + 1)
    # a query's own row goes, which is one of the k + 1 or is none of the k
    mine = queries.join(near.select("q", "nth", "score", "vec_id"), "q")
    own = F.row_number().over(Window.partitionBy("query_id", "vec_id").orderBy("nth"))
    others = mine.withColumn("own", own).filter((F.col("vec_id") != F.col("query_id")) | (F.col("own") > 1))
    ranked = others.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _flat(lists: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = lists["first"].map(len).to_numpy()
    join = lambda c: np.concatenate(lists[c].to_list()) if len(lists) else np.zeros(0)
    return np.repeat(lists["q"].to_numpy(np.int64), sizes), join("score").astype(float), join("first").astype(np.int64)


def nearest_rows(x: np.ndarray, y: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of y the k rows of x of largest inner product, ties to the smaller of first, and the products.

    A matrix product chooses a few more than k; their products are summed again in one order, so that a pair has the
    same score wherever it is met. Where the last of them ties with the k-th, the row is sorted whole.
    """
    wide = min(k + 8, len(x))
    rough = y @ x.T
    chosen = np.argpartition(-rough, wide - 1, axis=1)[:, :wide] if wide < len(x) else np.tile(np.arange(len(x)), (len(y), 1))
    score = (x[chosen] * y[:, None, :]).sum(2)
    order = np.lexsort((first[chosen], -score), axis=1)
    chosen, score = np.take_along_axis(chosen, order, 1), np.take_along_axis(score, order, 1)
    if wide < len(x):
        for i in np.flatnonzero(score[:, min(k, wide) - 1] <= score[:, -1] + 1e-12):
            whole = (x * y[i]).sum(1)
            chosen[i] = np.lexsort((first, -whole))[:wide]
            score[i] = whole[chosen[i]]
    return chosen[:, :k], score[:, :k]


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
