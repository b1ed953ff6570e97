"""K-d tree sharding: recursive splits at distributed weighted medians along the widest metadata dimension.

The dimensions are measured of the text alone (length, script, word length, line length, share of digits), so equal texts
are one point: a cut falls between groups of equal texts, and each row finds its shard by walking the tree, without a
shuffle. A node's dimension is the widest: the one whose values, weighed by bytes and counted in COARSE parts of a scale
common to all documents, have the largest entropy in the node. Within a dimension rows are ordered by value, then by a
hash of the text. The weighted median is found by two aggregations a level for all nodes at once: sums by value for all
dimensions, then sums by parts of the text's hash within the value where the median falls (and further parts of parts
while a cut is worse than TOLERANCE). The driver sees sums by node and part only.

Groups of equal texts of more than LARGE of a shard would make medians coarse: they are dealt first, the largest to the
emptiest shard, and the leaves of the tree get what each shard then lacks. There are at most shards / LARGE of them.
Only a group larger than a shard is divided, by doc_id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, utf8_bytes

SHARDS, OVERHEAD = 40, 16
#: Values of a dimension, parts of its scale by which width is told, bits of the text's hash, and bits told apart at once.
VALUES, COARSE, HASH_BITS, STEP = 4096, 16, 56, 14
DIMS = ("d0", "d1", "d2", "d3", "d4")
#: A cut is good when it misses the wanted bytes by less than this share of a shard.
TOLERANCE = 0.001
#: Share of a shard from which a group of equal texts is dealt apart.
LARGE = 0.05
#: Rows of a part in which slots are numbered.
SLOT_ROWS = 20_000


def measures(text: Column, doc_id: Column) -> dict[str, Column]:
    """size, the dimensions as integers below VALUES, and hashes of the text and of the document's id."""
    whole = F.coalesce(text, F.lit(""))
    size, chars = F.octet_length(whole), F.greatest(F.length(whole), F.lit(1))
    scaled = lambda c: F.greatest(F.least(F.floor(c * VALUES), F.lit(VALUES - 1)), F.lit(0)).cast("int")
    gaps = F.length(whole) - F.length(F.translate(whole, " \n", ""))
    lines = F.length(whole) - F.length(F.translate(whole, "\n", "")) + 1
    digits = F.length(whole) - F.length(F.translate(whole, "0123456789", ""))
    return {
        "size": utf8_bytes(text) + OVERHEAD,
        "d0": scaled(F.log2(size + F.lit(1)) / 40),  # length
        "d1": scaled((size / chars - 1) / 3),  # bytes a character: the script
        "d2": scaled(chars / (gaps + 1) / 16),  # word length
        "d3": scaled(F.log2(chars / lines + 1) / 20),  # line length
        "d4": scaled(F.sqrt(digits / chars)),
        "same": F.shiftrightunsigned(F.xxhash64(whole), 64 - HASH_BITS),
        "own": F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id, F.lit(-1)), F.lit(2)), 64 - HASH_BITS),
    }


@dataclass
class Tree:
    """Nodes breadth first: what is below (value, hash) in the node's dimension goes to 2n + 1, the rest to 2n + 2."""

    levels: int
    dim: np.ndarray
    value: np.ndarray
    hash: np.ndarray
    shard: dict[int, int] = field(default_factory=dict)  # of the leaves, and of nodes whose subtrees hold one shard
    large: dict[int, list[int]] = field(default_factory=dict)  # shards of the parts of a large group

    def nodes(self, dims: np.ndarray, same: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels; a node that is not divided keeps its rows."""
        node = np.zeros(len(same), dtype=np.int64)
        for _ in range(levels):
            d = self.dim[node]
            v = dims[np.arange(len(node)), np.maximum(d, 0)]
            upper = (v > self.value[node]) | ((v == self.value[node]) & (same >= self.hash[node]))
            node = np.where(d < 0, node, 2 * node + 1 + upper)
        return node

    def shards(self, dims: np.ndarray, same: np.ndarray, own: np.ndarray) -> np.ndarray:
        node = self.nodes(dims, same, self.levels)
        out = np.fromiter((self.shard.get(n, 0) for n in node.tolist()), dtype=np.int32, count=len(node))
        if self.large:
            for i in np.flatnonzero(np.isin(same, np.fromiter(self.large, dtype=np.int64))):
                parts = self.large[int(same[i])]
                out[i] = parts[int(own[i]) % len(parts)]
        return out


def _route(spark: SparkSession, tree: Tree, levels: int | None = None) -> Column:
    """The shard of each row of measures(); with levels the node reached after so many, -1 for rows of large groups."""
    sent = spark.sparkContext.broadcast(tree)  # a few values for each shard

    @F.pandas_udf("int")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for own, same, *dims in batches:
            at, text, tree = np.column_stack([d.to_numpy() for d in dims]), same.to_numpy(), sent.value
            if levels is None:
                yield pd.Series(tree.shards(at, text, own.to_numpy()))
            else:
                node = tree.nodes(at, text, levels)
                yield pd.Series(np.where(np.isin(text, np.fromiter(tree.large, dtype=np.int64)), -1, node).astype(np.int32))

    return run("own", "same", *DIMS)


def _deal_large(groups: list[tuple[int, int]], shards: int, total: int) -> tuple[dict[int, list[int]], list[float]]:
    """The shards of the large groups (hash, bytes), and the bytes each shard has left for the tree."""
    target = total / shards
    items = []
    for same, size in groups:
        parts = 1 if size <= target else int(-(-size // (target / 2)))
        items += [(size / parts, same, k) for k in range(parts)]
    heap, of = [(0.0, s) for s in range(shards)], {same: {} for same, _ in groups}
    for size, same, k in sorted(items, key=lambda x: (-x[0], x[1], x[2])):
        load, s = heapq.heappop(heap)
        of[same][k] = s
        heapq.heappush(heap, (load + size, s))
    load = [0.0] * shards
    for x, s in heap:
        load[s] = x
    # the level to which the rest fills the shards
    rest, level = total - sum(load), 0.0
    for k, x in enumerate(ordered := sorted(load), 1):
        level = (rest + sum(ordered[:k])) / k
        if k == shards or level <= ordered[k]:
            break
    return {same: [parts[k] for k in range(len(parts))] for same, parts in of.items()}, [max(0.0, level - x) for x in load]


def fit(rows: DataFrame, shards: int = SHARDS) -> Tree:
    """rows: measures(), written."""
    spark, total = rows.sparkSession, rows.agg(F.sum("size")).first()[0] or 0
    levels = max(0, int(np.ceil(np.log2(shards))))
    inner = 2**levels - 1
    tree = Tree(levels, np.full(2 * inner + 1, -1), np.zeros(2 * inner + 1, dtype=np.int64), np.zeros(2 * inner + 1, dtype=np.int64), {0: 0})
    if shards == 1 or not total:
        return tree
    target = total / shards
    found = rows.groupBy("same").agg(F.sum("size").alias("size")).filter(F.col("size") > LARGE * target).collect()  # at most shards / LARGE
    tree.large, lacks = _deal_large([(r["same"], r["size"]) for r in found], shards, total)
    spans, tree.shard = {0: (0, shards)}, {}  # shards of each open node
    for level in range(levels):
        tree.shard |= {n: a for n, (a, b) in spans.items() if b - a == 1}
        spans = {n: s for n, s in spans.items() if s[1] - s[0] > 1}
        here = rows.withColumn("node", _route(spark, tree, level)).filter(F.col("node").isin(*spans)).withColumn("at", F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(d).alias("value")) for i, d in enumerate(DIMS)])))
        sums = here.groupBy("node", "at.dim", "at.value").agg(F.sum("size").alias("size")).toPandas()
        plan = {n: p for n, (a, b) in spans.items() if (p := _widest(sums[sums["node"] == n], sum(lacks[a : (a + b) // 2]) / max(sum(lacks[a:b]), 1e-9)))}
        _refine(rows.withColumn("node", _route(spark, tree, level)), plan, target * TOLERANCE)
        for n, p in plan.items():
            tree.dim[n], tree.value[n], tree.hash[n] = p["dim"], p["value"], p["cut"]
        spans = {k: s for n, (a, b) in spans.items() for k, s in ([(2 * n + 1, (a, (a + b) // 2)), (2 * n + 2, ((a + b) // 2, b))] if n in plan else [(n, (a, a + 1))])}
    tree.shard |= {n: a for n, (a, _) in spans.items()}
    return tree


def _widest(sums: pd.DataFrame, share: float) -> dict | None:
    """The widest dimension of a node, the value where its lower side's share ends, and what that value's rows must give."""
    best = None
    for dim, part in sums.groupby("dim", sort=True):
        coarse = np.bincount(part["value"] * COARSE // VALUES, part["size"], COARSE)
        p = coarse[coarse > 0] / coarse.sum()
        width = float(-(p * np.log(p)).sum())
        if best is None or width > best[0] + 1e-9:
            best = (width, int(dim), part.sort_values("value"))
    if best is None:
        return None
    part = best[2]
    reach = part["size"].cumsum().to_numpy(float)
    want = reach[-1] * share
    k = min(int(np.searchsorted(reach, want, side="right")), len(part) - 1)
    below = reach[k - 1] if k else 0.0
    return {"dim": best[1], "value": int(part["value"].iloc[k]), "want": want - below, "lo": 0, "bits": HASH_BITS, "cut": None}


def _refine(placed: DataFrame, plan: dict[int, dict], tolerance: float) -> None:
    """Sets the cut of each node: the hash, within its value, that comes nearest to what is wanted. A part of one hash is
    a group of equal texts, which no cut divides."""
    while active := {n: p for n, p in plan.items() if p["cut"] is None}:
        for p in active.values():
            p["step"] = max(p["bits"] - STEP, 0)
        of = lambda get: F.element_at(F.create_map(*[F.lit(x) for n, p in active.items() for x in (n, get(p))]), F.col("node"))  # noqa: E731, B023
        here = placed.filter(F.col("node").isin(*active)).withColumns({"value": F.element_at(F.array(*DIMS), of(lambda p: p["dim"] + 1)), "step": of(lambda p: p["step"])})
        inside = here.filter(F.col("value") == of(lambda p: p["value"])).withColumn("off", F.col("same") - of(lambda p: p["lo"]).cast("long"))
        inside = inside.filter((F.col("off") >= 0) & (F.expr("shiftright(off, step)") < of(lambda p: 1 << (p["bits"] - p["step"]))))
        sums = inside.groupBy("node", F.expr("shiftright(off, step)").alias("part")).agg(F.sum("size").alias("size"), F.min("same").alias("least"), F.max("same").alias("most")).collect()
        by_node: dict[int, list] = {n: [] for n in active}
        for r in sums:
            by_node[r["node"]].append((r["part"], r["size"], r["least"], r["most"]))
        for n, p in active.items():
            below = 0.0
            for part, size, least, most in sorted(by_node[n]):
                if below + size > p["want"]:
                    short, over = p["want"] - below, below + size - p["want"]
                    if min(short, over) <= tolerance or least == most:
                        p["cut"] = least if short <= over else most + 1
                    else:
                        p |= {"want": short, "lo": p["lo"] + (part << p["step"]), "bits": p["step"]}
                    break
                below += size
            else:  # all rows of the value lie below
                p["cut"] = p["lo"] + (1 << p["bits"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text_crc32 and measures() of docs (doc_id, text)."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    return docs.select("doc_id", crc, *[c.alias(n) for n, c in measures(F.col("text"), F.col("doc_id")).items()])


def numbered(rows: DataFrame, parts: int) -> DataFrame:
    """rows with slot, gapless from 0 in each shard: parts of a shard are counted, then numbered on their own."""
    split = rows.withColumn("part", F.pmod(F.xxhash64("own", "doc_id"), F.lit(parts)))
    counts = split.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "part", first.alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("own", "doc_id", "text_crc32", "size"))
    return split.withColumn("nth", inside).join(starts, ["shard", "part"]).withColumn("slot", F.col("first") + F.col("nth") - 1).drop("part", "nth", "first")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row of docs (doc_id, text).

    Shards are near equal in bytes: the UTF-8 text (null: none) and OVERHEAD. Equal texts, ties and repeated rows share
    a shard, unless their group is larger than a shard: then rows of one doc_id share it. Null and empty texts are one
    group. Very long texts are measured whole. Null ids are an id like others. Of few texts some shards stay empty; an
    empty table gives no rows. Other columns are not read, so clashing names do no harm.
    """
    rows = cut(measured(docs), "measured")
    total = rows.count()
    dealt = cut(rows.withColumn("shard", _route(docs.sparkSession, fit(rows, shards))).select("doc_id", "size", "text_crc32", "own", "shard"), "dealt")
    return numbered(dealt, max(1, -(-total // (shards * SLOT_ROWS)))).select("doc_id", "size", "text_crc32", "shard", "slot")


def with_shard(docs: DataFrame, shards: int = SHARDS, name: str = "shard") -> DataFrame:
    """docs, all rows and columns as they are, with each row's shard in a new last column.

    The column is called name, with as many underscores as a clash with docs' own columns takes. No row is joined:
    each walks the fitted tree.
    """
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    own = {n: f"__{n}" for n in (*DIMS, "same", "own")}
    while {x.lower() for x in own.values()} & {c.lower() for c in docs.columns}:
        own = {n: f"_{x}" for n, x in own.items()}
    tree = fit(cut(measured(docs), "measured"), shards)
    marked = docs.select("*", *[c.alias(own[n]) for n, c in measures(F.col("text"), F.col("doc_id")).items() if n in own])
    routed = _route_on(docs.sparkSession, tree, own)
    return marked.withColumn(name, routed).select(*docs.columns, name)


def _route_on(spark: SparkSession, tree: Tree, names: dict[str, str]) -> Column:
    sent = spark.sparkContext.broadcast(tree)

    @F.pandas_udf("int")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for own, same, *dims in batches:
            yield pd.Series(sent.value.shards(np.column_stack([d.to_numpy() for d in dims]), same.to_numpy(), own.to_numpy()))

    return run(*[F.col(names[n]) for n in ("own", "same", *DIMS)])


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
