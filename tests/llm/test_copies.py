import random
import re

import pytest
from pyspark.sql import functions as F

from tidewater.llm import simhash
from tidewater.llm.common import cut


def _words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def _shingles(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _similarity(a, b):
    x, y = _shingles(a), _shingles(b)
    return len(x & y) / len(x | y)


def _changed(rng, words, changes):
    """words with some replaced, far enough apart that each spoils five shingles."""
    out = list(words)
    for i in rng.sample(range(5, len(words) - 5, 6), changes):
        out[i] = _words(rng, 1)[0]
    return out


def _components(spark, texts):
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash.near_copies(rows).collect()}


def test_copies_with_a_common_passage_are_all_found(spark):
    """Documents that share 60% of their words; each has one copy with a few words replaced."""
    rng = random.Random(1)
    passage, texts = _words(rng, 120), []
    for _ in range(150):
        own = passage + _words(rng, 80)
        texts += [own, _changed(rng, own, 3)]
    of = _components(spark, texts)
    assert all(of[i] == of[i + 1] == i for i in range(0, len(texts), 2))


def test_similarity_of_five_word_shingles_decides(spark):
    """Pairs around 0.8: all of at least 0.8 are copies; below, only those that op3_simhash's own three bits link."""
    rng, texts = random.Random(2), []
    for k in range(200):
        own = _words(rng, 204)
        texts += [own, _changed(rng, own, 3 + k % 4)]
    of = _components(spark, texts)
    prints = [simhash.fingerprint(" ".join(t)) for t in texts]
    pairs = range(0, len(texts), 2)
    above = {i: _similarity(texts[i], texts[i + 1]) >= 0.8 for i in pairs}
    narrow = {i: (prints[i] ^ prints[i + 1]).bit_count() <= 3 for i in pairs}
    assert sum(above.values()) == 100 and sum(not above[i] and not narrow[i] for i in pairs) > 80
    assert {i: of[i] == of[i + 1] for i in pairs} == {i: above[i] or narrow[i] for i in pairs}


@pytest.mark.parametrize("count", [1, 2, 10**9])
def test_copies_do_not_depend_on_what_counts_as_common(spark, monkeypatch, count):
    """The list of common shingles is all that follows the table's size: from all shingles to none, the same pairs are found."""
    rng = random.Random(3)
    passage, texts = _words(rng, 100), []
    for _ in range(100):
        own = passage + _words(rng, 104)
        texts += [own, _changed(rng, own, 4)]
    monkeypatch.setattr(simhash, "COMMON_COUNT", count, raising=False)
    monkeypatch.setattr(simhash, "COMMON_SHARE", 1, raising=False)
    of = _components(spark, texts)
    assert all(of[i] == of[i + 1] == i for i in range(0, len(texts), 2))


def test_probes_are_not_sent_through_the_driver(spark):
    """A small file of fingerprints makes 68 probes each, which the planner takes for few rows: the join must shuffle them."""
    prints = cut(spark.range(1000).select(F.xxhash64("id").alias("fp")), "tested")
    plan = simhash.links(prints)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[key#\d+L\], \[key#\d+L\], Inner", plan) and not re.search(r"BroadcastHashJoin \[key#\d+L\], \[key#\d+L\], Inner", plan)


def test_marks_never_part_copies(spark):
    """Odd sketches bound how many shingles two texts do not share, so no pair of at least 0.8 is told apart by them."""
    rng, rows = random.Random(5), []
    for k in range(100):
        own = _words(rng, 204)
        rows.append((" ".join(own), " ".join(_changed(rng, own, k % 8)), " ".join(own[:60] + _words(rng, 144))))
    frame = spark.createDataFrame(rows, "a string, b string, c string")
    for k in "abc":
        frame = frame.withColumn("n" + k, F.size(simhash._shingles_column(k))).withColumn("m" + k, simhash._marks_column(k))
    close = lambda x, y: simhash._close(F.col("n" + x), F.col("m" + x), F.col("n" + y), F.col("m" + y))
    got = frame.select(close("a", "b"), close("a", "c")).collect()
    assert all(r[0] for (a, b, _), r in zip(rows, got, strict=True) if _similarity(a.split(), b.split()) >= 0.8)
    assert not any(r[1] for r in got)
