import corpus_pipeline
from pyspark.sql import functions as F

from tests.oracle import DATA
from tidewater.llm import decontaminate, simhash, toxicity
from tidewater.llm.common import cut, table, word_count


def test_each_stage_takes_effect(spark):
    """Each stage against a plain version of its decision, on all that the one before kept."""
    docs = table(spark, DATA, "documents")
    columns, after = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, DATA), "tested")
        after[name] = docs
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        was = {r["doc_id"] for r in before.select("doc_id").collect()}
        assert ids <= was
        if name != "sharding":
            assert docs.columns == columns
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.classify(before, table(spark, DATA, "labels")).filter("predicted = 1").collect()}
            assert was - ids == bad
        elif name == "simhash":
            groups = {}
            for r in simhash.near_copies(before).collect():
                groups.setdefault(r["component_id"], set()).add(r["doc_id"])
            assert all(len(g & ids) == 1 for g in groups.values())
        elif name == "decontamination":
            leaks = {r["doc_id"] for r in decontaminate.leaks(before, table(spark, DATA, "benchmark")).collect()}
            assert leaks and was - ids == leaks
        elif name == "mixing":
            total, taken = (x.agg(F.sum(word_count(F.col("text")))).first()[0] for x in (before, docs))
            assert 0.95 * total <= taken <= total
            assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
        else:
            assert docs.columns == [*columns, "shard"] and docs.count() == before.count()
            assert docs.select("shard").distinct().count() == 40
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]


def test_stages_keep_clashing_columns_and_repeated_rows(spark, odd, none):
    """Columns that stages use themselves come out as they went in; only whole rows of the input come out."""
    rows = {repr(r) for r in odd.collect()}
    for frame in (odd, none):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            docs = cut(stage(spark, docs, DATA), "tested")
            assert docs.columns == ([*odd.columns, "shard_"] if name == "sharding" else odd.columns)
            assert {repr(r) for r in docs.select(odd.columns).collect()} <= rows
        assert docs.count() <= 3 * frame.count()


def test_copies_stage_by_brute_force(spark):
    """One document stays of each class of texts linked by 0.8 of five-word shingles or three bits, the least id."""
    docs = table(spark, DATA, "documents")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    shingles, prints = [], []
    for _, t in rows:
        w = t.lower().split()
        shingles.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
        prints.append(simhash.fingerprint(t))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(shingles[i] & shingles[j])
            if 5 * both >= 4 * (len(shingles[i]) + len(shingles[j]) - both) or (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == want


def test_mixing_and_sharding_stages_by_plain_python(spark):
    docs = table(spark, DATA, "documents")
    mixed = corpus_pipeline.mix_sources(spark, docs, DATA)
    before, after = ([r for r in x.collect()] for x in (docs, mixed))
    size = lambda r: len((r["text"] or "").split())
    names = sorted({r["source"] for r in before})
    whole = {s: sum(size(r) for r in before if r["source"] == s) for s in names}
    goal, open_ = dict.fromkeys(names, 0.0), set(names)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    while open_:
        level = (sum(whole.values()) - sum(3 * whole[s] for s in names if s not in open_)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * whole[s]}
        if not over:
            break
        open_ -= over
    for s in names:
        goal[s] = level * weight[s] if s in open_ else 3 * whole[s]
        taken = sum(size(r) for r in after if r["source"] == s)
        assert goal[s] - 0.1 * goal[s] - 20 <= taken <= goal[s] + 1e-6
    times = {}
    for r in after:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 3
    dealt = corpus_pipeline.deal_shards(spark, mixed, DATA).collect()
    assert sorted(tuple(r)[:-1] for r in dealt) == sorted(map(tuple, after))
