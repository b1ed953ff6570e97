import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.oracle import DATA, assert_same, connect
from tidewater.llm import decontaminate, linededup, mixing, queries, secrets, simhash, toxicity
from tidewater.llm.common import shared_dir, skew_join
from tidewater.llm.components import components


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLES[name])


def _odd_sql(name, rows):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    got = c.execute(queries.ORACLES[name])
    names = [x[0] for x in got.description]
    return names, got.fetchall()


# toxicity


def _labelled(spark, n=300):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(["ba", "ko", "ri", "tu", "se"], rng.integers(1, 4)))
    rows = []
    for i in range(n):
        ws = [word() for _ in range(rng.integers(20, 80))]
        toxic = int(i % 3 == 0)
        for k in range(0, len(ws), 8) if toxic else ():
            ws[k] = ["vilest", "dreck", "vileness"][k % 3]
        rows.append((i, " ".join(ws), toxic))
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), {r[0]: r[2] for r in rows}


def test_toxicity_held_out_accuracy(spark):
    docs, labels, truth = _labelled(spark)
    held = [r for r in toxicity.classify(docs, labels).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 40 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in held)


def test_toxicity_never_learns_from_the_held_out_fold(spark):
    docs, labels, _ = _labelled(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.classify(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity_counts_every_labelled_document(spark):
    """Bigrams of each class's counted documents, the larger class's as means over its parts, by plain Python."""
    rng = np.random.default_rng(2)
    texts = {i: " ".join(rng.choice(["ba", "ko", "ri"], rng.integers(5, 30))) for i in range(900)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in texts], "doc_id long, toxic int")
    chosen = toxicity.labelled(docs, labels).collect()
    assert {r["doc_id"] for r in chosen} == {i for i in texts if zlib.crc32(str(i).encode()) % 5}
    seen = {}
    keep = toxicity.count_model

    def spy(counts, parts):
        seen.update({(r["v"], r["w"], r["part"]): r["n"] for r in counts.collect()}, parts=parts)
        return keep(counts, parts)

    toxicity.count_model = spy
    try:
        toxicity.fit(docs, labels)
    finally:
        toxicity.count_model = keep
    parts = seen.pop("parts")
    counted = [(r["toxic"], r["text"].split()) for r in chosen if r["fit"]]
    assert parts == [round(sum(y == 0 for y, _ in counted) / sum(y for y, _ in counted)), 1] and parts[0] > 1
    # bigrams of toxic documents exactly; every word of every ordinary one is in a part
    want = {}
    for y, ws in counted:
        for u, v, w in zip(["", "", *ws[:-2]], ["", *ws[:-1]], ws, strict=False):
            want.setdefault((y, v, w), set()).add(u)
    assert {k[:2]: n for k, n in seen.items() if k[2] >= parts[0]} == {k[1:]: len(u) for k, u in want.items() if k[0] == 1}
    assert {k[:2] for k in seen if k[2] < parts[0]} == {k[1:] for k in want if k[0] == 0}
    assert {k[2] for k in seen} == set(range(sum(parts)))


def test_toxicity_fit_needs_little_disk(spark, tmp_path):
    """All texts and whole trigrams were shuffled and bigrams written: more than 1.5 times the input here."""
    rng = np.random.default_rng(3)
    names = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(2000)])
    docs = pd.DataFrame([(i, " ".join(rng.choice(names, 300))) for i in range(3000)], columns=["doc_id", "text"])
    docs.to_parquet(tmp_path / "docs.parquet")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(0, 3000, 3)], "doc_id long, toxic int")
    folders = [Path(f.getPath()) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    folders.append(Path(shared_dir(spark).removeprefix("file://")))
    used = lambda: {f: f.stat().st_size for d in folders for f in d.rglob("*") if f.is_file()}
    before = used()
    toxicity.fit(spark.read.parquet(str(tmp_path / "docs.parquet")), labels)
    new = sum(n for f, n in used().items() if f not in before)
    assert new < 1.5 * (tmp_path / "docs.parquet").stat().st_size


def test_toxicity_fit_shuffles_no_texts(spark, tmp_path):
    """Labels beyond the limit of a broadcast join had all labelled texts shuffled, by a join with them. Digits are no words."""
    rng = np.random.default_rng(7)
    texts = ["ba ko " + "".join(map(str, rng.integers(0, 10, 20_000))) for _ in range(400)]
    pd.DataFrame({"doc_id": range(400), "text": texts}).to_parquet(tmp_path / "docs.parquet")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    folders = [Path(f.getPath()) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    folders.append(Path(shared_dir(spark).removeprefix("file://")))
    used = lambda: {f: f.stat().st_size for d in folders for f in d.rglob("*") if f.is_file()}
    limit, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), used()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        toxicity.fit(spark.read.parquet(str(tmp_path / "docs.parquet")), labels)
        new = sum(n for f, n in used().items() if f not in before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert new < 0.05 * sum(map(len, texts)), new


@pytest.mark.parametrize(("of_docs", "of_labels"), [("long", "long"), ("int", "long"), ("long", "smallint"), ("string", "string"), ("string", "long")])
def test_toxicity_labels_by_lookup_and_by_join(spark, of_docs, of_labels):
    """Repeated documents and labels, ids below zero and null, labels that are none, by any kind of doc_id."""
    ids = [None, *range(-40, 160), 7, 7]
    given = [(i, t) for i in (None, *range(-90, 60)) for t in ((0, 1) if i == 7 else (0,) if (i or 0) % 3 else (1, 2) if i != 9 else (None, 5))]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(of_docs))
    labels = spark.createDataFrame(given, "doc_id long, toxic int").withColumn("doc_id", F.col("doc_id").cast(of_labels))
    known = {}
    for i, t in given:
        if i is not None and t in (0, 1) and zlib.crc32(str(i).encode()) % 5:
            known[i] = max(t, known.get(i, 0))
    got = sorted((int(r["doc_id"]), r["text"], r["toxic"]) for r in toxicity.labelled(docs, labels).collect())
    assert got == sorted((i, f"t{i}", known[i]) for i in ids if i in known) and len(got) > 50
    assert toxicity.labelled(docs, labels.limit(0)).count() == 0


def test_toxicity_packs_trigrams_without_loss():
    """Packing by bucket, from several tasks with trigrams in common, gives the counts of plain Python."""
    rng = np.random.default_rng(5)
    words = ["", "a", "ab", "b", "é", "ﬁ", "字"]
    sets = [{f"{v} {w} {p} {u}" for v, w, p, u in zip(*(rng.choice(words, 3000) for _ in "vw"), rng.integers(0, 11, 3000), rng.choice(words, 3000), strict=True) if w} for _ in range(3)]
    packed = pd.concat([toxicity._packed(s, 5) for s in sets])
    got = pd.concat([toxicity._counted(rows) for _, rows in packed.groupby("bucket")])
    want = Counter(tuple(k.split(" ")[:3]) for k in set().union(*sets))
    assert {(r.v, r.w, str(r.part)): r.n for r in got.itertuples()} == want and len(got) == len(want)
    assert not got.duplicated(["v", "w", "part"]).any()


def test_toxicity_odd_cases(spark, odd, none):
    _, labels, _ = _labelled(spark)
    docs, _, _ = _labelled(spark)
    model = toxicity.fit(docs, labels)
    assert model.ratio(None) == model.ratio("") == model.ratio("123 !") == 0.0
    got = toxicity.classify(odd, labels.limit(0))
    assert got.columns.count("score") == 1 and {r["score"] for r in got.collect()} == {0.0} and got.count() == odd.count()
    assert toxicity.classify(odd, spark.createDataFrame([(1, 1), (2, None), (3, 7), (None, 1)], "doc_id long, toxic int")).count() == odd.count()
    assert toxicity.classify(none, labels).count() == 0


# secrets


def _brute_spans(text):
    found = []
    key = "".join
    letters = lambda w: key(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join([letters("password"), letters("passwd"), letters("secret"), letters("token"), letters("api") + "_?" + letters("key")])
    for m in re.finditer(rf"(?:{names})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, m.end()))
    at = 0
    while (at := text.find("AKIA", at)) >= 0:
        end = at + 4
        while end < len(text) and text[end] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
            end += 1
        if end > at + 4 and end - at >= 20:
            found.append((at, 1, end))
        at = max(end, at + 1)
    at = 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in "0123456789abcdef":
            end += 1
        if end - at >= 24:
            found.append((at, 2, end))
        at = max(end, at + 1)
    return sorted(found)


HEX = hashlib.sha256(b"x").hexdigest()
SECRET_TEXTS = [
    f'token = "{HEX[:40]}" x', f"é\U0001f600 PassWord: hunter2hunter {HEX}", "secret=abc token: abcdef", "secret=token: abcdefg", "AKIA" + "A1" * 8 + " AKIA123", "AKIAAKIA" + "B" * 20,
    "api_key='zzzzzz' apikey = qqqqqqq API_KEY:1234567", "pasſword=abcdefg Key", "password==abcdefg", "xx" + "0" * 24 + "g" + "f" * 23, "", "secret", "token=" + "a" * 5,
]


@pytest.mark.parametrize("text", SECRET_TEXTS)
def test_secret_patterns(text):
    assert secrets.base_spans(text) == _brute_spans(text)


def _random_texts(count=200):
    import base64
    import random

    rng, out = random.Random(2), []
    for _ in range(count):
        raw = rng.randbytes(30)
        out.append(rng.choice([base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).decode(), raw.hex().upper(), base64.b32encode(raw).decode().rstrip("=")]))
    return out


ORDINARY = ("internationalization_of_programming_languages", "src/main/resources/application/configuration/defaults", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz", "98765432109876543210x", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "Donaudampfschifffahrtsgesellschaft", "getUserAccountByEmailAddressAndPassword")


def _brute_discoveries(texts):
    """The two weighted Benjamini-Hochberg rules on the p-values themselves, sorted: the text and span of each report."""
    tests = [(k, m.span(), m[0]) for k, t in enumerate(texts) for m in secrets._RUN.finditer(t)]
    alphabets = [secrets.ALPHABETS[secrets.encoding(run)] for _, _, run in tests]
    mean = sum(len(run) for _, _, run in tests) / len(tests)

    def rejected(ps, rate):
        order = sorted(range(len(ps)), key=lambda i: ps[i] * mean / len(tests[i][2]))
        last = max((k for k, i in enumerate(order, 1) if ps[i] * mean / len(tests[i][2]) <= rate * k / len(ps)), default=0)
        return set(order[:last])

    cleared = rejected([secrets.battery(run, a) for (_, _, run), a in zip(tests, alphabets, strict=True)], secrets.CLEARED)
    odd = rejected([secrets.ordinary(run, len(a)) for (_, _, run), a in zip(tests, alphabets, strict=True)], secrets.FDR)
    return {(tests[i][0], *tests[i][1]) for i in odd - cleared}


def test_random_keys_are_found_and_words_are_not(spark):
    codes = _random_texts()
    texts = ["before " + c + " after" for c in codes] + list(ORDINARY) * 40
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(rows, keep_text=False).select("doc_id", "secrets.spans").collect()}
    assert sum(got[i] == f"random:7:{7 + len(c)}" for i, c in enumerate(codes)) >= 190
    assert all(got[i] == "" for i in range(len(codes), len(texts)))
    found = {(i, *map(int, x.split(":")[1:])) for i, spans in got.items() for x in spans.split(",") if x}
    brute = _brute_discoveries(texts)
    assert len(found ^ brute) <= 2  # bins are a twentieth of a digit wide
    whole = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(rows).select("doc_id", "secrets.spans").collect()}
    assert whole == got


def test_battery_rejects_order_and_keeps_randomness():
    hex16 = secrets.ALPHABETS["hex"]
    assert secrets.battery(hex16 * 3, hex16) < 0.01 and secrets.battery("0f" * 20, hex16) < 1e-6
    assert secrets.chi_squared([0] * 40, 16) < 1e-6
    assert secrets.runs([0, 15] * 20, 16) < 1e-6
    rng = np.random.default_rng(0)
    for size in (16, 32, 64):
        ps = [secrets.chi_squared(rng.integers(0, size, 40).tolist(), size) for _ in range(2000)]
        assert 0.03 < np.mean(np.array(ps) < 0.05) < 0.07 and 0.4 < np.mean(np.array(ps) < 0.5) < 0.6


def test_op2_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = secrets.op2_secrets(spark, DATA).collect()
    assert len(rows) == len(texts) and rows[0].asDict().keys() == {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}
    for r in rows:
        base = _brute_spans(texts[r["doc_id"]])
        told = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for _, k, _ in base) for kind in range(3))
        spans = r["spans"].split(",") if r["spans"] else []
        assert [x for x in spans if not x.startswith("random")] == told
        places = [int(x.split(":")[1]) for x in spans]
        assert places == sorted(places)


def test_secrets_odd_cases(odd, none):
    got = secrets.find_secrets(odd)
    assert got.count() == odd.count() and got.columns == odd.columns
    assert all(r["secrets"]["spans"] == "" for r in got.filter("text is null or text = ''").collect())
    assert secrets.find_secrets(none).count() == 0


# SimHash


def _brute_simhash(texts):
    out = []
    for t in texts:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def _brute_components(ids, prints):
    label = list(range(len(ids)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(find(i), []).append(x)
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    prints = _brute_simhash([r["text"] for r in rows])
    want = {r["doc_id"]: (f"{p:016x}", c) for r, p, c in zip(rows, prints, _brute_components([r["doc_id"] for r in rows], prints), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()} == want


def test_simhash_odd_cases(odd, odd_rows, none):
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()), key=repr)
    prints = _brute_simhash([r[1] for r in odd_rows])
    want = sorted(((r[0], f"{p:016x}", c) for r, p, c in zip(odd_rows, prints, _brute_components([r[0] for r in odd_rows], prints), strict=True)), key=repr)
    assert got == want
    assert simhash.near_duplicates(none).count() == 0
    kept = [r["doc_id"] for r in simhash.keep_first(odd).collect()]
    assert kept.count(None) == 0 and kept.count(7) == 0 and kept.count(1) == 1 and simhash.keep_first(odd).columns == odd.columns
    nameless = odd.filter("doc_id is null")
    assert simhash.keep_first(nameless.unionByName(nameless)).count() == 2


@pytest.mark.parametrize("hot", [1, 256])
def test_hot_buckets_link_the_same(spark, hot):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 6, dtype=np.int64)
    rows = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(60):
            x = b
            for k in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                x ^= 1 << k
            rows.add(x if x < 1 << 63 else x - (1 << 64))
    unsigned = [x % (1 << 64) for x in sorted(rows)]
    want = _brute_components(sorted(rows), unsigned)
    roots = {r["u"]: r["root"] for r in components(simhash.links(spark.createDataFrame([(x,) for x in sorted(rows)], "fp long"), hot)).collect()}
    assert [roots.get(x, x) for x in sorted(rows)] == want


def test_near_copies_of_five_word_similarity(spark):
    """Copies of a similarity of 0.8 or more share a component; documents without a partner of 0.5 stay alone."""
    docs = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    shingles = {}
    for r in docs.collect():
        w = (r["text"] or "").lower().split()
        shingles[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    of = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    ids, near, caught = sorted(shingles), 0, 0
    partner = set()
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = shingles[a], shingles[b]
            if 2 * min(len(x), len(y)) >= max(len(x), len(y)) and (common := len(x & y)) * 3 >= len(x) + len(y):
                partner |= {a, b}
                if common >= 0.8 * (len(x) + len(y) - common):
                    near, caught = near + 1, caught + (of[a] == of[b])
    assert near > 10 and caught >= 0.95 * near
    sizes = {}
    for c in of.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert all(sizes[of[i]] == 1 for i in ids if i not in partner)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (1, 0)]
    roots = {r["u"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(roots[i] == 0 for i in range(1, 61)) and all(roots[200 + i] == 100 for i in range(50))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# decontamination


def test_leaks_are_found_and_clean_documents_left(spark, odd, none):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join("".join(rng.choice(["ba", "ko", "ri", "tu", "se", "mo"], rng.integers(1, 4))) for _ in range(n))
    items = [text(n) + ". " + text(6) + "." for n in (8, 20, 40)]
    docs, truth = [], set()
    for i in range(60):
        body = text(150)
        if i % 5 == 0:
            item = items[i % 3].upper() if i % 2 else items[i % 3].replace(" ", "\n")
            body = body[:300] + " " + item + " " + body[300:]
            truth.add((i, i % 3))
        docs.append((i, body))
    # a paraphrase: one word in eight is another, the answer is there; and without the answer
    ws = items[2].split()
    docs.append((60, text(50) + " " + " ".join("zzz" if k % 8 == 3 and k < 38 else w for k, w in enumerate(ws)) + " " + text(50)))
    docs.append((61, text(50) + " " + " ".join(ws[:14]) + " " + text(50)))
    truth.add((60, 2))
    bench = spark.createDataFrame([*enumerate(items), (7, None), (8, ""), (None, "... !")], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame, bench).collect()} == truth
    assert decontaminate.without_leaks(frame, bench).count() == 62 - len(truth)
    assert decontaminate.leaks(odd, bench).count() == 0 and decontaminate.without_leaks(odd, bench).columns == odd.columns
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(frame, bench.limit(0)).count() == 0


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    want = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 15)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == want
    # brute force: nine tenths of an item's five-word shingles
    shingles = lambda t: {tuple(x[i : i + 5]) for x in [decontaminate.words_of(t)] for i in range(len(x) - 4)}
    items = [(r["item_id"], shingles(r["text"])) for r in bench.collect()]
    brute = {(d["doc_id"], i) for d in docs.collect() for s in [shingles(d["text"])] for i, x in items if len(x & s) >= 0.9 * len(x)}
    assert brute and brute <= want


def test_the_space_is_fitted_on_every_document(spark):
    """The space of 3000 documents, against the same from dense rows of all of them; a sample of some 500 gives another."""
    rng = np.random.default_rng(6)
    word = lambda n: " ".join("".join(rng.choice(["ba", "ko", "ri", "tu", "se"], rng.integers(1, 3))) for _ in range(n))
    texts, items = [word(int(n)) for n in rng.integers(0, 120, 3000)], [(i, word(12)) for i in range(5)]
    docs = spark.createDataFrame([*enumerate(texts), (3000, None)], "doc_id long, text string")
    space, _ = decontaminate.build(docs, items)
    ids, size = space.ids, len(space.ids)
    df = np.array([sum(w in t.split() for t in texts) for w in ids])
    assert np.allclose(space.idf, np.log((len(texts) + 2) / (df + 1)) + 0.01)
    own = lambda ws: np.bincount([ids[w] for w in ws if w in ids], minlength=size) * space.idf
    pieces = [own(t.split()[k : k + decontaminate.PIECE]) for t in texts for k in range(0, len(t.split()), decontaminate.PIECE)]
    a = np.array([x / np.linalg.norm(x) for x in pieces + [own(t.split()) for _, t in items] if x.any()])
    assert size <= decontaminate.DIMENSIONS  # so the space is the whole one, turned by the right singular vectors
    got = space.rows[:-1] / space.idf[:, None]
    values = np.linalg.eigvalsh(a.T @ a)[::-1]
    assert np.allclose(got.T @ got, np.eye(size), atol=1e-4)
    assert np.allclose(np.diag(got.T @ a.T @ a @ got), values, rtol=1e-3)


def test_paraphrases_are_found_as_by_brute_force(spark):
    """Items with a third of the words replaced, answer left: at least 0.9 of what a search without the space finds."""
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    rng, pool = np.random.default_rng(7), [w for r in docs.limit(300).collect() for w in decontaminate.words_of(r["text"])]
    made, items = [], bench.collect()
    for k in range(120):
        item = items[k % len(items)]
        ws, answer = decontaminate.words_of(item["text"]), len(decontaminate.answer_of(item["text"]))
        new = [w if j >= len(ws) - answer or rng.random() < 0.7 else pool[rng.integers(len(pool))] for j, w in enumerate(ws)]
        at = int(rng.integers(len(pool) - 200))
        made.append((k, " ".join([*pool[at : at + 100], *new, *pool[at + 100 : at + 200]])))
    frame = spark.createDataFrame(made, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame, bench).collect()}
    rows = sorted(((r["item_id"], r["text"]) for r in bench.collect()), key=repr)
    sized = {i: (decontaminate.words_of(t), decontaminate.answer_of(t)) for i, t in rows}
    brute = set()
    for k, t in made:
        words = decontaminate.words_of(t)
        for i, (x, answer) in sized.items():
            best = 0
            for a, w in [(a, w) for w in decontaminate.WINDOWS for a in range(0, max(1, len(words) - w // 2), w // 2)]:
                around = words[max(0, a - len(x)) : min(a + w, len(words)) + len(x)]
                n = decontaminate.common_subsequence(decontaminate.masks_of(x), len(x), around)
                if n > best and n >= decontaminate.PARAPHRASE * len(x) - 1e-9:
                    told = decontaminate.common_subsequence(decontaminate.masks_of(answer), len(answer), around) >= decontaminate.ANSWER * len(answer)
                    best = n if n >= decontaminate.SAME * len(x) or told else best
            if best:
                brute.add((k, i))
    assert len(brute) > 80 and got <= brute and len(got) >= 0.9 * len(brute)


def test_words_are_numbered_as_by_plain_python():
    texts = ["Ab_c1 İstanbul ΣΑΣ ΣΑΣ, é\U0001f600x ٣٤ x", None, "", " ", "x", "straße STRASSE 漢字 ab", "y " * 70_000 + "x"]
    words = sorted({w for t in texts for w in decontaminate.words_of(t)} - {"c1", "y"})
    at, sizes = decontaminate.Numbering(words)(texts)
    want = [[words.index(w) if w in words else -1 for w in decontaminate.words_of(t)] for t in texts]
    assert sizes.tolist() == [len(x) for x in want] and at.tolist() == [n for x in want for n in x]


def test_common_subsequence_equals_the_table():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (rng.choice(list("abcde"), n).tolist() for n in (9, 14))
        table = [[0] * 15 for _ in range(10)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(decontaminate.masks_of(a), 9, b) == table[9][14]


# line dedup


def test_linededup_odd_cases(spark, odd, odd_rows, none):
    line = "this very line is longer than forty characters, surely"
    rows = [*odd_rows, *[(100 + i, f"x{i}\n \t{line.upper()} \x0b\n{line}", None, None, 0) for i in range(6)], (105, f"{line}\n{line}", None, None, 0), (None, f"{line}\nb", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r["doc_id"], r["kept"]): (r["n_lines"], r["n_dropped"]) for r in linededup.dedup_lines(docs).collect()}
    assert got[100, "x0"] == (3, 2) and got[105, f"x5\n \t{line.upper()} \x0b\n{line}"] == (3, 0) and got[105, f"{line}\n{line}"] == (2, 0) and got[None, "b"] == (2, 1)
    assert got[2, ""] == (1, 0) and got[3, ""] == (1, 0)
    assert linededup.dedup_lines(odd).count() == odd.count() and linededup.dedup_lines(none).count() == 0
    unique = [r for r in rows if r[0] is not None and [x[0] for x in rows].count(r[0]) == 1]
    names, want = _odd_sql("op7_linededup", unique)
    frame = spark.createDataFrame(unique, docs.schema)
    out = linededup.dedup_lines(frame).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
    assert sorted(map(tuple, out.select(*names).collect())) == sorted(want)


def test_keep_bitmap_is_run_length_coded(spark):
    df = spark.sql("select array(2, 3, 6) as dropped, split('a,b,c,d,e,f,g', ',') as lines")
    runs = df.select(linededup.keep_runs(F.col("dropped"), F.col("lines")).alias("r")).first()["r"]
    assert [(r["start"], r["size"]) for r in runs] == [(1, 1), (3, 0), (4, 2), (7, 1)]


# mixing


def test_mixing_odd_cases(spark, odd, odd_rows, none):
    names, want = _odd_sql("op10_mixing", odd_rows)
    got = mixing.mix(odd).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want, key=repr)
    assert mixing.mix(none).count() == 0


def test_mixing_hits_targets_and_reruns_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    run = lambda: mixing.mix(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    a = run()
    pd.testing.assert_frame_equal(a, run())
    g = a.assign(taken=a["times"] * a["size"]).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), cap=("source_size", "first"))
    assert (g["taken"] <= g["target"] + 1e-6).all() and (g["taken"] >= 0.9 * g["target"] - 20).all() and g["taken"].sum() <= a["size"].sum() and (g["target"] <= 3 * g["cap"] + 1e-6).all()
    assert g["target"].sum() == pytest.approx(a["size"].sum())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    pd.testing.assert_frame_equal(a, run())


def test_the_cut_takes_a_prefix_of_the_global_order(spark, monkeypatch):
    """Brute force: all queued documents sorted by finish time, taken until the total is reached, less what lies beyond a target."""
    monkeypatch.setattr(mixing, "FILLS", 0)
    got = mixing.mix(spark.read.parquet(f"{DATA}/documents.parquet")).toPandas()
    entries = []
    for r in got.itertuples():
        turn = hashlib.md5(str(r.doc_id).encode()).hexdigest()
        entries += [(r.finish + e * r.source_size / r.target, turn, "s" + r.source, r.doc_id, r.size) for e in range(3)]
    total, taken = 0, {}
    for finish, _, _, doc, size in sorted(entries):
        total += size
        if total > got["size"].sum():
            break
        if finish <= 1:
            taken[doc] = taken.get(doc, 0) + 1
    assert finish > 1
    assert {r.doc_id: r.times for r in got.itertuples() if r.times} == taken


def test_mixed_repeats_rows_as_counted(spark):
    rows = [(1, "a b c", "x", 7), (1, "a b c", "x", 8), (2, "d e", "x", 9), (None, "f g h", "y", 1), (None, "f g h", "y", 2), (None, "i", "y", 3), (3, None, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, times int")
    times = mixing.mix(docs).groupBy("doc_id", "size").agg(F.sum("times").alias("n")).collect()
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = [r for r in out.collect()]
    for r in times:
        assert sum((x["doc_id"], len((x["text"] or "").split())) == (r["doc_id"], r["size"]) for x in got) == r["n"]
    assert set(map(tuple, got)) <= set(rows)


def test_hot_lines_are_joined_apart(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = sorted(map(tuple, linededup.dedup_lines(docs).select("doc_id", "n_dropped", "kept").collect()))
    monkeypatch.setattr(linededup, "skew_join", lambda a, b, keys: skew_join(a, b, keys, hot_rows=6))
    assert sorted(map(tuple, linededup.dedup_lines(docs).select("doc_id", "n_dropped", "kept").collect())) == want


def test_connect_has_all_tables():
    assert connect().execute("select count(*) from documents").fetchone()[0] > 0
