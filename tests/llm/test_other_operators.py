import base64
import gzip
import hashlib
import html as entities
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import DATA
from tidewater.llm import ann, html, sharding, warc

# HTML


def test_field_on_held_out_layouts():
    rng, right, total = random.Random(77), 0, 0
    for _ in range(200):
        page, labels = html.labelled_page(rng)
        got = html.default_field().decode(html.features(html.blocks_of(page)))
        right, total = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert right / total > 0.97


def test_viterbi_equals_enumeration():
    from itertools import product

    field, rng = html.default_field(), random.Random(3)
    page, _ = html.labelled_page(rng)
    rows = html.features(html.blocks_of(page))[:9]
    gain = [sum(field.weights[field.ids[n]] for n in r if n in field.ids) for r in rows]
    score = lambda y: sum(g for g, v in zip(gain, y, strict=True) if v) + sum(field.steps[a, b] for a, b in zip(y, y[1:], strict=False))
    assert score(tuple(map(int, field.decode(rows)))) == pytest.approx(max(map(score, product((0, 1), repeat=len(rows)))))


def test_main_text_of_the_test_pages(spark):
    for r in html.extract(spark.read.parquet(f"{DATA}/pages.parquet")).collect():
        inner = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(x for x in parts if x)


PAGE = """<html><body><header><div>Site name</div></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>
<div class="cookie-banner">We use cookies to make this site better for all of you.</div>
<article><h1>A  title &amp; more</h1><p>First&nbsp;paragraph of <b>the</b> article,
with a line break.<p>Second one &lt;here&gt;<br>after break.<!-- no --><script>var a = "<p>no</p>";</script>
<div class="advert">Buy our things now, they are cheap and good.</div><p>Third paragraph ends the story.</article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this article a lot, thank you.</p></div></section>
<aside class=sidebar><p>Related stories you may like</p></aside><form><p>Sign up</p><button>Go</button></form><footer>&copy; 2024 Site</footer></body></html>"""


def test_page_with_all_kinds_of_boxes():
    assert html.main_text(html.default_field(), PAGE) == "A title & more\nFirst paragraph of the article, with a line break.\nSecond one <here> after break.\nThird paragraph ends the story."


def test_html_odd_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "<p"), (None, "u", "<article><p>" + "word " * 50_000), (5, "u", "plain &#x41; text"), (5, "u", "plain &#x41; text"), (6, "u", "<!-- open"), (7, "u", "<script>never closed <p>x</p>")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html.extract(df)
    assert got.columns == df.columns and got.count() == len(rows)
    text = {r["page_id"]: r["text"] for r in got.collect()}
    assert text[1] == text[2] == text[6] == text[7] == "" and len(text[None]) == 5 * 50_000 - 1
    assert html.extract(df.limit(0)).count() == 0


def test_formulas_stay_and_white_space_is_unicode():
    page = "<article><p>The area is <math><mi>x</mi><mo>=</mo><mn>2</mn></math> for\u00a0\u3000all of&nbsp;the squares here.</p></article>"
    assert [b.text for b in html.blocks_of(page)] == ["The area is x=2 for all of the squares here."]


# nearest neighbours


def _brute(rows, k=20, every=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = {}
    for q, x in ok:
        if q % every == 0:
            out[q] = sorted((-float((x * y).sum()), i) for i, y in ok if i != q)[:k]
    return out


def test_recall_and_exact_scores(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = _brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"], r["rank"]))
    assert set(got) == set(want)
    for rows in got.values():
        assert [x[2] for x in rows] == list(range(1, 21)) and [x[:2] for x in rows] == sorted(x[:2] for x in rows)
    hit = [len({i for _, i in want[q]} & {i for _, i, _ in got[q]}) / 20 for q in want]
    assert np.mean(hit) >= 0.9
    full = {q: dict((i, s) for s, i in _brute([(r["vec_id"], r["embedding"]) for r in df.collect()], 10**6)[q]) for q in list(want)[:3]}
    for q, scores in full.items():
        assert all(abs(scores[i] - s) < 1e-12 for s, i, _ in got[q])


def test_ann_odd_cases(spark):
    g = np.random.default_rng(0)
    rows = [(i, g.standard_normal(4).tolist()) for i in range(1, 60)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100, 190)]
    bad = [(200, None), (220, [0.0] * 4), (240, [None, 1.0, 1.0, 1.0]), (260, [float("nan"), 1.0, 1.0, 1.0]), (280, [float("inf"), 1.0, 1.0, 1.0]), (320, []), (None, [1.0] * 4)]
    short = [(300, [1.0, 2.0])]  # counts as filled up with zeros
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + bad + short], "vec_id long, embedding array<double>, rank int, score int")
    want = _brute([*rows, (300, [1.0, 2.0, 0.0, 0.0])])
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [i for _, i in x] for q, x in want.items()}  # so few rows are searched whole
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.filter("vec_id = 20")).count() == 0
    few = ann.nearest(df.filter("vec_id in (20, 21, 22)")).collect()
    assert sorted(r["rank"] for r in few) == [1, 2]


@pytest.mark.parametrize("bounds", [{}, {"SAMPLE": 400, "LEAF": 64, "CELL": 300, "PROBES": 16, "LISTS": 50}])
def test_forest_lifts_large_vectors(spark, monkeypatch, bounds):
    """Recall holds when the sample is far smaller than the table and cells, probes and lists are dealt to many calls."""
    for name, value in bounds.items():
        monkeypatch.setattr(ann, name, value)
    g = np.random.default_rng(1)
    rows = [(i, (g.standard_normal(8) * g.uniform(0.2, 5)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = _brute(rows)
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len({i for _, i in x} & got[q]) / 20 for q, x in want.items()]) >= 0.9


# WARC


def test_records_round_trip_in_small_blocks():
    import io

    payloads = [b"", b"x" * 300_000, bytes(range(256)) * 40, "é\r\n\r\n".encode()]
    data = b"".join(warc.record(p, str(i), f"http://x/{i}\n", None) for i, p in enumerate(payloads)) + warc.record(payloads[1], "9", "", "1")
    for block in (1, 7, 1 << 16):
        if block == 1:
            small = b"".join(warc.record(p, "1", "", None) for p in (b"", b"abc"))
            assert len(list(warc.read_records(io.BytesIO(small), 1))) == 2
            continue
        got = [warc.page_of(h, b) for h, b in warc.read_records(io.BytesIO(data), block)]
        assert [x[:4] for x in got[:4]] == [(str(i), len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response") for i, p in enumerate(payloads)]
        assert got[4] == ("9", 300_000, got[1][2], "revisit", "1")
    assert gzip.decompress(warc.record(b"abc", "1", "u", None)).startswith(b"WARC/1.1\r\n")


def test_damage_is_noticed():
    good = warc.record(b"abc" * 100, "1", "u", None)
    plain = gzip.decompress(good)
    pack = lambda b: gzip.compress(b)
    for bad in (good[:-9], good + b"junk", pack(plain[:-1]), pack(plain + b"x"), pack(b"no header"), pack(plain.replace(b"Content-Length: ", b"Content-Size: ")), pack(plain.replace(b"WARC/1.1", b"HTTP/1.1"))):
        with pytest.raises(warc.WarcError):
            warc.records_of(bad)
    head, block = warc.records_of(pack(plain.replace(b"abcabc", b"abcabd", 1)))[0]
    with pytest.raises(warc.WarcError):
        warc.page_of(head, block)


def test_archives_equal_brute_force(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(900, None, None), (901, "u", ""), (902, "u", None), (903, "a\r\nb", "dup"), (904, "u", "dup"), (904, "u", "dup"), (None, "u", "dup"), (None, None, "alone")], "page_id long, url string, html string")
    both = pages.unionByName(odd)
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in both.collect()]
    best = {}
    for i, p in rows:
        if i is not None:
            best[p] = max(best.get(p, i), i)
    want = []
    for i, p in rows:
        other = best.get(p) is not None and i != best[p]
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if other else "response", best[p] if other else None))
    got = warc.round_trip(both.withColumns({"digest": F.lit("x"), "best": F.lit(1), "payload": F.lit(2)}))
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == sorted(want, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0
    few = warc.round_trip(odd, min_bytes=4).filter("record_type = 'revisit'").count()
    assert few == 0


# sharding


def _check(rows, shards, texts):
    assert len(rows) == len(texts)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(0 <= r["shard"] < shards for r in rows)
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want


def test_shards_are_near_equal_in_bytes(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 400))) for _ in range(3000)] + ["copy of the same text"] * 4000
    df = spark.createDataFrame([(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", None])) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    rows = sharding.shard(df, 12).collect()
    _check(rows, 12, texts)
    size = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows], 12)
    assert size.max() <= 1.02 * size.mean() and size.min() >= 0.98 * size.mean()
    again = sharding.shard(df.orderBy(F.col("doc_id").desc()), 12).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    # the copies fill two shards; no other text is divided
    spread = {}
    for r in rows:
        spread.setdefault(r["text_crc32"], set()).add(r["shard"])
    large = zlib.crc32(b"copy of the same text")
    assert all(len(x) == 1 for crc, x in spread.items() if crc != large) and 2 <= len(spread[large]) <= 4


def test_equal_texts_share_a_shard_on_whole_tables(spark):
    sf = DATA.replace("sf0.001", "sf0.01")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sharding.op9_sharding(spark, sf).collect()
    assert rows[0].asDict().keys() == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    _check(rows, 40, list(texts.values()))
    size = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows], 40)
    assert size.min() >= 0.95 * size.mean() and size.max() <= 1.05 * size.mean()
    spread, weight = {}, {}
    for r in rows:
        spread.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
        weight[texts[r["doc_id"]]] = weight.get(texts[r["doc_id"]], 0) + r["size"]
    assert any(len(x) > 1 for x in spread.values()) <= any(w > size.mean() for w in weight.values())
    assert all(len(x) == 1 or weight[t] > size.mean() for t, x in spread.items())


def test_shards_are_added_to_documents_as_they_are(odd, none):
    out = sharding.with_shard(odd)
    assert out.columns == [*odd.columns, "shard_"] and out.count() == odd.count()
    assert sorted(map(repr, out.drop("shard_").collect())) == sorted(map(repr, odd.collect()))
    by_text = {}
    for r in out.collect():
        by_text.setdefault(r["text"] or "", set()).add(r["shard_"])
    assert all(len(x) == 1 for x in by_text.values()) and sharding.with_shard(none).count() == 0


def test_sharding_odd_cases(odd, odd_rows, none):
    rows = sharding.shard(odd).collect()
    _check(rows, 40, [r[1] for r in odd_rows])
    assert sharding.shard(none).count() == 0
    assert {r["shard"] for r in sharding.shard(odd, 1).collect()} == {0}
