"""Operators 3, 7, 9 and 10: brute force or held-out accuracy, and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodlens.llm import language, toxicity
from floodlens.llm.common import fold_of, read, sha256_hex
from floodlens.llm.decontaminate import NORMAL, find_contamination
from floodlens.llm.queries import QUERIES, URL_RULES
from floodlens.llm.url_rules import judge_urls

SF = "/root/testdata/sf0.01"


# --- URL rules ---------------------------------------------------------------

URLS = ["http://example.org/es/1", "https://a.b.EXAMPLE.org/en/12?x=1", "example.org/es/", None, "", "http://", "http://org/", "http://org", "http://xorg/", "ftp://www.xexample.org/es/",
        "http://example.org?/es/", "http://example.org#/en/1", "http://a.com/de/x#f", "http://com/fr/", "https://ü.com/de/é", "http://x.com//de/", "http://a://b.org/en/1", "http://b\nc.org/x\ny", "http://example.org./es/"]


def brute_url(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else default


def test_urls_against_brute_force(spark):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(1, URLS[0]), (1, URLS[0]), (None, URLS[1])]
    rules = [*URL_RULES, ("b.org", "/en", "block"), ("org", "", "allow"), (None, "/", "block"), ("c", None, "block"), ("", "/", "block"), ("com", "/de/", "block"), ("ü.com", "/de/é", "allow")]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in rows], "page_id bigint, url string, host string, rule string")
    got = judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    sound = [r for r in rules if None not in r and r[0]]
    assert sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=repr) == sorted(((i, u, *brute_url(u, sound)) for i, u in rows), key=repr)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id bigint, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [(r.rule, r.verdict) for r in judge_urls(pages, none, default="block").collect()] == [(None, "block")]
    assert judge_urls(pages.limit(0), spark.createDataFrame(URL_RULES, none.schema)).count() == 0


# --- decontamination ---------------------------------------------------------

def brute_hits(text, items, window=10):
    words = (text or "").encode().translate(NORMAL).split()
    hit, ids = [False] * len(words), set()
    for item, body in items:
        seq = (body or "").encode().translate(NORMAL).split()
        for i in range(max(1, len(seq) - window + 1) if seq else 0):
            key = seq[i:i + window]
            for j in range(len(words) - len(key) + 1):
                if words[j:j + len(key)] == key:
                    hit[j:j + len(key)] = [True] * len(key)
                    ids.add("null" if item is None else str(item))
    return len(words), sum(hit), sorted(ids)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven TWELVE"), (2, "Short item"), (10, "short, ITEM!"), (3, None), (4, "..."), (5, "é1 x"), (None, "null id here"), (6, "a a a a a a a a a a a")]
TEXTS = ["zero One, two-three four five six seven eight nine ten eleven twelve thirteen", "a short item and short itemx", "xé1 x é1 x", None, "", " .. ", "null id here null", "a " * 30, "two three four five six seven eight nine ten eleven",
         "one two three four five six seven eight nine", "shortitem short\x00item", "y " * 20000 + "short item"]


@pytest.mark.parametrize("automaton_bytes", [1 << 20, 40])
def test_contamination_against_brute_force(spark, automaton_bytes):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, TEXTS[1])]
    docs = spark.createDataFrame([(d, t, "x", [9]) for d, t in rows], "doc_id bigint, text string, items string, spans array<int>")
    got = find_contamination(docs, spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id bigint, text string, doc_id int"), automaton_bytes=automaton_bytes).collect()
    assert sorted(((r.doc_id, r.text, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == sorted(((d, t, *brute_hits(t, ITEMS)) for d, t in rows), key=repr)
    for r in got:
        assert r.contaminated == (r.n_hit > 0)
        for first, end, a, b in r.spans:  # byte offsets are those of the original text
            assert r.text.encode()[a:b].translate(NORMAL).split() == r.text.encode().translate(NORMAL).split()[first:end]


def test_empty_benchmark_and_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in find_contamination(docs, none).collect()] == [(2, 0, [], False)]
    assert find_contamination(docs.limit(0), spark.createDataFrame(ITEMS, none.schema)).count() == 0


def test_decontamination_query(spark):
    rows = {r.doc_id: r.text for r in read(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text").collect()}
    items = [(r.item_id, r.text) for r in read(spark, "/root/testdata/sf0.001", "benchmark", "item_id", "text").collect()]
    hits = 0
    for r in QUERIES["op7_decontaminate"](spark, "/root/testdata/sf0.001").collect():
        n, hit, ids = brute_hits(rows[r.doc_id][:4000], items)
        if len(rows[r.doc_id]) <= 4000:
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, hit, len(ids), sha256_hex(",".join(ids).encode()))
            hits += hit > 0
    assert hits


# --- toxicity ----------------------------------------------------------------

def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op9_toxicity"](spark, sf).join(read(spark, sf, "labels", "doc_id", "toxic").where("toxic IS NOT NULL"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    caught, missed, wrong = n.get((1, 1), 0), n.get((1, 0), 0), n.get((0, 1), 0)
    assert caught / (caught + missed) > 0.85 and caught / (caught + wrong) > 0.9


def test_toxicity_odd_rows(spark):
    good, bad = "the quiet morning was fine and calm", "you are a vile toad today"
    rows = [(k, f"{good} {k % 7}" if k % 3 else f"{bad} {k % 5}") for k in range(300)] + [(900, None), (901, ""), (902, bad.upper() + "!!"), (903, "x " * 50000), (None, bad), (904, good), (904, good)]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id bigint, text string, score string, _label int")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), 5) for k in range(300)] + [(1, 0, 5), (2, None, 5), (None, 1, 5), (7777, 1, 5)], "doc_id bigint, toxic int, quality int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.5) == ("vile" in (r.text or "").lower()) for r in got if r.text)
    assert len(model[0]) < 400  # L1 leaves few weights
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert {round(r.score, 6) for r in toxicity.score(docs, none).collect()} == {0.0}
    one = toxicity.train(docs, labels.where("toxic = 1"))
    assert min(r.score for r in toxicity.score(docs, one).collect()) > 0.5
    shards = toxicity.train(docs, labels, shard_rows=40)
    assert all((r.score >= 0.5) == ("vile" in r.text) for r in toxicity.score(docs.where("doc_id < 300"), shards).collect())


def test_ftrl_first_step():
    w, b = toxicity.ftrl([np.array([0, 1])] * 40, np.ones(40), 3)
    assert w[0] == w[1] > 0 and w[2] == 0 and b > 0


# --- language ----------------------------------------------------------------

def test_language_held_out(spark):
    got = QUERIES["op3_language_id"](spark, SF).join(read(spark, SF, "documents", "doc_id", "lang"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    held = {r.doc_id for r in got.collect()}
    assert held == {r.doc_id for r in read(spark, SF, "documents", "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}


def test_language_odd_rows(spark):
    rows = [(k, t, lang) for k in range(30) for lang, t in (("aa", f"kaka koko kiki {k}"), ("bb", f"zuzu zozo zaza {k}"))]
    rows += [(900, None, "aa"), (901, "", None), (902, "123 !?", "bb"), (903, "漢字", None), (904, "KAKA " * 30000, None), (905, "𐐀", None), (906, "zaza", None), (906, "zaza", None), (None, "koko", None), (907, "ǅ ﬁ ͅ", None)]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id bigint, text string, lang string, lang_pred string, _lang double")
    got = language.identify(docs, language.train(docs)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
        if r.text and r.text[0] in "kKz":
            assert r.lang_pred == ("bb" if r.text[0] == "z" else "aa")
    none = language.train(docs.where("lang = 'cc'"))
    assert {(r.lang_pred, r.score) for r in language.identify(docs, none).collect()} == {("und", 0.0)}
    assert language.identify(docs.limit(0), language.train(docs)).count() == 0
    assert language.train(docs.limit(0)).languages == []


def test_languages_of_all_rows(spark):
    """A language of 3 rows in 4,003 is learnt from a sample of 200, and a null or repeated id hides none."""
    rows = [(k, f"kaka koko kiki {chr(97 + k % 26)}", "aa") for k in range(4_000)] + [(9_000, f"zuzu zozo zaza {c}", "bb") for c in "xyz"]
    rows += [(None, "mumu mimi meme", "cc")] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(docs, sample_rows=200)
    assert model.languages == ["aa", "bb", "cc"]
    wrong = language.identify(docs, model).where("lang <> lang_pred").count()
    assert wrong == 0


def test_bounds_of_the_sample():
    assert language._bounds({"a": (50, 1), "b": (100, 2)}, 200) == {}
    got = language._bounds({"a": (10, 1), "b": (10_000, 2), "c": (90_000, language.MOST_DRAW)}, 1_000)
    assert set(got) == {"b", "c"} and got["c"] == language.MOST_DRAW
    got = language._bounds({"a": (10, 1), "b": (10_000, 2), "c": (90_000, 3)}, 1_000)
    taken = 10 + sum(n * got[k] / language.MOST_DRAW for k, n in (("b", 10_000), ("c", 90_000)))
    assert 950 < taken < 1_050


def test_presence_kernel_by_hand():
    marks = language.Landmarks(["abc", "xyz"])
    kernel, known = marks.kernel(["abc", "cab abc", None, "..."])
    def grams(t):
        t = " " + t + " "
        return {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    a, b = grams("abc"), grams("cab abc")
    assert known.tolist() == [True, True, False, False] and np.isclose(kernel[0, 0], 1, atol=1e-5)
    assert np.isclose(kernel[1, 0], len(a & b) / np.sqrt(len(a) * len(b)), atol=1e-5) and kernel[2].max() == 0


def test_folds(spark):
    rows = spark.createDataFrame([(k,) for k in [0, 5, 123456789, None]], "i bigint").select("i", fold_of(F.col("i"), 5).alias("f")).collect()
    assert [r.f for r in rows] == [zlib.crc32(("" if r.i is None else str(r.i)).encode()) % 5 for r in rows]
