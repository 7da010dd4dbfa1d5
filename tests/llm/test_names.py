"""Columns of any name go through every operator, and hits of several automata are those of one."""

import pytest
from pyspark.sql import functions as F

from floodlens.llm import language, toxicity
from floodlens.llm.decontaminate import find_contamination
from floodlens.llm.hmm import score_texts
from floodlens.llm.lexicon import encode
from floodlens.llm.queries import URL_RULES
from floodlens.llm.repeats import remove_repeats
from floodlens.llm.token_counts import count_tokens
from floodlens.llm.url_rules import judge_urls
from floodlens.llm.windows import remove_repeated_windows

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = ["_block", "_held", "_symbols", "_rare", "_text", "_items", "_spans", "_n_words", "_h", "_rule", "_id", "a.b", "a`b", "carried_1"]
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ROWS = [(1, PASSAGE, "http://example.org/es/1"), (2, f"x {PASSAGE} y", None), (3, None, ""), (None, "", "http://a.b/c"), (2, "short", "no url")]
OPERATORS = {
    "score_texts": lambda d: score_texts(d, F.col("doc_id") == 2, rounds=1),
    "remove_repeats": remove_repeats,
    "remove_repeated_windows": remove_repeated_windows,
    "encode": lambda d: encode(d, VOCABULARY),
    "count_tokens": lambda d: count_tokens(d, VOCABULARY),
    "find_contamination": lambda d: find_contamination(d, d.sparkSession.createDataFrame([("i", PASSAGE)], "item_id string, text string")),
    "judge_urls": lambda d: judge_urls(d, d.sparkSession.createDataFrame(URL_RULES, "host string, path string, verdict string")),
    "toxicity.score": lambda d: toxicity.score(d, toxicity.train(d, d.select("doc_id", F.lit(1).alias("toxic")))),
    "language.identify": lambda d: language.identify(d, language.train(d.withColumn("lang", F.lit("aa")))),
}


def plain_and_odd(spark):
    plain = spark.createDataFrame(ROWS, "doc_id bigint, text string, url string")
    odd = spark.createDataFrame([(*r, *(f"{n}:{k}" for n in ODD)) for k, r in enumerate(ROWS)],
                                "doc_id bigint, text string, url string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in ODD))
    return plain, odd


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(spark, name):
    """Own names, dots and backticks among the columns: values stay, results are those without them."""
    plain, odd = plain_and_odd(spark)
    want, got = OPERATORS[name](plain), OPERATORS[name](odd)
    assert sorted(got.columns) == sorted([*want.columns, *ODD])
    rows = [r.asDict() for r in got.collect()]
    assert sorted(repr([r[c] for c in want.columns]) for r in rows) == sorted(repr(list(r)) for r in want.collect())
    for r in rows:
        k = r["_block"].split(":")[1]
        assert [r[n] for n in ODD] == [f"{n}:{k}" for n in ODD] and ROWS[int(k)][:2] == (r["doc_id"], r["text"])


def test_odd_names_as_arguments(spark):
    docs = spark.createDataFrame([(1, PASSAGE, True), (2, PASSAGE, False)], "`_block` bigint, `the.text` string, `_held` boolean")
    cut = remove_repeated_windows(docs, id_col="_block", text_col="the.text", carry=["_block"])
    assert {r["_block"]: r.n_removed for r in cut.select("_block", "n_removed").collect()} == {1: 0, 2: 14}
    scored = score_texts(docs, F.col("_held"), text_col="the.text", id_col="_block", rounds=1)
    assert {r["_block"]: (r.held_out, r["_held"]) for r in scored.collect()} == {1: (True, True), 2: (False, False)}


def test_several_automata_equal_one(spark):
    """Spans are maximal, sorted and disjoint however many automata the items are dealt over."""
    words = [f"w{k}" for k in range(60)]
    items = [(str(k), " ".join(words[k:k + 12])) for k in range(0, 48, 3)] + [("short", "w58"), ("none", "..."), ("null", None)]
    texts = [" ".join(words), " ".join(words[5:30]) + " gap, é " + " ".join(words[20:60]), "w58 w58", "", None, "Ünder W58"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    table = spark.createDataFrame(items, "item_id string, text string")
    one = find_contamination(docs, table)
    several = find_contamination(docs, table, automaton_bytes=100)
    cols = ["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"]
    assert sorted(map(repr, one.select(cols).collect())) == sorted(map(repr, several.select(cols).collect()))
    assert one.where("n_hit > 30").count() == 2
