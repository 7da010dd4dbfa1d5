"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import flat_graph, hmm, language, lexicon, toxicity
from .common import fold_of, read
from .decontaminate import find_contamination
from .hard_negatives import mine_hard_negatives
from .minhash import near_duplicates
from .repeats import remove_repeats
from .token_counts import count_tokens
from .url_rules import judge_urls
from .whitening import whiten
from .windows import remove_repeated_windows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


@register("op10_url_rules", f"""
WITH rules(rule_host, rule_path, v) AS (VALUES {_RULES_SQL}),
parts AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
hits AS (
  SELECT rid, rule_host || rule_path AS rule, v,
         row_number() OVER (PARTITION BY rid ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, v DESC) AS k
  FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (rid)""")
def op10(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(read(spark, sf_dir, "pages", "page_id", "url"), rules).drop("url")


_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@register("op7_decontaminate", f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_WORDS}') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_WORDS}') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS key
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS key
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT DISTINCT rid, dw.n, i, id FROM dw JOIN bw ON dw.n = bw.n AND dw.key = bw.key),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS s FROM (SELECT DISTINCT rid, id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN ids USING (rid)""")
def op7(spark, sf_dir):
    found = find_contamination(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_TOKENS = "[^\\x20\\x09-\\x0D]+"


@register("op6_window_dedup", f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_TOKENS}') AS w FROM documents),
win AS (
  SELECT rid, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS key
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT key, min(doc_id) AS first_id FROM win GROUP BY key),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (key) WHERE first_id < doc_id),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS n FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)""")
def op6(spark, sf_dir):
    cut = remove_repeated_windows(read(spark, sf_dir, "documents", "doc_id", "text"), carry=["doc_id"])
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op5_suffix_dedup", """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (
  SELECT rid, doc_id, i, substr(h, 2 * i + 1, 100) AS key
  FROM (SELECT rid, doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
firsts AS (SELECT key, min(doc_id) AS first_id FROM win GROUP BY key),
hit AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM win JOIN firsts USING (key) WHERE first_id < doc_id),
run AS (SELECT rid, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS k FROM hit),
span AS (SELECT rid, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY rid, k),
cut AS (SELECT rid, a, b, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS c FROM span),
rest AS (
  SELECT rid, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS s, max(b) AS e, count(*) AS n_spans, sum(b - a) AS n
  FROM cut JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN e IS NULL THEN h ELSE s || substr(h, 2 * e + 1) END)) AS kept_sha256
FROM d LEFT JOIN rest USING (rid)""")
def op5(spark, sf_dir):
    cut = remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"), carry=["doc_id"])
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register("op9_toxicity")
def op9(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", fold_of(F.col("doc_id"), 4) == 2)
    model = toxicity.train(docs.where("NOT held_out"), read(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


@register("op3_language_id")
def op3(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", fold_of(F.col("doc_id"), 5) == 0)
    classifier = language.train(docs.where("NOT held_out"))
    return language.identify(docs.drop("lang"), classifier).select("doc_id", "held_out", "lang_pred", "score")


@register("op4_bpe")
def op4(spark, sf_dir):
    coded = lexicon.encode(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id"])
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


_SHINGLES = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_TOKENS}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + 3), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, b FROM reach JOIN link ON link.a = reach.other),
"""


@register("op8_minhash", _SHINGLES + """
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN n USING (doc_id)""")
def op8(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), width=4).drop("text_hash")


@register("op2_flat_graph", """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.9 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, b FROM reach JOIN link ON link.a = reach.other),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN n USING (vec_id)""")
def op2(spark, sf_dir):
    return flat_graph.near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@register("op1_hmm")
def op1(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return hmm.score_texts(docs, fold_of(F.col("doc_id"), 10) == 0, carry=["doc_id"])


@register("op11_whitening")
def op11(spark, sf_dir):
    return whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@register("op12_hard_negatives", """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE) FOR c IN embedding] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
a AS (SELECT DISTINCT vec_id, label, x FROM r WHERE vec_id % 100 = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score
  FROM a JOIN r ON a.vec_id <> r.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place
  FROM s WHERE same),
n AS (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, place ORDER BY score DESC, other_id) AS k
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND place <= 5 AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 10""")
def op12(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@register("op13_token_counts")
def op13(spark, sf_dir):
    counted = count_tokens(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)
