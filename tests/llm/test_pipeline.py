"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline
from floodlens.llm.lexicon import Vocabulary
from floodlens.session import materialize

TOXIC = "you vile wicked toad"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(30)
    passage = text(60)
    rows = {k: text(120) for k in range(200)}
    for k in range(0, 60, 2):
        rows[k] = rows[k] + " " + TOXIC
    rows[301] = rows[101]
    rows[302] = rows[101] + " extra"
    rows[303], rows[304] = text(50) + " " + passage + " " + text(50), text(50) + "\n" + passage + "  " + text(50)
    rows[305] = text(40) + ". " + item.upper().replace(" ", ", ") + " " + text(40)
    rows[306], rows[307], rows[308] = None, "", text(40_000)
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "gone", 1, t) for d, t in rows.items()],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, n_removed int, spans string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k < 60 and k % 2 == 0)) for k in range(150)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, text(5))], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, passage


def test_stages(spark, corpus):
    folder, rows, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), name)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == names or name == "bpe"
    toxic = {k for k in range(0, 60, 2)}
    assert set(seen["toxicity"]) == set(rows) - toxic
    assert set(seen["near_dedup"]) == set(rows) - toxic - {301, 302}
    cut = seen["substring_dedup"]
    assert set(cut) == set(seen["near_dedup"])
    assert cut[303].text == rows[303] and passage not in " ".join(cut[304].text.split()) and cut[304].n_chars == len(cut[304].text) and len(cut[304].text.split()) == 100
    assert {d for d in cut if cut[d].text != rows[d]} == {304}
    assert all((r.kept, r.n_removed, r.spans) == ("gone", 1, rows[d]) for d, r in cut.items())
    assert set(seen["decontamination"]) == set(cut) - {305}
    with open(corpus_pipeline.TOKENIZER, encoding="utf-8") as f:
        tokens = Vocabulary(f.read()).tokens
    for d, r in seen["bpe"].items():
        assert r.n_tokens == len(r.ids) and r.decoded == " ".join(tokens[i] for i in r.ids)
    assert set(seen["bpe"]) == set(seen["decontamination"])
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=repr) == sorted(map(tuple, seen["bpe"].values()), key=repr)


def test_empty_corpus(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), name)
        assert docs.count() == 0
