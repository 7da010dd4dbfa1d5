"""The training-data pipeline over ``documents``: toxic texts go, one of each
group of near copies stays, repeated passages are cut, texts with benchmark
passages go, and what is left is encoded.

Every stage takes (spark, docs, sf_dir); all but the last return the columns
of ``docs``, in their order and whatever their names.  Empty tables give empty
results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.llm import toxicity
from floodlens.llm.common import read
from floodlens.llm.decontaminate import find_contamination
from floodlens.llm.lexicon import encode
from floodlens.llm.minhash import near_duplicates
from floodlens.llm.windows import remove_repeated_windows
from floodlens.session import materialize

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _plain(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with names that clash with no operator's, but for doc_id and
    text, and the columns that undo it."""
    names = [n if n in ("doc_id", "text") else f"column_{k}" for k, n in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(old) for n, old in zip(names, docs.columns)]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the texts that the model of all labelled rows rejects.  Null and
    empty texts have no features; they stay while toxic rows are the fewer."""
    plain, columns = _plain(docs)
    model = toxicity.train(plain, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(plain, model).where(F.col("score") < toxicity.REJECT).select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group linked by five-word
    shingles at 0.8 or more.  Texts without words and rows without an id stay,
    as do rows that repeat an id and a text of the kept document."""
    plain, columns = _plain(docs)
    gone = near_duplicates(plain).where("NOT kept").select(F.col("doc_id").alias("gone_id"), "text_hash").distinct()
    return plain.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.xxhash64("text") == F.col("text_hash")), "left_anti").select(*columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word windows that a document of smaller id
    has too; ``n_chars``, where there is one, follows.  Texts that lose nothing
    are unchanged, and a text that loses all is empty."""
    plain, columns = _plain(docs)
    cut = F.col("n_removed") > 0
    out = remove_repeated_windows(plain).withColumn("text", F.when(cut, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        name, kind = plain.columns[docs.columns.index("n_chars")], docs.schema["n_chars"].dataType
        out = out.withColumn(name, F.when(cut, F.length("text").cast(kind)).otherwise(F.col(name)))
    return out.select(*columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the texts that hold a 10-word window of a benchmark item."""
    plain, columns = _plain(docs)
    return find_contamination(plain, read(spark, sf_dir, "benchmark", "item_id", "text")).where("NOT contaminated").select(*columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every text; null texts have no ids."""
    return encode(docs.select("doc_id", "text"), TOKENIZER, carry=["doc_id"]).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("substring_dedup", cut_repeats),
          ("decontamination", drop_contaminated), ("bpe", encode_texts)]

#: toxicity is a trained model, which SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``, each written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
