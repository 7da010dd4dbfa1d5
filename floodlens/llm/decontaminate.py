"""Operator 7, benchmark decontamination.

The test items' word windows form one Aho-Corasick automaton over word
numbers.  Each text is normalised byte for byte (so offsets in the normalised
text are offsets in the original), read once as a sequence of word numbers and
run through the automaton; hits are mapped back to words and byte spans.
"""

from __future__ import annotations

import re
import uuid
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import any_names, text_bytes

#: words are runs of these bytes: ASCII digits, letters (A-Z lower-cased) and every byte of a non-ASCII character
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
#: UTF-8 bytes of test items held by one automaton; a larger benchmark is split over several passes
AUTOMATON_BYTES = 1 << 20

_built: dict[str, WindowAutomaton] = {}


class WindowAutomaton:
    """Aho-Corasick over the word windows of test items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            words = text.translate(NORMAL).split()
            seq = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            for i in range(max(1, len(seq) - window + 1) if seq else 0):
                owners.setdefault(tuple(seq[i:i + window]), set()).add(item_id)
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, ids in owners.items():
            self.trie.add_word(key, (len(key), tuple(sorted(ids))))
        self.empty = not owners
        if owners:
            self.trie.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word intervals [first, last) of all occurring windows, merged, and the items hit."""
        if self.empty or not words:
            return [], set()
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for last, (n, ids) in self.trie.iter(tuple(map(self.numbers.get, words, repeat(0)))):
            first = last - n + 1
            items.update(ids)
            while spans and spans[-1][1] >= first:
                first = min(first, spans.pop()[0])
            spans.append((first, last + 1))
        return spans, items


class _Handle:
    """A broadcast list of items and a key, so that a reused worker builds the automaton once."""

    def __init__(self, broadcast, key: str, window: int):
        self.broadcast, self.key, self.window = broadcast, key, window

    def automaton(self) -> WindowAutomaton:
        if self.key not in _built:
            _built.clear()
            _built[self.key] = WindowAutomaton(self.broadcast.value, self.window)
        return _built[self.key]


def _union(spans: list[list[int]]) -> list[list[int]]:
    """Maximal runs of spans [first word, end word, first byte, end byte] that overlap or touch."""
    out: list[list[int]] = []
    for span in sorted(spans):
        if out and span[0] <= out[-1][1]:
            if span[1] > out[-1][1]:
                out[-1][1], out[-1][3] = span[1], span[3]
        else:
            out.append(list(span))
    return out


def _scanner(handle: _Handle, out: pa.Schema):
    def run(batches):
        automaton = handle.automaton()
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            n_words, item_lists, byte_spans = [], [], []
            for text, had_spans, had_items in zip(text_bytes(cols["_text"]), cols["_spans"].to_pylist(), cols["_items"].to_pylist(), strict=True):
                plain = text.translate(NORMAL)
                words = plain.split()
                spans, items = automaton.scan(words)
                if spans:
                    at = np.array([m.span() for m in WORD.finditer(plain)])
                    had_spans = _union(had_spans + [[a, b, int(at[a, 0]), int(at[b - 1, 1])] for a, b in spans])
                n_words.append(len(words))
                byte_spans.append([list(s) for s in had_spans])
                item_lists.append(sorted({*had_items, *items}))
            cols |= {"_n_words": pa.array(n_words, pa.int64()), "_items": pa.array(item_lists, pa.list_(pa.string())),
                     "_spans": pa.array(byte_spans, pa.list_(pa.list_(pa.int64())))}
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in out], schema=out)
    return run


@any_names
def find_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                       window: int = 10, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``docs`` with added columns: ``n_words``, ``n_hit`` (words inside an
    occurring window), ``items`` (sorted ids, as text, of items with occurring
    windows), ``spans`` (maximal hit runs as [first word, end word, first byte,
    end byte] of the original UTF-8 text) and ``contaminated``.

    A window is ``window`` consecutive words of an item; an item of fewer words
    is one window, an item of none has none.  Null texts have no words; null
    item ids are the text ``null``.  Columns of ``docs`` with these names are
    replaced; repeated rows are judged each.  Items of over ``automaton_bytes``
    are dealt over several automata, each bounded, whose hits add up.
    """
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("null")).alias("id"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // automaton_bytes))
    added = ("n_words", "n_hit", "items", "spans", "contaminated")
    keep = [c for c in docs.columns if c not in added]
    work = docs.select(*keep, F.col(text_col).alias("_text"), F.lit(0).cast("long").alias("_n_words"),
                       F.lit(None).cast("array<string>").alias("_items"), F.lit(None).cast("array<array<bigint>>").alias("_spans"))
    work = work.withColumns({"_items": F.coalesce("_items", F.array().cast("array<string>")), "_spans": F.coalesce("_spans", F.array().cast("array<array<bigint>>"))})
    out = to_arrow_schema(work.schema)
    for k in range(shards):
        part = items if shards == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == k)
        listed = [(r.id, r.text.encode()) for r in part.toLocalIterator()]
        handle = _Handle(spark.sparkContext.broadcast(listed), uuid.uuid4().hex, window)
        work = work.mapInArrow(_scanner(handle, out), work.schema)
    hit = F.expr("aggregate(_spans, 0L, (n, s) -> n + s[1] - s[0])")
    return work.select(*keep, F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.col("_items").alias("items"),
                       F.col("_spans").alias("spans"), (F.size("_spans") > 0).alias("contaminated"))
