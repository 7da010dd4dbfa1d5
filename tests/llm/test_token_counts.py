"""Operator 13 against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from floodlens.llm import token_counts
from floodlens.llm.common import read
from floodlens.llm.queries import QUERIES
from floodlens.llm.token_counts import CHUNK, SplitTransducer, TokenCounter, TransitionTable, count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ODD = ["", "  \n", "Don't we'll I'VE it'S o'r o'rx ''s '", "ΑΣ ΣΑΣ Σ", "İstanbul ẞ ﬁ Ǆ", "é e ́x Å", "a b c　d\x85e\x1cf\x0bg", "<|startoftext|>x<|endoftext|>",
       "a<|endoftext|>B <|STARTOFTEXT|> <|endoftext <|", "12345 ½ ٣ Ⅷ 3rd", "😀👍🏽 z‍w ﻿", "漢字かな交じり文 한국어", "aaaa aaaaaaa ababab", "x" * 3000, "漢字" * 900, "!!! ...'s,;;; (a)[b]{c}", "\x00\x01\x7f", "ſ K Å"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as f:
        return TokenCounter(f.read())


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def random_texts(rng, n):
    letters = ["ab", "aeinrst", "'srtvmeldx !", "!?.,'\"<|>/w", "éñüΣσİſKÅ é́", "漢字かな한국어ab", "0123 ab'", ["th", "in", "er", " "], " \n\t\x85\x1c　a"]
    return ["".join(rng.choice(kind) for _ in range(rng.choice([1, 3, 8, 20, 70, 300]))) for kind in (rng.choice(letters) for _ in range(n))]


def test_odd_and_random_texts(library, counter):
    texts = ODD + random_texts(random.Random(3), 4000)
    assert counter.count([t.encode() for t in texts]).tolist() == expected(library, texts)
    assert counter.count([]).tolist() == []


def test_states_are_made_again_after_they_are_forgotten(library, counter, monkeypatch):
    monkeypatch.setattr(token_counts, "TRANSITIONS", 50)
    rng = random.Random(4)
    for _ in range(4):
        texts = random_texts(rng, 300)
        assert counter.count([t.encode() for t in texts]).tolist() == expected(library, texts)


def test_state_maps_compose():
    """Chunks scanned side by side mark the words that the pattern finds in one go."""
    split, rng = SplitTransducer(PATTERN), random.Random(5)
    for size in (1, CHUNK - 1, CHUNK, CHUNK + 1, 9 * CHUNK + 5):
        text = "".join(rng.choice("abrsltvemd''''!!1 é") for _ in range(size)) + " "
        classes = split.classes[np.array([ord(c) for c in text])]
        assert np.flatnonzero(split.marks(classes)).tolist() == [m.start() for m in regex.finditer(PATTERN, text)]
        state = SplitTransducer.SPACE
        padded = np.concatenate([classes, np.zeros(-len(classes) % CHUNK, np.uint8)])
        states = split.scan(split.state_maps(padded.reshape(-1, CHUNK).T.copy()))
        for k, c in enumerate(padded):
            if k % CHUNK == 0:
                assert states[k // CHUNK] == state
            state = int(split.after[state * split.width + c])


def test_a_words_transitions_add_up_to_its_tokens(library, counter):
    for word in ("unbelievable", "aaaaaaaaaaaaa", "internationalisation", "zzzq", "a"):
        assert counter.pairs.word(word.encode()) == expected(library, [word])[0]


def test_transition_table_holds_what_collides():
    table, rng = TransitionTable(slots=6), np.random.default_rng(1)
    keys = rng.choice(1 << 40, 60_000, replace=False)
    for part in np.array_split(keys, 7):
        table.add(part, part % 1000)
    assert (table.find(keys) == keys % 1000).all()
    assert (table.find(keys + (1 << 41)) == -1).all()


def test_rows_and_names(spark, library):
    rows = [(None, "the cat", 1, 5), (2, None, 2, 6), (2, "", 3, 7), (2, "the cat", 4, 8), (2, "the cat", 4, 8)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, n_tokens int, `a.b` int")
    out = count_tokens(docs, PATH)
    assert out.columns == ["doc_id", "text", "a.b", "n_bytes", "n_tokens"]
    assert sorted((r["a.b"], r.n_bytes, r.n_tokens) for r in out.collect()) == [(5, 7, 2), (6, 0, 0), (7, 0, 0), (8, 7, 2), (8, 7, 2)]
    assert count_tokens(docs.limit(0), PATH).count() == 0
    clash = docs.select("doc_id", "text", docs["n_tokens"].alias("carried_1"))
    assert count_tokens(clash, PATH).columns == ["doc_id", "text", "carried_1", "n_bytes", "n_tokens"]


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in QUERIES["op13_token_counts"](spark, sf).collect()}
    docs = read(spark, sf, "documents", "doc_id", "text").collect()
    for r, n in zip(docs, expected(library, [r.text for r in docs])):
        assert (out[r.doc_id].n_tokens, out[r.doc_id].n_bytes, out[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 2048)
