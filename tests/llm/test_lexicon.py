"""Operator 4 against the tokenizers library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from floodlens.llm.common import read, sha256_hex
from floodlens.llm.lexicon import Encoder, Lexicon, Vocabulary, compile_lexicon, count_words, encode
from floodlens.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "   ", "\n\t", "Don't we'll I'VE it'S", "ΑΣ ΣΑΣ Σ", "İstanbul ẞ ﬁ Ǆ", "é e ́x Å", "a b c　d\x85e\x1cf\x0bg", "<|startoftext|>x<|endoftext|>",
       "a<|endoftext|>B <|STARTOFTEXT|> <|endoftext", "12345 ½ ٣ Ⅷ 3rd", "😀👍🏽 z‍w ﻿", "漢字かな交じり文 한국어", "aaaa aaaaaaa ababab", "x" * 3000, "!!! ... ,,,;;; (a)[b]{c}", "\x00\x01\x7f", "ſ K Å"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return Vocabulary(f.read())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_transducer_shares_prefixes_and_suffixes():
    words = [b"", b"a", b"stop", b"stops", b"tap", b"taps", b"top", b"tops"]
    data = compile_lexicon((w, [k, 7 * k]) for k, w in enumerate(words))
    lexicon = Lexicon(data)
    assert [lexicon.find(w) for w in words] == [[k, 7 * k] for k in range(len(words))]
    assert [lexicon.find(w) for w in (b"s", b"to", b"topss", b"x", b"tapt")] == [None] * 5
    assert len(lexicon.first) - 1 == 7  # "", s, st, t, (st|t)o and ta, what ends in p, the end; a trie has 14
    with pytest.raises(ValueError):
        compile_lexicon([(b"b", []), (b"a", [])])
    assert Lexicon(compile_lexicon([])).find(b"a") is None


def test_transducer_random_words():
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"abc\xff") for _ in range(rng.randint(0, 9))) for _ in range(3000)})
    held = {w: [rng.randrange(49_000) for _ in range(rng.randint(0, 5))] for w in words if rng.random() < 0.7}
    lexicon = Lexicon(compile_lexicon(held.items()))
    for w in words:
        assert lexicon.find(w) == held.get(w)
    assert lexicon.find_all(words) == [held.get(w) for w in words] and lexicon.find_all([]) == []


@pytest.mark.parametrize("memory", [1, 1000])
def test_odd_texts(library, vocabulary, memory):
    rng = random.Random(5)
    chars = [chr(c) for c in [*range(32, 127), *range(0xA0, 0x250), *range(0x300, 0x340), *range(0x390, 0x400), 0x1F600, 0x2028, 0x200B, 10, 9]]
    texts = ODD + ["".join(rng.choice(chars) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    encoder = Encoder(vocabulary, Lexicon(compile_lexicon([(b"don", [1])])), memory)  # a wrong id shows that the lexicon is asked
    assert encoder.encode_pieces([b"don", b"don,"])[0] == [1] and encoder.encode_pieces([]) == []
    encoder = Encoder(vocabulary, None, memory)
    for text in texts:
        n, ids = encoder.encode([text.encode(), b"", text.encode()])
        want, decoded = expected(library, text)
        assert ids.tolist() == want * 2 and n.tolist() == [len(want), 0, len(want)], text
        assert encoder.decode(want).decode() == decoded


def test_frame(spark, library, vocabulary):
    rows = [(k, t, "clash") for k, t in enumerate(ODD)] + [(1, None, None), (None, "twice", "x"), (None, "twice", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = encode(docs, PATH, lexicon_share=0.01).collect()
    assert sorted(((r.doc_id, r.text, r.ids, r.decoded) for r in got), key=repr) == sorted(((d, t, *expected(library, t)) for d, t, _ in rows), key=repr)
    assert encode(docs.limit(0), PATH).count() == 0
    counts = {r.word: r["count"] for r in count_words(docs, vocabulary).collect()}
    assert counts["twice"] == 2 and counts["!!!"] == 1


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    want = []
    for r in read(spark, sf, "documents", "doc_id", "text").collect():
        ids, decoded = expected(library, r.text)
        want.append((r.doc_id, len(ids), sha256_hex(" ".join(map(str, ids)).encode()), sha256_hex(decoded.encode())))
    assert sorted(map(tuple, QUERIES["op4_bpe"](spark, sf).collect())) == sorted(want)
