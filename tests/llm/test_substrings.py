"""Operators 5 and 6 against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodlens.llm.common import read, sha256_hex
from floodlens.llm.hashing import PIECE_BYTES
from floodlens.llm.queries import QUERIES
from floodlens.llm.repeats import previous_factors, remove_repeats, suffix_order
from floodlens.llm.windows import remove_repeated_windows

SCHEMA = "doc_id bigint, text string, n_words string, block int"


def brute_bytes(rows, length):
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        if doc is not None:
            for i in range(len(data) - length + 1):
                key = data[i:i + length]
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        if doc is not None:
            for i in range(len(data) - length + 1):
                if first[data[i:i + length]] < doc:
                    gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(data), sum(gone), runs, sha256_hex(bytes(b for b, g in zip(data, gone) if not g))))
    return sorted(out, key=repr)


def brute_words(rows, width):
    first = {}
    split = [(doc, (text or "").encode().split()) for doc, text in rows]
    for doc, words in split:
        if doc is not None:
            for i in range(len(words) - width + 1):
                key = tuple(words[i:i + width])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, words in split:
        gone = [False] * len(words)
        if doc is not None:
            for i in range(len(words) - width + 1):
                if first[tuple(words[i:i + width])] < doc:
                    gone[i:i + width] = [True] * width
        out.append((doc, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out, key=repr)


def fixture(seed=3, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé ñ") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(6)]
    rows = []
    for k in range(n):
        kind = rng.random()
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))
        if kind < 0.3 and rows:
            text = rng.choice(rows)[1] or ""
        if kind < 0.6:
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            text = text[:50] + p[cut:cut + rng.randint(20, 200)] + text[50:]
        if kind > 0.9:
            text = "ab" * rng.randint(0, 90)
        rows.append((rng.choice([k, k, k, rng.randint(0, n)]), text))
    rows += [(5, None), (None, rows[3][1]), (None, rows[3][1]), (7, ""), (n + 1, "x" * 3000 + passages[0] * 5), (n + 2, "x" * 60 + "\n\t " + passages[0])]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return fixture()


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)


@pytest.mark.parametrize("block_bytes,bucket_keys", [(1 << 20, 1 << 20), (1500, 40)])
def test_bytes_against_brute_force(spark, rows, block_bytes, bucket_keys):
    got = remove_repeats(frame(spark, rows), block_bytes=block_bytes, bucket_keys=bucket_keys)
    assert "block" in got.columns and got.columns.count("n_words") == 1
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), sha256_hex(bytes(r.kept))) for r in got.collect()]
    assert sorted(got, key=repr) == brute_bytes(rows, 50)


@pytest.mark.parametrize("length", [2, 7, 33])
def test_other_lengths(spark, rows, length):
    got = remove_repeats(frame(spark, rows[:40]), length=length, block_bytes=800, bucket_keys=30)
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), sha256_hex(bytes(r.kept))) for r in got.collect()]
    assert sorted(got, key=repr) == brute_bytes(rows[:40], length)


@pytest.mark.parametrize("block_bytes,bucket_keys", [(1 << 20, 1 << 20), (1500, 40)])
def test_words_against_brute_force(spark, rows, block_bytes, bucket_keys):
    got = remove_repeated_windows(frame(spark, rows), block_bytes=block_bytes, bucket_keys=bucket_keys)
    assert dict(got.dtypes)["n_words"] == "bigint" and "block" in got.columns
    got = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute_words(rows, 13)
    for r in got:
        assert r.n_removed == sum(b - a for a, b in r.spans)


def test_long_text_is_cut_into_overlapping_pieces(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3 << 20))
    at = 2 * PIECE_BYTES - 20
    rows = [(1, long), (2, "q" * 30 + long[at:at + 70] + "q" * 30), (3, long[:200] + "!" + long[200:400])]
    got = {r.doc_id: (r.n_removed, r.spans) for r in remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_removed", "spans").collect()}
    assert got == {1: (0, []), 2: (70, [[30, 100]]), 3: (400, [[0, 200], [201, 401]])}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert remove_repeats(none).count() == 0
    assert remove_repeated_windows(none).count() == 0


def test_query_over_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in read(spark, sf, "documents", "doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op5_suffix_dedup"](spark, sf).collect()), key=repr)
    assert got == brute_bytes(rows, 50)
    got = QUERIES["op6_window_dedup"](spark, sf)
    want = sorted(((d, n, r, sha256_hex(k.encode())) for d, n, r, k in brute_words(rows, 13)), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert got.where(F.col("n_removed") > 0).count() > 0


def common_prefix(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


@pytest.mark.parametrize("letters", [b"a", b"ab", b"a\0", b"\0", b"abc\xff\0"])
def test_longest_previous_factors(letters):
    """Suffix order, neighbours' common prefixes and factor lengths against all pairs; suffixes of
    one place, empty ones, zero bytes at the end and equal documents among them."""
    rng = random.Random(len(letters))
    for _ in range(60):
        text = bytes(rng.choice(letters) for _ in range(rng.randint(1, 80)))
        start = [rng.randrange(len(text)) for _ in range(rng.randint(0, 40))]
        size = [rng.randint(0, len(text) - k) for k in start]
        document = [rng.randint(0, rng.choice([1, 5, 40])) for _ in start]
        suffixes = [text[k:k + n] for k, n in zip(start, size)]
        arrays = [np.frombuffer(text, np.uint8), *(np.array(x, np.int64) for x in (start, size, document))]
        order, common = suffix_order(*arrays)
        ordered = [suffixes[k] for k in order]
        assert ordered == sorted(suffixes)
        assert common.tolist() == [common_prefix(a, b) for a, b in zip([b"", *ordered], ordered)]
        assert previous_factors(*arrays).tolist() == [
            max([common_prefix(a, b) for b, e in zip(suffixes, document) if e < d], default=0) for a, d in zip(suffixes, document)]
