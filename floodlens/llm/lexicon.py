"""Operator 4, BPE encoding and decoding with a transducer lexicon.

The frequent words of the corpus, counted in Spark, are compiled with their
token ids into a minimal acyclic transducer: words share prefixes and suffixes,
arcs add up to a word's number, and the number has the ids.  Tasks memory-map
the automaton; words it doesn't hold are merged exactly by the vocabulary's
merge ranks.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import any_names, give_back, text_bytes
from .hashing import batches as text_batches
from .token_counts import TransitionTable

#: the least share of all words of one in the lexicon (so it has at most 1 / LEXICON_SHARE), and pieces of text between spaces that a worker remembers
LEXICON_SHARE, MEMORY_PIECES = 2e-6, 400_000
#: texts are encoded in runs of about this many bytes
RUN_BYTES = 4 << 20


class PairTable:
    """Numbers of pairs of token ids, in hash tables: what collides in one stands in the next."""

    SLOTS = 20

    def __init__(self, first: np.ndarray, second: np.ndarray):
        keys, numbers = first << 32 | second, np.arange(len(first))
        self.missing, self.tables = len(first), []
        while len(keys):
            factor = np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * len(self.tables) & 0xFFFFFFFFFFFFFFFF)
            slot = self._slot(keys, factor)
            held, number = np.full(1 << self.SLOTS, -1), np.zeros(1 << self.SLOTS, np.int32)
            held[slot], number[slot] = keys, numbers
            self.tables.append((factor, held, number))
            left = held[slot] != keys
            keys, numbers = keys[left], numbers[left]

    def _slot(self, keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return (keys.astype(np.uint64) * factor >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys, out = first << 32 | second, np.full(len(first), self.missing)
        for factor, held, number in self.tables:
            slot = self._slot(keys, factor)
            hit = held[slot] == keys
            out[hit] = number[slot[hit]]
        return out


class Vocabulary:
    """A byte-level BPE vocabulary with word ends: its tokens, merges, splitting and special tokens.

    Read from the JSON of a tokenizer file whose normaliser is NFC, white space
    and lower case, and whose pre-tokeniser keeps the matches of one pattern."""

    def __init__(self, text: str):
        data = json.loads(text)
        model = data["model"]
        kinds = [n["type"] for n in data["normalizer"]["normalizers"]]
        split, level = data["pre_tokenizer"]["pretokenizers"]
        if (kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or data["decoder"] or data["post_processor"]
                or (split["type"], split["behavior"], split["invert"], level["type"]) != ("Split", "Removed", True, "ByteLevel")):
            raise ValueError("this tokenizer file has steps that are not known here")
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = np.array([self.ids[a + b] for a, b in merges], np.int64)  # by rank
        self.rank = PairTable(np.array([self.ids[a] for a, _ in merges], np.int64), np.array([self.ids[b] for _, b in merges], np.int64))
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        other = [b for b in range(256) if b not in set(plain)]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}
        self.inner = np.array([self.ids[letters[b]] for b in range(256)])
        self.last = np.array([self.ids[letters[b] + self.end] for b in range(256)])

    def words(self, piece: bytes) -> list[str | int]:
        """The normalised words of a piece of text, and special tokens as ids."""
        text = piece.decode()
        if piece.isalpha():  # ASCII letters only
            return [text.lower()]
        if piece[:-1].isalpha() and text[-1] in ".,":
            return [text[:-1].lower(), text[-1]]
        if self.specials and "<" in text:
            return [w for k, part in enumerate(self.specials.split(text)) for w in ([self.special[part]] if k % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case goes by single characters
                return self.pattern.findall("".join(map(str.lower, text)))
            lower = text.lower()
            return [lower] if lower.isalpha() else self.pattern.findall(lower)
        return self.pattern.findall(text.lower())

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of words in UTF-8, none empty, by merges of the lowest rank
        first, from the left.  All words go through each round together."""
        out: list[list[int]] = [[]] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        part, word = self.inner[data], np.repeat(np.arange(len(words)), size)
        if len(part):
            part[np.cumsum(size) - 1] = self.last[data[np.cumsum(size) - 1]]
        none = len(self.made)
        while len(part):
            rank = np.full(len(part), none)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self.rank.find(part[inside], part[inside + 1])
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, head)
            length = np.diff(np.append(head, len(part)))
            done = least == none
            ends = np.repeat(done, length)
            ids = part[ends].tolist()
            at = 0
            for w, n in zip(word[head[done]].tolist(), length[done].tolist()):
                out[w] = ids[at:at + n]
                at += n
            hit = np.flatnonzero((rank == np.repeat(least, length)) & ~ends)
            # of pairs that overlap (aaa), every second one counts from the left
            run = np.maximum.accumulate(np.where(np.concatenate([[True], hit[1:] != hit[:-1] + 1]), np.arange(len(hit)), 0)) if len(hit) else hit
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            part[hit] = self.made[rank[hit]]
            keep = ~ends
            keep[hit + 1] = False
            part, word = part[keep], word[keep]
        return out


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """A minimal acyclic transducer of sorted, distinct words, as flat arrays.

    States with equal right languages are one: the states of the word before
    are frozen, from its end, once the next word leaves them.  An arc carries
    the number of words before it in its state, so that the arcs of a word add
    up to its number, at which its ids are found."""
    frozen: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((label, target), ...)) with targets numbered
    count: list[int] = []  # words accepted from each state

    def freeze(final: bool, arcs: list) -> int:
        key = (final, tuple(arcs))
        if key not in frozen:
            frozen[key] = len(states)
            states.append(key)
            count.append(final + sum(count[t] for _, t in arcs))
        return frozen[key]

    path: list[list] = [[False, [], 0]]  # final, frozen arcs, label that led here
    last, ids, ends = b"", [], [0]
    for word, tokens in entries:
        if word <= last and ends != [0]:
            raise ValueError("words must be sorted and distinct")
        shared = len(os.path.commonprefix([word, last]))
        while len(path) > shared + 1:
            final, arcs, label = path.pop()
            path[-1][1].append((label, freeze(final, arcs)))
        path.extend([False, [], b] for b in word[shared:])
        path[-1][0] = True
        last = word
        ids.extend(tokens)
        ends.append(len(ids))
    while len(path) > 1:
        final, arcs, label = path.pop()
        path[-1][1].append((label, freeze(final, arcs)))
    root = freeze(path[0][0], path[0][1])
    labels, target, before, first, finals = bytearray(), [], [], [0], bytearray()
    for final, arcs in states:
        n = int(final)
        for label, t in arcs:
            labels.append(label)
            target.append(t)
            before.append(n)
            n += count[t]
        first.append(len(labels))
        finals.append(final)
    arrays = [np.array(x, np.int32) for x in (target, before, first, ends, ids)]
    head = np.array([root, *map(len, arrays), len(labels), len(finals)], np.int32)
    return head.tobytes() + b"".join(a.tobytes() for a in arrays) + bytes(labels) + bytes(finals)


class Lexicon:
    """A compiled lexicon, memory-mapped from a file that is unlinked at once."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        numbers = memoryview(self.map)[:(len(self.map) // 4) * 4].cast("i")
        self.root, *sizes, n_labels, _ = numbers[:8].tolist()
        at, views = 8, []
        for n in sizes:
            views.append(numbers[at:at + n])
            at += n
        self.target, self.before, self.first, self.ends, self.ids = views
        self.arcs: TransitionTable | None = None
        self.labels = 4 * at
        self.finals = self.labels + n_labels

    def find_all(self, words: list[bytes]) -> list[list[int] | None]:
        """``find`` of many words: they go through the automaton together, a byte a
        step, and those that have no arc for theirs drop out."""
        if not words:
            return []
        if self.arcs is None:
            self.arcs = TransitionTable(18)
            first = np.frombuffer(self.first, np.int32).astype(np.int64)
            state = np.repeat(np.arange(len(first) - 1), np.diff(first))
            label = np.frombuffer(self.map, np.uint8, len(state), self.labels)
            self.arcs.add(state << 8 | label, np.arange(len(state)))
        target, before, ends = (np.frombuffer(x, np.int32) for x in (self.target, self.before, self.ends))
        final = np.frombuffer(self.map, np.uint8, offset=self.finals)
        size = np.fromiter(map(len, words), np.int64, len(words))
        data, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        on, held = np.arange(len(words)), np.zeros(len(words), bool)
        step = 0
        while len(on):
            done = size[on] == step
            held[on[done]] = final[state[on[done]]] > 0
            on = on[~done]
            arc = self.arcs.find(state[on] << 8 | data[start[on] + step])
            on, arc = on[arc >= 0], arc[arc >= 0]
            number[on] += before[arc]
            state[on] = target[arc]
            step += 1
        out: list[list[int] | None] = [None] * len(words)
        some = np.flatnonzero(held)
        for k, i, j in zip(some.tolist(), ends[number[some]].tolist(), ends[number[some] + 1].tolist()):
            out[k] = self.ids[i:j].tolist()
        return out

    def find(self, word: bytes) -> list[int] | None:
        """The ids of a word, or None if the lexicon doesn't hold it."""
        state, number, find, base = self.root, 0, self.map.find, self.labels
        for k in range(len(word)):
            at = find(word[k:k + 1], base + self.first[state], base + self.first[state + 1])
            if at < 0:
                return None
            number += self.before[at - base]
            state = self.target[at - base]
        return self.ids[self.ends[number]:self.ends[number + 1]].tolist() if self.map[self.finals + state] else None


class Encoder:
    """Encodes and decodes texts.  It remembers the ids of the first ``memory``
    pieces between spaces that it meets (most frequent ones are among them);
    others are encoded once a run of texts."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None, memory: int = MEMORY_PIECES):
        self.vocabulary, self.lexicon, self.memory = vocabulary, lexicon, memory
        self.code: dict[bytes, int] = {}
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)  # of the remembered pieces, by code
        self.token = [vocabulary.tokens[i].encode() if i in vocabulary.tokens else b"" for i in range(max(vocabulary.tokens) + 1)]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of pieces: their words are looked up among the remembered
        pieces and in the lexicon, and what neither holds is merged."""
        out: list[list[int] | None] = [None] * len(pieces)
        find_all = self.lexicon.find_all if self.lexicon else lambda words: [None] * len(words)
        unseen: dict[bytes, list[int]] = {}  # places that hold the word alone
        mixed, found, alone = [], {}, []
        for k, piece in enumerate(pieces):
            if piece.isalpha() and piece.islower():  # one word, as it stands
                alone.append(k)
            else:
                mixed.append((k, self.vocabulary.words(piece)))
        for k, ids in zip(alone, find_all([pieces[k] for k in alone])):
            out[k] = ids
            if ids is None:
                unseen.setdefault(pieces[k], []).append(k)
        ask: list[str] = []
        for word in set(chain.from_iterable(words for _, words in mixed)):
            if isinstance(word, int):
                found[word] = [word]
                continue
            at = self.code.get(word.encode())  # a word by itself is a piece
            if at is None:
                ask.append(word)
            else:
                found[word] = self.ids[self.start[at]:self.start[at + 1]].tolist()
        asked = [word.encode() for word in ask]
        for word, data, ids in zip(ask, asked, find_all(asked)):
            if ids is None:
                unseen.setdefault(data, [])
            else:
                found[word] = ids
        for (word, places), ids in zip(unseen.items(), self.vocabulary.merge(list(unseen))):
            for k in places:
                out[k] = ids
            found[word.decode()] = ids
        for k, words in mixed:
            out[k] = found[words[0]] if len(words) == 1 else [i for w in words for i in found[w]]
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        """Tokens joined by a space, as a tokenizer without a decoder does, in UTF-8."""
        return b" ".join(map(self.token.__getitem__, ids))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids in turn)."""
        split = [t.split() for t in texts]
        new = list(set().union(*split).difference(self.code))
        fresh = self.encode_pieces(new)
        kept = len(self.start) - 1
        self.code.update(zip(new, range(kept, kept + len(new))))
        start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh)))])
        ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(fresh), np.int32)])
        words = np.cumsum([0, *map(len, split)])
        place = np.fromiter(map(self.code.__getitem__, chain.from_iterable(split)), np.int64, words[-1])
        n = start[place + 1] - start[place]
        ends = np.concatenate([[0], np.cumsum(n)])
        where = np.repeat(start[place] - ends[:-1], n) + np.arange(ends[-1])
        keep = max(0, min(len(new), self.memory - kept))
        for piece in new[keep:]:
            del self.code[piece]
        self.start, self.ids = start[:kept + keep + 1], ids[:start[kept + keep]]
        return np.diff(ends[words]), ids[where]


_encoders: dict[str, Encoder] = {}


def _runs(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of batches of about ``RUN_BYTES`` of text, and their texts."""
    for batch in batches:
        texts = text_bytes(batch.column(text_col))
        for first, end in text_batches(texts, RUN_BYTES):
            yield batch.slice(first, end - first), texts[first:end]


def count_words(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """(word, count) of the normalised words of all texts; counts add up within a task first."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        pieces: Counter = Counter()

        def out():
            words: Counter = Counter()
            for piece, n in pieces.items():
                for w in shared.value.words(piece):
                    if not isinstance(w, int):
                        words[w] += n
            pieces.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(list(words), pa.string()), "count": pa.array(list(words.values()), pa.int64())})
        for batch in batches:
            for text in batch.column(text_col).to_pylist():
                pieces.update((text or "").encode().split())
                if len(pieces) > MEMORY_PIECES:
                    yield out()
        yield out()
        give_back()
    return docs.select(text_col).mapInArrow(count, "word string, count bigint").groupBy("word").agg(F.sum("count").alias("count"))


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", share: float = LEXICON_SHARE) -> bytes:
    """The compiled lexicon of the words that make up ``share`` or more of all words."""
    counts = materialize(count_words(docs, vocabulary, text_col), "piece-words")
    total = counts.agg(F.sum("count")).first()[0] or 0
    words = sorted(r.word.encode() for r in counts.where(F.col("count") >= share * total).select("word").collect())
    return compile_lexicon(zip(words, vocabulary.merge(words)))


@any_names
def encode(docs: DataFrame, vocabulary_path: str, text_col: str = "text", carry: list[str] | None = None, lexicon_share: float = LEXICON_SHARE) -> DataFrame:
    """The ``carry`` columns of ``docs`` (all by default) with ``ids`` (token
    ids, without added special tokens; special tokens in a text are encoded as
    such) and ``decoded`` (the ids' tokens, special ones too, joined by spaces).

    ``vocabulary_path`` is read on the driver and sent to the tasks, as is the
    lexicon of at most ``1 / lexicon_share`` words.  Null and empty texts have no
    ids; columns of ``docs`` with the added names are replaced."""
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = Vocabulary(f.read())
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("ids", "decoded")]
    shared = spark.sparkContext.broadcast((vocabulary, build_lexicon(docs, vocabulary, text_col, lexicon_share)))
    key = uuid.uuid4().hex

    def run(batches):
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(shared.value[0], Lexicon(shared.value[1]))
        encoder = _encoders[key]
        for part, texts in _runs(batches, text_col):
            give_back()
            n, ids = encoder.encode(texts)
            ends = np.concatenate([[0], np.cumsum(n)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            decoded = pa.array([encoder.decode(ids[i:j].tolist()) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), lists, decoded], [*carry, "ids", "decoded"])
    out = docs.select(*carry, F.array().cast("array<int>").alias("ids"), F.lit("").alias("decoded")).schema
    return docs.select(*dict.fromkeys([*carry, text_col])).mapInArrow(run, out)
