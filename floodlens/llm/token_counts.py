"""Operator 13, token counts by a tokenizer compiled to finite-state transducers.

Two deterministic transducers in a row count what the tokenizer would emit,
without making a token:

* The *split* transducer reads classes of characters and marks where words
  begin.  It has a handful of states, so a run of texts is cut into chunks that
  go through it side by side: a chunk's state map (the state after it, for
  every state before it) is composed with those of the chunks before it by a
  parallel prefix scan, which gives the state that each chunk really starts in.
* The *pair* transducer reads the bytes of a word (its last byte is a symbol of
  its own) and every transition carries the number of tokens by which it changes
  the count of the prefix read so far, so that a word's transitions add up to its
  tokens.  A pair encoding of a prefix ends in one token only, the token at the
  prefix's end that may follow the last token of what is left of it.  A state
  therefore is the longest suffix that begins a vocabulary token, with the last
  token and the relative count at the places where such a token may begin.  The
  states that the vocabulary's own tokens reach are compiled beforehand and
  broadcast; further ones are made where a text first needs them.  Words go
  through the table of transitions together, a byte a step.

Nothing is cut off: whole texts are read, and words of any length.  Null and
empty texts have no tokens; bytes that are no UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections import deque

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import any_names, text_bytes
from .hashing import batches as text_batches

#: texts are read in runs of about this many bytes, cut into chunks of so many characters
RUN_BYTES, CHUNK = 2 << 20, 256
#: words of more bytes go through the transitions one by one
TOGETHER = 64
#: a worker forgets the transitions that it made itself when it has so many
TRANSITIONS = 1_500_000
#: symbols: a byte inside a word, and 256 more for the last byte of one
SYMBOLS, START = 512, 0
_NONE = 1 << 30


class SplitTransducer:
    """Marks the first character of each word of ``literal|...|[runs]+|[single]|[^rest]+``.

    The literals share their first character, which is of the rest, and go on
    with one or two letters.  An output bit 1 means that a word begins at the
    character read, bit 2 that one began at the character before."""

    SPACE, LETTER, DIGIT, OTHER, CLOSED = range(5)

    def __init__(self, pattern: str):
        *literals, letters, digits, others = pattern.split("|")
        if (letters, digits, others) != (r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+") or len({x[0] for x in literals}) > 1 or any(
                not 2 <= len(x) <= 3 or not x[1:].isalpha() or x[0].isalnum() or x[0].isspace() for x in literals):
            raise ValueError("this splitting pattern is not known here")
        prefixes = sorted({x[:k] for x in literals for k in range(1, len(x))}, key=lambda p: (len(p), p))
        state = {p: 5 + k for k, p in enumerate(prefixes)} | dict.fromkeys(literals, self.CLOSED)
        marked = sorted({c for x in literals for c in x})
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.classes = np.full(0x110000, self.OTHER, np.uint8)
        for kind, found in ((self.LETTER, r"\p{L}+"), (self.DIGIT, r"\p{N}+"), (self.SPACE, r"\s+")):
            for m in regex.finditer(found, every):
                low, high = ord(every[m.start()]), ord(every[m.end() - 1])
                self.classes[low:high + 1] = kind
        self.classes[0xD800:0xE000] = self.OTHER
        for k, c in enumerate(marked):
            self.classes[ord(c)] = 4 + k
        kinds = [(self.SPACE, ""), (self.LETTER, ""), (self.DIGIT, ""), (self.OTHER, "")] + [(self.LETTER if c.isalpha() else self.OTHER, c) for c in marked]

        def begin(kind: int, c: str) -> tuple[int, int]:
            return (state[c] if c in state else kind), int(kind != self.SPACE)

        def move(prefix: str, at: int, kind: int, c: str) -> tuple[int, int]:
            if prefix:
                if c and prefix + c in state:
                    return state[prefix + c], 0
                if len(prefix) == 2:  # no literal: its letter began a word
                    after, mark = move("", self.LETTER, kind, c)
                    return after, mark | 2
                return move("", self.OTHER, kind, c)
            return (at, 0) if at == kind and at in (self.LETTER, self.OTHER) else begin(kind, c)
        names = [("", s) for s in range(5)] + [(p, state[p]) for p in prefixes]
        table = np.array([[move(p, s, kind, c) for kind, c in kinds] for p, s in names])
        self.width = len(kinds)
        self.after = np.ascontiguousarray(table[:, :, 0].ravel().astype(np.uint8))
        self.mark = np.ascontiguousarray(table[:, :, 1].ravel().astype(np.uint8))
        self.states = len(names)

    def state_maps(self, chunks: np.ndarray) -> np.ndarray:
        """The state after each chunk (a column of ``chunks``) for each state before it."""
        maps = np.repeat(np.arange(self.states, dtype=np.int32)[:, None], chunks.shape[1], 1)
        for k, classes in enumerate(chunks):
            if k % 8 == 0 and len(maps) > 1 and (maps == maps[:1]).all():
                maps = maps[:1]  # the state no longer depends on the one before
            maps = self.after[maps * self.width + classes].astype(np.int32)
        return np.broadcast_to(maps, (self.states, chunks.shape[1]))

    @staticmethod
    def scan(maps: np.ndarray) -> np.ndarray:
        """The state before each chunk, from the start: map composition is
        associative, so all prefixes come from log2(chunks) rounds."""
        maps, step = maps.copy(), 1
        while step < maps.shape[1]:
            later = np.take_along_axis(maps[:, step:], maps[:, :-step], 0)
            maps = np.concatenate([maps[:, :step], later], 1)
            step *= 2
        return np.concatenate([[SplitTransducer.SPACE], maps[SplitTransducer.SPACE, :-1]]).astype(np.int32)

    def marks(self, classes: np.ndarray) -> np.ndarray:
        """Whether a word begins at each character; the last one is a space."""
        n = len(classes)
        chunks = np.zeros((-(-n // CHUNK), CHUNK), np.uint8)
        chunks.ravel()[:n] = classes
        chunks = np.ascontiguousarray(chunks.T)
        state, out = self.scan(self.state_maps(chunks)), np.empty_like(chunks)
        for k, row in enumerate(chunks):
            at = state * self.width + row
            out[k] = self.mark[at]
            state = self.after[at].astype(np.int32)
        out = out.T.ravel()[:n]
        marks = (out & 1).astype(bool)
        marks[:-1] |= (out[1:] & 2).astype(bool)
        return marks


class TransitionTable:
    """A growing map of numbers to numbers in hash tables; what collides in one stands in the next."""

    def __init__(self, slots: int = 22):
        self.slots, self.tables = slots, []

    def _table(self, k: int) -> tuple:
        if k == len(self.tables):
            slots = max(14, self.slots - 2 * k)
            factor = np.uint64((0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * k) & 0xFFFFFFFFFFFFFFFF)
            self.tables.append((factor, np.uint64(64 - slots), np.full(1 << slots, -1, np.int64), np.zeros(1 << slots, np.int64)))
        return self.tables[k]

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Of keys that are distinct and new."""
        k = 0
        while len(keys):
            factor, shift, held, value = self._table(k)
            slot = (keys.astype(np.uint64) * factor >> shift).astype(np.int64)
            free = held[slot] < 0
            held[slot[free]], value[slot[free]] = keys[free], values[free]
            left = held[slot] != keys
            keys, values, k = keys[left], values[left], k + 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1 where a key isn't held."""
        out = np.full(len(keys), -1, np.int64)
        left = None
        for factor, shift, held, value in self.tables:
            ask = keys if left is None else keys[left]
            slot = (ask.astype(np.uint64) * factor >> shift).astype(np.int64)
            hit = held[slot] == ask
            if left is None:
                out = np.where(hit, value[slot], -1)
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] = value[slot[hit]]
                left = left[~hit]
            if not len(left):
                break
        return out


class PairModel:
    """Merges of a byte-pair vocabulary, and the automaton of its tokens' symbols."""

    def __init__(self, data: dict):
        model, ids = data["model"], data["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        other = iter(range(256, 512))
        letter = [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]
        n = max(ids.values()) + 1
        self.left, self.right, self.born = [-1] * n, [-1] * n, [-1] * n
        self.rank: dict[int, int] = {}
        symbols: dict[int, tuple] = {}
        for b in range(256):
            symbols[ids[letter[b]]] = (b,)
            symbols[ids[letter[b] + model["end_of_word_suffix"]]] = (b + 256,)
        for r, (a, b) in enumerate(merges):
            a, b, t = ids[a], ids[b], ids[a + b]
            if t in symbols or a not in symbols or b not in symbols:
                raise ValueError("a merge of this vocabulary comes before its parts, or twice")
            self.left[t], self.right[t], self.born[t] = a, b, r
            self.rank[a << 20 | b] = r
            symbols[t] = symbols[a] + symbols[b]
        whole: set[int] = set()  # tokens that their own text is encoded as
        for t in symbols:
            a, b = self.left[t], self.right[t]
            if a < 0 or (a in whole and b in whole and self.first_merge(a, b) == (a, b)):
                whole.add(t)
        self.symbols = {t: s for t, s in symbols.items() if t in whole}
        # Aho-Corasick automaton of the tokens
        self.go: dict[int, int] = {}
        self.token, depth = [-1], [0]
        for t, s in self.symbols.items():
            node = 0
            for c in s:
                key = node << 9 | c
                if key not in self.go:
                    self.go[key] = len(self.token)
                    self.token.append(-1)
                    depth.append(depth[node] + 1)
                node = self.go[key]
            self.token[node] = t
        self.fail = [0] * len(self.token)
        self.depth = depth
        children: dict[int, list] = {}
        for key, node in self.go.items():
            children.setdefault(key >> 9, []).append((key & 511, node))
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for c, child in children.get(node, ()):
                queue.append(child)
                if node:
                    self.fail[child] = self.after(self.fail[node], c)

    def after(self, node: int, c: int) -> int:
        """The longest suffix that begins a token, once ``c`` is read."""
        go = self.go
        while True:
            to = go.get(node << 9 | c)
            if to is not None:
                return to
            if not node:
                return 0
            node = self.fail[node]

    def first_merge(self, a: int, b: int) -> tuple[int, int] | None:
        """The first merge over the border of tokens ``a`` and ``b`` when their
        texts are encoded as one, or None if both tokens stay.

        Left of the border stands what ``a`` has at its end so far, right of it
        what ``b`` has at its start; each is replaced when its next merge is due."""
        ends, starts = [a], [b]
        while self.born[ends[-1]] >= 0:
            ends.append(self.right[ends[-1]])
        while self.born[starts[-1]] >= 0:
            starts.append(self.left[starts[-1]])
        i, j = len(ends) - 1, len(starts) - 1
        while True:
            due_left = self.born[ends[i - 1]] if i else _NONE
            due_right = self.born[starts[j - 1]] if j else _NONE
            r = self.rank.get(ends[i] << 20 | starts[j], _NONE)
            if r < due_left and r <= due_right:  # of equal pairs the left one is merged
                return (ends[i], starts[j]) if r < _NONE else None
            if due_left <= due_right:
                if not i:
                    return None
                i -= 1
            else:
                j -= 1


class PairTransducer:
    """Counts the tokens of words; its states are made as they are reached.

    A state is (automaton node, last tokens, relative counts), the latter two at
    the places that the node's chain of suffixes names, longest first."""

    def __init__(self, model: PairModel):
        self.model = model
        self.chain: dict[int, tuple] = {}  # of a node: (depth, token) of its suffixes, longest first, the empty one last
        self.states: list[tuple] = [(0, (-1,), (0,))]
        self.number: dict[tuple, int] = {self.states[0]: START}
        self.fits: dict[int, bool] = {}
        self.to: dict[int, int] = {}  # state << 9 | symbol -> next state << 10 | change of the count + 512
        self.table = TransitionTable()
        self.compiled = 0

    def _chain(self, node: int) -> tuple:
        if node not in self.chain:
            at, out = node, []
            while at:
                out.append((self.model.depth[at], self.model.token[at]))
                at = self.model.fail[at]
            self.chain[node] = (*out, (0, -1))
        return self.chain[node]

    def step(self, state: int, symbol: int) -> int:
        """The packed transition, made if it is new."""
        key = state << 9 | symbol
        packed = self.to.get(key)
        if packed is not None:
            return packed
        node, last, count = self.states[state]
        old, at = self._chain(node), 0
        after = self.model.after(node, symbol)
        lasts, counts, token, change = [], [], -1, 0
        for depth, t in self._chain(after)[:-1]:
            while old[at][0] != depth - 1:
                at += 1
            lasts.append(last[at])
            counts.append(count[at])
            if t >= 0 and token < 0:
                before = last[at]
                fits = before < 0 or self.fits.get(before << 20 | t)
                if fits is None:
                    fits = self.fits[before << 20 | t] = self.model.first_merge(before, t) is None
                if fits:
                    token, change = t, count[at] + 1
        to = START
        if symbol < 256:
            new = (after, (*lasts, token), (*(n - change for n in counts), 0))
            to = self.number.get(new)
            if to is None:
                to = self.number[new] = len(self.states)
                self.states.append(new)
        self.to[key] = packed = to << 10 | change + 512
        return packed

    def word(self, data: bytes) -> int:
        """The tokens of one word."""
        state, total, get = START, 0, self.to.get
        final = len(data) - 1
        for k, b in enumerate(data):
            symbol = b if k < final else b + 256
            packed = get(state << 9 | symbol)
            if packed is None:
                packed = self.step(state, symbol)
            state = packed >> 10
            total += (packed & 1023) - 512
        return total

    def compile(self) -> PairTransducer:
        """Make the states that the tokens of the vocabulary reach."""
        for symbols in self.model.symbols.values():
            state = START
            for c in symbols:
                state = self.step(state, c) >> 10
        self.compiled = len(self.to)
        return self

    def ready(self) -> None:
        """Put the compiled transitions into the table."""
        self.table = TransitionTable()
        self.table.add(np.fromiter(self.to, np.int64, len(self.to)), np.fromiter(self.to.values(), np.int64, len(self.to)))

    def forget(self) -> None:
        """Keep only what was compiled."""
        self.to = dict(list(self.to.items())[:self.compiled])
        n = max((v >> 10 for v in self.to.values()), default=0) + 1
        self.states = self.states[:n]
        self.number = {s: k for k, s in enumerate(self.states)}
        self.fits = {}
        self.ready()

    def words(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The tokens of many words, given by place and length in ``data``."""
        if len(self.to) > self.compiled + TRANSITIONS:
            self.forget()
        total = np.zeros(len(start), np.int64)
        for k in np.flatnonzero(length > TOGETHER).tolist():
            total[k] = self.word(data[start[k]:start[k] + length[k]].tobytes())
        short = np.flatnonzero(length <= TOGETHER)
        short = short[np.argsort(TOGETHER - length[short].astype(np.uint8), kind="stable")]  # the longest first
        place, size = start[short], length[short]
        longer = len(size) - np.searchsorted(size[::-1], np.arange(TOGETHER + 1), "right")  # words of more than k bytes
        state, sums = np.zeros(len(short), np.int64), np.zeros(len(short), np.int64)
        for k in range(int(size[0]) if len(size) else 0):
            n, inner = longer[k], longer[k + 1]
            symbol = data[place[:n] + k].astype(np.int64)
            symbol[inner:] += 256
            key = state[:n] << 9 | symbol
            packed = self.table.find(key)
            missing = np.flatnonzero(packed < 0)
            if len(missing):
                new, back = np.unique(key[missing], return_inverse=True)
                made = np.array([self.step(x >> 9, x & 511) for x in new.tolist()], np.int64)
                self.table.add(new, made)
                packed[missing] = made[back]
            sums[:n] += (packed & 1023) - 512
            state = packed >> 10
        total[short] = sums
        return total


class TokenCounter:
    """A tokenizer file as transducers: NFC and lower case, splitting, pair encoding."""

    def __init__(self, text: str):
        data = json.loads(text)
        kinds = [n["type"] for n in data["normalizer"]["normalizers"]]
        split, level = data["pre_tokenizer"]["pretokenizers"]
        if (kinds != ["NFC", "Replace", "Lowercase"] or data["model"]["type"] != "BPE" or data["post_processor"]
                or (split["type"], split["behavior"], split["invert"], level["type"]) != ("Split", "Removed", True, "ByteLevel")):
            raise ValueError("this tokenizer file has steps that are not known here")
        special = sorted((t["content"] for t in data["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.lead = [s[:2].encode() for s in special]
        self.split = SplitTransducer(split["pattern"]["Regex"])
        self.pairs = PairTransducer(PairModel(data)).compile()

    def _normal(self, text: bytes) -> tuple[bytes, int]:
        """The normalised text, and the number of special tokens, which become spaces."""
        found = 0
        if self.special and any(x in text for x in self.lead):
            plain, found = self.special.subn("\n", text.decode(errors="replace"))
            text = plain.encode()
        if text.isascii():
            return text.lower(), found
        plain = unicodedata.normalize("NFC", text.decode(errors="replace"))
        return plain.replace("Σ", "σ").lower().encode(), found  # lower case goes by single characters

    def count(self, texts: list[bytes]) -> np.ndarray:
        """The number of tokens of each text."""
        if not self.pairs.table.tables:
            self.pairs.ready()
        normal = [self._normal(t) for t in texts]
        joined = b"\n".join(t for t, _ in normal) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        if joined.isascii():
            classes, place = self.split.classes[:128][data], None
        else:
            classes = self.split.classes[np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)]
            place = np.flatnonzero((data & 0xC0) != 0x80)
        begins = self.split.marks(classes)
        edges = np.flatnonzero(begins | (classes == SplitTransducer.SPACE))
        first = np.flatnonzero(begins[edges])
        start, end = edges[first], edges[first + 1]
        if place is not None:
            start, end = place[start], place[end]
        tokens = self.pairs.words(data, start, end - start)
        ends = np.cumsum([len(t) + 1 for t, _ in normal])
        sums = np.concatenate([[0], np.cumsum(tokens)])[np.concatenate([[0], np.searchsorted(start, ends)])]
        return np.diff(sums) + np.array([n for _, n in normal], np.int64)


_counters: dict[str, TokenCounter] = {}


@any_names
def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns of ``docs`` (all by default) with ``n_bytes`` (UTF-8)
    and ``n_tokens`` of the text, special strings in it being one token each.

    The tokenizer file is read and compiled on the driver and broadcast; its size
    doesn't depend on the data.  One narrow pass, no shuffle.  Columns of ``docs``
    with the added names are replaced; rows, repeated ones too, stay as they are."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(TokenCounter(f.read()))
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("n_bytes", "n_tokens")]
    names, key = [f"carried_{k}" for k in range(len(carry))], uuid.uuid4().hex
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        if key not in _counters:
            _counters.clear()
            _counters[key] = shared.value
        counter = _counters[key]
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for first, end in text_batches(texts, RUN_BYTES):
                part = texts[first:end]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n).slice(first, end - first) for n in names), pa.array(map(len, part), pa.int64()), pa.array(counter.count(part), pa.int64())],
                    [*names, "n_bytes", "n_tokens"])
    out = plain.select(*names, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema
    return plain.mapInArrow(run, out).toDF(*carry, "n_bytes", "n_tokens")
