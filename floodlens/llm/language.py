"""Operator 3, language ID by string kernels.

The blended-spectrum presence kernel of two texts is the number of character
n-grams (n = 1 to ``GRAMS``, hashed) that both hold, over the geometric mean of
their counts.  Nyström landmarks span the kernel's space: ridge regression of
one target a language is fitted on kernels to the landmarks, whose normal
equations add up over partitions, and texts are scored by products of batches
of presence rows with the landmarks' matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import any_names, per_batch

GRAMS = 3
HASH_BITS = 16
#: a training sample of about this many rows, landmarks in all (at least ``LEAST_LANDMARKS`` a language), and the ridge
SAMPLE_ROWS, LANDMARKS, LEAST_LANDMARKS, RIDGE = 20_000, 128, 4, 1e-4
SAMPLE_TASKS = 16
#: rows of the sample that a language gets at least (all its rows, if fewer), and the largest draw
LEAST_ROWS, MOST_DRAW = 64, (1 << 63) - 1
UNKNOWN = "und"
BATCH = 512

_TABLE = 0x3000  # characters beyond are asked one by one
_letters = np.array([chr(c).isalpha() for c in range(_TABLE)])
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def gram_buckets(text: str) -> np.ndarray | None:
    """Buckets of the text's n-grams, with repeats; None without a letter.
    Lower case; every run of other characters than letters is one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters[np.minimum(codes, _TABLE - 1)]
    far = np.flatnonzero(codes >= _TABLE)
    if len(far):
        letter[far] = [chr(c).isalpha() for c in codes[far].tolist()]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of other characters, the first after a letter
    codes = np.concatenate([[32], codes[keep], [32]]).astype(np.uint64)
    parts, value = [], np.zeros(len(codes), np.uint64)
    for n in range(GRAMS):
        value = (value[:len(codes) - n] if n else value) + codes[n:] * _POWERS[n]
        x = value * np.uint64(0xFF51AFD7ED558CCD + 2 * n)
        x ^= x >> np.uint64(32)
        parts.append((x * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(64 - HASH_BITS))
    return np.concatenate(parts)


class Landmarks:
    """The landmarks' presence rows over the buckets that any of them holds."""

    def __init__(self, texts: list[str]):
        rows = []
        for t in texts:
            flags = np.zeros(1 << HASH_BITS, bool)
            flags[gram_buckets(t)] = True
            rows.append(flags)
        every = np.array(rows)
        self.columns = np.flatnonzero(every.any(axis=0))
        self.matrix = (every[:, self.columns] / np.sqrt(every.sum(axis=1, keepdims=True))).astype(np.float32).T

    def kernel(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(kernels to the landmarks, whether the text has a letter)."""
        out, known = np.zeros((len(texts), self.matrix.shape[1]), np.float32), np.zeros(len(texts), bool)
        for at in range(0, len(texts), BATCH):
            part = texts[at:at + BATCH]
            present = np.zeros((len(part), len(self.columns)), np.float32)
            for k, text in enumerate(part):
                buckets = gram_buckets(text) if text else None
                if buckets is not None:
                    flags = np.zeros(1 << HASH_BITS, bool)
                    flags[buckets] = True
                    present[k] = flags[self.columns] / np.sqrt(np.count_nonzero(flags))
                    known[at + k] = True
            out[at:at + BATCH] = present @ self.matrix
        return out, known

    def self_kernel(self) -> np.ndarray:
        return (self.matrix.T @ self.matrix).astype(float)


class Classifier:
    """Landmarks, the languages and their ridge weights."""

    def __init__(self, landmarks: Landmarks | None, languages: list[str], weights: np.ndarray | None):
        self.landmarks, self.languages, self.weights = landmarks, languages, weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        kernels, known = self.landmarks.kernel(texts)
        values = kernels @ self.weights
        best = values.argmax(axis=1)
        sure = np.clip((1 + values[np.arange(len(texts)), best]) / 2, 0, 1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, sure, 0.0)


def _sums(landmarks: Landmarks, languages: list[str]):
    """Normal equations of one part of the sample, as bytes."""
    def run(parts):
        m, number = landmarks.matrix.shape[1], {v: k for k, v in enumerate(languages)}
        square, cross = np.zeros((m, m)), np.zeros((m, len(languages)))
        for batch in parts:
            kernels, known = landmarks.kernel(batch.column("_text").to_pylist())
            kernels = kernels[known].astype(float)
            target = np.full((len(kernels), len(languages)), -1.0)
            target[np.arange(len(kernels)), [number[v] for v, k in zip(batch.column("_lang").to_pylist(), known) if k]] = 1
            square += kernels.T @ kernels
            cross += kernels.T @ target
        yield pa.RecordBatch.from_pydict({"sums": pa.array([np.hstack([square, cross]).tobytes()], pa.binary())})
    return run


def _bounds(held: dict[str, tuple[int, int]], sample_rows: int) -> dict[str, int]:
    """The largest draw that is taken of each language that isn't taken whole, from its
    (rows, least draw); the row of the least draw always is."""
    quota = max(LEAST_ROWS, sample_rows // max(1, len(held)))
    spare = max(0, sample_rows - sum(min(n, quota) for n, _ in held.values()))
    over = sum(max(0, n - quota) for n, _ in held.values())
    if over <= spare:
        return {}
    share = {lang: (quota + spare * (n - quota) / over) / n for lang, (n, _) in held.items() if n > quota}
    return {lang: max(held[lang][1], int(part * MOST_DRAW)) for lang, part in share.items()}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """A classifier of the languages of ``docs`` (rows of null language or of
    no letter teach nothing), fitted on a sample of about ``sample_rows`` rows
    (all, if fewer), drawn by a hash of the id and the text.  The languages are those of
    all rows: each gets an equal quota of the sample, at least ``LEAST_ROWS``
    (all its rows, if fewer), and what the small ones leave goes to the others
    by their rows.  Landmarks are the rows of the smallest hashes of each
    language."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    draw = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("")), "_text"), 1)
    rows = rows.withColumn("_draw", draw)
    held = {r["_lang"]: (r["n"], r["least"]) for r in rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n"), F.min("_draw").alias("least")).collect()}
    languages, bounds = sorted(held), _bounds(held, sample_rows)
    limit = F.lit(MOST_DRAW)
    for lang, bound in bounds.items():
        limit = F.when(F.col("_lang") == F.lit(lang), F.lit(bound)).otherwise(limit)
    drawn = rows.where(F.col("_draw") <= limit)
    if not languages:
        return Classifier(None, [], None)
    each = max(LEAST_LANDMARKS, LANDMARKS // len(languages))
    order = Window.partitionBy("_lang").orderBy("_draw", "_id", F.xxhash64("_text"))
    chosen = drawn.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).select("_text").collect()
    landmarks = Landmarks(sorted(r[0] for r in chosen))
    parts = drawn.select("_text", "_lang").repartition(SAMPLE_TASKS).mapInArrow(_sums(landmarks, languages), "sums binary").collect()
    m = landmarks.matrix.shape[1]
    total = sum(np.frombuffer(r.sums).reshape(m, -1) for r in parts)
    base = landmarks.self_kernel()
    penalty = RIDGE * max(1, total[0, 0]) * (base + 1e-6 * np.eye(m))
    weights = np.linalg.solve(total[:, :m] + penalty, total[:, m:])
    return Classifier(landmarks, languages, weights.astype(np.float32))


@any_names
def identify(docs: DataFrame, classifier: Classifier, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` (``und`` for null texts and texts without a
    letter, or where nothing was learnt) and ``score`` (0 to 1; 0 for ``und``).
    Columns of these names are replaced."""
    base = docs.drop("lang_pred", "score")
    out = base.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def predict(batch: pa.RecordBatch) -> dict:
        lang, score = shared.value.predict(batch.column(text_col).to_pylist())
        return {n: batch.column(n) for n in batch.schema.names} | {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}
    return base.mapInArrow(per_batch(predict), out)
