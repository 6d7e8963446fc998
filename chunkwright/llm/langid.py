"""Language identification in two levels.

Texts become hashed character n-gram counts (square roots, unit length).  The
labels' mean vectors are merged into families by average linkage; a linear
classifier picks the family, then one-versus-one linear support vector machines
vote between the labels inside it.  Both are fitted on the driver, on at most
``sample_rows`` labelled rows of each label, taken by a hash of the id; the
sample's features, not its texts, come to the driver.

Defined cases: null text, and text without a letter, is ``und`` with score 0; a
null label isn't learned from; with one label all text gets it; without any
labelled row every text is ``und``.  Long texts are read whole.  Repeated rows
get equal results, ties go to the label first in order, an empty table gives an
empty one, and extra columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwright.runtime import ship, tidied

#: Hashed features.
DIMS = 4096
#: Lengths of the byte n-grams; they don't cross white space.
GRAMS = (1, 2, 3, 4)
#: Rows of each label that are learned from, at most.
SAMPLE_ROWS = 1000
#: Labels whose mean vectors are at least this similar (cosine) form a family.
FAMILY_SIMILARITY = 0.55

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.ones(256, dtype=bool)
_SPACE[97:123] = False
_SPACE[128:] = False
#: How a text is cut for counting, so that a long one needs little memory; grams don't cross the cuts' margins twice.
_SLICE = 1 << 20


def features(data: bytes) -> np.ndarray:
    """Hashed n-gram counts of a text's letters; everything else separates words."""
    counts = np.zeros(DIMS, dtype=np.int64)
    for start in range(0, len(data), _SLICE):
        low = max(0, start - max(GRAMS))
        raw = _LOWER[np.frombuffer(data, dtype=np.uint8, count=min(len(data), start + _SLICE) - low, offset=low)]
        fresh = start - low  # grams that end before this were counted already
        gap = _SPACE[raw]
        codes = raw.astype(np.uint32)
        codes[gap] = 1
        run = np.zeros(len(raw), dtype=np.uint32)
        inner = np.zeros(len(raw), dtype=bool)  # the gram holds a separator before its last byte
        for k in range(1, max(GRAMS) + 1):
            if len(raw) < k:
                break
            if k == 1:
                run = codes * _MULTIPLIERS[0]
                ok = ~gap
            else:
                n = len(raw) - k + 1
                # a gram may begin or end at a separator, but none stands inside it
                inner = (inner[:n] | gap[1 : n + 1]) if k > 2 else np.zeros(n, dtype=bool)
                run = (run[:n] ^ (run[:n] >> np.uint32(15))) * _MULTIPLIERS[k - 1] + codes[k - 1 :]
                ok = ~inner & ~(gap[:n] & gap[k - 1 :])
                if k > 2:
                    ok &= ~gap[k - 2 : k - 2 + n]
            if k in GRAMS:
                first = max(0, fresh - k + 1)
                mixed = run[first:][ok[first:]]
                mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x5BD1E995)
                counts += np.bincount(mixed >> np.uint32(32 - DIMS.bit_length() + 1), minlength=DIMS)
    out = np.sqrt(counts.astype(np.float32))
    norm = float(np.linalg.norm(out))
    return out / norm if norm else out


def train_svm(x: np.ndarray, y: np.ndarray, epochs: int = 12, strength: float = 1e-4, seed: int = 7) -> np.ndarray:
    """A linear support vector machine by averaged Pegasos; y is -1 or 1. The last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    w, mean = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    order, steps, summed, batch = np.random.default_rng(seed), 0, 0, 32
    for epoch in range(epochs):
        for part in np.array_split(order.permutation(len(x)), max(1, len(x) // batch)):
            steps += 1
            rate = 1 / (strength * (steps + 1 / strength / 50))
            wrong = part[y[part] * (x[part] @ w) < 1]
            w *= 1 - rate * strength
            if len(wrong):
                w += rate / len(part) * (y[wrong] @ x[wrong])
            if epoch >= epochs // 2:
                mean += w
                summed += 1
    return mean / max(1, summed)


def families_of(means: np.ndarray, similarity: float) -> list[list[int]]:
    """Average linkage on cosine similarity of the labels' mean vectors."""
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    close = unit @ unit.T
    groups = [[i] for i in range(len(means))]
    while len(groups) > 1:
        best = max(((close[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), key=lambda t: (t[0], -t[1], -t[2]))
        if best[0] < similarity:
            break
        groups[best[1]] += groups.pop(best[2])
    return [sorted(g) for g in groups]


@dataclass
class LanguageModel:
    labels: list[str]
    families: list[list[int]]
    family_weights: np.ndarray  # a row for each family, one against the rest
    pair_weights: dict[tuple[int, int], np.ndarray]  # positive: the first of the two

    @classmethod
    def fit(cls, x: np.ndarray, y: list[str], similarity: float = FAMILY_SIMILARITY) -> LanguageModel:
        labels = sorted(set(y))
        at = np.array([labels.index(v) for v in y], dtype=int)
        means = np.array([x[at == i].mean(axis=0) for i in range(len(labels))]) if labels else np.zeros((0, DIMS))
        families = families_of(means, similarity) if labels else []
        family = np.array([next(f for f, g in enumerate(families) if i in g) for i in at], dtype=int)
        weights = np.array([train_svm(x, np.where(family == f, 1.0, -1.0)) for f in range(len(families))]) if len(families) > 1 else np.zeros((len(families), DIMS + 1))
        pairs = {}
        for group in families:
            for n, i in enumerate(group):
                for j in group[n + 1 :]:
                    both = (at == i) | (at == j)
                    pairs[i, j] = train_svm(x[both], np.where(at[both] == i, 1.0, -1.0))
        return cls(labels, families, weights, pairs)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(label index, score) of each row; the score is the product of both levels' margins, each as a logistic."""
        x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
        outer = x @ self.family_weights.T
        family = outer.argmax(axis=1)
        top = outer[np.arange(len(x)), family]
        rest = np.where(np.arange(outer.shape[1]) == family[:, None], -np.inf, outer).max(axis=1, initial=-np.inf)
        score = np.where(np.isfinite(rest), 1 / (1 + np.exp(-2 * np.clip(top - rest, -30, 30))), 1.0)
        best = np.zeros(len(x), dtype=int)
        for f, group in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            if not len(rows):
                continue
            votes, margins = np.zeros((len(rows), len(group))), np.zeros((len(rows), len(group)))
            for (i, j), w in self.pair_weights.items():
                if i in group:
                    margin = x[rows] @ w
                    a, b = group.index(i), group.index(j)
                    votes[:, a] += margin >= 0
                    votes[:, b] += margin < 0
                    margins[:, a] += margin
                    margins[:, b] -= margin
            chosen = (votes + 1e-3 * np.tanh(margins)).argmax(axis=1)
            best[rows] = np.array(group)[chosen]
            if len(group) > 1:
                score[rows] *= 1 / (1 + np.exp(-2 * np.clip(margins[np.arange(len(rows)), chosen] / (len(group) - 1), -30, 30)))
        return best, np.clip(score, 0.0, 1.0)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learn from a sample of the rows whose label isn't null: by hash of the id, at most ``sample_rows`` a label."""
    ship(labelled.sparkSession)
    known = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(label_col).count().collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col(label_col) == F.lit(label), F.lit(min(1.0, 0.9 * sample_rows / n) if n > sample_rows else 1.0)).otherwise(share)
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.where(place < share).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(label, features(t.encode())) for label, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.string()), pa.array([v.astype(np.float16).tobytes() for _, v in kept], pa.binary())], names=["label", "x"])

    # float16 rows of DIMS features: at most 8 KB each, and sample_rows of them a label.
    rows = sorted(drawn.mapInArrow(tidied(run), "label string, x binary").limit(2 * sample_rows * max(1, len(counts))).collect())
    x = np.array([np.frombuffer(r["x"], dtype=np.float16) for r in rows], dtype=np.float32).reshape(len(rows), DIMS)
    return LanguageModel.fit(x, [r["label"] for r in rows])


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: the columns in ``keep`` (the id alone, if not given), lang_pred, score."""
    spark = docs.sparkSession
    ship(spark)
    keep = [id_col] if keep is None else keep
    known = spark.sparkContext.broadcast(model)  # some hundred KB: DIMS weights for each family and each pair within one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for batch in batches:
            texts, n = batch.column(place), len(batch)
            labels, scores = ["und"] * n, [0.0] * n
            for low in range(0, n, 256):
                rows, vectors = [], []
                for i in range(low, min(n, low + 256)):
                    text = texts[i].as_py()
                    if text and model.labels and has_letter(text):
                        rows.append(i)
                        vectors.append(features(text.encode()))
                if rows:
                    best, score = model.predict(np.array(vectors, dtype=np.float32))
                    for i, b, s in zip(rows, best.tolist(), score.tolist(), strict=True):
                        labels[i], scores[i] = model.labels[b], s
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = docs.select(*keep).schema
    # A text that is kept is sent once.
    place = keep.index(text_col) if text_col in keep else len(keep)
    given = docs.select(*keep) if text_col in keep else docs.select(*keep, F.col(text_col).alias("_text"))
    return given.mapInArrow(tidied(run), schema.add("lang_pred", "string").add("score", "double"))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
