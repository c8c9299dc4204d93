"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's features are its words and pairs of neighbouring words, hashed into 2 ** BITS places, once by what the words say
(lower case, without punctuation) and once by their shape (case, digits, punctuation; a pair also says whether its
words are equal). A feature's value is its share of the text's words times SCALE, so that a score is a sparse dot
product of shares and weights, and doesn't depend on a text's length.

Updates are FTRL-proximal: each weight has its own learning rate, and one whose gradients stay small is exactly 0.

Labels: rows without an id or with another label than 0 or 1 are ignored; of an id with several labels the greatest
counts. With no usable label every score is 0.5. Null and empty texts have the score of a text without features.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mix
from .training import chosen, fold, scored, sigmoid, trained

BITS = 18
SCALE = 8.0
#: At most so many labelled documents are fitted, those whose ids have the least hashes.
TRAIN_ROWS = 8_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.01
_LETTERS = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"[\W_]+")


def word_codes(word: bytes) -> tuple[int, int]:
    """Hashes of what a word says and of its shape."""
    said = word.decode("utf-8", "replace")
    shape = _LETTERS.sub(lambda m: "x" if m[0].islower() else "X" if m[0].isupper() and len(m[0]) > 1 else "Xx" if m[0][:1].isupper() else "m", said)
    shape = re.sub(r"\d+", "9", shape)
    return xxhash.xxh3_64_intdigest(_PLAIN.sub("", said.lower())), xxhash.xxh3_64_intdigest(shape[:12], seed=1)


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all features of all texts, the text of each, and the number of words of each text."""
    ids: dict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    parts = [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)) for words in ((x or b"").split() for x in texts)]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    codes = np.array([word_codes(w) for w in ids], np.uint64).reshape(-1, 2)[flat]
    owner = np.repeat(np.arange(len(parts)), counts)
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    same = (flat[1:] == flat[:-1]).astype(np.uint64)[pair]
    said, shape = codes[:, 0], codes[:, 1]
    found = [
        mix(said, 1),
        mix(shape, 2),
        mix(mix(said[pair]) + said[pair + 1], 3),
        mix(mix(shape[pair]) + shape[pair + 1] + same, 4),
    ]
    owners = [owner, owner, owner[pair], owner[pair]]
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owners), counts


def fit(texts: list[bytes], labels: np.ndarray) -> np.ndarray:
    """2 ** BITS weights and the bias, by FTRL-proximal over the texts in order, EPOCHS times."""
    size = (1 << BITS) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    rows = []
    for text in texts:
        places, _, counts = features([text])
        at, times = np.unique(places, return_counts=True)
        rows.append((np.append(at, size - 1), np.append(times * SCALE / max(1, counts[0]), 1.0).astype(np.float32)))
    if len(set(labels.tolist())) < 2:
        return w
    for _ in range(EPOCHS):
        for (at, x), y in zip(rows, labels.tolist(), strict=True):
            own, root = z[at], np.sqrt(n[at])
            weight = np.where(np.abs(own) <= L1, 0.0, -(own - np.sign(own) * L1) / ((BETA + root) / ALPHA + L2))
            gradient = (sigmoid(weight @ x) - y) * x
            squares = n[at] + gradient * gradient
            z[at] = own + gradient - (np.sqrt(squares) - root) / ALPHA * weight
            n[at] = squares
    root = np.sqrt(n)
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + root) / ALPHA + L2))


def score(texts: list[bytes | None], weights: np.ndarray) -> np.ndarray:
    places, owner, counts = features(texts)
    sums = np.bincount(owner, weights[places], minlength=len(texts)) if len(texts) else np.zeros(0)
    return sigmoid(weights[-1] + SCALE * sums / np.maximum(1, counts))


def quality_scores(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 4, held_out: int = 2, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: labels only of documents outside the held-out fold are learnt."""
    known = labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1) & (fold(F.col(id), folds) != held_out))
    sample = chosen(known.groupBy(F.col(id).alias("doc_id")).agg(F.max(label).alias("mark")), most)
    weights = trained(docs, id, text, sample, fit)
    return scored(docs, id, text, fold(F.col(id), folds) == held_out, weights, score)
