"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled ones (which hold toxic ones too, at the rate of the class prior) train a linear
classifier in numpy. With the prior p, the risk of calling a document clean is estimated on the unlabelled, less p times
the same risk on the toxic ones; an estimate below zero means that the classifier fits the unlabelled by heart, and the
step goes the other way (non-negative correction). So no document is ever taken to be clean because it has no label.

A text's features are its distinct words (lower case, without punctuation around them) and their beginnings of PREFIXES
characters, hashed into 2 ** BITS places: an inflected or compounded insult has its beginning in common with others.
Only features are fitted of which the same prior-corrected estimate says that they tell (see telling). The loss
is the sigmoid loss, which is bounded, the steps are AdaGrad. Weights other than the bias stay at 0 or above: an insult in a long text can't be outvoted
by clean words around it.

The prior is the share of toxic ones among the labelled documents outside the held-out fold, at least LEAST_PRIOR. Rows
without an id or with another label than 0 or 1 are ignored; of an id with several labels the greatest counts. With no
toxic example every score is 0. Null and empty texts have the score of a text without features.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training import chosen, fold, scored, sigmoid, trained

BITS = 20
PREFIXES = (4, 5)
#: At most so many toxic and so many unlabelled documents are fitted, those whose ids have the least hashes.
TOXIC_ROWS, UNLABELLED_ROWS = 2_000, 8_000
LEAST_PRIOR = 0.005
STEPS, RATE = 800, 0.7
#: A feature is fitted if so many toxic documents have it, and if it makes a document toxic with this chance or more.
FEWEST, TELLING = 4, 0.5
#: How far a step goes the other way where the clean risk is below zero.
BACK = 0.1
EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_/\\…“”„‚‘’«»¡¿"


def word_places(word: bytes) -> list[int]:
    said = word.decode("utf-8", "replace").lower().strip(EDGES)
    if not said:
        return []
    parts = [said, *(f"{said[:n]}{n}*" for n in PREFIXES if len(said) >= n)]
    return [xxhash.xxh3_64_intdigest(p) >> (64 - BITS) for p in parts]


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct features of all texts, and where each text's begin and end."""
    ids: dict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    rows = [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)) for words in (set((x or b"").split()) for x in texts)]
    places = [word_places(w) for w in ids]
    size = np.fromiter(map(len, places), np.int64, len(places))
    start = np.cumsum(size) - size
    flat = np.fromiter((p for own in places for p in own), np.int64, int(size.sum()))
    found = []
    for row in rows:
        own = size[row]
        found.append(np.unique(flat[np.repeat(start[row] - np.cumsum(own) + own, own) + np.arange(own.sum())]))
    bounds = np.append(0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found))))
    return np.concatenate(found) if found else np.zeros(0, np.int64), bounds


def sums(places: np.ndarray, bounds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = np.append(0.0, np.cumsum(weights[places], dtype=np.float64))
    return total[bounds[1:]] - total[bounds[:-1]]


def fit(texts: list[bytes], marks: np.ndarray, prior: float) -> np.ndarray:
    """2 ** BITS weights and the bias. marks: 1 toxic, 0 unlabelled."""
    w = np.zeros((1 << BITS) + 1)
    w[-1] = -40.0
    toxic, unlabelled = np.flatnonzero(marks == 1), np.flatnonzero(marks == 0)
    if not len(toxic) or not len(unlabelled):
        return w
    places, bounds = features(texts)
    w[-1] = np.log(prior / (1 - prior))
    told = telling(places, bounds, toxic, unlabelled, prior)[places]
    bounds = np.append(0, np.cumsum(told))[bounds]
    return _descend(w, places[told], bounds, toxic, unlabelled, prior)


def telling(places: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Which features to fit: prior * P(feature | toxic) estimates how many toxic documents have a feature among all that
    do, P(feature | unlabelled), without any label of a clean one."""
    marks = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    of_toxic, of_all = np.isin(marks, toxic), np.isin(marks, unlabelled)
    n_toxic, n_all = (np.bincount(places[x], minlength=(1 << BITS) + 1) for x in (of_toxic, of_all))
    return (n_toxic >= min(FEWEST, len(toxic))) & (prior * n_toxic / len(toxic) >= TELLING * n_all / len(unlabelled))


def _descend(w: np.ndarray, places: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """AdaGrad on the whole sample; places holds only features that tell, so a step is cheap."""
    own = np.append(np.unique(places), len(w) - 1)
    at, size = np.searchsorted(own, places), np.diff(bounds)
    v, squares, floor = w[own], np.full(len(own), 1e-12), w[-1] - 4
    for _ in range(STEPS):
        s = sigmoid(sums(at, bounds, v) + v[-1])
        steep = s * (1 - s)
        clean_risk = s[unlabelled].mean() - prior * s[toxic].mean()
        slope = np.zeros(len(size))
        slope[unlabelled] = steep[unlabelled] / len(unlabelled)
        slope[toxic] -= prior * steep[toxic] / len(toxic)
        if clean_risk < 0:
            slope *= -BACK
        else:
            slope[toxic] -= prior * steep[toxic] / len(toxic)
        gradient = np.append(np.bincount(at, np.repeat(slope, size), minlength=len(own) - 1)[: len(own) - 1], slope.sum())
        squares += gradient**2
        v = v - RATE * gradient / np.sqrt(squares)
        v[:-1], v[-1] = np.maximum(0, v[:-1]), max(v[-1], floor)
    out = w.copy()
    out[own] = v
    return out


def score(texts: list[bytes | None], weights: np.ndarray) -> np.ndarray:
    return sigmoid(sums(*features(texts), weights) + weights[-1])


def toxicity_scores(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted: labels only of documents outside the held-out fold are learnt."""
    known = labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1) & (fold(F.col(id), folds) != held_out)).groupBy(F.col(id).alias("doc_id")).agg(F.max(label).alias("mark"))
    counts = known.agg(F.sum("mark").alias("toxic"), F.count("*").alias("all")).collect()[0]
    prior = min(0.5, max(LEAST_PRIOR, (counts["toxic"] or 0) / max(1, counts["all"])))
    toxic = chosen(known.where("mark = 1"), TOXIC_ROWS)
    any_text = docs.where(F.col(id).isNotNull() & (fold(F.col(id), folds) != held_out)).select(F.col(id).alias("doc_id"), F.lit(0).alias("mark"))
    sample = toxic.select("doc_id", "mark", "order").union(chosen(any_text, UNLABELLED_ROWS).select("doc_id", "mark", "order"))
    weights = trained(docs, id, text, sample, lambda texts, marks: fit(texts, marks, prior))
    return scored(docs, id, text, fold(F.col(id), folds) == held_out, weights, score)
