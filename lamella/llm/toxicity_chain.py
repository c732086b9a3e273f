"""Toxicity by a classifier chain over linear models.

Categories are predicted one after the other. The model of a category sees the words of
the text and the probabilities of the categories before it. For training, those earlier
probabilities are out of fold: the labelled rows are dealt to folds by a hash of their
doc_id, and each row's probability comes from models fitted on the other folds, so a
later model never learns from an over-confident earlier one.

Features are the presence of words (lower case), of word beginnings (``STEMS``
characters, for languages that compound), and of four coarse measures of the text (upper
case, symbols, repeated words, length). Each model keeps the features that are enriched in its
category; the weights are fitted by regularised logistic regression (limited-memory BFGS).

The fit uses at most ``sample`` labelled documents, those with the smallest hash of
their doc_id (a documented bound); their features come to the driver, where the models
are fitted. Scoring reads every document on the executors with the models' weights.

Special rows: a null text counts as empty; null doc_ids are scored like any other; labels
without a document, with a null label or null doc_id are left out, and repeated labels of
one document count once; extra columns are kept by ``reject_toxic``. Without labelled rows
of both kinds a category has the labelled share as its probability (0 without any rows).
An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import Memo, drop_kept, give_back, rows_of, whole_text

#: The chain: category and the condition on the label columns that makes a row positive.
CHAIN = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
SAMPLE = 16_000
FOLDS = 5
STEMS = (4, 5, 6, 7)
SPACE = 1 << 22
LEAST_ROWS = 3
#: Words whose features a task remembers, to score and to fit (there all five of each, about 400 bytes a
#: word); the memory goes back when it ends.
WORDS = 400_000
FIT_WORDS = 100_000
#: Documents that are scored at a time.
SCORED = 1024
WORD = re.compile(r"\w+")
DENSE = 4


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a word: itself and its beginnings."""
    import xxhash

    hash_ = xxhash.xxh3_64_intdigest
    return (hash_("w:" + word) % SPACE, *(hash_(f"p:{word[:n]}") % SPACE for n in STEMS if len(word) > n))


@cache
def upper_case() -> np.ndarray:
    """Whether each code point is an upper case letter."""
    return np.fromiter((chr(c).isupper() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def capitals(text: str) -> int:
    """How many of all characters are upper case letters."""
    return int(np.count_nonzero(upper_case()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]))


def shares(text: str, words: list[str]) -> tuple[float, ...]:
    """Upper case letters and symbols as shares of the characters, repeated words as a share of the
    words, and a tenth of the logarithm of the number of words."""
    n = max(1, len(text))
    spaced = sum(map(len, words))
    return (capitals(text) / n, 1 - (spaced + text.count(" ")) / n, 1 - len(set(words)) / max(1, len(words)), math.log1p(len(words)) / 10)


@dataclass
class Linear:
    """A logistic model over some hashed features, the dense shares and the earlier categories."""

    features: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def score(self, rows: np.ndarray, columns: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Probabilities of len(dense) rows, given (row, column of ``features``) pairs."""
        z = np.bincount(rows, weights=self.weights[columns], minlength=len(dense)) + dense @ self.dense + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Entries:
    """Which labelled rows have which hashed features, one pair each; only passed over in slices."""

    rows: np.ndarray
    hashed: np.ndarray

    def slices(self, size: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for start in range(0, len(self.rows), size):
            yield self.rows[start : start + size], self.hashed[start : start + size]

    def enriched(self, y: np.ndarray, learn: np.ndarray) -> np.ndarray:
        """The features whose rows (of ``learn``) have more or fewer positives than chance would give."""
        total, positive = np.zeros(SPACE, np.int32), np.zeros(SPACE, np.int32)
        for rows, hashed in self.slices():
            total += np.bincount(hashed[learn[rows]], minlength=SPACE).astype(np.int32)
            positive += np.bincount(hashed[learn[rows] & (y[rows] > 0)], minlength=SPACE).astype(np.int32)
        share = y[learn].mean()
        often = np.flatnonzero(total >= LEAST_ROWS)
        n = total[often]
        z = np.abs(positive[often] - n * share) / np.sqrt(n * share * (1 - share))
        return often[z > 4]

    def matched(self, features: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column of ``features``) pairs; rows are numbered within ``some``."""
        table = np.full(SPACE, -1, np.int32)
        table[features] = np.arange(len(features))
        place = np.cumsum(some) - 1
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
        for rows, hashed in self.slices():
            columns = table[hashed]
            hit = (columns >= 0) & some[rows]
            found.append((place[rows[hit]], columns[hit]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def minimise(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 100, memory: int = 10, least: float = 1e-5) -> np.ndarray:
    """Limited-memory BFGS for a smooth convex function; ``value`` gives the function and its gradient.

    Ends when a round lowers the function by less than ``least`` of it.
    """
    loss, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        way, shares_of = -g, []
        for s, y, r in reversed(past):
            shares_of.append(r * (s @ way))
            way = way - shares_of[-1] * y
        way = way / (past[-1][2] * (past[-1][1] @ past[-1][1])) if past else way / max(1.0, float(np.linalg.norm(g)))
        for (s, y, r), share in zip(past, reversed(shares_of), strict=True):
            way = way + (share - r * (y @ way)) * s
        step, slope = 1.0, float(g @ way)
        after, g_after = value(x + way)
        while after > loss + 1e-4 * step * slope and step > 1e-8:
            step /= 2
            after, g_after = value(x + step * way)
        if after >= loss:
            break
        s, y = step * way, g_after - g
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y, 1 / float(s @ y))]
        x, small = x + s, loss - after < least * loss
        loss, g = after, g_after
        if small:
            break
    return x


def fit(entries: Entries, dense: np.ndarray, y: np.ndarray, learn: np.ndarray, ridge: float = 1e-3) -> Linear:
    """Regularised logistic regression on the rows of ``learn``."""
    all_y, dense, y = y, dense[learn], y[learn]
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.0, 1e-9), 1 - 1e-9)
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(dense.shape[1]), float(np.log(p / (1 - p))))
    features = entries.enriched(all_y, learn)
    rows, columns = entries.matched(features, learn)
    n, k = len(y), len(features)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    theta = np.zeros(k + dense.shape[1] + 1)
    theta[-1] = -1.0

    def value(t: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(rows, weights=t[:k][columns], minlength=n) + dense @ t[k:-1] + t[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        r = weight * (p - y) / n
        g = np.concatenate([np.bincount(columns, weights=r[rows], minlength=k), dense.T @ r, [r.sum()]])
        g[:-1] += ridge / 10 * t[:-1]
        loss = float((weight * np.logaddexp(0, np.where(y > 0, -z, z))).mean() + ridge / 20 * (t[:-1] ** 2).sum())
        return loss, g

    theta = minimise(value, theta)
    return Linear(features, theta[:k], theta[k:-1], float(theta[-1]))


@dataclass
class Chain:
    names: tuple[str, ...]
    models: list[Linear]
    thresholds: list[float]

    def features(self) -> np.ndarray:
        return np.unique(np.concatenate([m.features for m in self.models])) if self.models else np.zeros(0, np.int64)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1 on out-of-fold probabilities, half way to the next lower one."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    at = int(np.argmax(f1))
    below = p[order[at + 1]] if at + 1 < len(p) else 0.0
    return float((p[order[at]] + below) / 2)


def train(entries: Entries, dense: np.ndarray, folds: np.ndarray, labels: np.ndarray, names: tuple[str, ...]) -> Chain:
    """Fit the chain: category by category, with out-of-fold probabilities of the earlier ones."""
    models, thresholds = [], []
    known = dense
    for k in range(len(names)):
        y = labels[:, k].astype(float)
        out = np.zeros(len(y))
        for fold in range(FOLDS):
            test = folds == fold
            if test.any():
                model = fit(entries, known, y, ~test)
                out[test] = model.score(*entries.matched(model.features, test), known[test])
        models.append(fit(entries, known, y, np.ones(len(y), bool)))
        thresholds.append(best_threshold(out, y))
        known = np.column_stack([known, out])
    return Chain(names, models, thresholds)


def labelled_sample(docs: DataFrame, labels: DataFrame, chain=CHAIN, sample: int = SAMPLE) -> DataFrame:
    """The labelled documents with the smallest hash: doc_id, text, one 0/1 column per category."""
    flags = [F.max(F.expr(f"CAST(({c}) AS int)")).alias(f"__c{k}") for k, (_, c) in enumerate(chain)]
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(*flags).dropna()
    picked = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    # At most ``sample`` rows of a few numbers: small enough to broadcast at any input size.
    return docs.select(F.col("doc_id").cast("long").alias("__doc"), whole_text().alias("__text")).join(F.broadcast(picked), F.col("__doc") == F.col("__id"))


def fit_chain(docs: DataFrame, labels: DataFrame, chain=CHAIN, sample: int = SAMPLE) -> Chain:
    """Features on the executors, models on the driver."""
    schema = pa.schema([("doc", pa.int64()), ("labels", pa.binary()), ("dense", pa.binary()), ("hashed", pa.binary())])
    marks = [f"__c{k}" for k in range(len(chain))]

    def featurise(batches):
        drop_kept()
        memo = Memo(word_features, FIT_WORDS)
        for batch in batches:
            out: list[tuple] = []
            for doc, text, *flags in rows_of([batch], "__doc", "__text", *marks):
                words = WORD.findall(text.lower())
                found = {f for w in set(words) for f in memo[w]}
                out.append((doc, bytes(flags), np.array(shares(text, words)).tobytes(), np.fromiter(found, np.uint32, len(found)).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        memo.clear()
        give_back()

    rows = labelled_sample(docs, labels, chain, sample).mapInArrow(featurise, "doc bigint, labels binary, dense binary, hashed binary")
    got = rows.toArrow()
    hashes = got.column("hashed")
    got = got.drop_columns("hashed").to_pydict()
    once = {d: i for i, d in enumerate(got["doc"])}  # repeated documents count once
    keep = sorted(once.values(), key=lambda i: got["doc"][i])
    sizes = [len(hashes[i].as_buffer()) // 4 for i in keep]
    hashed = np.empty(sum(sizes), np.int32)
    for i, n, end in zip(keep, sizes, np.cumsum(sizes), strict=True):
        hashed[end - n : end] = np.frombuffer(hashes[i].as_buffer(), np.int32)
    del hashes, rows
    give_back()
    entries = Entries(np.repeat(np.arange(len(keep), dtype=np.int32), sizes), hashed)
    dense = np.array([np.frombuffer(got["dense"][i]) for i in keep]).reshape(-1, DENSE)
    y = np.array([list(got["labels"][i]) for i in keep]).reshape(-1, len(chain))
    ids = np.array([got["doc"][i] for i in keep], np.int64)
    folds = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % FOLDS
    model = train(entries, dense, folds, y, tuple(n for n, _ in chain))
    del entries, hashed, dense, got  # a hundred MB, which the driver needs for its plans in what follows
    give_back()
    return model


def probabilities(docs: DataFrame, model: Chain) -> DataFrame:
    """``docs`` with ``__p``: an array of the categories' probabilities."""
    wanted = model.features()
    schema = pa.schema([("p", pa.list_(pa.float64()))])
    places = []
    for m in model.models:
        table = np.full(len(wanted), -1)
        table[np.searchsorted(wanted, m.features)] = np.arange(len(m.features))
        places.append(table)

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        drop_kept()
        index = {int(f): i for i, f in enumerate(wanted)}
        memo = Memo(lambda w: tuple(index[f] for f in word_features(w) if f in index), WORDS)

        def some(texts: pa.Array) -> list[np.ndarray]:
            rows, found, dense = [], [], []
            for k, text in enumerate(texts.to_pylist()):
                words = WORD.findall(text.lower())
                hits = set().union(*map(memo.__getitem__, set(words)))
                rows += [k] * len(hits)
                found += hits
                dense.append(shares(text, words))
            at, of = np.array(found, np.int64), np.array(rows, np.int64)
            known = np.array(dense).reshape(-1, DENSE)
            for m, table in zip(model.models, places, strict=True):
                columns = table[at] if len(at) else at
                p = m.score(of[columns >= 0], columns[columns >= 0], known)
                known = np.column_stack([known, p])
            return list(known[:, DENSE:])

        for batch in texts:
            yield pa.array([p for start in range(0, len(batch), SCORED) for p in some(batch.slice(start, SCORED))], schema.field("p").type)
        memo.clear()
        index.clear()
        give_back()

    from pyspark.sql.pandas.functions import arrow_udf

    return docs.withColumn("__p", arrow_udf(score, "array<double>")(whole_text()))


def classify(docs: DataFrame, labels: DataFrame, chain=CHAIN, sample: int = SAMPLE) -> DataFrame:
    """doc_id, p_<category>... and is_<category>... for every document."""
    model = fit_chain(docs, labels, chain, sample)
    scored = probabilities(docs.select("doc_id", "text"), model)
    ps = [F.col("__p")[k].alias(f"p_{n}") for k, n in enumerate(model.names)]
    flags = [(F.col("__p")[k] >= t).alias(f"is_{n}") for k, (n, t) in enumerate(zip(model.names, model.thresholds, strict=True))]
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), *ps, *flags)


def reject_toxic(docs: DataFrame, labels: DataFrame, category: str = "toxic", chain=CHAIN, sample: int = SAMPLE) -> DataFrame:
    """The documents that are not in the category, with all their columns."""
    model = fit_chain(docs, labels, chain, sample)
    k = model.names.index(category)
    return probabilities(docs, model).where(F.col("__p")[k] < model.thresholds[k]).select(*docs.columns)
