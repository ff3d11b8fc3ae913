"""Toxicity by a counterfactually regularised linear classifier.

A text becomes the set of its lower-case words and of the first four characters of each (so that inflected insults share
a feature). Of a bounded sample of labelled documents the features that tell the labels apart best are kept, and a
logistic model is fitted to

    mean log-loss + L2 |w|^2 + penalty * mean over pairs (w.x - w.x')^2

where x' is a sampled document with each identity term swapped for another of the same group. A term of identity that
happens to be frequent in toxic documents thus gains no weight of its own, as it must score like its swaps.

Features are made where the texts are, and counted and chosen by aggregates; the task that fits the model gets the places
of each document's chosen features, and of those that a swap adds and removes, and never a text.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.llm.common import remainder, run_hashes, small_batches, stored, table

#: Most labelled rows of each class that the model is fitted on, drawn by a hash of the id.
SAMPLE = 3000
FEATURES, PENALTY, L2, STEPS = 4000, 4.0, 2e-4, 400
#: Documents of the sample that must have a feature.
LEAST = 3
PREDICT_AT = 0.3

#: Terms within a group are swapped for each other.
IDENTITY_GROUPS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "protestant", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "protestants", "atheists"),
    ("man", "woman"), ("men", "women"), ("male", "female"), ("boy", "girl"), ("he", "she"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "queer"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "american"),
    ("young", "old"), ("blind", "deaf", "disabled"), ("immigrant", "native"), ("immigrants", "natives"),
    ("homme", "femme"), ("hommes", "femmes"), ("musulman", "chrétien", "juif"), ("noir", "blanc"),
    ("mann", "frau"), ("männer", "frauen"), ("muslime", "christen", "juden"), ("schwarze", "weiße"),
    ("hombre", "mujer"), ("hombres", "mujeres"), ("musulmán", "cristiano", "judío"), ("negro", "blanco"),
)

_TERM = re.compile(r"[^\W_]+")


def _hashes(terms: list[str]) -> np.ndarray:
    if not terms:
        return np.zeros(0, np.uint64)
    data = "\0".join(terms).encode("utf-8", "surrogatepass")
    b = np.frombuffer(data, np.uint8)
    cut = np.flatnonzero(b == 0)
    return run_hashes(b, np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(b)]]))


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's words and prefixes."""
    terms = set(_TERM.findall(text.lower())) if text else set()
    return np.unique(_hashes([*terms, *{f"{t[:4]}~" for t in terms if len(t) > 4}]))


def swaps(text: str | None, groups=IDENTITY_GROUPS) -> list[str]:
    """The text with each identity term replaced by the next of its group; by the one after that; and so on."""
    turn = {t: g for g in groups for t in g}
    if not text or not turn.keys() & set(_TERM.findall(low := text.lower())):
        return []
    n = max(len(turn[t]) for t in _TERM.findall(low) if t in turn) - 1
    put = lambda k: _TERM.sub(lambda m: (g := turn.get(m[0])) and g[(g.index(m[0]) + k) % len(g)] or m[0], low)
    return list(dict.fromkeys(x for k in range(1, n + 1) if (x := put(k)) != low))


def changes(text: str | None, groups=IDENTITY_GROUPS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each swap of a text the features that it adds and those that it removes."""
    own = features(text)
    return [
        (np.setdiff1d(other, own, assume_unique=True), np.setdiff1d(own, other, assume_unique=True)) for other in map(
            features, swaps(text, groups)
        )
    ]


def gains(there, bad, n: float, n_bad: float):
    """How well a feature in ``there`` documents, of which ``bad`` are toxic, tells n_bad of n documents apart; for arrays or columns."""
    return (bad - there * n_bad / n) * (bad - there * n_bad / n) / (there * (1 - there / (n + 1)))


def choose(rows: list[np.ndarray], toxic: np.ndarray, n_features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """The features, in order, that tell the labels apart best, and their log-odds."""
    every, inverse = np.unique(np.concatenate([*rows, np.zeros(0, np.uint64)]), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    there, bad = np.bincount(inverse, minlength=len(every)).astype(float), np.bincount(inverse, weights=toxic[owner], minlength=len(every))
    some = np.flatnonzero(there >= LEAST)
    gain = gains(there[some], bad[some], len(rows), toxic.sum())
    best = some[np.lexsort((every[some], -gain))[:n_features]]
    best = np.sort(best[gains(there[best], bad[best], len(rows), toxic.sum()) > 0])
    return every[best], log_odds(there[best], bad[best], len(rows), toxic.sum())


def log_odds(there: np.ndarray, bad: np.ndarray, n: float, n_bad: float) -> np.ndarray:
    return np.log((bad + 0.5) / (n_bad + 1)) - np.log((there - bad + 0.5) / (n - n_bad + 1))


def places(hashes: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Where hashes are among the kept features; others are left out."""
    at = np.searchsorted(kept, hashes)
    return at[kept[np.minimum(at, len(kept) - 1)] == hashes] if len(kept) else at[:0]


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by place; numpy counts in integers where there is none."""
    return np.bincount(at, weights=values, minlength=n).astype(float)


class Sample:
    """Documents as places of features, with labels, and pairs of a document and a swap as places added and removed."""

    def __init__(self, rows: list[np.ndarray], toxic: np.ndarray, swapped: list[tuple[np.ndarray, np.ndarray]], m: int, penalty: float):
        def flat(sets):
            return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate([*sets, np.zeros(0, int)]).astype(int)

        self.toxic, self.m, self.penalty, self.n, self.pairs = toxic, m, penalty, len(rows), len(swapped)
        (self.r, self.c), (self.r1, self.c1), (self.r2, self.c2) = flat(rows), flat([b for _, b in swapped]), flat([a for a, _ in swapped])
        n_bad = toxic.sum()
        self.each = np.where(toxic > 0, 0.5 / n_bad, 0.5 / (self.n - n_bad))

    def objective(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        """Loss, and its gradient by the weights and the intercept."""
        z = np.clip(_sums(self.r, w[self.c], self.n) + b, -40, 40)
        p = 1 / (1 + np.exp(-z))
        loss = float(self.each @ (np.logaddexp(0, z) - self.toxic * z)) + L2 / 2 * float(w @ w)
        e = self.each * (p - self.toxic)
        g = _sums(self.c, e[self.r], self.m) + L2 * w
        if self.pairs:
            gap = _sums(self.r1, w[self.c1], self.pairs) - _sums(self.r2, w[self.c2], self.pairs)
            loss += self.penalty * float(gap @ gap) / self.pairs
            gap *= 2 * self.penalty / self.pairs
            g += _sums(self.c1, gap[self.r1], self.m) - _sums(self.c2, gap[self.r2], self.m)
        return loss, g, float(e.sum())

    def fit(self, prior: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights and intercept by AdaGrad over the whole sample, which is deterministic."""
        w, b = 0.2 * np.clip(prior, -2, 2), float(np.log(self.toxic.sum() / (self.n - self.toxic.sum())))
        step, squares, square_b = 0.3, np.full(self.m, 1e-8), 1e-8
        for _ in range(STEPS):
            _, g, g_b = self.objective(w, b)
            squares += g * g
            w -= step * g / np.sqrt(squares)
            square_b += g_b**2
            b -= step * g_b / np.sqrt(square_b)
        return w, b


def constant(toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Without labels of both classes: no features, and the clipped share of toxic labels."""
    base = float(np.clip(toxic.mean() if len(toxic) else 0.0, 0.01, 0.99))
    return np.zeros(0, np.uint64), np.zeros(0), float(np.log(base / (1 - base)))


def fit(texts: list[str], toxic: np.ndarray, groups=IDENTITY_GROUPS, n_features: int = FEATURES, penalty: float = PENALTY) -> tuple[
    np.ndarray, np.ndarray, float
]:
    """Feature hashes, their weights, and the intercept, of texts at hand."""
    toxic = np.asarray(toxic, float)
    if not len(toxic) or toxic.min() == toxic.max():
        return constant(toxic)
    rows = [features(t) for t in texts]
    kept, prior = choose(rows, toxic, n_features)
    swapped = [(places(a, kept), places(b, kept)) for t in texts for a, b in changes(t, groups)]
    return kept, *Sample([places(r, kept) for r in rows], toxic, swapped, len(kept), penalty).fit(prior)


def fit_rows(rows: DataFrame, groups=IDENTITY_GROUPS, n_features: int = FEATURES, penalty: float = PENALTY) -> tuple[
    np.ndarray, np.ndarray, float
]:
    """As ``fit``, of rows label_id, text, label: at most n_features counts and weights come to the driver."""

    def make(batches):
        for batch in batches:
            out = []
            for i, text, label in zip(batch.label_id, batch.text, batch.label, strict=True):
                swapped = [[x.view(np.int64) for x in pair] for pair in changes(text, groups)]
                out.append((i, label, features(text).view(np.int64), [a for a, _ in swapped], [b for _, b in swapped]))
            yield pd.DataFrame(out, columns=["label_id", "label", "has", "adds", "drops"])

    id_type = rows.schema["label_id"].dataType.simpleString()
    made = stored(
        rows.mapInPandas(make, f"label_id {id_type}, label int, has array<long>, adds array<array<long>>, drops array<array<long>>")
    )
    n, n_bad = made.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < n_bad < n:
        return constant(np.repeat([1.0, 0.0], [n_bad, n - n_bad]))
    counts = made.select("label", F.explode("has").alias("h")).groupBy("h").agg(
        F.count("*").cast("double").alias("there"), F.sum("label").cast("double").alias("bad")
    )
    counts = counts.where(F.col("there") >= LEAST).withColumn(
        "gain", gains(F.col("there"), F.col("bad"), float(n), float(n_bad))
    ).where("gain > 0")
    unsigned = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    best = counts.orderBy(F.col("gain").desc(), unsigned).limit(n_features).toPandas()
    kept = best.h.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(kept)
    kept, there, bad = kept[order], best.there.to_numpy()[order], best.bad.to_numpy()[order]
    prior = log_odds(there, bad, n, n_bad)

    def place(batches):
        at = lambda x: places(np.asarray(x, np.int64).view(np.uint64), kept).tolist()
        for batch in batches:
            yield pd.DataFrame(
                {
                    "label_id": batch.label_id,
                    "label": batch.label,
                    "has": [at(x) for x in batch.has],
                    **{c: [[at(x) for x in xs] for xs in batch[c]] for c in ("adds", "drops")},
                }
            )

    placed = made.mapInPandas(place, f"label_id {id_type}, label int, has array<int>, adds array<array<int>>, drops array<array<int>>")

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("label_id")
        ints = lambda xs: [np.asarray(x, int) for x in xs]
        swapped = [pair for adds, drops in zip(part.adds, part.drops, strict=True) for pair in zip(ints(adds), ints(drops), strict=True)]
        w, b = Sample(ints(part.has), part.label.to_numpy(float), swapped, len(kept), penalty).fit(prior)
        return pd.DataFrame({"w": [w.tolist()], "b": [b]})

    r = placed.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(learn, "w array<double>, b double").first()
    return kept, np.array(r.w, float), r.b


class Scorer:
    def __init__(self, kept: np.ndarray, weights: np.ndarray, intercept: float):
        self.kept, self.weights, self.intercept = kept, weights, intercept
        self.near = np.zeros(1 << 20, bool)  # by the hash's top bits: most terms go no further
        self.near[(kept >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, text: str | None) -> float:
        z = self.intercept
        if text and len(self.kept):
            h = features(text)
            h = h[self.near[(h >> np.uint64(44)).astype(np.int64)]]
            at = np.minimum(np.searchsorted(self.kept, h), len(self.kept) - 1)
            z += float(self.weights[at[self.kept[at] == h]].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def toxicity(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
    groups=IDENTITY_GROUPS,
    penalty: float = PENALTY,
) -> DataFrame:
    """id, held_out, score, predicted: one row a row of df.

    Only labelled ids whose crc32 modulo 4 is not 2 are learned from, at most ``sample`` of each class. A null or empty
    text gets the score of the intercept; a null id is scored, is not held out and never learned from; repeated rows each
    give their row. Without labels of both classes every score is the clipped share of toxic labels. Only the named
    columns are read.
    """
    small_batches(df)
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (remainder(id_col) != 2))
    known = usable.groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("int").alias("label"))
    drawn = lambda x: known.where(F.col("label") == x).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    ids = drawn(1).unionByName(drawn(0))  # at most 2 * sample rows: the bound of the broadcast
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = docs.join(F.broadcast(ids), F.col("id") == F.col("label_id")).select("label_id", "text", "label").dropDuplicates(["label_id"])

    scorer = fit_rows(rows, groups, penalty=penalty)
    id_type = df.schema[id_col].dataType.simpleString()

    def score(batches):
        s = Scorer(*scorer)
        for batch in batches:
            yield pd.DataFrame({"id": batch.id.to_numpy(), "held_out": batch.held_out.to_numpy(), "score": [s(t) for t in batch.text]})

    scored = docs.withColumn("held_out", F.coalesce(remainder("id") == 2, F.lit(False))).mapInPandas(
        score, f"id {id_type}, held_out boolean, score double"
    )
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
