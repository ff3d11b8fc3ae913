"""Hierarchical language identification: family first, then one-versus-one linear SVMs within it.

A text's letters become counts of hashed byte n-grams (2 to 4 bytes, within and across words). The family is that of the
highest of one-versus-rest linear SVMs; the language is the one with the most wins among the pairwise SVMs of its family.
The counts of the sample are made where its texts are; each binary problem is a group of sparse rows and is fitted by itself, so
that problems spread over tasks. The other families' rows of a family's problem come from a pool of ``POOL`` rows at most.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.llm.common import mix, remainder, small_batches, stored, table

#: Slots of the sample: at most so many documents of each language are learned from.
SAMPLE = 600
#: Labelled rows in all: with more than 64 languages each has a smaller sample, of one row at least.
ROWS = 38_400
BUCKETS = 1 << 12
EPOCHS, C = 6, 1.0
UNKNOWN = "und"
#: Rows of all languages that the problems of families hold as the other families' rows, at most.
POOL = 4800

#: Languages that are hard to tell apart share a family; one that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa", "ur"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
    "sinitic": ("zh", "yue"),
}

_WORD_CHARACTER = re.compile(r"[^\W\d_]")
_KEEP = np.full(256, 32, np.uint8)
for _b in (*range(97, 123), *range(128, 256)):
    _KEEP[_b] = _b


def family_of(lang: str, families=FAMILIES) -> str:
    return next((f for f, members in families.items() if lang in members), lang)


def ngrams(text: str) -> np.ndarray:
    """Buckets of the byte n-grams of a text's letters; other bytes are one space."""
    b = _KEEP[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])].astype(np.uint64)
    two = b[:-1] * np.uint64(257) + b[1:]
    three = two[:-1] * np.uint64(257) + b[2:]
    four = three[:-1] * np.uint64(257) + b[3:]
    return (mix(np.concatenate([two, three, four])) & np.uint64(BUCKETS - 1)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    """Whether a character of the categories L is in the text; numbers such as fractions and Roman numerals are none."""
    return bool(text) and any(m[0].isalpha() for m in _WORD_CHARACTER.finditer(text))


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams in order, and the square roots of their counts, scaled to length 1."""
    at, counts = np.unique(ngrams(text), return_counts=True)
    x = np.sqrt(counts.astype(np.float32))
    return at, x / max(1e-9, float(np.sqrt(x @ x)))


def vector(text: str) -> np.ndarray:
    out = np.zeros(BUCKETS, np.float32)
    at, x = sparse(text)
    out[at] = x
    return out


def svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, c: float = C) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss over sparse rows, by dual coordinate descent in a fixed order."""
    n = len(rows)
    w, alpha = np.zeros(BUCKETS + 1, np.float32), np.zeros(n)
    cost = {s: c * n / (2 * max(1, (y == s).sum())) for s in (-1, 1)}
    diagonal = [0.5 / cost[int(s)] for s in y]
    q = [float(x @ x) + 1 + d for (_, x), d in zip(rows, diagonal, strict=True)]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(n).tolist():
            at, x = rows[i]
            g = y[i] * (float(w[at] @ x) + float(w[-1])) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - g / q[i])
            if new != alpha[i]:
                step = np.float32((new - alpha[i]) * y[i])
                w[at] += step * x
                w[-1] += step
                alpha[i] = new
    return w


def fragments(text: str, rng) -> list[str]:
    """The whole text and a few short runs of its words, so that short texts are learned too."""
    ws = text.split()
    out = [text]
    for size in (1, 3, 8):
        if len(ws) > size:
            at = int(rng.integers(0, len(ws) - size + 1))
            out.append(" ".join(ws[at : at + size]))
    return out


def _features(families):
    """Sparse rows of the texts of a sample and of runs of their words."""

    def run(batches):
        for batch in batches:
            out = []
            for h, text, lang in zip(batch.h, batch.text, batch.lang, strict=True):
                parts = fragments(text, np.random.default_rng([11, int(h) & (1 << 63) - 1])) if has_letter(text) else []
                for part, f in enumerate(parts):
                    if has_letter(f):
                        at, x = sparse(f)
                        out.append((int(h), part, lang, family_of(lang, families), at.astype(np.uint16).tobytes(), x.tobytes()))
            yield pd.DataFrame(out, columns=["h", "part", "lang", "family", "at", "x"])

    return run


def _rows(frame: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(x, np.float32)) for a, x in zip(frame["at"], frame.x, strict=True)]


_MODEL = "kind string, a string, b string, w binary"


def _family_problem(pool: pd.DataFrame):
    """One family against the pool's rows of the others."""

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "part", "lang"])
        family = part.family.iloc[0]
        others = pool[pool.family != family]
        y = np.concatenate([np.ones(len(part)), -np.ones(len(others))])
        w = svm(_rows(part) + _rows(others), y) if len(others) else np.zeros(BUCKETS + 1, np.float32)
        return pd.DataFrame({"kind": ["family"], "a": [family], "b": [""], "w": [w.tobytes()]})

    return fit


def _pair_problem(part: pd.DataFrame) -> pd.DataFrame:
    """Two languages of a family; a language that has its family to itself meets nobody."""
    part = part.sort_values(["h", "part", "lang"])
    a, b = part.a.iloc[0], part.b.iloc[0]
    w = svm(_rows(part), np.where(part.lang == a, 1, -1)) if a != b else np.zeros(BUCKETS + 1, np.float32)
    return pd.DataFrame({"kind": ["pair"], "a": [a], "b": [b], "w": [w.tobytes()]})


def fit(rows: DataFrame, families=FAMILIES, pool: int = POOL) -> list[tuple[str, str, str, np.ndarray]]:
    """(kind, a, b, weights) of each binary problem over rows h, text, lang: 16 KB a problem come to the driver."""
    made = stored(
        rows.select("h", "text", "lang").mapInPandas(
            _features(families), "h long, part int, lang string, family string, at binary, x binary"
        )
    )
    others = made.orderBy(F.xxhash64("h", "part", "lang"), "h", "part", "lang").limit(pool).toPandas()  # at most POOL rows
    tops = made.groupBy("family").applyInPandas(_family_problem(others), _MODEL)
    langs = made.select("family", "lang").distinct()
    alone = langs.groupBy("family").agg(F.count("*").alias("n"), F.min("lang").alias("a")).where("n = 1").select(
        "family", "a", F.col("a").alias("b")
    )
    pairs = langs.select("family", F.col("lang").alias("a")).join(langs.select("family", F.col("lang").alias("b")), "family").where("a < b")
    pairs = pairs.unionByName(alone).withColumnRenamed("family", "of")
    of_pair = made.join(pairs, (F.col("family") == F.col("of")) & (F.col("lang").isin(F.col("a"), F.col("b"))))
    bottoms = of_pair.groupBy("a", "b").applyInPandas(_pair_problem, _MODEL)
    model = tops.unionByName(bottoms).collect()
    return sorted(((r.kind, r.a, r.b, np.frombuffer(bytes(r.w), np.float32)) for r in model), key=lambda m: m[:3])


class Classifier:
    def __init__(self, model: list[tuple[str, str, str, np.ndarray]], families=FAMILIES):
        self.names = [m[:3] for m in model]
        self.w = np.stack([w[:-1] for *_, w in model]) if model else np.zeros((0, BUCKETS), np.float32)
        self.b = np.array([w[-1] for *_, w in model])
        self.tops = [k for k, (kind, _, _) in enumerate(self.names) if kind == "family"]
        self.pairs: dict[str, list[int]] = {}
        for k, (kind, a, _) in enumerate(self.names):
            if kind == "pair":
                self.pairs.setdefault(family_of(a, families), []).append(k)

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not self.names or not has_letter(text):
            return UNKNOWN, 0.0
        z = self.w @ vector(text) + self.b
        top = max(self.tops, key=lambda k: z[k])
        sure = 1 / (1 + np.exp(-4 * float(z[top]))) if len(self.tops) > 1 else 1.0
        wins: dict[str, float] = {}
        least: dict[str, float] = {}
        for j in self.pairs[self.names[top][1]]:
            _, a, b = self.names[j]
            if a == b:
                return a, float(sure)
            for lang, margin in ((a, float(z[j])), (b, -float(z[j]))):
                wins[lang] = wins.get(lang, 0) + (margin > 0) + 1e-3 * np.tanh(margin)
                least[lang] = min(least.get(lang, 9e9), margin)
        best = max(sorted(wins), key=lambda lang: wins[lang])
        return best, float(sure / (1 + np.exp(-4 * least[best])))


def language_id(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, families=FAMILIES
) -> DataFrame:
    """id, held_out, lang_pred, score: one row a row of df.

    Learned from rows with a language whose id's crc32 modulo 4 is not 2, at most ``sample`` of a language
    and ``ROWS`` in all, or one of each language if there are more languages than that. A text that
    is null or has no letter (a character of the categories L) is ``und`` with score 0; so is every text if nothing could be learned. A null id is classified
    and never learned from; repeated rows each give their row. Only the named columns are read.
    """
    small_batches(df)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    able = docs.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & (remainder("id") != 2))
    slots = able.withColumn("h", F.xxhash64("id")).groupBy("lang", F.pmod("h", F.lit(sample)).alias("slot")).agg(F.min("h").alias("h"))
    each = F.floor(F.lit(ROWS) / F.greatest(F.lit(1), F.countDistinct("lang")))
    share = slots.agg(F.greatest(F.lit(1), F.least(F.lit(sample), each)).alias("share"))
    drawn = slots.crossJoin(F.broadcast(share)).groupBy(F.col("lang").alias("its"), F.pmod("slot", "share").alias("slot")).agg(
        F.min("h").alias("h")
    ).drop("slot")
    rows = able.withColumn("h", F.xxhash64("id")).join(F.broadcast(drawn), "h").where(F.col("lang") == F.col("its")).select(
        "id", "text", "lang"
    ).dropDuplicates(["id"])

    model = fit(rows.withColumn("h", F.xxhash64("id")), families)
    id_type = df.schema[id_col].dataType.simpleString()

    def classify(batches):
        c = Classifier(model, families)
        for batch in batches:
            found = [c(t) for t in batch.text]
            yield pd.DataFrame(
                {
                    "id": batch.id.to_numpy(),
                    "held_out": batch.held_out.to_numpy(),
                    "lang_pred": [f[0] for f in found],
                    "score": [f[1] for f in found],
                }
            )

    out = docs.select("id", "text", F.coalesce(remainder("id") == 2, F.lit(False)).alias("held_out")).mapInPandas(
        classify, f"id {id_type}, held_out boolean, lang_pred string, score double"
    )
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
