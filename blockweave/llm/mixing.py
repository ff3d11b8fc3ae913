"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a target total of words, so each of its documents is to be taken target / size times on average. The flight phase
moves the vector of these numbers, each between 0 and the most copies, through the null space of two constraints, the expected number
of words and of documents. The longest document whose number is no integer leads each move, until its own number is one or another's
reaches an end, and all others make up for it by a little; so long documents are decided while many short ones can still balance
them. The flight runs in blocks of a source, dealt by hash; each leaves at most two undecided documents, which meet in fewer
blocks in the next round, until a source has one block, whatever the others have. There the flight ends with ``LANDING`` open
documents at most, and these are the landing problem: of all distributions over their numbers of copies that keep each document's
mean, a linear program finds the one whose words and documents miss the targets least on average, and one is drawn from it. Every
move of the flight has mean 0 as well, so the mean number of copies of each document is kept from the first move to the draw.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.llm.common import WORD, cut, grouped, table

#: Documents in a block of the flight phase.
BLOCK = 4096
#: Open documents with which the flight ends: the linear program is over MOST + 1 to that power selections.
LANDING = 6
#: No document is taken more often.
MOST = 3
#: Sources whose totals are broadcast, at most; with more the totals are joined in shares.
SOURCES, SHARES = 10_000, 64
EPS = 1e-9


def _whole(q: np.ndarray) -> np.ndarray:
    """Whether a number of copies is an integer."""
    return np.abs(q - np.round(q)) < EPS


def _flight(q: np.ndarray, size: np.ndarray, rng, leave: int = 2, most: int = MOST) -> np.ndarray:
    """Numbers of copies after the flight phase: all are integers but ``leave`` at most, or two where words and documents allow no more.

    A move goes along the projection of the longest open document onto the null space, in the metric of q (most - q), up or down by
    chances that make its mean 0.
    """
    q = np.where(_whole(q), np.round(q), q)
    open_ = np.flatnonzero(~_whole(q))
    open_ = open_[np.lexsort((open_, -size[open_]))]  # the longest first
    x, y = size[open_] / max(1.0, float(size.max(initial=1))), q[open_]
    while len(y) > leave:
        d = y * (most - y)
        total = float(d.sum())
        words = x - float(d @ x) / total
        spread = float(d @ (words * words))
        for lead in range(min(len(y), 3)):  # the first may be the only one of its size, which cannot move then
            v = -d / total - (d * words * (words[lead] / spread) if spread > 1e-18 else 0.0)
            v[lead] += 1.0
            if np.abs(v).max() > 1e-9:
                break
        else:
            break
        v /= np.abs(v).max()
        high, low = np.full(len(y), float(most)), np.zeros(len(y))
        high[lead], low[lead] = np.ceil(y[lead]), np.floor(y[lead])
        moving = np.flatnonzero(np.abs(v) > 1e-12)
        above, below = (high - y)[moving] / np.abs(v[moving]), (y - low)[moving] / np.abs(v[moving])
        up = float(np.where(v[moving] > 0, above, below).min())
        down = float(np.where(v[moving] > 0, below, above).min())
        y = y + (up if rng.random() * (up + down) < down else -down) * v
        done = (y < EPS) | (y > most - EPS)
        done[lead] |= _whole(y[lead])
        if not done.any():  # rounding: the lead has reached an integer
            done[lead] = True
        q[open_[done]] = np.round(y[done])
        open_, x, y = open_[~done], x[~done], y[~done]
    q[open_] = y
    return q


def _selections(q: np.ndarray, cost, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of copies and their probabilities: of all distributions with means q that of least mean cost.

    The simplex method over all (most + 1)^n selections. It starts with the integers below and the nested sets of documents of which one
    copy more is likeliest, and any step it ends at keeps the means.
    """
    n, base = len(q), most + 1
    unit = base ** np.arange(n)
    every = ((np.arange(base**n)[:, None] // unit) % base).astype(float)
    a = np.hstack([np.ones((base**n, 1)), every])
    b, c = np.append(1.0, q), cost(every)
    order = np.argsort(-(q - np.floor(q)), kind="stable")
    least = int((np.floor(q) * unit).sum())
    basis = np.array([least + int(unit[order[:m]].sum()) for m in range(n + 1)])
    x = np.linalg.solve(a[basis].T, b)
    for _ in range(50 * (n + 1)):
        inverse = np.linalg.inv(a[basis].T)
        x = np.maximum(inverse @ b, 0.0)
        gain = c - a @ (inverse.T @ c[basis])
        enter = int(np.argmin(np.round(gain, 9)))
        if gain[enter] > -1e-9:
            break
        step = inverse @ a[enter]
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        basis[int(np.argmin(ratio))] = enter
    return every[basis], x / x.sum()


def _landing(q: np.ndarray, size: np.ndarray, rng) -> np.ndarray:
    """What the flight has left becomes integers, with the means left, by a draw that keeps words and documents near their totals."""
    q = np.where(_whole(q), np.round(q), q)
    open_ = np.flatnonzero(~_whole(q))
    if len(open_):
        own, mean = size[open_], q[open_]
        scale = max(1.0, float(size.mean()))
        selections, weights = _selections(mean, lambda s: np.abs((s - mean) @ own) / scale + 0.1 * np.abs((s - mean).sum(axis=1)))
        q[open_] = selections[int(np.searchsorted(np.cumsum(weights)[:-1], rng.random(), side="right"))]
    return q


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with their rank in code point order, null last: sorted in ranges, and numbered by the sizes of the ranges."""
    ordered = cut(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    before, offsets = 0, [F.lit(0).alias("none")]
    for r in ordered.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row a range
        offsets.append(F.lit(r.part))
        offsets.append(F.lit(before))
        before += r["count"]
    offset = F.create_map(*offsets[1:]) if before else F.create_map(F.lit(0), F.lit(0))
    return ordered.withColumn("rank", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.element_at(offset, part.cast("long"))).drop("at")


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> with target: shares by weight 1, 2, 3, 1, ... in order of the source, null last.

    A target stops at MOST times its source's size and the excess is shared again by weight until none is above. One row a source.
    Each round is a sum over all sources; a source that stops stays so.
    """
    ranked = cut(
        _ranked(sources)
        .withColumn("weight", (F.col("rank") % 3 + 1).cast("double"))
        .withColumn("cap", F.col("source_size").cast("double") * MOST)
        .select("source", "source_size", "weight", "cap")
    )
    level, stopped = None, -1
    while True:
        stops = F.lit(False) if level is None else F.col("cap") < F.lit(level) * F.col("weight")
        free = F.when(~stops, F.col("weight")).otherwise(0.0)
        held = F.when(stops, F.col("cap")).otherwise(0.0)
        r = ranked.agg(
            F.sum("source_size").alias("total"), F.sum(free).alias("weights"), F.sum(held).alias("held"), F.count_if(stops).alias("stopped")
        ).first()
        if r.stopped == stopped or not r.weights:
            break
        stopped, level = r.stopped, max(level or 0.0, (float(r.total) - r.held) / r.weights)
    shared = F.least("cap", F.lit(0.0 if level is None else level) * F.col("weight"))
    return ranked.select("source", "source_size", shared.alias("target"))


def row_hash(id_col: str, text_col: str, seed: int = 9):
    return F.xxhash64(F.lit(seed), id_col, text_col)


def _with_totals(units: DataFrame, goal: DataFrame) -> DataFrame:
    """units with the totals of their source, which are broadcast if few, else joined in shares of a source's rows."""
    units = units.withColumnRenamed("source", "of")
    match = F.col("of").eqNullSafe(F.col("source"))
    if goal.count() <= SOURCES:
        return units.join(F.broadcast(goal), match)
    shares = goal.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    units = units.withColumn("own", F.pmod(F.xxhash64("h", "ordinal"), F.lit(SHARES)).cast("int"))
    return units.join(shares, match & (F.col("own") == F.col("share"))).drop("own", "share")


def _open(q: str) -> Column:
    return F.abs(F.col(q) - F.round(F.col(q))) >= EPS


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = 9
) -> DataFrame:
    """id, size, source_size, target, copies, taken: one row a row of df; taken = copies * size.

    A null or empty text has size 0 and is never taken. A null source is a source of its own, the last; sources may be of any type
    that sorts. Rows repeated in full are documents of their own, told apart by an ordinal, with equal chances. A null id takes
    part like any other. Reruns on the same rows agree, however they are partitioned. Only the named columns are read; an
    empty table gives no rows.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    docs = df.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), row_hash(id_col, text_col, seed).alias("h")
    )
    docs = cut(docs)  # ids, sources and sizes only: the texts are read once
    sizes = cut(docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    counts = sizes.select(F.col("source").alias("s2"), "n")
    goal = cut(targets(sizes.select("source", "source_size")).join(counts, F.col("source").eqNullSafe(F.col("s2"))).drop("s2"))
    # One row for each equal (id, source, size, hash): such rows share their fate up to an ordinal.
    units = docs.groupBy("id", "source", "size", "h").agg(F.count("*").alias("times"))
    units = units.withColumn("ordinal", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    stopped = F.when(F.col("source_size") > 0, float(MOST)).otherwise(0.0)
    units = _with_totals(units, goal).withColumn("rate", F.when(F.col("target") >= MOST * F.col("source_size"), stopped).otherwise(rate))
    units = units.withColumn("q", F.when(F.col("size") > 0, F.col("rate")).otherwise(0.0))  # copies on average
    units = cut(units.select("id", "source", "size", "h", "ordinal", "source_size", "target", "n", "q"))

    def fly(salt: int):
        def run(batches):
            for g in grouped(batches, ["sh", "k"]):
                g = g.sort_values(["h", "ordinal", "size"], kind="stable")
                rng = np.random.default_rng([seed, salt, int(g.k.iloc[0]), int(g.sh.iloc[0]) & 0xFFFFFFFF])
                size = g["size"].to_numpy(float)
                land = g.n.iloc[0] <= block  # the source has this block only
                q = _flight(g.q.to_numpy(float), size, rng, LANDING if land else 2)
                g["q"] = _landing(q, size, rng) if land else q
                yield g

        return run

    open_ = units.where(_open("q")).select("source", F.xxhash64("source").alias("sh"), "size", "h", "ordinal", "n", "q", "id")
    most = sizes.agg(F.max("n")).first()[0] or 0
    types = {c: df.schema[x].dataType.simpleString() for c, x in (("id", id_col), ("source", source_col))}
    schema = f"source {types['source']}, sh long, size long, h long, ordinal int, n long, q double, id {types['id']}, k long"
    decided = None
    round_ = 0
    while True:
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block))).cast("long")
        last = most <= block
        flown = open_.withColumn("k", F.pmod(F.xxhash64(F.lit(round_), "h", "ordinal"), blocks))
        flown = cut(flown.repartition("sh", "k").sortWithinPartitions("sh", "k").mapInPandas(fly(round_), schema))
        done = flown.where(~_open("q")).select("sh", "h", "ordinal", "size", "id", "q")
        decided = done if decided is None else decided.unionByName(done)
        if last:
            break
        # Each block leaves two at most: a source's next number of rows is bounded by so many times its blocks.
        open_ = flown.where(_open("q")).withColumn("n", 2 * blocks).drop("k")
        most = 2 * -(-most // block)
        round_ += 1
    taken = decided.select(
        F.col("sh").alias("csh"),
        F.col("h").alias("ch"),
        F.col("ordinal").alias("co"),
        F.col("size").alias("cs"),
        F.col("id").alias("cid"),
        F.col("q").alias("drawn"),
    )
    same = (F.col("h") == F.col("ch")) & (F.col("ordinal") == F.col("co")) & (F.col("size") == F.col("cs"))
    out = units.join(taken, same & (F.xxhash64("source") == F.col("csh")) & F.col("id").eqNullSafe(F.col("cid")), "left")
    copies = F.round(F.coalesce("drawn", "q")).cast("long")
    return out.select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
        "h",
        "ordinal",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
