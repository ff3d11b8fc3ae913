"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents with the same words in the same order are one text. A text's shingles are its runs of five words. MinHash values in
bands put texts that may be alike in the same bucket. MinHash values of a pair are compared 16 at a time: with m of n equal and
a flat prior, the posterior probability that the similarity reaches 0.8 is P(Binomial(n + 1, 0.8) <= m); below the
tolerance the pair is dropped. Pairs that stay tie texts into families. In a bucket each text is first held against the least one;
only texts that this does not tie are held against the others, and only those with which they share no earlier bucket. Of buckets
that hold the same texts one is enough. At last the shingles of a family's texts are compared in full, again only for pairs
that share a bucket and outlast the pruning, and links are counted.

No group grows with the data: texts left in a bucket and the texts of a family are cut into blocks of about ``BLOCK``, and each pair of
blocks is a group of its own, which returns counts and a spanning forest of its links rather than the links.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.llm.common import Rolling, grouped, mix, small_batches, stored, table, whole_groups, word_hashes, words
from blockweave.llm.components import components

SHINGLE, TENTHS = 5, 8
BANDS, ROWS = 24, 4
#: A pair of similarity 0.8 shares no bucket with probability (1 - 0.8^4)^24 < 4e-6; pruning adds at most 12 tolerances.
TOLERANCE = 1e-7
STEP, BLOCK, SLICE = 16, 64, 500
#: Pairs whose MinHash values are compared at once, and the shares into which a key of many rows is cut where sizes meet rows.
CHUNK, SALTS, SPREAD = 1 << 16, 64, 16
_HASHES = BANDS * ROWS
_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, _HASHES, dtype=np.uint64)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of five words; all its words as one run if it has fewer."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    return np.unique(Rolling(h).windows(min(size, len(h)))) if len(h) else h


def minhash(sh: np.ndarray) -> np.ndarray:
    """The upper halves of the least values of 96 hash functions over a set of shingles."""
    out = np.full(_HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(sh), 2048):
        x = sh[at : at + 2048]
        np.minimum(out, (_A[:, None] * x[None, :] + _B[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def bands(signatures: np.ndarray) -> np.ndarray:
    """A hash for each band of each row of signatures; that of a band differs from those of all others."""
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(signatures), BANDS))
    rows = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return h


def least_matches(threshold: float = TENTHS / 10, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(n, the fewest equal values of n with which a pair stays) for n = 16, 32, ..."""
    out = []
    for n in range(STEP, _HASHES + 1, STEP):
        tail, m = 0.0, -1
        while True:
            tail += math.comb(n + 1, m + 1) * threshold ** (m + 1) * (1 - threshold) ** (n - m)
            if tail >= tolerance:
                break
            m += 1
        out.append((n, m + 1))
    return out


def outlast(i: np.ndarray, j: np.ndarray, signatures: np.ndarray, threshold: float = TENTHS / 10) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of rows of signatures that the posterior leaves, after 16 values, then 32, and so on."""
    equal = np.zeros(len(i), int)
    for n, least in least_matches(threshold):
        part = signatures[:, n - STEP : n]
        for at in range(0, len(i), CHUNK):
            x = slice(at, at + CHUNK)
            equal[x] += (part[i[x]] == part[j[x]]).sum(axis=1)
        stay = equal >= least
        i, j, equal = i[stay], j[stay], equal[stay]
        if not len(i):
            break
    return i, j


def alike(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray], tenths: int = TENTHS) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of sets whose similarity is tenths / 10 or more, by their whole shingles."""
    n = np.array([len(s) for s in sets])
    fits = 10 * np.minimum(n[i], n[j]) >= tenths * np.maximum(n[i], n[j])
    i, j = i[fits], j[fits]
    some = np.unique(np.concatenate([i, j]))
    every = np.unique(np.concatenate([sets[k] for k in some.tolist()])) if len(i) > 64 else None
    if every is not None and len(every) * len(some) <= 8e6:
        there = np.zeros((len(some), len(every)), np.float32)
        for row, k in enumerate(some.tolist()):
            there[row, np.searchsorted(every, sets[k])] = 1
        both = (there @ there.T)[np.searchsorted(some, i), np.searchsorted(some, j)].astype(np.int64)
    else:
        both = np.zeros(len(i), np.int64)
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            a, b = sets[x], sets[y]
            both[k] = (a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum()
    sure = 10 * both >= tenths * (n[i] + n[j] - both)
    return i[sure], j[sure]


def linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None = None, tenths: int = TENTHS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of either list, or within the first, whose similarity is tenths / 10 or more."""
    sets = [*sets_a, *(sets_b or ())]
    i, j = np.triu_indices(len(sets), 1)
    if sets_b is not None:
        across = (i < len(sets_a)) & (j >= len(sets_a))
        i, j = i[across], j[across]
    i, j = alike(*outlast(i, j, np.stack([minhash(s) for s in sets]), tenths / 10), sets, tenths)
    return i, j - (0 if sets_b is None else len(sets_a))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[int]:
    """For each of n rows the least row that the pairs (i, j) connect it with."""
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
    return [root(k) for k in range(n)]


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, _HASHES)


def _across(starts: np.ndarray, left: np.ndarray):
    """Pairs of a left and another row of one group, about CHUNK at a time."""
    us, vs, n = [], [], 0
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(left)], strict=True):
        own, other = np.flatnonzero(left[a:b]) + a, np.flatnonzero(~left[a:b]) + a
        us.append(np.repeat(own, len(other)))
        vs.append(np.tile(other, len(own)))
        n += len(us[-1])
        if n >= CHUNK:
            yield np.concatenate(us), np.concatenate(vs)
            us, vs, n = [], [], 0
    if n:
        yield np.concatenate(us), np.concatenate(vs)


def _near_hub(batches):
    """Whether a text and the least text of its bucket outlast the pruning."""
    for batch in batches:
        own, hub = _signatures(batch.column("sig")), _signatures(batch.column("hub_sig"))
        n = len(own)
        near = np.zeros(n, bool)
        near[outlast(np.arange(n), np.arange(n, 2 * n), np.concatenate([own, hub]))[0]] = True
        columns = [batch.column(c) for c in ("node", "k", "b", "hub", "members")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(near)], names=["node", "k", "b", "hub", "members", "near"])


def _bucket_edges(batches):
    """Of rows sorted by (b, bi, bj): a spanning forest of the pairs of a left and another row of a group that share no
    bucket of an earlier band and outlast the pruning."""

    def edges(t: pa.Table):
        col = {c: t.column(c).to_numpy() for c in ("node", "k", "b", "bi", "bj", "left", "near")}
        new = np.ones(len(t), bool)
        new[1:] = np.logical_or.reduce([col[c][1:] != col[c][:-1] for c in ("b", "bi", "bj")])
        sig = _signatures(t.column("sig"))
        band = bands(sig)
        us, vs = [], []
        for i, j in _across(np.flatnonzero(new), col["left"]):
            stay = col["near"][j] | (col["node"][i] < col["node"][j])
            i, j = i[stay], j[stay]
            k, here, before = col["k"][i], np.zeros(len(i), bool), np.zeros(len(i), bool)
            for at in range(int(k.max(initial=-1)) + 1):
                same = band[i, at] == band[j, at]
                here |= same & (k == at)
                before |= same & (at < k)
            i, j = outlast(i[here & ~before], j[here & ~before], sig)
            if len(i):
                some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                up = some[forest(at[: len(i)], at[len(i) :], len(some))]
                us.append(some[up != some])
                vs.append(up[up != some])
        if us:
            u, v = np.concatenate(us), np.concatenate(vs)
            return pa.RecordBatch.from_arrays([pa.array(col["node"][u]), pa.array(col["node"][v])], names=["u", "v"])
        return None

    for t in whole_groups(batches, ["b", "bi", "bj"]):
        if out := edges(t):
            yield out


def _compare(batches):
    """Of rows sorted by (fam, bi, bj): links of each text within the group, and a spanning forest of them."""
    for g in grouped(batches, ["fam", "bi", "bj"]):
        g = g.sort_values(["node", "sh"], kind="stable").drop_duplicates("node")
        left = (g.block == g.bi).to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in g.sh]
        sig = np.frombuffer(b"".join(g.sig), np.uint32).reshape(-1, _HASHES)
        nodes, band = g.node.to_numpy(), bands(sig)
        i, j = np.triu_indices(len(g), 1)
        if g.bi.iloc[0] != g.bj.iloc[0]:
            across = left[i] != left[j]
            i, j = i[across], j[across]
        shared = np.zeros(len(i), bool)
        for k in range(BANDS):
            shared |= band[i, k] == band[j, k]
        i, j = alike(*outlast(i[shared], j[shared], sig), sets)
        if len(i):
            links = np.bincount(np.concatenate([i, j]), minlength=len(g))
            some = np.flatnonzero(links)
            yield pd.DataFrame({"u": nodes[some], "v": nodes[np.array(forest(i, j, len(g)))[some]], "links": links[some]})


def node_id(id_col: str, text_col: str):
    """The id, or for a null a stand-in drawn from the text."""
    stand_in = -(F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 2)) - F.lit(1 << 61)
    return F.coalesce(F.col(id_col).cast("long"), stand_in)


def by_key(rows: DataFrame, key: str, spread: str, parts: list, wholes: list) -> DataFrame:
    """rows with aggregates over key: ``parts`` of each share of a key, ``wholes`` of its shares.

    Rows of a key are cut into SALTS shares by a hash of ``spread``, so that a key of many rows is no group anywhere.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    part = stored(salted.groupBy(F.col(key).alias("pkey"), F.col("salt").alias("psalt")).agg(*parts))
    whole = part.groupBy(F.col("pkey").alias("wkey")).agg(*wholes)
    each = part.select("pkey", "psalt").join(whole, F.col("pkey") == F.col("wkey")).drop("wkey")
    return salted.join(each, (F.col(key) == F.col("pkey")) & (F.col("salt") == F.col("psalt"))).drop("salt", "pkey", "psalt")


def _block(members: str, salt: int = 0):
    """(number of blocks, a row's own block) for a group of so many members."""
    blocks = F.ceil(F.col(members) / BLOCK).cast("int")
    return blocks, F.pmod(F.xxhash64("node", F.lit(salt)), blocks).cast("int")


def _each(blocks):
    return F.explode(F.sequence(F.lit(0), blocks - 1))


def _share(members: str):
    """A row's share of a bucket of so many members: no key of a join has many more rows than BLOCK."""
    return _block(members, 2)[1]


def _families(texts: DataFrame) -> DataFrame:
    """node, label: texts that pairs with a bucket in common and a posterior above the tolerance tie together."""
    signed = texts.where(F.length("sig") > 0).select("node", "sig")

    def banded(batches):
        ks = np.arange(BANDS, dtype=np.int32)
        for batch in batches:
            h = bands(_signatures(batch.column(1)))
            nodes = pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))
            yield pa.RecordBatch.from_arrays(
                [nodes, pa.array(np.tile(ks, len(h))), pa.array(h.reshape(-1).view(np.int64))], names=["node", "k", "b"]
            )

    light = signed.mapInArrow(banded, "node long, k int, b long")
    prints = [F.bit_xor(F.xxhash64("node", F.lit(salt))).alias(f"print{salt}") for salt in (0, 1)]  # of the texts that a bucket holds
    buckets = light.groupBy("b").agg(F.count("*").alias("members"), F.min("node").alias("hub"), F.min("k").alias("k"), *prints).where(
        "members > 1"
    )
    mixed = buckets.groupBy("members", "hub", "print0", "print1").agg(F.min(F.struct("k", "b")).alias("least"))
    mixed = stored(mixed.select(F.col("least.b").alias("mb"), "members", "hub"))
    hubs = mixed.hint("merge").join(
        signed.select(F.col("node").alias("hnode"), F.col("sig").alias("hub_sig")), F.col("hub") == F.col("hnode")
    )
    hubs = hubs.select(F.col("mb").alias("hb"), "hub_sig", _each(_block("members")[0]).alias("hshare"))
    spread = mixed.withColumn("mshare", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    some = light.withColumn("share", F.pmod(F.xxhash64("node"), F.lit(SPREAD))).join(
        spread, (F.col("b") == F.col("mb")) & (F.col("share") == F.col("mshare"))
    )
    some = some.where(F.col("node") != F.col("hub")).select(F.col("node").alias("bnode"), "k", "b", "hub", "members")
    some = some.hint("merge").join(signed, F.col("bnode") == F.col("node")).withColumn("share", _share("members"))
    some = some.join(hubs, (F.col("b") == F.col("hb")) & (F.col("share") == F.col("hshare"))).select(
        "node", "k", "b", "hub", "members", "sig", "hub_sig"
    )
    held = stored(some.mapInArrow(_near_hub, "node long, k int, b long, hub long, members long, near boolean"))
    edges = held.where("near").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    # Texts unlike the least of their bucket meet all others of it.
    held = held.where("members > 2").withColumn("share", _share("members"))
    far = held.groupBy(F.col("b").alias("fb"), "members").agg(F.count_if(~F.col("near")).alias("far")).where("far > 0")
    far = far.select("fb", "far", _each(_block("members")[0]).alias("fshare"))
    left_over = held.join(far, (F.col("b") == F.col("fb")) & (F.col("share") == F.col("fshare"))).withColumnRenamed("node", "bnode")
    left_over = left_over.hint("merge").join(signed, F.col("bnode") == F.col("node"))
    (fars, own_far), (alls, own_all) = _block("far"), _block("members", 1)
    columns = ["node", "k", "b", "near", "sig", "bi", "bj"]
    sides = left_over.where(~F.col("near")).withColumn("bi", own_far).withColumn("bj", _each(alls)).select(
        *columns, F.lit(True).alias("left")
    )
    sides = sides.unionByName(
        left_over.withColumn("bj", own_all).withColumn("bi", _each(fars)).select(*columns, F.lit(False).alias("left"))
    )
    sides = sides.repartition("b", "bi", "bj").sortWithinPartitions("b", "bi", "bj")
    edges = edges.unionByName(sides.mapInArrow(_bucket_edges, "u long, v long"))
    return stored(components(edges))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id, n_links, n_copies, keeper: a row for each row of df.

    n_links counts the other texts whose shingles have a Jaccard similarity of 0.8 or more with the row's; n_copies the rows with
    its words. class_id is the least id of all rows that links and copies connect with it. A text of fewer than five words has
    all of them as its one shingle. Null and empty texts are copies of each other. A row without an id belongs to the class
    of its text under a stand-in drawn from the text, and counts; class_id is null only if no row of the class has an id.
    Rows that share an id share a class, and each has the links of its own text. ``keeper`` is ``node_id`` of the rows of the
    class that stay if one is to. Only the named columns are read; an empty table gives no rows.
    """
    small_batches(df)
    docs = df.select(
        F.col(id_col).alias("id"), node_id(id_col, text_col).alias("nid"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th")
    )

    def sign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):  # texts become Python objects a slice at a time
                part = batch.slice(at, SLICE)
                digests, signatures = [], []
                for text in part.column(2).to_pylist():
                    digests.append(np.frombuffer(hashlib.blake2b(b" ".join(words(text)), digest_size=16).digest(), np.int64))
                    sh = shingles(text)
                    signatures.append(minhash(sh).tobytes() if len(sh) else b"")
                hi, lo = np.stack(digests).T
                made = [pa.array(hi), pa.array(lo), pa.array(signatures, pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), *made], names=["id", "nid", "th", "hi", "lo", "sig"]
                )

    id_type = df.schema[id_col].dataType.simpleString()
    signed = stored(docs.mapInArrow(sign, f"id {id_type}, nid long, th long, hi long, lo long, sig binary"))
    # A text is named by half of its digest, not by an id: texts of one id are compared like others. One row of each has its words looked up.
    texts = signed.groupBy("hi", "lo").agg(
        F.min(F.struct("nid", "th")).alias("row"), F.count("*").alias("n_copies"), F.min(
            F.col("id").cast("long")
        ).alias("least_id"), F.first("sig").alias("sig")
    )
    texts = stored(
        texts.select(
            "hi",
            "lo",
            F.col("hi").alias("node"),
            F.col("row.nid").alias("rid"),
            F.col("row.th").alias("rth"),
            "n_copies",
            "least_id",
            "sig",
        )
    )
    family = _families(texts)
    members = by_key(family, "label", "node", [F.count("*").alias("some")], [F.sum("some").alias("members")]).withColumnRenamed(
        "node", "fnode"
    )
    located = stored(
        members.join(texts, F.col("fnode") == F.col("node")).select("node", F.col("label").alias("fam"), "members", "rid", "rth", "sig")
    )
    # A merge join whatever the sizes: what is looked up grows with the texts.
    with_text = docs.select("nid", "th", "text").hint("merge").join(located, (F.col("nid") == F.col("rid")) & (F.col("th") == F.col("rth")))

    def shingled(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sh = pa.array([shingles(t).tobytes() for t in part.column(4).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], sh], names=["node", "fam", "members", "sig", "sh"])

    rows = with_text.select("node", "fam", "members", "sig", "text").mapInArrow(
        shingled, "node long, fam long, members long, sig binary, sh binary"
    )
    blocks, own = _block("members")
    rows = rows.withColumn("block", own).withColumn("other", _each(blocks))
    rows = rows.select("node", "fam", "block", "sig", "sh", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    rows = rows.repartition("fam", "bi", "bj").sortWithinPartitions("fam", "bi", "bj")
    compared = stored(rows.mapInPandas(_compare, "u long, v long, links long"))
    links = compared.groupBy(F.col("u").alias("lu")).agg(F.sum("links").alias("n_links"))
    # Texts that share an id have an edge to the least of them.
    many = signed.groupBy(F.col("nid").alias("mid")).agg(F.min("hi").alias("v"), F.max("hi").alias("last")).where(
        F.col("v") != F.col("last")
    )
    many = signed.select("nid", F.col("hi").alias("u")).join(many, F.col("nid") == F.col("mid")).where(
        F.col("u") != F.col("v")
    ).select("u", "v").distinct()
    classes = components(compared.select("u", "v").unionByName(many)).withColumnRenamed("node", "cnode")
    labelled = texts.drop("sig").join(classes, F.col("node") == F.col("cnode"), "left").withColumn("label", F.coalesce("label", "node"))
    labelled = labelled.join(links, F.col("node") == F.col("lu"), "left")
    labelled = stored(labelled.select("hi", "lo", "label", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "least_id", "rid"))
    parts = [F.min("least_id").alias("some_id"), F.min("rid").alias("some_rid")]
    named = by_key(labelled, "label", "hi", parts, [F.min("some_id").alias("class_id"), F.min("some_rid").alias("least_rid")])
    named = named.select(
        F.col("hi").alias("h1"),
        F.col("lo").alias("h2"),
        "class_id",
        "n_links",
        "n_copies",
        F.coalesce("class_id", "least_rid").alias("keeper"),
    )
    out = signed.select("id", "hi", "lo").join(named, (F.col("hi") == F.col("h1")) & (F.col("lo") == F.col("h2")))
    return out.select(F.col("id").alias(id_col), "class_id", "n_links", "n_copies", "keeper")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("keeper")


SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, array_to_string(ws, ' ') AS key, ws FROM w),
texts AS (SELECT key, min(doc_id) AS node, count(*) AS n_copies, any_value(ws) AS ws FROM t GROUP BY key),
sh AS (SELECT DISTINCT node, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT node, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM texts WHERE len(ws) > 0)),
sizes AS (SELECT node, count(*) AS n FROM sh GROUP BY node),
pairs AS (SELECT a.node AS u, b.node AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.node < b.node GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs JOIN sizes x ON x.node = u JOIN sizes y ON y.node = v WHERE 10 * c >= 8 * (x.n + y.n - c)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT node AS n, node AS m FROM texts UNION SELECT r.n, b.v FROM reach r JOIN both_ways b ON r.m = b.u),
classes AS (SELECT n, min(m) AS class_id FROM reach GROUP BY n),
degrees AS (SELECT u, count(*) AS n_links FROM both_ways GROUP BY u)
SELECT t.doc_id, class_id, coalesce(n_links, 0) AS n_links, n_copies FROM t JOIN texts USING (key) JOIN classes c ON c.n = texts.node LEFT JOIN degrees d ON d.u = texts.node
"""
