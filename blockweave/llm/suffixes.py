"""Repeated passages by a sparse suffix array.

Of a text's suffixes (at words) only those are retained that start at a minimiser: in each window of ``WINDOW`` starts the run
of ``GRAM`` words with the least hash. A passage of ``LENGTH`` words in two places retains the same suffix in both, and that
suffix has its first ``PREFIX`` words within the passage. Suffixes whose first words have a 64-bit print of their own go; the
others are dealt by that print, so that equal beginnings meet, sorted by their first words, and neighbours are compared word
by word: neighbours with equal first words make a run. Prints of many suffixes are dealt in shares of about ``SHARE``, and the runs of the
shares are joined by their words. Each suffix is then held against the first place of its run (the first against the last).

Retained suffixes that agree with their partners at one distance and follow each other without a gap certify a common stretch;
so matches grow left and right from suffix to suffix. Beyond the certified stretch, where a passage of ``LENGTH`` words may
reach a few words further to either side, every window of ``LENGTH`` words around a retained suffix is compared by its own
64-bit print with those of the other texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.llm.common import Rolling, WORD, small_batches, stored, table, whole_groups, word_hashes

_WORD = re.compile(WORD)
LENGTH, WINDOW, GRAM, SLICE = 50, 25, 4, 500
#: Suffixes of one print that are sorted together.
SHARE = 1024
PREFIX = LENGTH - WINDOW + 1  # at least WINDOW, so that neighbouring retained prefixes leave no gap


def minimisers(h: np.ndarray, length: int = LENGTH, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """For each start of a run of ``length`` words, the position of its minimiser: the first least gram."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    g = Rolling(h).windows(gram)[: n + window - 1]
    view = np.lib.stride_tricks.sliding_window_view(g, window)
    return np.arange(n) + view.argmin(axis=1)


def _hashes(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode("utf-8", "surrogatepass"))


def _spans(a: np.ndarray, b: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of [s, s + length) for all s of the closed intervals [a, b]."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order]) if len(b) else b
    cut = np.flatnonzero(a[1:] > b[:-1] + length)
    return a[np.concatenate([[0], cut + 1])] if len(a) else a, b[np.concatenate([cut, [len(b) - 1]])] + length if len(b) else b


def _slices(batches):
    """Rows of Arrow batches as lists, a few at a time, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield [c.to_pylist() for c in batch.slice(at, SLICE).columns]


def _ints(values, kind=np.int64) -> pa.Array:
    return pa.array(np.asarray(values, kind))


def _retain(batches):
    for nids, ths, texts in _slices(batches):
        prints, owners, hashes, places = [np.zeros(0, np.uint64)], [], [], [np.zeros(0, np.int64)]
        for nid, th, text in zip(nids, ths, texts, strict=True):
            h = _hashes(text)
            p = np.unique(minimisers(h))
            if len(p):
                prints.append(Rolling(h).slices(p, p + PREFIX))
                owners.append(np.full(len(p), nid))
                hashes.append(np.full(len(p), th))
                places.append(p)
        made = [np.concatenate(prints).view(np.int64), np.concatenate([*owners, places[0]]), np.concatenate([*hashes, places[0]])]
        yield pa.RecordBatch.from_arrays([*map(_ints, made), _ints(np.concatenate(places), np.int32)], names=["h", "nid", "th", "pos"])


def _with_lists(batches):
    """(ids, hashes, texts, where each text's items start and end, the items' fields as arrays), a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            nid, th, text, items = batch.slice(at, SLICE).columns
            ends = np.cumsum(pc.list_value_length(items).to_numpy(zero_copy_only=False))
            values = items.flatten()
            fields = {f.name: values.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(values.type)}
            yield nid.to_numpy(), th.to_numpy(), text.to_pylist(), list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)), fields


def _spell(batches):
    """The first words of a text's suffixes that are to be sorted."""
    for nids, ths, texts, bounds, f in _with_lists(batches):
        spelt = []
        for text, (a, b) in zip(texts, bounds, strict=True):
            ws = text.encode("utf-8", "surrogatepass").split()
            spelt += [b" ".join(ws[p : p + PREFIX]) for p in f["pos"][a:b].tolist()]
        sizes = [b - a for a, b in bounds]
        owners = [_ints(np.repeat(x, sizes)) for x in (nids, ths)]
        made = [
            _ints(f["h"]),
            _ints(f["share"], np.int32),
            pa.array(f["shared"], pa.bool_()),
            pa.array(spelt, pa.binary()),
            *owners,
            _ints(f["pos"], np.int32),
        ]
        yield pa.RecordBatch.from_arrays(made, names=["h", "share", "shared", "words", "nid", "th", "pos"])


_FOUND = ["kind", "h", "share", "run", "shared", "words", "nid", "th", "pos", "pn", "pt", "pp", "first"]


def _neighbours(batches):
    """Of suffixes sorted by (h, share, words, place): runs of neighbours with equal words.

    Kind 0: a suffix with its partner, the first place of its run, or of the first the last. Kind 1: a run of a print that
    has several shares, with its words, first and last place.
    """
    for t in whole_groups(batches, ["h", "share"]):
        h, share, nid, th, pos = (t.column(c).to_numpy() for c in ("h", "share", "nid", "th", "pos"))
        words = t.column("words").combine_chunks()
        new = np.ones(len(t), bool)
        equal = pc.equal(words.slice(1), words.slice(0, len(t) - 1)).to_numpy(zero_copy_only=False)
        new[1:] = ~equal | (h[1:] != h[:-1]) | (share[1:] != share[:-1])
        again = np.zeros(len(t), bool)  # rows that are repeated in full have their suffixes in one place
        again[1:] = ~new[1:] & (nid[1:] == nid[:-1]) & (th[1:] == th[:-1]) & (pos[1:] == pos[:-1])
        at = np.flatnonzero(~again)
        starts = np.flatnonzero(new[at])
        run = np.cumsum(new[at]) - 1
        ends = np.append(starts[1:], len(at))
        first, last = at[starts][run], at[ends - 1][run]
        shared = t.column("shared").to_numpy()[at]
        keep = shared | ((ends - starts)[run] > 1)
        at, run, first, last, shared = at[keep], run[keep], first[keep], last[keep], shared[keep]
        is_first = at == first
        partner = np.where(is_first, last, first)
        heads = is_first & shared

        def rows(kind, own, runs, with_words, of, to, first):
            none = pa.nulls(len(own), pa.binary())
            ints = [_ints(h[own]), _ints(share[own], np.int32), _ints(runs)]
            places = [_ints(nid[of]), _ints(th[of]), _ints(pos[of], np.int32), _ints(nid[to]), _ints(th[to]), _ints(pos[to], np.int32)]
            spelt = words.take(pa.array(own)) if with_words else none
            made = [
                _ints(np.full(len(own), kind), np.int32),
                *ints,
                pa.array(t.column("shared").to_numpy()[own], pa.bool_()),
                spelt,
                *places,
                pa.array(first, pa.bool_()),
            ]
            return pa.RecordBatch.from_arrays(made, names=_FOUND)

        yield rows(0, at, run, False, at, partner, is_first)
        yield rows(1, at[heads], run[heads], True, first[heads], last[heads], is_first[heads])


_KINDS = ["kind", "w", "nid", "th", "a", "b", "first", "src"]


def _kind_rows(kind: int, w, nid, th, a, b, first, src) -> pa.RecordBatch:
    n = len(a)
    wide = lambda x, t: _ints(np.broadcast_to(np.asarray(x, t), n), t)
    ints = [wide(kind, np.int32), wide(w, np.int64), wide(nid, np.int64), wide(th, np.int64), wide(a, np.int32), wide(b, np.int32)]
    return pa.RecordBatch.from_arrays([*ints, pa.array(np.broadcast_to(np.asarray(first, bool), n)), wide(src, np.int64)], names=_KINDS)


def _stretches(starts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive starts that belong to one suffix."""
    cut = np.flatnonzero((np.diff(starts) > 1) | (np.diff(of) != 0))
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]


def _extend(batches):
    """Of each text with repeated suffixes: certified runs of starts (kind 0) and windows still to compare (kind 1)."""
    for nids, ths, texts, bounds, fields in _with_lists(batches):
        known, asked = [], []
        for nid, th, text, (lo, hi) in zip(nids.tolist(), ths.tolist(), texts, bounds, strict=True):
            h = _hashes(text)
            order = np.argsort(fields["pos"][lo:hi]) + lo
            p, pn, pt, pp, first = (fields[c][order] for c in ("pos", "pn", "pt", "pp", "first"))
            n = max(0, len(h) - LENGTH + 1)
            of = minimisers(h)
            at = np.full(len(h) + 1, -1)  # by position: its suffix among the repeated ones
            at[p] = np.arange(len(p))
            own = at[of]
            # Suffixes that follow each other without a gap, with partners in one text at one distance, certify the words they cover.
            follows = (p[1:] <= p[:-1] + PREFIX) & (pn[1:] == pn[:-1]) & (pt[1:] == pt[:-1]) & (pp[1:] - p[1:] == pp[:-1] - p[:-1])
            begin, end = p[np.concatenate([[True], ~follows])], p[np.concatenate([~follows, [True]])] + PREFIX
            end = np.maximum(begin, np.minimum(end - LENGTH + 1, n))
            sure = np.cumsum(np.bincount(begin, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1])[:n] > 0
            repeated, is_first = own >= 0, np.append(first, False)[own]
            starts = np.flatnonzero(sure & repeated & is_first)
            if len(starts):
                a, b = _stretches(starts, np.zeros(len(starts)))
                known.append((np.full(len(a), nid), np.full(len(a), th), a, b, np.ones(len(a), bool), np.full(len(a), nid)))
            later = np.flatnonzero(sure & repeated & ~is_first)  # the first of each run holds these windows too
            if len(later):
                a, b = _stretches(later, own[later])
                k = own[a]
                known.append((np.full(len(a), nid), np.full(len(a), th), a, b, np.zeros(len(a), bool), pn[k]))
                known.append((pn[k], pt[k], a + pp[k] - p[k], b + pp[k] - p[k], np.ones(len(a), bool), pn[k]))
            ask = np.flatnonzero(repeated & (is_first | ~sure))
            if len(ask):
                asked.append((Rolling(h).slices(ask, ask + LENGTH).view(np.int64), np.full(len(ask), nid), np.full(len(ask), th), ask))
        if known:
            yield _kind_rows(0, 0, *(np.concatenate(x) for x in zip(*known, strict=True)))
        if asked:
            w, nid, th, pos = (np.concatenate(x) for x in zip(*asked, strict=True))
            yield _kind_rows(1, w, nid, th, pos, pos, False, nid)


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _gather(batches):
    """Of each text its spans, those to drop, the words in both, and the ids that hold the latter first."""
    for batch in batches:
        nid, th, items = batch.columns
        ends = np.cumsum(pc.list_value_length(items).to_numpy(zero_copy_only=False)).tolist()
        values = items.flatten()
        a, b, first, src = (values.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        found, sources = ([], []), []
        for own, lo, hi in zip(nid.to_numpy().tolist(), [0, *ends[:-1]], ends, strict=True):
            later = np.flatnonzero(~first[lo:hi]) + lo
            found[0].append(_spans(a[lo:hi], b[lo:hi]))
            found[1].append(_spans(a[later], b[later]))
            sources.append([s for s in np.unique(src[later]).tolist() if s != own])
        lists, sums = [], []
        for spans in found:
            sizes = [len(x) for x, _ in spans]
            flat = [pa.array(np.concatenate([s[k] for s in spans]).astype(np.int32)) for k in (0, 1)]
            made = pa.StructArray.from_arrays(flat, fields=list(_SPAN.value_type))
            lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), made))
            sums.append(_ints([int((y - x).sum()) for x, y in spans], np.int32))
        names = ["nid", "th", "spans", "drop_spans", "n_repeated", "n_drop", "sources"]
        yield pa.RecordBatch.from_arrays([nid, th, *lists, *sums, pa.array(sources, pa.list_(pa.int64()))], names=names)


def _place(nid: str = "nid", th: str = "th", pos: str = "pos"):
    return F.struct(F.col(nid).alias("nid"), F.col(th).alias("th"), F.col(pos).alias("pos"))


def _sorted_suffixes(docs: DataFrame) -> DataFrame:
    """nid, th, pos, pn, pt, pp, first: each retained suffix whose first words stand in another place too, with its partner."""
    retained = stored(docs.mapInArrow(_retain, "h long, nid long, th long, pos int"))
    where = F.xxhash64("nid", "th", "pos")
    often = retained.groupBy(F.col("h").alias("h2")).agg(F.count("*").alias("n"), F.min(where).alias("lo"), F.max(where).alias("hi"))
    often = stored(often.where(F.col("lo") != F.col("hi")).select("h2", F.ceil(F.col("n") / SHARE).cast("int").alias("shares")))
    met = retained.join(often, F.col("h") == F.col("h2"))
    met = met.select(
        "nid",
        "th",
        F.struct("h", "pos", F.pmod(where, F.col("shares")).cast("int").alias("share"), (F.col("shares") > 1).alias("shared")).alias("f"),
    )
    per_text = met.groupBy(F.col("nid").alias("mnid"), F.col("th").alias("mth")).agg(F.collect_set("f").alias("met"))  # a text's own suffixes
    spelt = docs.hint("merge").join(per_text, (F.col("nid") == F.col("mnid")) & (F.col("th") == F.col("mth"))).select(
        "nid", "th", "text", "met"
    )
    spelt = spelt.mapInArrow(_spell, "h long, share int, shared boolean, words binary, nid long, th long, pos int")
    spelt = spelt.repartition("h", "share").sortWithinPartitions("h", "share", "words", "nid", "th", "pos")
    kinds = "kind int, h long, share int, run long, shared boolean, words binary, nid long, th long, pos int, pn long, pt long, pp int, first boolean"
    found = stored(spelt.mapInArrow(_neighbours, kinds))
    own = found.where("kind = 0")
    # Runs of one print's shares: equal words are one run.
    runs = found.where("kind = 1")
    whole = runs.groupBy(F.col("h").alias("h2"), F.col("words").alias("words2")).agg(
        F.min(_place()).alias("lo"), F.max(_place("pn", "pt", "pp")).alias("hi")
    )
    whole = runs.join(whole.where(F.col("lo") != F.col("hi")), (F.col("h") == F.col("h2")) & (F.col("words") == F.col("words2")))
    whole = whole.select(F.col("h").alias("h3"), F.col("share").alias("share3"), F.col("run").alias("run3"), "lo", "hi")
    split = own.where("shared").join(
        whole, (F.col("h") == F.col("h3")) & (F.col("share") == F.col("share3")) & (F.col("run") == F.col("run3"))
    )
    split = split.withColumn("first", _place() == F.col("lo")).withColumn("p", F.when(F.col("first"), F.col("hi")).otherwise(F.col("lo")))
    columns = ["nid", "th", "pos", "pn", "pt", "pp", "first"]
    split = split.select("nid", "th", "pos", F.col("p.nid").alias("pn"), F.col("p.th").alias("pt"), F.col("p.pos").alias("pp"), "first")
    return own.where(~F.col("shared")).select(columns).unionByName(split)


def _passages(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th, n_repeated, n_drop, spans, drop_spans, sources: a row for each row of df; th is a hash of its text."""
    small_batches(df)
    stand_in = -(F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 2)) - F.lit(1 << 61)
    docs = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(id_col).cast("long"), stand_in).alias("nid"),
        F.xxhash64(text_col).alias("th"),
        F.col(text_col).alias("text"),
    )
    texts = docs.select("nid", "th", "text")
    found = _sorted_suffixes(texts).select(
        F.col("nid").alias("fnid"), F.col("th").alias("fth"), F.struct("pos", "pn", "pt", "pp", "first").alias("f")
    )
    per_text = found.groupBy("fnid", "fth").agg(F.collect_set("f").alias("found"))  # a text's own suffixes, once each
    kinds = "kind int, w long, nid long, th long, a int, b int, first boolean, src long"
    joined = texts.hint("merge").join(per_text, (F.col("nid") == F.col("fnid")) & (F.col("th") == F.col("fth"))).select(
        "nid", "th", "text", "found"
    )
    grown = stored(joined.mapInArrow(_extend, kinds))
    place = _place("nid", "th", "pos")
    windows = grown.where("kind = 1").select("w", "nid", "th", F.col("a").alias("pos"))
    met = windows.groupBy(F.col("w").alias("w2")).agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
    met = stored(met.where(F.col("lo") != F.col("hi")).select("w2", "lo"))
    told = windows.join(met, F.col("w") == F.col("w2"))
    told = told.select(
        "nid", "th", F.col("pos").alias("a"), F.col("pos").alias("b"), (place == F.col("lo")).alias("first"), F.col("lo.nid").alias("src")
    )
    items = grown.where("kind = 0").select("nid", "th", "a", "b", "first", "src").unionByName(told)
    items = items.groupBy("nid", "th", "a", "first", "src").agg(F.max("b").alias("b"))
    items = items.groupBy("nid", "th").agg(F.collect_list(F.struct("a", "b", "first", "src")).alias("items"))
    span = "array<struct<start: int, end: int>>"
    spans = items.mapInArrow(
        _gather, f"nid long, th long, spans {span}, drop_spans {span}, n_repeated int, n_drop int, sources array<long>"
    )
    spans = spans.withColumnRenamed("nid", "snid").withColumnRenamed("th", "sth")
    none = F.array().cast(span)
    out = docs.select("id", "nid", "th").join(spans, (F.col("nid") == F.col("snid")) & (F.col("th") == F.col("sth")), "left")
    return out.select(
        "id",
        "th",
        F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"),
        F.coalesce("n_drop", F.lit(0)).alias("n_drop"),
        F.coalesce("spans", none).alias("spans"),
        F.coalesce("drop_spans", none).alias("drop_spans"),
        F.filter(F.coalesce("sources", F.array().cast("array<long>")), lambda i: i > -(1 << 61)).alias("sources"),
    )


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_repeated, n_drop, spans, drop_spans, sources: a row for each row of df.

    ``spans`` are the words [start, end) of the row's text that lie in a passage of at least 50 words found in two places, in this text or
    another; ``drop_spans`` those that an earlier place, by id, then text, then word, holds too, so that removing them all leaves
    each passage once. ``sources`` are the other ids that hold its dropped passages first. Null, empty and short texts
    have none. Rows that repeat an id and text are one text; rows that share an id but not their text are texts of their own. A
    row without an id takes part under a stand-in drawn from its text, before all others. Only the named columns are read; no rows
    give no rows.
    """
    return _passages(df, id_col, text_col).drop("th").withColumnRenamed("id", id_col)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with later places of repeated passages cut from the text, from the first word of a span to its last."""
    spans = _passages(df, id_col, text_col).where("n_drop > 0").select(
        F.col("id").alias("span_id"), F.col("th").alias("span_th"), "drop_spans"
    )
    spans = spans.dropDuplicates(["span_id", "span_th"])
    at, columns = df.columns.index(text_col), df.columns

    def cut_out(batches):
        for batch in batches:
            texts = []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                if gone:
                    places = [m.span() for m in _WORD.finditer(text)]
                    for g in reversed(gone):
                        text = text[: places[g["start"]][0]] + text[places[g["end"] - 1][1] :]
                texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(columns))], names=columns
            )

    match = F.col(id_col).eqNullSafe(F.col("span_id")) & (F.xxhash64(text_col) == F.col("span_th"))
    joined = df.join(spans, match, "left").select(*(df[c] for c in columns), "drop_spans")
    return joined.mapInArrow(cut_out, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as "start-end,start-end" and sources as "id,id", so that SQL can be held against them."""

    def text(c):
        return F.array_join(
            F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ","
        ).alias(c)

    out = repeated_passages(table(spark, sf_dir, "documents"))
    numbers = [F.col(c).cast("long").alias(c) for c in ("n_repeated", "n_drop")]
    return out.select(
        "doc_id", *numbers, text("spans"), text("drop_spans"), F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources")
    )


SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS s, md5(array_to_string(ws[i:i + 49], ' ')) AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT doc_id, s, count(*) OVER (PARTITION BY w) AS c, first_value(doc_id) OVER o AS fd, first_value(s) OVER o AS fs FROM win WINDOW o AS (PARTITION BY w ORDER BY doc_id, s)),
r AS (SELECT doc_id, s, fd, fd <> doc_id OR fs <> s AS later FROM f WHERE c > 1),
kinds AS (SELECT 'all' AS kind, doc_id, s FROM r UNION ALL SELECT 'drop', doc_id, s FROM r WHERE later),
cuts AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY kind, doc_id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS cut FROM kinds),
islands AS (SELECT *, sum(cut) OVER (PARTITION BY kind, doc_id ORDER BY s) AS g FROM cuts),
spans AS (SELECT kind, doc_id, min(s) AS a, max(s) + 50 AS b FROM islands GROUP BY kind, doc_id, g),
texts AS (SELECT kind, doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS spans, CAST(sum(b - a) AS BIGINT) AS n FROM spans GROUP BY kind, doc_id),
sources AS (SELECT doc_id, string_agg(CAST(fd AS VARCHAR), ',' ORDER BY fd) AS sources FROM (SELECT DISTINCT doc_id, fd FROM r WHERE later AND fd <> doc_id) GROUP BY doc_id)
SELECT d.doc_id, coalesce(x.n, 0) AS n_repeated, coalesce(y.n, 0) AS n_drop, coalesce(x.spans, '') AS spans, coalesce(y.spans, '') AS drop_spans, coalesce(s.sources, '') AS sources
FROM documents d LEFT JOIN texts x ON x.kind = 'all' AND x.doc_id = d.doc_id LEFT JOIN texts y ON y.kind = 'drop' AND y.doc_id = d.doc_id LEFT JOIN sources s ON s.doc_id = d.doc_id
"""
