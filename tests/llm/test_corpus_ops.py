import numpy as np

from blockweave.llm import jaccard, mixing, suffixes
from blockweave.llm.common import word_hashes
from blockweave.llm.components import components
from tests.llm.test_text_ops import EDGE, LONG, docs


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5)]
    parent = {n: n for e in edges for n in e}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root(n) for n in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_jaccard(rows):
    texts = {}
    for i, t in rows:
        texts.setdefault(tuple((t or "").split()), []).append(i)
    sets = {k: {k[i : i + 5] for i in range(max(1, len(k) - 4))} for k in texts if k}
    keys = list(texts)
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = dict.fromkeys(keys, 0)
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            if a and b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for k, ids in texts.items():
        least[root(k)] = min([least.get(root(k), 1 << 60), *(i for i in ids if i is not None)])
    return {(i, t): (least[root(tuple((t or "").split()))] if least[root(tuple((t or "").split()))] < 1 << 60 else None, links[tuple((t or "").split())], len(texts[tuple((t or "").split())])) for i, t in rows}


def family(rng, n, edits):
    base = [f"w{x}" for x in rng.integers(0, 9999, 150)]
    out = []
    for _ in range(n):
        ws = list(base)
        for _ in range(int(rng.integers(0, edits))):
            ws[int(rng.integers(0, 150))] = f"x{rng.integers(0, 9999)}"
        out.append(" ".join(ws))
    return out


def test_jaccard(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = np.random.default_rng(2)
    texts = [t for _ in range(8) for t in family(rng, 5, 6)] + family(rng, 70, 8) + [
        " ".join(f"u{x}" for x in rng.integers(0, 99999, 60)) for _ in range(30)
    ] + ["same text here"] * 20 + ["a b"] * 2
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)] + [(None if i is None else 1000 + i, t, lang, s) for i, t, lang, s in EDGE]
    got = jaccard.near_duplicates(docs(spark, rows)).collect()
    want = brute_jaccard([(r[0], r[1]) for r in rows])
    by_id = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r.class_id, r.n_links, r.n_copies) == want[r.doc_id, by_id[r.doc_id]], r
    keepers = {r.keeper for r in got}
    assert len(keepers) == len({(r.class_id, r.keeper) for r in got})
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0


def test_jaccard_threshold_is_exact():
    a = np.arange(90, dtype=np.uint64)
    assert len(jaccard.linked([a[:80], a[:100:1]], None)[0]) == 1  # 80 of 90 shared
    b = [np.arange(0, 40, dtype=np.uint64), np.arange(0, 50, dtype=np.uint64), np.arange(0, 51, dtype=np.uint64)]
    assert set(zip(*map(list, jaccard.linked(b, None)), strict=True)) == {(0, 1), (1, 2)}  # 40/50 links, 40/51 does not


def thue_morse(n):
    """Two words of 2^n letters that every polynomial hash modulo 2^64 takes for one from n = 11 on."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(1 << n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_long_unlike_words_stay_unlike(spark):
    a, b = thue_morse(11)
    h = word_hashes(f"{a} {b}".encode())
    assert h[0] != h[1]
    texts = [" ".join([w] * k + [f"{w}{k}"] * k) for w in (a, b) for k in (60,)]
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)]
    assert [r.n_links for r in jaccard.near_duplicates(docs(spark, rows)).collect()] == [0, 0]
    got = {r.doc_id: r for r in suffixes.repeated_passages(docs(spark, rows)).collect()}
    assert not any(r.sources for r in got.values())


def test_jaccard_a_template_ties_no_family(spark):
    """Pages that share a third of their words meet in buckets and stay apart; a near copy of one is still found."""
    rng = np.random.default_rng(4)
    template = [f"t{k}" for k in range(50)]
    rows = [(k, " ".join([*template, *(f"p{k}w{x}" for x in rng.integers(0, 9999, 70))]), "en", "a") for k in range(300)]
    rows.append((300, rows[7][1] + " more", "en", "a"))
    df = docs(spark, rows)
    words_of = lambda t: np.frombuffer(jaccard.minhash(jaccard.shingles(t)).tobytes(), np.uint32)
    signed = spark.createDataFrame([(k, bytearray(words_of(t).tobytes())) for k, t, _, _ in rows], "node long, sig binary")
    assert sorted(r.node for r in jaccard._families(signed).collect()) == [7, 300]
    assert sorted(r.doc_id for r in jaccard.near_duplicates(df).where("n_links > 0").collect()) == [7, 300]


def test_posterior_bound():
    for n, least in jaccard.least_matches():
        import math

        tail = lambda m, n=n: sum(math.comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m + 1))
        assert tail(least) >= jaccard.TOLERANCE > (tail(least - 1) if least else 0)


def brute_passages(rows, n=50):
    texts = sorted({(i, t or "") for i, t in rows})
    seen: dict = {}
    for i, t in texts:
        w = t.split()
        for s in range(len(w) - n + 1):
            seen.setdefault(tuple(w[s : s + n]), []).append((i, s))

    def spans(starts):
        out = []
        for s in starts:
            if out and s <= out[-1][1]:
                out[-1] = (out[-1][0], s + n)
            else:
                out.append((s, s + n))
        return out

    out = {}
    for i, t in texts:
        w = t.split()
        found = [(s, seen[tuple(w[s : s + n])]) for s in range(len(w) - n + 1)]
        out[i] = (spans([s for s, p in found if len(p) > 1]), spans([s for s, p in found if p[0] != (i, s)]))
    return out


def test_suffixes(spark):
    rng = np.random.default_rng(6)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 99999, n)]
    passages = [word(n) for n in (49, 50, 51, 75, 130, 300)]
    rows = []
    for k in range(60):
        body = word(int(rng.integers(0, 80)))
        for p in rng.choice(6, int(rng.integers(0, 3))):
            a = int(rng.integers(0, 12)) if rng.random() < 0.4 else 0
            body += passages[p][a:] + word(int(rng.integers(0, 60)))
        rows.append((k, " ".join(body), "en", "a"))
    rows += [
        (200, " ".join(["again"] * 300), "en", "a"),
        (201, " ".join(word(40) * 4), "en", "a"),
        (202, rows[3][1], "en", "a"),
        (202, rows[3][1], "en", "a"),
        (203, None, None, None),
        (204, "", "en", "a"),
        (205, LONG, "en", "b"),
    ]
    got = suffixes.repeated_passages(docs(spark, rows)).collect()
    want = brute_passages([(r[0], r[1]) for r in rows])
    assert len(got) == len(rows)
    for r in got:
        assert ([tuple(s) for s in r.spans], [tuple(s) for s in r.drop_spans]) == want[r.doc_id], r.doc_id
        assert r.n_drop == sum(b - a for a, b in want[r.doc_id][1])
        assert all(i < r.doc_id for i in r.sources) and (r.sources or not r.n_drop or r.doc_id in (200, 201, 205))
    clean = suffixes.without_repeats(docs(spark, rows[:60])).collect()
    assert len(clean) == 60
    cut = {r[0]: want_of for r, want_of in ((r, brute_passages([(x[0], x[1]) for x in rows[:60]])[r[0]][1]) for r in rows[:60])}
    for r in clean:
        ws = rows[r.doc_id][1].split()
        assert r.text.split() == [w for k, w in enumerate(ws) if not any(a <= k < b for a, b in cut[r.doc_id])] and r.h == 7
    assert suffixes.repeated_passages(docs(spark, [])).count() == 0
    assert suffixes.repeated_passages(docs(spark, EDGE)).count() == len(EDGE)


def test_suffixes_of_texts_that_share_an_id(spark):
    """Two texts of one id hold one passage each, found elsewhere; both passages are found in both."""
    word = lambda k, n: " ".join(f"p{k}w{x}" for x in range(n))
    rows = [
        (1, f"a b {word(1, 60)} c", "en", "a"),
        (1, f"{word(2, 70)} d", "en", "a"),
        (2, f"x {word(1, 60)}", "en", "a"),
        (3, f"y z {word(2, 70)}", "en", "a"),
    ]
    got = sorted(
        (r.doc_id, [tuple(s) for s in r.spans], r.n_drop, r.sources) for r in suffixes.repeated_passages(docs(spark, rows)).collect()
    )
    assert got == [(1, [(0, 70)], 0, []), (1, [(2, 62)], 0, []), (2, [(1, 61)], 60, [1]), (3, [(2, 72)], 70, [1])]
    left = sorted(r.text for r in suffixes.without_repeats(docs(spark, rows)).collect())
    assert left == sorted([rows[0][1], rows[1][1], "x ", "y z "])


def test_suffixes_of_a_hot_passage(spark, monkeypatch):
    """A passage in very many texts is sorted in shares, with the same result."""
    monkeypatch.setattr(suffixes, "SHARE", 8)
    passage = " ".join(f"p{k}" for k in range(90))
    rows = [(k, f"{' '.join(f'b{k}x{i}' for i in range(k % 7))} {passage} {k} end", "en", "a") for k in range(150)]
    want = brute_passages([(r[0], r[1]) for r in rows])
    got = suffixes.repeated_passages(docs(spark, rows)).collect()
    assert len(got) == 150
    for r in got:
        assert ([tuple(s) for s in r.spans], [tuple(s) for s in r.drop_spans]) == want[r.doc_id], r
    assert {tuple(r.sources) for r in got if r.n_drop} == {(0,)}


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        w = sum(weight[s] for s in names if s not in stopped)
        share = {s: 3 * sizes[s] if s in stopped else rest * weight[s] / w for s in names}
        over = {s for s in names if s not in stopped and share[s] > 3 * sizes[s]}
        if not over:
            return share
        stopped |= over


def test_jaccard_texts_of_one_id(spark):
    """Three texts under one id: each is compared with the others' copies elsewhere, and all share a class."""
    text = lambda k, end: " ".join([*(f"t{k}w{i}" for i in range(40)), end])
    rows = [(1, text(k, "end"), "en", "a") for k in (1, 2, 3)] + [
        (10 * k + j, text(k, f"end{j}"), "en", "a") for k in (1, 2, 3) for j in range(k)
    ]
    got = jaccard.near_duplicates(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_links) for r in got) == [(1, 1), (1, 2), (1, 3), (10, 1), (20, 2), (21, 2), (30, 3), (31, 3), (32, 3)]
    assert {r.class_id for r in got} == {1} and {r.keeper for r in got} == {1} and {r.n_copies for r in got} == {1}



def test_mixing(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(900):
        s = rng.choice(["a", "b", "c", "d", "é", "z"], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.1])
        rows.append((k, " ".join(["w"] * int(rng.integers(1, 60))), "en", str(s)))
    rows += [
        (None, "x y z", "en", "a"),
        (2000, "x y", "en", None),
        (2001, None, "en", "a"),
        (2002, "", "en", "a"),
        (2003, "p q r", "en", "tiny"),
        (2004, "p q r", "en", "b"),
        (2004, "p q r", "en", "b"),
        (2005, "", "en", "empty"),
    ]
    df = docs(spark, rows)
    got = mixing.mix(df, block=64).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    share = brute_targets(sizes)
    source = {i: s for i, _, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - share[s]) < 1e-6 * max(1, share[s])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - share[s]) <= max(3, 0.01 * share[s]), (s, taken[s], share[s])
    again = mixing.mix(df.repartition(7), block=64).collect()
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    assert key(got) == key(again)
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mixing_lands_beside_a_hot_source(spark):
    """A source lands with documents held back, however large another one is; "two" has two blocks, "hot" many."""
    rng = np.random.default_rng(12)
    n = {"hot": 700, "one": 50, "small": 40, "third": 60, "two": 100}
    rows = [(f"{s}{k}", 250 if k == 0 and s != "hot" else int(rng.integers(1, 5 if s == "hot" else 60)), s) for s in n for k in range(n[s])]
    df = spark.createDataFrame([(i, " ".join(["w"] * size), s) for i, size, s in rows], "doc_id string, text string, source string")
    sizes = {s: sum(size for _, size, t in rows if t == s) for s in n}
    share = brute_targets(sizes)
    taken = dict.fromkeys(n, 0)
    for r in mixing.mix(df, block=64).collect():
        taken[r.doc_id.rstrip("0123456789")] += r.taken
    assert all(abs(taken[s] - share[s]) <= 3 for s in n), {s: taken[s] - share[s] for s in n}



def test_flight_balances():
    rng = np.random.default_rng(9)
    size, q = rng.integers(1, 500, 400).astype(float), np.full(400, 1.37)
    out = mixing._flight(q, size, rng)
    open_ = ~mixing._whole(out)
    assert open_.sum() <= 2 and abs(out @ size - q @ size) < 1e-6 * size.sum() and abs(out.sum() - q.sum()) < 1e-6
    assert out.min() >= 0 and out.max() <= mixing.MOST and (np.isin(out[~open_], [1, 2])).mean() > 0.9
    assert set(np.unique(mixing._landing(out, size, rng))) <= {0.0, 1.0, 2.0, 3.0}
    drawn = [mixing._landing(mixing._flight(q[:30], size[:30], rng, mixing.LANDING), size[:30], rng) for _ in range(1500)]
    assert abs(np.mean(drawn, axis=0) - 1.37).max() < 4 * np.std(drawn) / np.sqrt(1500)  # means are kept


def test_means_are_kept_in_a_small_source():
    """Twelve documents, one as long as all others: each is taken as often as it is to be on average, and totals are near."""
    size = np.array([900.0, 40, 55, 60, 75, 80, 90, 100, 105, 110, 120, 130])
    rate = np.array([0.5, 0.3, 1.3, 0.3, 0.7, 0.3, 0.6, 0.3, 2.3, 0.9, 0.3, 0.45])
    drawn = [mixing._landing(mixing._flight(rate, size, rng, mixing.LANDING), size, rng) for rng in map(np.random.default_rng, range(4000))]
    drawn = np.array(drawn)
    assert set(np.unique(drawn)) <= {0.0, 1.0, 2.0, 3.0}
    assert (np.abs(drawn.mean(axis=0) - rate) < 4 * drawn.std(axis=0) / np.sqrt(4000) + 1e-9).all()
    miss = np.abs(drawn @ size - rate @ size)
    apart = np.floor(rate) + (np.random.default_rng(1).random((4000, 12)) < rate - np.floor(rate))
    assert miss.mean() < 0.5 * np.abs(apart @ size - rate @ size).mean()


def test_selections_are_the_best_that_keep_the_means():
    """The linear program against a search over all bases of two documents."""
    from itertools import combinations

    rng = np.random.default_rng(3)
    every = np.array([[k % 4, k // 4] for k in range(16)], float)
    for _ in range(20):
        q, size = rng.uniform(0.05, 2.95, 2), rng.integers(1, 90, 2).astype(float)
        cost = lambda s, q=q, size=size: np.abs((s - q) @ size)
        picked, weight = mixing._selections(q, cost)
        assert np.allclose(weight @ picked, q) and np.isclose(weight.sum(), 1) and (weight >= 0).all()
        least = np.inf
        for three in combinations(range(16), 3):
            a = np.vstack([np.ones(3), every[list(three)].T])
            if abs(np.linalg.det(a)) > 1e-9:
                x = np.linalg.solve(a, np.append(1.0, q))
                if (x >= -1e-12).all():
                    least = min(least, float(x @ cost(every[list(three)])))
        assert np.isclose(weight @ cost(picked), least)


def test_mixing_of_sources_that_are_no_strings(spark):
    rows = [(k, " ".join(["w"] * (k % 9 + 1)), k % 3 if k % 10 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source int")
    few = mixing.mix(df, block=32).collect()
    assert len(few) == 300 and {r.source_size for r in few} == {
        sum(k % 9 + 1 for k in range(300) if (k % 3 if k % 10 else None) == s) for s in (0, 1, 2, None)
    }


def test_mixing_of_more_sources_than_are_broadcast(spark, monkeypatch):
    rows = [(k, " ".join(["w"] * (k % 9 + 1)), "en", f"s{k % 7}") for k in range(300)]
    want = sorted(map(tuple, mixing.mix(docs(spark, rows), block=32).collect()))
    monkeypatch.setattr(mixing, "SOURCES", 3)
    assert sorted(map(tuple, mixing.mix(docs(spark, rows), block=32).collect())) == want


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(10)
    rows = [(k, "\n".join(" ".join(f"w{x}" for x in rng.integers(0, 400, 20)) for _ in range(5)), "en", "abc"[k % 3]) for k in range(60)]
    rows += [(100 + k, rows[k][1].replace("\n", " "), "en", "a") for k in range(5)] + [
        (200, None, None, None), (201, "short", "en", "a"), (202, " ".join(["again"] * 200), "en", "b"), (203, rows[0][1], "en", "a")
    ]
    spark.createDataFrame(
        [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{len(kept)}"))
        at = spark.read.parquet(str(tmp_path / f"s{len(kept)}"))
        kept.append(at)
    assert all(k.columns == corpus_pipeline.COLUMNS for k in kept[:-1])
    ids = [sorted(r.doc_id for r in k.collect()) for k in kept]
    assert set(ids[0]) == {*range(60), *range(100, 105), 203}  # the rules' verdict
    assert 203 not in ids[1] and set(range(60)) <= set(ids[1])  # a whole copy is gone with its lines
    assert ids[2] == list(range(60))  # joined lines are near copies
    assert set(ids[3]) <= set(ids[2]) and max(ids[3].count(i) for i in ids[3]) <= 3
    assert ids[4] == ids[3] and all(r.n_tokens == len(r.ids) > 0 for r in kept[4].collect())
    twice = kept[2].limit(3).unionByName(kept[2].limit(3)).unionByName(kept[2])
    mixed = corpus_pipeline.mix_sources(spark, twice, str(tmp_path)).collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(r.taken for r in mixing.mix(twice).collect())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in whole.collect()) == ids[4]


PIPE = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], PIPE).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_edges_and_extra_columns(spark, tmp_path):
    """Nulls in every column, empty and long texts, ties and repeated rows, with columns that operators use inside."""
    import corpus_pipeline

    spark.createDataFrame([(3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table = docs(spark, EDGE)
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, str(tmp_path))
        assert name == "encode" or out.columns == corpus_pipeline.COLUMNS
        counts[name] = sorted((r.doc_id is not None, r.doc_id or 0) for r in out.collect())
    every = sorted((i is not None, i or 0) for i, *_ in EDGE)
    assert counts["line dedup"] == counts["encode"] == every
    assert counts["quality rules"] == []  # the long text repeats its words
    assert counts["near duplicates"] == [(False, 0), (True, 1), (True, 3), (True, 4), (True, 5)]
    assert set(counts["mix sources"]) <= set(every) and not {1, 2, 7} & {i for _, i in counts["mix sources"]}
