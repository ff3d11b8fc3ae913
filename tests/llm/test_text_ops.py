import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockweave.llm import bpe, html, jaccard, language, lines, mixing, quality, suffixes, topk, toxicity
from blockweave.llm.common import Rolling, grouped, word_hashes, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, k int, id long, first string, kept string, score double"


def docs(spark, rows):
    """Rows (doc_id, text, lang, source), with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 7, 7, 7, "x", "y", 0.5) for i, t, lang, s in rows], DOCS)


LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(30000))
EDGE = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (None, "a line\nb line\nc line\nd line", "en", "a"),
    (3, LONG, "en", None),
    (3, LONG, "en", None),
    (4, "1234 !!", None, "b"),
    (5, "tie tie tie", "fr", "b"),
    (6, "tie tie tie", "fr", "b"),
    (7, " \t\n\x0b\x0c\r ", "en", "c"),
]


# ---- hashes and grouping ----------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=" ab\n\té", max_size=40))
def test_word_hashes(text):
    ws, h = words(text), word_hashes(text.encode())
    assert len(ws) == len(h) and len(ws) == len(re.findall(r"[^\x20\x09-\x0D]+", text))
    assert len(set(zip(ws, h.tolist(), strict=True))) == len(set(ws)) == len(set(h.tolist()))
    r = Rolling(h)
    for size in (1, 2, 3):
        seen = {}
        for i, w in enumerate(r.windows(size).tolist()):
            assert seen.setdefault(w, ws[i : i + size]) == ws[i : i + size]


def test_grouped_crosses_batches():
    import pandas as pd

    frames = [
        pd.DataFrame({"a": [1, 1, 2], "v": [1, 2, 3]}),
        pd.DataFrame({"a": [], "v": []}),
        pd.DataFrame({"a": [2, 2], "v": [4, 5]}),
        pd.DataFrame({"a": [3], "v": [6]}),
    ]
    assert [g.v.tolist() for g in grouped(iter(frames), ["a"])] == [[1, 2], [3, 4, 5], [6]]


# ---- 1: line dedup ----------------------------------------------------------------


def brute_lines(rows):
    """The same definition, one document after another."""
    P, B = 2147483647, 1000003
    places, chunks = {}, {}
    order = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in order:
        ls = t.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:15], 16) % P for x in ls]
        roll = [(a * B + b) % P for a, b in zip(h, h[1:], strict=False)]
        ends = [b for b in range(1, len(ls) - 2) if roll[b - 1] < (roll[b - 2] if b > 1 else P) and roll[b - 1] <= roll[b]]
        cuts = [0, *(e + 1 for e in ends), len(ls)]
        chunks[i, t] = [ls[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for k, c in enumerate(chunks[i, t]):
            if len(c) > 1:
                places.setdefault("\n".join(c), (i, t, k))
    out = {}
    for (i, t), cs in chunks.items():
        gone = [len(c) > 1 and places["\n".join(c)] != (i, t, k) for k, c in enumerate(cs)]
        out[i, t] = (sum(gone), "\n".join("\n".join(c) for c, g in zip(cs, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("clash", [False, True])
def test_line_dedup(spark, monkeypatch, clash):
    if clash:  # chunks of one hash and unlike texts must be told apart
        monkeypatch.setattr(lines, "_chunk_hash", lambda chunk: (F.length(chunk) % 5).cast("long"))
    rng = np.random.default_rng(3)
    shared = [f"shared line {k}" for k in range(12)]
    rows = []
    for i in range(60):
        own = [f"line {i} {k}" for k in range(int(rng.integers(1, 9)))]
        at = int(rng.integers(0, len(own) + 1))
        rows.append((300 + i, "\n".join(own[:at] + (shared if i % 3 == 0 else []) + own[at:]), "en", "a"))
    rows += [(100 + k, "\n".join(["same"] * 40), "en", "a") for k in range(3)] + EDGE
    got = lines.line_dedup(docs(spark, rows), keep=("lang", "h")).collect()
    want = brute_lines([(r[0], r[1]) for r in rows])
    assert len(got) == len(rows)
    by_id = Counter()
    for r in got:
        if r.doc_id == 1:
            assert (r.text, r.n_lines, r.n_removed_chunks) == (None, 0, 0)
            continue
        text = next(t for i, t, *_ in rows if i == r.doc_id and (r.doc_id is not None or True))
        assert (r.n_removed_chunks, r.text) == want[r.doc_id, text], r.doc_id
        assert r.n_lines == text.count("\n") + 1 and r.h == 7
        by_id[r.doc_id] += 1
    assert by_id[3] == 2
    assert sum(r.n_removed_chunks for r in got) > 15
    assert sum("shared line 5" in (r.text or "") for r in got) == 1
    assert lines.line_dedup(docs(spark, []), keep=("lang",)).count() == 0


def test_line_dedup_is_native(spark):
    plan = lines.line_dedup(docs(spark, EDGE))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 2: toxicity ------------------------------------------------------------------


def labelled(n=400, biased=True):
    rng = np.random.default_rng(5)
    plain = [f"word{k}" for k in range(200)]
    texts, toxic = [], []
    for i in range(n):
        bad = i % 2 == 0
        ws = list(rng.choice(plain, 30))
        if bad:
            ws[3] = ["idiot", "scum", "moron"][i % 3]
        if rng.random() < (0.7 if bad and biased else 0.1):
            ws[10] = "muslim"
        texts.append(" ".join(ws))
        toxic.append(int(bad))
    return texts, np.array(toxic)


def test_counterfactual_penalty_closes_the_gap():
    texts, toxic = labelled()
    gap = {}
    for penalty in (0.0, 4.0):
        s = toxicity.Scorer(*toxicity.fit(texts, toxic, penalty=penalty))
        gap[penalty] = abs(s("the muslim man word3 word5") - s("the christian man word3 word5"))
        assert all(s(t) > 0.5 for t, y in zip(texts, toxic, strict=True) if y) and sum(
            s(t) < 0.3 for t, y in zip(texts, toxic, strict=True) if not y
        ) > 190
    assert gap[4.0] < 0.3 * gap[0.0]


def test_gradient_is_that_of_the_loss():
    """Central differences of the loss, with swaps, at weights drawn at random."""
    rng = np.random.default_rng(8)
    texts, toxic = labelled(60)
    rows = [toxicity.features(t) for t in texts]
    kept, _ = toxicity.choose(rows, toxic.astype(float), 50)
    swapped = [(toxicity.places(a, kept), toxicity.places(b, kept)) for t in texts for a, b in toxicity.changes(t)]
    assert len(kept) == 50 and any(len(b) for _, b in swapped)
    sample = toxicity.Sample([toxicity.places(r, kept) for r in rows], toxic.astype(float), swapped, 50, 4.0)
    w, b = rng.normal(size=50), 0.3
    _, g, g_b = sample.objective(w, b)
    for k in range(50):
        step = np.eye(50)[k] * 1e-5
        assert abs((sample.objective(w + step, b)[0] - sample.objective(w - step, b)[0]) / 2e-5 - g[k]) < 1e-7
    assert abs((sample.objective(w, b + 1e-5)[0] - sample.objective(w, b - 1e-5)[0]) / 2e-5 - g_b) < 1e-7
    brute = 0.0
    for t in texts:
        own = set(toxicity.features(t).tolist())
        for x in toxicity.swaps(t):
            other = set(toxicity.features(x).tolist())
            brute += sum(w[i] * ((h in own) - (h in other)) for i, h in enumerate(kept.tolist())) ** 2
    plain = toxicity.Sample([toxicity.places(r, kept) for r in rows], toxic.astype(float), [], 50, 4.0).objective(w, b)[0]
    assert abs(sample.objective(w, b)[0] - plain - 4.0 * brute / len(swapped)) < 1e-9


def test_swaps_without_chosen_features():
    """Swaps whose terms are no chosen feature add nothing, alone or beside others."""
    toxic, rows = np.array([1.0, 0.0]), [np.array([0]), np.array([1])]
    none = np.zeros(0, int)
    for swapped in ([(none, none)], [(none, none), (none, np.array([1]))], []):
        sample = toxicity.Sample(rows, toxic, swapped, 2, 4.0)
        loss, g, _ = sample.objective(np.array([1.0, 2.0]), 0.0)
        assert np.isfinite(loss) and g.dtype == float
        w, _ = sample.fit(np.array([1.0, -1.0]))
        assert w[0] > 0 > w[1]


def test_fit_of_rows_is_that_of_texts(spark):
    texts, toxic = labelled(120)
    rows = spark.createDataFrame(
        [(k, t, int(y)) for k, (t, y) in enumerate(zip(texts, toxic, strict=True))], "label_id long, text string, label int"
    )
    for got, want in zip(toxicity.fit_rows(rows.repartition(5), n_features=60), toxicity.fit(texts, toxic, n_features=60), strict=True):
        assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_swaps():
    assert toxicity.swaps("A Muslim man", (("muslim", "jewish", "hindu"), ("man", "woman"))) == ["a jewish woman", "a hindu man"]
    assert toxicity.swaps(None) == toxicity.swaps("no terms here") == []


def test_toxicity_edges(spark):
    texts, toxic = labelled(400, biased=False)
    rows = [(1000 + i, t, "en", "a") for i, t in enumerate(texts)]
    labels = spark.createDataFrame(
        [(1000 + i, 1, int(y), "clash") for i, y in enumerate(toxic)] + [(None, 1, 1, "clash"), (1000, 1, 1, "twice")],
        "doc_id long, quality int, toxic int, text string",
    )
    got = toxicity.toxicity(docs(spark, rows + EDGE), labels).collect()
    assert len(got) == len(rows) + len(EDGE) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and (r.doc_id or 0) >= 1000]
    assert len(held) > 60 and sum(r.predicted == toxic[r.doc_id - 1000] for r in held) > 0.9 * len(held)
    assert toxicity.toxicity(docs(spark, EDGE), labels.limit(0)).count() == len(EDGE)
    assert toxicity.toxicity(docs(spark, []), labels).count() == 0


# ---- 3: language ------------------------------------------------------------------

_SYLLABLES = {
    "en": "th er on an re he in ed nd ha".split(),
    "de": "ch sch ung ei ver ge der ich ent st".split(),
    "fr": "eau ou ent ai que oi les é on re".split(),
    "es": "ción ado ar os ll ue ra í que ez".split(),
}


def prose(lang, seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(_SYLLABLES[lang], int(rng.integers(1, 4)))) for _ in range(n))


def test_language(spark):
    rows = [(k, prose(lang, k, 4 + k % 60), lang, "a") for k in range(240) for lang in [list(_SYLLABLES)[k % 4]]]
    got = language.language_id(
        docs(
            spark,
            rows + [
                (None, "tie", "en", "a"), (900, None, None, None), (901, "", "en", "a"), (902, "12 !!", "en", "a"), (903, LONG, "en", "a")
            ],
        )
    ).collect()
    assert len(got) == 245 and all(0 <= r.score <= 1 for r in got)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert len(held) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (900, 901, 902))
    none = language.language_id(docs(spark, [(1, "abc", None, None)])).first()
    assert none.lang_pred == "und"
    one = language.language_id(docs(spark, [(k, prose("en", k), "en", "a") for k in range(20)])).collect()
    assert {r.lang_pred for r in one} == {"en"}
    assert language.language_id(docs(spark, [])).count() == 0


def test_many_languages(spark, monkeypatch):
    """Each of 70 languages is learned, with as few rows in all as languages too."""
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 70 * 3)]
    rows = [(k, " ".join("".join(alphabet[3 * (k % 70) :][:3]) for _ in range(4 + k // 70)), f"x{k % 70:02d}", "a") for k in range(70 * 6)]
    for most in (None, 70):
        if most:
            monkeypatch.setattr(language, "ROWS", most)
        got = language.language_id(docs(spark, rows)).collect()
        assert {r.lang_pred for r in got} == {r[2] for r in rows}
        assert all(r.lang_pred == f"x{r.doc_id % 70:02d}" for r in got)


def test_language_family_first(spark):
    rows = [(k, prose(lang, k), lang) for k in range(80) for lang in _SYLLABLES]
    model = language.fit(spark.createDataFrame(rows, "h long, text string, lang string"))
    assert {m[:3] for m in model} == {("family", "germanic", ""), ("family", "romance", ""), ("pair", "de", "en"), ("pair", "es", "fr")}


def test_texts_without_letters_are_und(spark):
    """Numbers of any kind are no letters; a letter of any script is one."""
    rows = [(k, prose("en", k), "en", "a") for k in range(20)]
    none, some = ["½ ²", "①", "Ⅷ", "12 !!", "٣", "_", "\u0301"], ["ª", "я", "中", "ʰ", "ǅ", "½ a"]
    texts = [(100 + k, t, None, "a") for k, t in enumerate(none + some)]
    got = {r.doc_id: r.lang_pred for r in language.language_id(docs(spark, rows + texts)).collect()}
    assert [got[100 + k] for k in range(len(none + some))] == ["und"] * len(none) + ["en"] * len(some)


def test_sparse_svm_is_a_minimum():
    """Dual coordinate descent against gradient descent on the primal problem of dense rows."""
    rng = np.random.default_rng(2)
    texts = [prose(lang, k, 8) for k in range(30) for lang in ("en", "de")]
    y = np.tile([1, -1], 30)
    w = language.svm([language.sparse(t) for t in texts], y, epochs=200)
    x = np.hstack([np.stack([language.vector(t) for t in texts]), np.ones((60, 1))])
    loss = lambda w: 0.5 * w @ w + (np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    least = np.zeros(x.shape[1])
    for _ in range(4000):
        least -= 0.002 * (least - 2 * x.T @ (y * np.maximum(0, 1 - y * (x @ least))))
    assert abs(loss(w.astype(float)) - loss(least)) < 1e-3 * loss(least)
    assert all(loss(w + 1e-3 * rng.normal(size=len(w))) > loss(w) for _ in range(20))


# ---- 5: BPE -----------------------------------------------------------------------

ODD = [
    "",
    "  ",
    "I'm you'LL it's café ΣΑΣ ẞ İstanbul ½ 123 a\x1cb \x1d\x85 q　z é",
    "<|endoftext|>x<|startoftext|> <|endoftext <|EndOfText|>",
    "日本語 テキスト 🎉👨‍👩‍👧 aaaaaa aaaa",
    "Å ẛ̣ ﬁ don't'd 'S 'T",
    "a" * 3000,
    "ab" * 2000 + "!" * 500,
    " x y﻿z​",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.tokenizer_path(), keep=50)


def test_bpe_odd_texts(library, encoder):
    for _ in range(2):
        for text, ids in zip(ODD, encoder.encode(ODD), strict=True):
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, np.int32).tolist() == want
            assert encoder.decode(ids) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_bpe_any_text(library, encoder, texts):
    texts = [t for t in texts if t.encode("utf-8", "ignore").decode() == t]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_frame(spark, library):
    rows = [(k, t, "en", "a") for k, t in enumerate(ODD)] + EDGE
    got = bpe.bpe(docs(spark, rows), bpe.tokenizer_path())
    out = {(r.doc_id, r.decoded): r for r in got.collect()}
    assert got.count() == len(rows)
    digests = {r.doc_id: r for r in bpe.digests(bpe.bpe(docs(spark, rows[: len(ODD)]), bpe.tokenizer_path())).collect()}
    for k, t in enumerate(ODD):
        want = library.encode(t, add_special_tokens=False).ids
        assert digests[k].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest() and digests[k].n_tokens == len(want)
        assert digests[k].decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert out[1, ""].ids == []
    in_worker = bpe.bpe(docs(spark, rows[: len(ODD)]), bpe.tokenizer_path(), digest=True).collect()
    assert {r.doc_id: tuple(r) for r in in_worker} == {i: tuple(r) for i, r in digests.items()}
    assert bpe.bpe(docs(spark, []), bpe.tokenizer_path()).count() == 0


# ---- 6: main text -----------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="</p>";</script></head><body>
<header class="site"><a href=/>Home page</a></header><nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav><!-- ad 1 -->
<div class="ad">Buy this now, really good and cheap for all of you.</div><article><h1>Title &amp; more</h1><p><b>First&nbsp;line<br>goes   on &lt;here&gt;.<p>Second
 line with <a href=x>a link</a>.</p><aside>Not this.</aside><form><p>Nor this</p></form><div class="share">Share it</div><ul><li>Item one of list</li></ul></article>
<div id="comments"><p>I think that this is a very long comment by a reader that goes on and on.</p></div><footer>&copy; Someone and others</footer></body></html>"""


def test_main_text():
    w = html.learn()
    assert html.extract(PAGE, w) == "Title & more\nFirst line goes on <here>.\nSecond line with a link.\nItem one of list"
    for empty in (None, "", "<p></p>", "<nav>a b c</nav>", "<script>x", "<!-- c"):
        assert html.extract(empty, w) == ""
    assert html.extract("only  plain\ntext", w) == "only plain text"
    assert html.extract("<p>seen</p><script>var x = 1; a < b", w) == html.extract("<p>seen</p><!-- <p>no</p> and", w) == html.extract(
        "<p>seen</p><!-- no", w
    ) == "seen"
    assert html.extract("<p>one</p><p>two < three", w) == "one\ntwo < three"
    for broken in (
        '<a b="' * 20000,"<p>a <", "<a href='x>y</a>", "</div></p><p>text here</p>", "<" * 2000, "<p" * 500, "<p>" * 3000 + "deep"
    ):
        html.extract(broken, w)
    assert html.extract(
        "<body><div><p>one two three four five</p><p>six</p></div><ul><li><a href=x>m</a></li></ul>", w
    ) == "one two three four five\nsix"


def test_main_text_frame(spark):
    df = spark.createDataFrame(
        [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None), (2, "v", "<p>" + "word " * 200000, "t")],
        "page_id long, url string, html string, text string",
    )
    got = html.main_text(df).collect()
    assert len(got) == 4 and {r.n_chars == len(r.text) for r in got} == {True}
    assert next(r for r in got if r.page_id == 2).n_chars == 5 * 200000 - 1
    assert next(r for r in got if r.page_id is None).text == ""
    assert html.main_text(df.limit(0)).count() == 0


def test_weights_come_from_the_labels():
    pages = [
        [("<nav>a b</nav>", False), ("<p>one two three</p>", True)], [("<div class=x>x y z</div>", False), ("<p>four five</p>", True)]
    ] * 3
    w = html.learn(pages)
    none, out = html.Place(), html.Place(None, frozenset(["name:x"]), w.deeper(frozenset(["name:x"]), 0.0))
    assert w.inside(none) and not w.inside(out) and w.word(none, "p", False) > 0 > w.word(out, "div", False)
    assert all(v <= -0.05 for v in w.tags.values())
    swapped = html.learn([[(piece, not main) for piece, main in page] for page in pages])
    assert swapped.word(none, "p", False) < 0


ARTICLE = "<h1>A title</h1>" + "".join(f"<p>{' '.join(f'w{k}x{i}' for i in range(40))}</p>" for k in range(3))
FRAME = (
    "<html><body><nav><ul><li><a href=/a>home</a></li><li><a href=/b>news</a></li></ul></nav>{}"
    "<div class=comments><p>what a nice text is this one here</p></div><footer>c someone</footer></body></html>"
)


@pytest.mark.parametrize(
    "name",
    [
        "page no-sidebar",
        "layout with-ads",
        "review",
        "post-review",
        "has-comments",
        "search-results-article",
        "story related",
        "widget-area content",
        "unheard of",
        "x1y2",
    ],
)
def test_main_text_no_name_decides_by_itself(name):
    w = html.learn()
    want = html.extract(FRAME.format(f"<article>{ARTICLE}</article>"), w)
    assert len(want.split()) == 122
    for tag in (f'<div class="{name}">', f'<div id="{name}">'):
        assert html.extract(FRAME.format(f"{tag}{ARTICLE}</div>"), w) == want


@pytest.mark.parametrize(
    "name", ["sidebar", "ad", "cookie-notice", "comments", "site-footer", "navbar", "newsletter", "share", "advertisement", "comment-list"]
)
def test_main_text_leaves_out(name):
    w = html.learn()
    junk = f'<div class="{name}"><p>junk text of a box with some words in it</p></div>'
    for page in (
        f"{junk}<article>{ARTICLE}</article>",
        f"<article>{ARTICLE}</article>{junk}",
        f"<article>{ARTICLE}{junk}{ARTICLE}</article>",
        f"<div class=content>{ARTICLE}</div>{junk}",
    ):
        assert "junk" not in html.extract(FRAME.format(page), w) and "w2x39" in html.extract(FRAME.format(page), w)


def test_main_text_of_formulas_and_drawings():
    page = "<article><p>Let <math><mi>x</mi></math> be <object>an object</object>.</p><svg><text>a label</text></svg></article>"
    assert html.extract(page, html.learn()) == "Let x be an object.\na label"


def brute_region(before, scores):
    """All contiguous regions; of equal ones that which ends first, then that which starts last."""
    best = max(
        ((round(sum(scores[a:b]) + sum(before[a + 1 : b]), 9), -b, a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)),
        default=(0, 0, 0),
    )
    return (best[2], -best[1]) if best[0] > 0 else (0, 0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(-4, 0), st.integers(-6, 6)), max_size=14))
def test_region_is_the_best_of_all(blocks):
    before, scores = [float(a) for a, _ in blocks], [float(b) for _, b in blocks]
    assert html.best_region(before, scores) == brute_region(before, scores)


def test_regions_of_pages_are_the_best_of_all():
    w = html.learn()
    rng = np.random.default_rng(3)
    pieces = [p for page in html.labelled_pages()[:40] for p, _ in page]
    for _ in range(120):
        page = "".join(pieces[k] for k in rng.integers(0, len(pieces), 12))
        before, scores, texts, kept = html.score_blocks(page, w)
        a, b = brute_region(before, scores)
        assert html.extract(page, w) == "\n".join(t for t, k in zip(texts[a:b], kept[a:b], strict=True) if k)


# ---- 8: quality rules -------------------------------------------------------------


def brute_counts(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {j for i in range(len(ws) - 2) if tri[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n\t#*\x1c\x85", max_size=60))
def test_base_counts(text):
    assert quality.base_counts(text) == brute_counts(text)


def brute_ngrams(text):
    t = [x.lower() for x in re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\x20\x09-\x0d]+", (text or "").encode())]
    return len(t), Counter(t) + Counter(zip(t, t[1:], strict=False))


def test_ngram_buckets_count_what_they_should():
    for text in ("Ab cd, ab CD! é#x", "", "a", LONG[:500]):
        n, grams = brute_ngrams(text)
        got = quality.ngram_buckets(text, 1 << 30)
        assert len(got) == max(0, 2 * n - 1) and sorted(Counter(got.tolist()).values()) == sorted(grams.values())


def test_quality_rules(spark):
    good = [" ".join(np.random.default_rng(k).choice([f"w{j}" for j in range(300)], 2500)) for k in range(40)]
    bad = [" ".join(f"{w}###" for w in np.random.default_rng(k).choice([f"w{j}" for j in range(300)], 2500)) for k in range(10)]
    rows = [(k, t, "en", "a") for k, t in enumerate(good + bad)] + [(100 + k, t, lang, s) for k, (_, t, lang, s) in enumerate(EDGE)]
    labels = spark.createDataFrame(
        [(k, 1, 0, "x") for k in range(0, 40, 2)] + [(None, 1, 1, "x"), (0, 1, 0, "x"), (41, 0, 0, "x")],
        "doc_id long, quality int, toxic int, text string",
    )
    got = {r.doc_id: r for r in quality.quality_rules(docs(spark, rows), labels).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert all(got[k].kept for k in range(40)) and not any(got[k].kept for k in range(40, 50))
    kept = quality.keep_good(docs(spark, rows), labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept} and kept.columns == docs(spark, rows).columns
    assert quality.quality_rules(docs(spark, []), labels).count() == 0
    assert all(not r.kept or not r.base_failed for r in quality.quality_rules(docs(spark, rows), labels.limit(0)).collect())


def test_llr_and_verdict_by_brute_force(spark):
    """Both multinomials, the ratio of every text and its verdict, counted in Python; the bound on trusted ids is a parameter."""
    rng = np.random.default_rng(7)
    vocabulary = [f"w{j}" for j in range(150)]
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(30, 120)))) for _ in range(30)]
    texts += [" ".join(f"{w}$$" for w in rng.choice(vocabulary, 90)) for _ in range(10)]
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)] + [(900, None, None, None), (901, "", "en", "a")]
    labels = spark.createDataFrame([(k, int(k % 3 == 0), 0) for k in range(30)], "doc_id long, quality int, toxic int")
    buckets = 1 << 10
    raw, target = np.ones(buckets), np.zeros(buckets)
    for k, t in enumerate(texts):
        for x in quality.ngram_buckets(t, buckets).tolist():
            raw[x] += 1
            target[x] += k < 30 and k % 3 == 0
    share = raw / raw.sum()
    ratio = np.log((target + quality.PRIOR * share) / (target.sum() + quality.PRIOR) / share)
    for threshold in (-0.35, 0.0):
        got = quality.quality_rules(docs(spark, rows), labels, threshold=threshold, buckets=buckets).collect()
        for r in got:
            found = quality.ngram_buckets(dict((i, t) for i, t, *_ in rows)[r.doc_id], buckets)
            want = float(np.mean([ratio[x] for x in found.tolist()])) if len(found) else 0.0
            assert abs(r.llr - want) < 1e-9 and r.kept == (not r.base_failed and r.llr >= threshold)
        assert {r.kept for r in got if not r.base_failed} == {False, True} or threshold < 0
    few = quality.fit(docs(spark, rows), labels, trusted=2, buckets=buckets)
    assert not np.allclose(few, quality.fit(docs(spark, rows), labels, buckets=buckets))


# ---- 10: top-k --------------------------------------------------------------------


def brute_topk(rows, k=10, every=100):
    ok = [(i, np.floor(np.array(v, float) * 1024).astype(np.int64)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, qv in ok:
        if q is not None and q % every == 0:
            found = [(-int(qv @ v), i is None, i) for i, v in ok if i != q and len(v) == len(qv)]
            out[q] = [(i, -s) for s, _, i in sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k]]
    return out


@pytest.mark.parametrize("kind", ["spread", "clustered", "copies", "few"])
def test_topk(spark, kind, monkeypatch):
    monkeypatch.setattr(topk, "PASSING", 3)
    rng = np.random.default_rng(4)
    n, dim = {"few": (5, 3)}.get(kind, (700, 8))
    x = rng.normal(size=(n, dim))
    if kind == "clustered":
        x = rng.normal(size=(6, dim))[rng.integers(0, 6, n)] + 0.01 * x
    if kind == "copies":
        x = np.tile(rng.normal(size=(3, dim)), (n // 3 + 1, 1))[:n]
    rows = [(i * (20 if kind == "few" else 1), [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    rows += [
        (9001, None),
        (9002, [1.0, None] + [0.0] * (dim - 2)),
        (9003, [float("nan")] * dim),
        (9004, [float("inf")] * dim),
        (9005, []),
        (9006, [1.0] * (dim + 1)),
        (None, [0.5] * dim),
    ]
    df = spark.createDataFrame([(i, v, 1, 5) for i, v in rows], "vec_id long, embedding array<float>, label int, v int")
    got: dict = {}
    for r in sorted(topk.top_k(df, group=150, pivots=4).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: v for q, v in brute_topk(rows).items() if v}
    assert topk.top_k(df.limit(0)).count() == 0


def test_topk_of_huge_components(spark):
    """Products beyond a long are ranked exactly and returned as the nearest long; those of other rows are as ever."""
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=3)]) for k in range(201)]
    rows += [
        (300, [1e30, 1.0, 2.0]),
        (301, [1e30, 1.5, 2.0]),
        (302, [-1e30, 0.25, 1.0]),
        (303, [1e308, -1e308, 3.0]),
        (304, [2e9, 1.0, 1.0]),
        (305, [3e9, -1e5, 7.0]),
        (400, [1e308, 1.0, 0.0]),
    ]
    whole = lambda v: [__import__("math").floor(__import__("fractions").Fraction(x) * 1024) for x in v]
    exact = [(i, whole(v)) for i, v in rows]
    want = {}
    for q, qv in exact:
        if q % 100 == 0:
            found = sorted(((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in exact if i != q))[:10]
            want[q] = [(i, max(-(2**63 - 1), min(2**63 - 1, -s))) for s, i in found]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in sorted(topk.top_k(df, group=40).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want


def test_topk_visits_few_trees(spark, monkeypatch):
    """With data in clusters the floor of the first tree keeps queries away from most others."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(8, 8))[rng.integers(0, 8, 1600)] * 50 + rng.normal(size=(1600, 8)) * 0.1
    df = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    sent = []
    passing = topk._passing
    monkeypatch.setattr(
        topk, "_passing", lambda trees, queries, k: (sent.append((trees.count(), queries.count())), passing(trees, queries, k))[1]
    )
    assert topk.top_k(df, group=200, pivots=64).count() == 160
    (trees, first), (_, second) = sent
    assert first == 16 and second < 0.5 * 16 * (trees - 1), (trees, first, second)


def test_mtree_prunes():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] * 1000 + rng.normal(size=(4000, 16)) * 10).astype(np.int64)
    tree = topk.MTree(list(range(4000)), x)
    for q in range(0, 4000, 400):
        tree.search(x[q], q, 10)
    assert tree.computed < 0.35 * 10 * 4000
