"""Learnt parts and renderers against plain versions: convolution, gradients, risks, Baum-Welch, calibrated scores, page layout; fingerprints that resist patterns."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("shoebox.llm.queries")
from shoebox.llm import hashed_features, hmm_scoring, html_extraction, jaccard_join, kernels, language_id, quality_classifier, quality_rules, substring_dedup, text_stats  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(rng, n, least=0, most=60):
    vocabulary = ["".join(rng.choices("abcdeé!A7", k=rng.randint(1, 9))) for _ in range(60)]
    return [" ".join(rng.choices(vocabulary, k=rng.randint(least, most))) for _ in range(n)]


def opposites(n):
    """Two texts of the letters a and b whose difference cancels out in any polynomial modulo a power of two."""
    x = [0]
    while len(x) < n:
        x += [1 - i for i in x]
    return "".join("ab"[i] for i in x), "".join("ba"[i] for i in x)


def test_fingerprints_tell_patterned_words_apart():
    a, b = opposites(1024)
    c, d = opposites(64)
    buf, offs = kernels.text_buffer(pa.array([f"{a} {b} {a} {c} {d} {c} {c}\0 x"]))
    h = kernels.Words(buf, offs).hash
    assert h[0] == h[2] != h[1] and h[3] == h[5] != h[4] and len(set(h.tolist())) == 6
    line = kernels.text_buffer(pa.array([f"{a}\n{b}\n{a}\n"]))
    assert text_stats.duplicate_lines(*line).tolist() == [1]
    words = np.array([kernels.mix(np.array([1], np.uint64))[0], kernels.mix(np.array([2], np.uint64))[0]])
    x, y = (words[[("ab").index(ch) for ch in t]] for t in (c, d))
    assert kernels.window_hash(x, 64)[0] != kernels.window_hash(y, 64)[0]


def test_patterned_texts_stay_apart_in_the_operators(spark, tmp_path):
    a, b = opposites(1024)
    tail = " ".join(f"w{i}" for i in range(40))
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(1, f"{a} {tail} one"), (2, f"{b} {tail} two"), (3, a), (4, b)], "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    removed = {r.doc_id: r.n_removed for r in substring_dedup.find(docs).collect()}
    assert removed == {1: 40, 2: 40, 3: 0, 4: 0}  # not the patterned word before them
    assert {r.doc_id: r.component_id for r in jaccard_join.join(docs, 4, 95).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    known = {r.doc_id: r.n_known for r in hmm_scoring.score(docs, docs.where("doc_id = 3"), states=2, symbols=4, classes=2, size=4, passes=1).collect()}
    assert known[3] == 2 and known[4] == 1


def test_convolution_against_loops():
    model = language_id.ByteCnn(["x", "y"], filters=3).compiled()
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 256, (4, language_id.WIDTH)).astype(np.uint8)
    got = model.probabilities(windows)
    for row, window in zip(got, windows, strict=True):
        hidden = []
        for k in language_id.SIZES:
            hidden += [max(sum(model.p[k][j][window[at + j], f] for j in range(k)) for at in range(language_id.WIDTH - k + 1)) for f in range(3)]
        z = np.exp(np.array(hidden) @ model.p["w"] + model.p["b"])
        assert np.allclose(row, z / z.sum(), atol=1e-4)


def test_convolution_gradient_against_differences():
    model = language_id.ByteCnn(["x", "y", "z"], filters=2)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(2)
    x, y = rng.integers(60, 70, (5, language_id.WIDTH)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, grads = model.gradients(x, y)
    for name, g in grads.items():
        for at in [tuple(rng.integers(0, n) for n in g.shape) for _ in range(6)] + [tuple(i[0] for i in np.nonzero(g))]:
            kept = model.p[name][at]
            model.p[name][at] = kept + 1e-5
            up = model.gradients(x, y)[0]
            model.p[name][at] = kept - 1e-5
            down = model.gradients(x, y)[0]
            model.p[name][at] = kept
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def test_windows_hold_every_byte():
    rng = random.Random(3)
    texts = [*texts_of(rng, 20, 0, 200), "", None, "x" * 256, "y" * 257, "z" * 40_000]
    buf, offs = kernels.text_buffer(pa.array(texts))
    windows, text, size = language_id.window_matrix(buf, offs)
    for i, t in enumerate(texts):
        assert b"".join(w[:n].tobytes() for w, n in zip(windows[text == i], size[text == i], strict=True)) == (t or "").encode()


def naive_features(text):
    """Shares of the n-grams of one text, by their meaning rather than their bucket."""
    raw, words = text.encode(), [w.encode() for w in WORD.findall(text)]
    grams = [[raw[i : i + k] for i in range(len(raw) - k + 1)] for k in (3, 4)] + [words, list(itertools.pairwise(words))]
    return [Counter(g) for g in grams]


def test_features_and_margins_against_counters():
    rng = random.Random(5)
    texts = [*texts_of(rng, 30), "", "a", "ab cd", "x" * 300_000]
    x = hashed_features.Features(texts, block=7)
    w = np.random.default_rng(0).normal(size=hashed_features.SIZE)
    got, table = x.dot(w), {}
    scored = np.zeros(len(texts))
    for lo, hi, *_, parts in hashed_features.family_slices(pa.array(texts)):
        scored[lo:hi] = hashed_features.margins(w, parts)
    assert np.allclose(got, scored, atol=1e-3)
    # a gram's weight is read off a text that consists of it
    for f, short in ((0, "abc"), (1, "abcd"), (2, "w")):
        one = hashed_features.Features([short])
        for text, margin in zip(texts[:3], got[:3], strict=True):
            table[f, text] = margin, one.dot(w)[0]
    for text, margin in zip(texts[:30], got, strict=False):
        want = 0.0
        for f, grams in enumerate(naive_features(text)):
            n = sum(grams.values())
            for gram, count in grams.items():
                want += hashed_features.SCALE * count / n * w[bucket(f, gram)]
        assert abs(want - margin) < 1e-2
    d = np.random.default_rng(1).normal(size=len(texts))
    assert abs(x.back(d) @ w - d @ got) < 1e-2 * max(1, np.abs(d @ got))


def bucket(family, gram):
    """The bucket of one n-gram, from a text of that n-gram alone."""
    if family < 2:
        code = 0
        for byte in gram:
            code = (code * 257 + byte) % 2**32
        return ((code * 2654435769) % 2**32 >> (32 - hashed_features.BITS)) + (family << hashed_features.BITS)
    text = gram.decode() if family == 2 else b" ".join(gram).decode()
    buf, offs = kernels.text_buffer(pa.array([text]))
    words = kernels.Words(buf, offs)
    h = words.hash[0] if family == 2 else words.windows(2)[0][0]
    return int(h >> np.uint64(64 - hashed_features.BITS)) + (family << hashed_features.BITS)


def test_positive_unlabelled_risk_against_loops():
    rng = np.random.default_rng(3)
    for prior in (0.3, 0.7):
        for shift in (0, 4):
            z, pos = rng.normal(size=12), np.arange(12) < 5
            z[pos] += shift
            risk, step = quality_classifier.pu_risk(z, pos, prior)
            loss = lambda m: math.log1p(math.exp(-m))
            positive = [loss(v) for v in z[pos]]
            negative = sum(loss(-v) for v in z[~pos]) / 7 - prior * sum(loss(-v) for v in z[pos]) / 5
            assert abs(risk - (prior * sum(positive) / 5 + max(0, negative))) < 1e-9
            for i in range(12):
                moved = z.copy()
                moved[i] += 1e-6
                up = quality_classifier.pu_risk(moved, pos, prior)[0]
                moved[i] -= 2e-6
                slope = (up - quality_classifier.pu_risk(moved, pos, prior)[0]) / 2e-6
                if negative > 0:
                    assert abs(slope - step[i]) < 1e-6  # downhill on the whole risk
                elif not pos[i]:
                    assert step[i] < 0  # uphill on the second term


def test_prior_is_estimated_from_the_two_samples():
    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choices("abcde", k=5)) for _ in range(60))
    bad = lambda: " ".join("".join(rng.choices("ABCDE", k=5)) for _ in range(60))
    for share in (0.3, 0.6, 0.9):
        web = [good() if rng.random() < share else bad() for _ in range(400)]
        model = quality_classifier.PuModel().fit([good() for _ in range(200)], web, steps=5)
        assert abs(model.prior - share) < 0.1


def test_calibration_against_a_grid():
    rng = np.random.default_rng(4)
    z = rng.normal(size=200)
    y = (rng.random(200) < 1 / (1 + np.exp(-(2 * z - 0.5)))).astype(float)
    a, b = quality_rules.platt(z, y)
    n1, n0 = y.sum(), (1 - y).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    loss = lambda a, b: np.mean(np.logaddexp(0, a * z + b) - goal * (a * z + b))
    assert all(loss(a, b) <= loss(a + s, b + t) + 1e-5 for s in (-0.1, 0, 0.1) for t in (-0.1, 0, 0.1))


def test_models_on_awkward_rows(spark):
    rng = random.Random(7)
    good, bad = texts_of(rng, 60, 30, 60), [t.upper() + " !!" for t in texts_of(rng, 60, 30, 60)]
    rows = [(i, t) for i, t in enumerate(itertools.chain(good, bad))] + [(200, None), (201, ""), (202, "x" * 200_000), (3, good[3]), (None, good[4]), (203, "a b " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as _body", "2 as score", "3 as rest", "4 as `a``b.c`")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(None, 1), (3, 1), (200, None)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels)
    out = quality_classifier.score(docs, model)
    assert out.columns == [*docs.columns, "pu_score"] and out.count() == len(rows)
    got = {(r.doc_id, r.text): r.pu_score for r in out.collect()}
    assert got[200, None] == got[201, ""] and all(0 <= p <= 1 for p in got.values())
    one = {t: float(model.scores(pa.array([t]), 1)[0]) for t in (good[0], bad[0])}
    assert abs(got[0, good[0]] - one[good[0]]) < 1e-6 and got[0, good[0]] > 0.5 > got[60, bad[0]]
    with pytest.raises(ValueError, match="pu_score"):
        quality_classifier.score(out, model)
    kept = quality_classifier.select(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(60)) and kept.schema == docs.schema
    rules = quality_rules.train(docs, labels)
    scored = quality_rules.apply_rules(docs, rules).collect()
    assert len(scored) == len(rows) and {r.doc_id for r in scored if r.base_failed} >= {200, 201, 202, 203}
    w, bias, a, b = rules
    z = hashed_features.Features([good[0]]).dot(w.astype(float))[0] + bias
    assert abs(next(r.probability for r in scored if r.doc_id == 0) - 1 / (1 + math.exp(-(a * z + b)))) < 1e-4
    langs = docs.withColumn("lang", docs.text.substr(1, 0))
    found = language_id.identify(langs, language_id.train(docs.selectExpr("doc_id", "text", "case when doc_id < 60 then 'low' when doc_id < 120 then 'up' end lang"))).collect()
    assert len(found) == len(rows) and {r.lang_pred for r in found if r.doc_id in (200, 201)} == {"und"} and next(r.lang_pred for r in found if r.doc_id == 70) == "up"


def naive_counts(model, sequences):
    total = model.empty()
    for x in sequences:
        n = len(x)
        if not n:
            continue
        a, b = np.zeros((n, model.k)), np.ones((n, model.k))
        a[0] = model.first * model.emit[:, x[0]]
        for t in range(1, n):
            a[t] = (a[t - 1] @ model.move) * model.emit[:, x[t]]
        for t in range(n - 2, -1, -1):
            b[t] = model.move @ (model.emit[:, x[t + 1]] * b[t + 1])
        p = a[-1].sum()
        for t in range(n):
            total["emit"][:, x[t]] += a[t] * b[t] / p
        total["first"] += a[0] * b[0] / p
        for t in range(1, n):
            total["move"] += model.move * np.outer(a[t - 1], model.emit[:, x[t]] * b[t]) / p
    return total


@pytest.mark.parametrize("held", [1, 3, 7, 50, 1 << 19])
def test_expected_counts_against_naive_baum_welch(held):
    rng = np.random.default_rng(0)
    model, sizes = hmm_scoring.Hmm(3, rng.random(7) * 5), [5, 1, 90, 0, 3, 90, 2, 141]
    border = np.append(0, np.cumsum(sizes))
    symbols = rng.integers(0, 7, border[-1])
    want, got = naive_counts(model, [symbols[a:b] for a, b in itertools.pairwise(border)]), model.empty()
    model.expect(symbols, border, got, held)
    assert all(np.allclose(got[k], want[k], rtol=1e-4, atol=1e-4) for k in want)


def test_words_share_their_class(spark, tmp_path):
    """With one state the score of a text is a sum over its words: symbol or class, then the word inside its class."""
    path = str(tmp_path / "d.parquet")
    rows = [(1, "aa bb aa cc xbb xcc"), (2, "aa bb zbb qcc nn"), (3, ""), (4, None), (5, "nn mm")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    training = docs.where("doc_id <= 3")
    got = {r.doc_id: r.score for r in hmm_scoring.score(docs, training, states=1, symbols=2, classes=3, size=3, passes=1).collect()}
    vocabulary = hmm_scoring.Vocabulary(hmm_scoring.word_counts(training, 3), 2, 3, 3)
    token = lambda t: [*WORD.findall(t or ""), None]
    count = Counter(w for _, t in rows[:3] for w in token(t))

    def parts(text):
        for _, _, seq, _, words, _, _ in vocabulary.read(pa.array([text or ""])):
            names = [*(text or "").split(), None]
            for s, w in zip(seq.tolist(), names, strict=True):
                yield s, w

    classes = defaultdict(set)
    for _, text in rows[:3]:
        for s, w in parts(text):
            classes[s].add(w)
    mass = np.zeros(vocabulary.size)
    for _, text in rows[:3]:
        for s, _ in parts(text):
            mass[s] += 1
    base = (vocabulary.mass + 0.5) / (vocabulary.mass + 0.5).sum()
    emit = (mass + 0.02 * mass.sum() * base + 1e-3 * base) / (1.02 * mass.sum() + 1e-3)
    emit /= emit.sum()
    for doc, text in rows:
        want = 0.0
        for s, w in parts(text):
            want += math.log10(emit[s])
            if s >= vocabulary.symbols:
                want += math.log10((count[w] + 1) / (sum(count[x] for x in classes[s]) + len(classes[s]) + 1))
        assert abs(got[doc] - want) < 1e-4, doc


# pages
def random_page(rng, depth=0):
    """(html, lines): blocks whose lines are known by construction."""
    html, lines = "", []
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice(("div", "p", "ul", "hidden", "span") if depth < 3 else ("div", "p"))
        words = [rng.choice(("red", "blue", "日本", "x&y")) for _ in range(rng.randint(1, 4))]
        inline = " \n ".join(rng.choice(("<b>{}</b>", "{}", "<i style='color:red'>{}</i>")).format(w.replace("&", "&amp;")) for w in words)
        text = " ".join(words)
        if kind in ("div", "p"):
            html += f"<{kind}>{inline}</{kind}>" if kind == "div" or rng.random() < 0.5 else f"<p>{inline}<div></div>"
            lines.append(text)
        elif kind == "ul":
            html += "<ul>" + "".join(f"<li>{w.replace('&', '&amp;')}" for w in words) + "</ul>"
            lines += [f"- {w}" for w in words]
        elif kind == "hidden":
            html += rng.choice(("<div hidden>{}</div>", "<div style='display: none'>{}<p>{}</div>", "<p style='visibility:hidden'>{}</p>", "<script>{}</script>", "<dialog>{}</dialog>")).replace("{}", "no")
        else:
            inner, more = random_page(rng, depth + 1)
            html += f"<section style='visibility:hidden'>no<div style='visibility:visible'>{inner}</div>no</section>"
            lines += more
    return html, lines


def test_pages_against_construction():
    rng = random.Random(9)
    for _ in range(200):
        html, lines = random_page(rng)
        assert [x for x in html_extraction.visible_text(html).split("\n") if x] == lines, html


def test_tables_line_up():
    """Every cell begins where the other cells of its column begin, cells do not overlap, and each cell's lines stay together."""
    rng = random.Random(10)
    for _ in range(150):
        rows, name = [], itertools.count()
        for _ in range(rng.randint(1, 5)):
            rows.append([([f"{rng.choice(('c', '日本', 'wide cell '))}{next(name)}." for _ in range(rng.randint(1, 2))], rng.choice((1, 1, 2, 3)), rng.choice((1, 1, 2, 3))) for _ in range(rng.randint(1, 4))])
        out = html_extraction.aligned([[(list(lines), a, d) for lines, a, d in row] for row in rows])
        grid, column = set(), {}  # naive placement on a grid
        for r, row in enumerate(rows):
            c = 0
            for lines, across, down in row:
                while (r, c) in grid:
                    c += 1
                grid |= {(r + i, c + j) for i in range(down) for j in range(across)}
                for line in lines:
                    column[line] = c
                c += across
        begins = defaultdict(set)
        for line, c in column.items():
            (at,) = [(x, html_extraction.width_of(x[: x.index(line)])) for x in out if re.search(rf"(?<![^ ]){re.escape(line)}", x)]
            begins[c].add(at[1])
        assert all(len(x) == 1 for x in begins.values()) and sum(map(len, [lines for row in rows for lines, _, _ in row])) == len(column)
        order = [next(iter(begins[c])) for c in sorted(begins)]
        assert order == sorted(set(order))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<svg><title>t</title><text>a</text><text>b</text></svg>", "a\nb"), ("<math><mi>x</mi><mo>+</mo><mn>1</mn></math>", "x+1"), ("<ol><li value=5>a<li>b</ol>", "5. a\n6. b"), ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
        ("<ol type=i start=4><li>a</ol>", "iv. a"), ("<input type=submit><input type=hidden value=no>", "Submit"), ("<p hidden style='display:block'>a", "a"), ("<select><option>a<option selected>b</select>", "b"),
        ("<table><tr><td colspan=2000>a<td>b</table>", "a  b"), ("<details><summary>s</summary>no</details>", "s"), ("", ""), ("<b>", ""),
    ],
)
def test_page_rules(html, text):
    assert html_extraction.visible_text(html) == text
