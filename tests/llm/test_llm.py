"""The ten operators and the pipeline against brute force, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("shoebox.llm.queries")
from shoebox.llm import components, decontamination, hmm_scoring, html_extraction, jaccard_join, language_id, packing, quality_classifier, quality_rules, substring_dedup, token_counts  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, n_words string"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated ids and a clashing extra column; read from files."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, base = text(50), text(120).split()
    rows = [None, "", " \n\t ", "one", "one two", "One  TWO", "\u0000x\x1c\x85y", "12 34!", text(3000)]
    rows += [text(rng.randint(5, 200)) for _ in range(40)]
    rows += [text(20) + " " + passage + "\n" + text(20) for _ in range(6)]
    for _ in range(8):
        near = list(base)
        near[rng.randrange(len(near))] = "changed"
        rows.append(" ".join(near))
    rows += [rows[12], rows[12], "a a a a a a a a a a a a " * 8]
    table = [(i, t, None if i % 9 == 0 else "xx", "clash") for i, t in enumerate(rows)] + [(5, rows[5], "xx", "clash"), (None, rows[20], None, None)]
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "d.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def key(rows):
    return sorted(rows, key=repr)


def test_all_scripts_go_by_pre_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    whole, encoder, rng = Tokenizer.from_file(tokenizer()), token_counts.Encoder(tokenizer()), random.Random(6)
    texts = ["it’s “quoted” – hello…", "Привет, мир! Ещё ёлка", "日本語のテキスト。漢字 한국어 텍스트", "e\u0301 İstanbul ΟΔΟΣ", "ΑΒΓ ΐ ǅ ﬁ", "café déjà vu 12½ ²", "🙂👍 ok", "<|endoftext|> ‘x’", "a\u00a0b\u2003c\u200bd"]
    signs = "aZé’“”–…жЯ漢か한é́½²🙂 \n'01"
    texts += ["".join(rng.choices(signs, k=rng.randint(1, 30))) for _ in range(300)]
    assert all(sum(encoder.values(t)) == len(whole.encode(t, add_special_tokens=False).ids) for t in texts)
    assert [encoder.cut(t) is not None for t in texts[:9]] == [True, True, True, False, False, True, True, False, False]
    path = str(tmp_path / "d")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    frequent = token_counts.frequent_lengths(spark.read.parquet(path), tokenizer())
    assert {"’", "“", "привет", "漢字", "한국어"} <= set(frequent)  # the broadcast table serves them
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.read.parquet(path), tokenizer()).collect()} == {i: len(whole.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer())
    want = [(r.doc_id, len((r.text or "").encode()), len(whole.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
    for size in (5, 1000):
        got = token_counts.count_tokens(docs, tokenizer(), limit=100, table_size=size).collect()
        assert key((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == key(want)
        assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts.count_tokens(none, tokenizer()).count() == 0


@pytest.mark.parametrize("text", ["It's <|endoftext|>x I'LL", "NAÏVE ß ẞ × ÷ µ ª ¼ x", "é ́a", "日本 語 İ", "a b c", "x'''s 've''", "1234 5²"])
def test_chunks_encode_as_the_whole_text(text):
    from tokenizers import Tokenizer

    encoder = token_counts.Encoder(tokenizer(), list, 400)
    for _ in range(3):
        for x in (text, text + " again", " " + text):
            assert [i for part in encoder.values(x) for i in part] == Tokenizer.from_file(tokenizer()).encode(x, add_special_tokens=False).ids


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer())
    capacity = 256
    rows = packing.pack(docs, tokenizer(), capacity=capacity, group_windows=8, piece=64).collect()
    ids = {r.doc_id: [*whole.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        times = 2 if doc == 5 else 1
        assert all(p.doc_tokens == len(ids[doc]) and zlib.crc32(packing.as_bytes(ids[doc][p.start : p.start + p.length])) == p.ids_crc32 for p in pieces)
        covered = Counter(i for p in pieces for i in range(p.start, p.start + p.length))
        assert covered == Counter(dict.fromkeys(range(len(ids[doc])), times))  # the pieces tile the document
    lengths = []
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        lengths.append(at)
    padded = sum(capacity - n for n in lengths if n & (n - 1))  # powers of two need no padding
    assert padded <= 0.05 * sum(lengths)
    assert packing.pack(none, tokenizer()).count() == 0


def test_differencing_balances():
    rng = random.Random(1)
    sizes = [rng.randint(1, 100) for _ in range(400)]
    windows = packing.difference(sizes, 10)
    loads = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(400)) and max(loads) - min(loads) <= 20
    assert all(sum(sizes[i] for i in w) <= 2100 for w in packing.pack_group(sizes, 2100))


def test_language_id(spark, none):
    rng = random.Random(2)
    make = {"aa": "bcdfg", "bb": "mnopq", "cc": "éàùçè"}
    rows = [(i, " ".join("".join(rng.choices(make[lang], k=4)) for _ in range(rng.randint(3, 200))), lang) for i, lang in enumerate(rng.choices(list(make), k=200))]
    table = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !?", "aa"), (902, "", None)], "doc_id long, text string, lang string")
    model = language_id.train(table.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in language_id.identify(table, model).collect()}
    held = [(lang, got[i].lang_pred) for i, _, lang in rows if i % 3 == 1]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(got[i].lang_pred == "und" for i in (900, 901, 902)) and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(none, language_id.train(none)).count() == 0


def base_rules(text):
    words = WORD.findall(text or "")
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    repeated = {j for where in at.values() if len(where) > 1 for i in where for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_quality_rules(spark, docs, none):
    extra = spark.createDataFrame([(700, "x # y\nx # y\n\nx # y \n<a|b>", None, None), (701, "l\n" * 30, None, None)], SCHEMA)
    every = docs.unionByName(extra)
    got = quality_rules.apply_rules(every, None).collect()
    assert key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == key((r.doc_id, *base_rules(r.text)) for r in every.collect())
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality_rules.apply_rules(none, None).count() == 0


def labelled(spark):
    rng = random.Random(3)
    good = lambda: " ".join("".join(rng.choices("abcde", k=5)) for _ in range(60))
    bad = lambda: " ".join("".join(rng.choices("ABCDE", k=5)) + "!!" for _ in range(60))
    rows = [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    return table.drop("quality"), table.drop("text")


def test_quality_models_hold_out(spark, none):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    learn = labels.where("doc_id % 3 <> 1")
    rules = quality_rules.apply_rules(docs, quality_rules.train(docs, learn)).where("doc_id % 3 = 1").collect()
    assert sum(r.kept == (truth[r.doc_id] == 1) for r in rules) >= 0.95 * len(rules)
    model = quality_classifier.train(docs.where("doc_id % 3 <> 1"), learn)
    scores = quality_classifier.score(docs, model).where("doc_id % 3 = 1").collect()
    assert sum((r.pu_score >= 0.5) == (truth[r.doc_id] == 1) for r in scores) >= 0.95 * len(scores)
    assert quality_classifier.score(none, model).columns[-1] == "pu_score" and quality_classifier.score(none, None).count() == 0
    assert abs(model.prior - 0.75) < 0.12


def test_hmm_base_score_and_forward(docs, none):
    rows, training = docs.collect(), docs.where("doc_id % 2 = 0")
    tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), " "]
    count = Counter(x for r in training.collect() for x in tokens(r.text))
    n, v = sum(count.values()), len(count)
    want = key((r.doc_id, len(tokens(r.text)), sum(count[x] > 0 for x in tokens(r.text)), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens(r.text)), 6)) for r in rows)
    for size, symbols in ((20, 10), (5000, 5000)):
        got = hmm_scoring.score(docs, training, states=3, symbols=symbols, classes=8, size=size, passes=1).collect()
        assert key((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert hmm_scoring.score(none, none).count() == 0


def test_forward_recursion_is_exact():
    import itertools

    import numpy as np

    model = hmm_scoring.Hmm(2, np.array([3.0, 1.0, 2.0]))
    x = [0, 2, 1, 0]
    total = 0.0
    for path in itertools.product(range(2), repeat=4):
        p = model.first[path[0]] * model.emit[path[0], x[0]]
        for a, b, s in zip(path[:-1], path[1:], x[1:], strict=True):
            p *= model.move[a, b] * model.emit[b, s]
        total += p
    assert abs(model.likelihood(np.array(x), np.array([0, 4]))[0] - math.log10(total)) < 1e-9


@pytest.mark.parametrize(("window", "first"), [(35, 18), (35, 9), (6, 2)])
def test_substring_dedup(docs, none, window, first):
    rows = docs.collect()
    words = [WORD.findall(r.text or "") for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    want = []
    for r, w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((r.doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert key(map(tuple, substring_dedup.find(docs, window, first).collect())) == key(want)
    assert substring_dedup.find(none, window, first).count() == 0
    kept = substring_dedup.remove_repeats(docs, window, first)
    assert kept.columns == docs.columns and kept.count() == len(rows)


@pytest.mark.parametrize(("block", "group"), [(10, 1), (10, 10_000_000), (50_000, 32_000_000)])
def test_decontamination(spark, docs, none, block, group):
    rows = docs.collect()
    items = [(1, " ".join(ALNUM.findall(rows[30].text or "x")[:14])), (2, "one TWO"), (3, None), (4, "!!"), (10, "one"), (5, " ".join(ALNUM.findall(rows[40].text or "")[2:30])), (5, "12 34"), (11, "a " * 14)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for r in rows:
        w, hit, found = ALNUM.findall((r.text or "").translate(LOWER)), set(), set()
        for item, text in items:
            x = ALNUM.findall((text or "").translate(LOWER))
            k = min(10, len(x))
            grams = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if k else set()
            for i in range(len(w) - k + 1) if k else ():
                if tuple(w[i : i + k]) in grams:
                    hit.update(range(i, i + k))
                    found.add(item)
        want.append((r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    assert key(map(tuple, decontamination.find(docs, bench, block_words=block, group_bytes=group).collect())) == key(want)
    assert decontamination.find(none, bench).count() == 0 and decontamination.find(docs, bench.limit(0)).where("contaminated").count() == 0
    left = decontamination.remove_spans(docs, bench.where("item_id = 1"), coverage=1.0, block_words=block, group_bytes=group)
    assert decontamination.find(left, bench.where("item_id = 1")).where("contaminated").count() == 0


def test_automaton_against_naive_search():
    rng = random.Random(8)
    for trial in range(60):
        items = [(i, " ".join(rng.choices("abc", k=rng.randint(1, 9)))) for i in range(rng.randint(1, 6))]
        window = rng.randint(2, 5)
        block = decontamination.Block(decontamination.pack_block(items, window))
        words = [decontamination.Words(*decontamination.text_buffer(pa.array([x])), decontamination.NOT_ALNUM).hash[0] for x in "abcd"]
        number = {x: int(decontamination.np.flatnonzero(block.vocabulary == h)[0]) if h in block.vocabulary else -1 for x, h in zip("abcd", words, strict=True)}
        text = rng.choices("abcd", k=40)
        got = {(at, n, item) for at, n, found in block.stream([number[x] for x in text]) for item in found}
        want = set()
        for item, own in items:
            own = own.split()
            n = min(window, len(own))
            for i in range(len(own) - n + 1):
                want |= {(j + n - 1, n, item) for j in range(len(text) - n + 1) if text[j : j + n] == own[i : i + n]}
        assert got == want, trial


@pytest.mark.parametrize(("k", "percent", "block", "shared", "bits"), [(4, 85, 1024, 64, 63), (5, 80, 3, 1, 63), (2, 60, 2, 1, 4)])
def test_jaccard_join(docs, none, k, percent, block, shared, bits):
    rows = [r for r in docs.collect() if r.doc_id is not None]
    sets = {}
    for r in rows:
        w = WORD.findall((r.text or "").translate(LOWER))
        sets[r.doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    got = jaccard_join.join(docs.where("doc_id is not null"), k, percent, block, bits=bits, shared=shared).collect()
    assert key(map(tuple, got)) == key((r.doc_id, len(sets[r.doc_id]), root(r.doc_id)) for r in rows)
    assert jaccard_join.join(none, k, percent).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (7, 7), (1, 2), *((20, i) for i in range(21, 60))]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(1, 6), 1), **dict.fromkeys((7, 8, 9), 7), **dict.fromkeys(range(20, 60), 20)}


def test_html(spark):
    page = "<title>t</title><h1>A  b</h1><p>one <b>two</b>three<p>four<ul><li>a<li>b<ol><li>c<li>d</ol></ul><table><tr><th>name<th>n<tr><td>longer name<td>2</table><div style='display:none'>no</div>x<br>y<script>z</script>"
    assert html_extraction.visible_text(page) == "A b\n\none twothree\n\nfour\n\n- a\n- b\n  1. c\n  2. d\n\nname         n\nlonger name  2\n\nx\ny"
    assert html_extraction.visible_text("<div>" * 20_000 + "deep") == "deep"
    table = spark.createDataFrame([(1, None, 1), (2, "", 2), (2, "<td>x</tr></table>&amp;", 3)], "page_id long, html string, text int")
    assert key(map(tuple, html_extraction.extract(table).collect())) == [(1, "", 0), (2, "", 0), (2, "x&", 1)]


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as pipeline

    sf, counts = "/root/testdata/sf0.001", []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = pipeline.cut(stage(spark, docs, sf))
        assert out.columns == docs.columns, name
        counts.append(out.count())
        docs = out
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] < 200
    packed = pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_components_of_stars_need_no_round(spark, monkeypatch):
    monkeypatch.setattr(components, "_few_round", lambda edges: pytest.fail("a round on stars"))
    rows = components.components(spark.createDataFrame([(1, 5), (1, 7), (9, 2)], "u long, v long")).collect()
    assert {(r.node, r.component) for r in rows} == {(1, 1), (5, 1), (7, 1), (9, 2), (2, 2)} and len(rows) == 5


@pytest.mark.parametrize("few", [-1, 1 << 20])
def test_components_by_either_round(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(-20, 0)] + [(200, 300), (300, 250), (250, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([*range(-20, 0), 100], -20), 200: 200, 250: 200, 300: 200}


def test_sets_of_a_group_link_alike_by_bits_and_by_lookup():
    rng = np.random.default_rng(5)
    sets = [np.unique(np.append(rng.choice(60, 40), rng.integers(100, 1 << 40, 3)).astype(np.uint64)) for _ in range(50)]
    exact = jaccard_join.shared_bits(sets)
    assert jaccard_join.shared_bits(sets, 10) is None
    parts = jaccard_join.signatures(np.concatenate(sets), np.append(0, np.cumsum([len(s) for s in sets])))
    i, j = (a.reshape(-1) for a in np.indices((50, 50)))
    one, other = (jaccard_join.Tree(*parts, sets, e) for e in (exact, None))
    assert (jaccard_join.linking(one, one, i, j, 60) == jaccard_join.linking(other, other, i, j, 60)).all()
    want = [100 * len(a & b) >= 60 * len(a | b) for a in (set(s.tolist()) for s in one.sets) for b in (set(s.tolist()) for s in one.sets)]
    assert jaccard_join.linking(one, one, i, j, 60).tolist() == want
