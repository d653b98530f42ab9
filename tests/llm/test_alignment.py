"""Cross-tokenizer alignment against whole texts, byte by byte."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("shoebox.llm.queries")
P = pytest.importorskip("public_tokenizers")
from shoebox.llm import tokenizer_alignment as T  # noqa: E402

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a", "  two  spaces \n\n and\n lines\r\nend ", "▁odd", "x ▁ y", "tab\tand nbsp em​zero", "<|endoftext|> <s></s> <0x41> <unk>", "café naïve ’quoted’ “text”",
       "привет мир\nещё", "日本語のテキスト。 漢字", "🙂 👩‍👩‍👧 é", "\x00nul\x01 \x85next\x1c", "it's we'll 123456 don't!!", "a" * 5000, " line para ﻿bom", "ends in spaces   ", "   starts"]


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {c: x for x, c in T._LETTERS.items()}
    docs, held = [], Counter()
    for text in texts:
        links, groups = [], []
        if text:
            left, right = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            parts_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in left]
            pieces = [b.id_to_piece(i) for i in right]
            parts_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
            if b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
                at_a = [k for k, p in enumerate(parts_a) for _ in p]
                at_b = [k for k, p in enumerate(parts_b) for _ in p]
                links = [(left[i], right[j]) for i, j in sorted(set(zip(at_a, at_b, strict=True)))]
                ends = sorted({sum(map(len, parts_a[: k + 1])) for k in range(len(left))} & {sum(map(len, parts_b[: k + 1])) for k in range(len(right))}) if len(left) < 3000 else []
                start = 0
                for end in ends:
                    groups.append(",".join(str(left[k]) for k in sorted(set(at_a[start:end]))) + "|" + ",".join(str(right[k]) for k in sorted(set(at_b[start:end]))))
                    start = end
            else:
                left, right = [], []
        held.update(set(links))
        docs.append((len(left) if links else 0, len(right) if links else 0, groups, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [(na, nb, len(g), len(li), sum(held[x] == most[x[0]] for x in li), sum(held[x] for x in li), hashlib.sha256(";".join(g).encode()).hexdigest() if li else "") for na, nb, g, li in docs], held


def corpus():
    rng = random.Random(12)
    words = ["the", "of", "étude", "naïve", "hello", "straße", "Anhation", "tiontheo", "x1y2", "don't", "word,", "end.\nNew"]
    return [*ODD, *(" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(80)), "the of", "the of", "the the the the the the the the the"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    texts = corpus()
    rows = [(i if i % 13 else None, t, i, "x") for i, t in enumerate(texts)] + [(3, "a", -1, "x")]
    path = str(tmp_path_factory.mktemp("align") / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, row long, a string").repartition(3).write.parquet(path)
    return spark.read.parquet(path), [(r[0], r[1]) for r in rows]


def test_alignment_equals_brute(table):
    df, rows = table
    want, _ = brute([t for _, t in rows])
    got = sorted(map(tuple, T.align(df, A, B).collect()), key=repr)
    assert got == sorted([(i, *w) for (i, _), w in zip(rows, want, strict=True)], key=repr)


def test_links_equal_brute(table):
    df, rows = table
    _, held = brute([t for _, t in rows])
    got = {(r.a, r.b): (r.documents, r.best) for r in T.links(df, A, B).collect()}
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    assert got == {k: (n, n == most[k[0]]) for k, n in held.items()}


def collected(aligner, texts, limit):
    facts, links = {}, Counter()
    for found, owner, pairs, times in aligner.documents(texts, limit):
        facts.update(found)
        for row in zip(owner.tolist(), pairs.tolist(), times.tolist(), strict=True):
            links[row[:2]] += row[2]
    return facts, links


def test_small_caches_and_segments():
    texts = [t for t in corpus() if t]
    want = collected(T.Aligner(A, B), texts, 1 << 20)
    assert collected(T.Aligner(A, B, limit_bytes=2000), texts, 7) == want
    assert collected(T.Aligner(A, B, limit_bytes=2000), texts, 100) == want
    whole = T.Aligner(A, B)
    whole.cuts = False
    assert collected(whole, texts, 100) == want


def test_units():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices("ab \n\t\x85\u3000é", k=rng.randint(1, 12)))
        assert T.units_of(text) == T.EDGE.split(text)


def test_planes_and_bitmaps():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 3, 6000) << 32 | rng.integers(0, 2, 6000) << 16 | rng.integers(0, 4096, 6000))
    pairs, places, times = keys >> 32 << 32 | (keys >> 16 & 1), keys & 0xFFF, rng.integers(1, 9, len(keys))
    back, n = Counter(), Counter()
    for batch in T.index_batches(5, pairs, places, times):
        for r in batch.to_pylist():
            at = np.frombuffer(r["places"], "<u2") if r["places"] is not None else np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little"))
            assert len(at) == r["size"] and r["container"] == 5
            n[r["a"] << 32 | r["b"]] += r["n"]
            for x in at.tolist():
                back[r["a"] << 32 | r["b"], x] += 1 << r["plane"]
    assert back == Counter(dict(zip(zip(pairs.tolist(), places.tolist(), strict=True), times.tolist(), strict=True)))
    assert n == Counter(pairs.tolist())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e"))
    assert T.align(spark.read.parquet(str(tmp_path / "e")), A, B).collect() == []
