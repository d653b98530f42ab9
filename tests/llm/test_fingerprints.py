"""Document fingerprints against a walker that goes character by character, and planted edits."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("shoebox.llm.queries")
from shoebox.llm import document_fingerprints as D  # noqa: E402


def plain_embedding(text):
    """The characters' classes as the walker writes them, position by position."""
    out, i, classes = [], 0, [int(D.CLASS[ord(c)]) for c in text]
    while i < len(classes):
        out.append(classes[i])
        stays = D.STRIDES[classes[i], (len(out) - 1) % D.PERIOD] > 1
        i += not stays
    return out


def plain_print(text):
    written = plain_embedding(text)
    return "".join(chr(D.DIGIT[t, written[p]]) for t, p in enumerate(D.PLACES.tolist()) if p < len(written))


def texts():
    rng = random.Random(13)
    make = lambda n: "".join(rng.choices("etaoin shrdlué\n世🙂", k=n))
    return ["", "a", "ab", make(7), make(31), make(64), *(make(rng.randint(1, 3000)) for _ in range(90)), make(40_000)]


def edited(text, k, rng):
    out = list(text)
    for _ in range(k):
        p = rng.randrange(len(out))
        out[p : p + 1] = rng.choice([[], ["x"], [out[p], "y"]])
    return "".join(out)


def test_fingerprints_equal_plain_walk():
    every = texts()
    assert D.fingerprints(every) == [plain_print(t) for t in every]
    assert D.fingerprints(every[::-1] * 2)[: len(every)] == D.fingerprints(every)[::-1]  # whatever else is in the batch
    assert D.fingerprints([]) == []


def test_samples_are_one_a_stratum():
    assert D.PLACES[:64].tolist() == list(range(64)) and (np.diff(D.PLACES) > 0).all()
    ends = np.cumsum(D.WIDTHS)
    assert (D.PLACES < ends).all() and (D.PLACES >= ends - D.WIDTHS).all()


def test_likeness_follows_edits():
    rng = random.Random(2)
    base = ["".join(rng.choices("etaoin shrdlu", k=4000)) for _ in range(30)]
    means = [np.mean([D.likeness(a, b) for a, b in zip(D.fingerprints(base), D.fingerprints([edited(t, k, rng) for t in base]), strict=True)]) for k in (0, 2, 20, 200)]
    others = np.mean([D.likeness(a, b) for a, b in zip(D.fingerprints(base), D.fingerprints(base[1:] + base[:1]), strict=True)])
    assert means[0] == 1 and 0.95 < means[1] < 1 and means[1] > means[2] > means[3] > others and others < 0.25
    assert D.likeness("", "") == 1 and D.likeness("", "a") == 0 == D.likeness("a", "")


def expected(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    out = []
    for at, i in enumerate(order):
        text, after = rows[i][1] or "", rows[order[(at + 1) % len(order)]][1] or ""
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        f, g, h = map(plain_print, (text, changed, after))
        out.append((rows[i][0], len(text), hashlib.sha256(changed.encode()).hexdigest(), f, g, D.likeness(f, g), D.likeness(f, h)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts,limit", [(1, 10**6), (3, 500), (9, 10**6)])
def test_next_documents(spark, tmp_path, parts, limit):
    every = texts()
    rows = [(i * 7 % 50 if i % 11 else None, t if i % 17 else None, "x") for i, t in enumerate(every[:60])] + [(7, t, "hot") for t in every[60:]]  # ties and null ids
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string, row string").coalesce(1).write.parquet(path)
    got = D.compare_with_next(spark.read.parquet(path), parts, limit)
    assert sorted((tuple(r)[:7] for r in got.collect()), key=repr) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(1, "alone")], [(1, None)], [(1, "a" * 50), (2, "b" * 50)]])
def test_tiny_tables(spark, tmp_path, rows):
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    assert sorted((tuple(r)[:7] for r in D.compare_with_next(spark.read.parquet(path)).collect()), key=repr) == expected(rows)


def test_near_documents(spark, tmp_path):
    rng = random.Random(8)
    base = ["".join(rng.choices("etaoin shrdlu", k=rng.randint(300, 2000))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, edited(t, 2, rng)) for i, t in enumerate(base)] + [(200 + i, base[0]) for i in range(30)] + [(None, base[1]), (300, None), (301, ""), (302, "hi")]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = D.near_documents(spark.read.parquet(path))
    by = {}
    for r in got.collect():
        by.setdefault(r.class_id, set()).add(r.doc_id)
    assert got.count() == len(rows)
    prints = D.fingerprints([t for _, t in rows[:80]])
    alike = [i for i in range(40) if D.likeness(prints[i], prints[40 + i]) >= 0.8]  # brute force: no other pair is
    met = sum(any({i, 100 + i} <= ids for ids in by.values()) for i in alike)
    assert len(alike) >= 30 and met >= 0.95 * len(alike)
    assert any(set(range(200, 230)) | {0} <= ids for ids in by.values())
    assert all(len({i % 100 for i in ids if i is not None and i < 200}) <= 1 for ids in by.values())  # nothing else is linked
    empty = str(tmp_path / "e")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(empty)
    assert D.near_documents(spark.read.parquet(empty)).collect() == []
