"""Operators on small hand-made tables: facts, quirks and negative cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from shoebox.functions import expr as X
from shoebox.operators import aliases as A
from shoebox.operators import convergence as C
from shoebox.operators import journal as J
from shoebox.operators import matching as M
from shoebox.plans import summary as P
from shoebox.sources import documents as D
from shoebox.sources import sinks
from shoebox.streaming import rollup as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stable_id_is_length_prefixed(spark):
    raw = b"".join(len(x).to_bytes(8, "little") + x for x in (b"live-photo-v1", b"a/b.jpg", "é.mov".encode()))
    assert one(spark, X.stable_id(F.lit("live-photo-v1"), F.lit("a/b.jpg"), F.lit("é.mov"))) == hashlib.sha256(raw).hexdigest()


@pytest.mark.parametrize(
    ("path", "stem", "ext"), [("a/b.JPG", "b", "jpg"), ("b", "b", None), ("a/.ini", "", None), ("a.b/c.tar.gz", "c.tar", "gz")]
)
def test_stem_and_extension(spark, path, stem, ext):
    assert one(spark, X.stem(F.lit(path))) == stem
    assert one(spark, X.extension(F.lit(path))) == ext


@pytest.mark.parametrize(("x", "text"), [(3.0, "3"), (1e-5, "0.00001"), (-0.0, "0"), (-45.25, "-45.25"), (0.1, "0.1")])
def test_canonical_decimal(spark, x, text):
    assert one(spark, X.canonical_decimal(F.lit(x))) == text


@pytest.mark.parametrize(
    ("name", "target"),
    [("a.jpg.supplemental-metadata(2).json", "a(2).jpg"), ("a.jpg.supp(3).json", "a(3).jpg"), ("a.jpg(1).json", "a(1).jpg"), ("a.jpg.other(1).json", "a.jpg(1).other"), ("a.json", None)],
)
def test_indexed_target(spark, name, target):
    assert one(spark, X.indexed_target(F.lit(name))) == target


def test_zero_exif_hides_plain_location(spark):
    g = lambda a, b: F.struct(F.lit(a).alias("latitude"), F.lit(b).alias("longitude"))
    assert one(spark, X.location(g(0.0, 0.0), g(1.0, 2.0))) is None
    assert tuple(one(spark, X.location(F.lit(None).cast(D.GEO), g(1.0, 2.5)))) == ("1", "2.5")


def test_epoch_and_dates(spark):
    assert one(spark, X.epoch_to_utc(F.lit("0"))) == "1970-01-01T00:00:00Z"
    assert one(spark, X.epoch_to_utc(F.lit("-1"))) is None
    assert one(spark, X.epoch_to_utc(F.lit("999999999999"))) is None
    assert one(spark, X.filename_date(F.lit("20240230-101010-x.jpg"))) is None


def test_noise_and_nfc(spark):
    assert one(spark, X.noise_prefix(F.lit("a/@EADIR/x.jpg"))) == "a/@EADIR"
    assert one(spark, X.noise_prefix(F.lit("a/b.jpg"))) is None
    assert one(spark, X.nfc(F.lit("é.jpg"))) == "é.jpg"


def test_tiers_stop_at_the_first_hit(spark):
    media = spark.createDataFrame([("d/a(1).jpg",), ("d/a.jpg",), ("d/long-name-x.jpg",), ("d/long-name-y.jpg",)], "path string")
    docs = spark.createDataFrame([("d/a.jpg(1).json", "a.jpg"), ("d/a.jpg.json", None), ("d/long-name.json", None), ("d/none.json", None)], "path string, title string")
    assert rows(M.tiered_sidecars(docs, media).drop("candidates")) == [("d/a.jpg(1).json", 0, 1, "d/a(1).jpg"), ("d/a.jpg.json", 2, 1, "d/a.jpg"), ("d/long-name.json", 3, 2, None), ("d/none.json", None, None, None)]


def test_prefix_tier_has_no_least_length(spark):
    media = spark.createDataFrame([("d/a1.jpg",), ("d/b12.jpg",), ("d/b13.jpg",), ("e/IMG_1.jpg",)], "path string")
    docs = spark.createDataFrame([("d/a.json", None), ("d/b.json", None), ("d/b12.supplemental-metadata.json", None), ("e/IMG_1.jpg.supplemental-metadata.json", None), ("d/.json", None)], "path string, title string")
    got = [tuple(r) for r in M.tiered_sidecars(docs, media).orderBy("sidecar").collect()]
    assert got == [("d/.json", None, None, None, []), ("d/a.json", 3, 1, "d/a1.jpg", []), ("d/b.json", 3, 2, None, ["d/b12.jpg", "d/b13.jpg"]), ("d/b12.supplemental-metadata.json", 3, 1, "d/b12.jpg", []), ("e/IMG_1.jpg.supplemental-metadata.json", 2, 1, "e/IMG_1.jpg", [])]


def test_paths_are_the_eight_smallest(spark):
    media = spark.range(40).selectExpr("concat('d', id % 20, '/', case when id % 2 = 0 then 'X' else 'x' end, '.jpg') path")
    assert [r.paths for r in A.duplicate_basenames(media).collect()] == [sorted({f"d{i}/{'X' if i % 2 == 0 else 'x'}.jpg" for i in range(20)})[:8]]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 19, 20, 1000])
def test_statistics_are_exact(spark, n):
    import random
    import statistics

    rng = random.Random(n)
    values = [rng.choice((rng.random(), 0.5)) for _ in range(n)]
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, value double")
    row = J.statistics(df, "g").first()
    assert (row.lowest, row.highest, row.p95) == (min(values), max(values), sorted(values)[-(-95 * n // 100) - 1]) and abs(row.median - statistics.median(values)) < 1e-12
    assert tuple(J.statistics(df, "g", accuracy=20).first()) == tuple(row)


def test_streams_read_their_own_table(spark, tmp_path):
    spark.createDataFrame([("r", 1, "run"), ("r", 2, "done"), ("s", 5, "run"), ("s", 4, "run")], "run string, sequence long, stage string").write.parquet(str(tmp_path / "e.parquet"))
    spark.range(1).write.parquet(str(tmp_path / "e2.parquet"))
    stream = R.event_stream(spark, str(tmp_path), "e", "run string, sequence long, stage string")
    assert rows(R.drain(R.progress(stream), ["run"])) == [("r", 2, "done"), ("s", 5, "run")]


def test_live_pairs_need_exactly_one_of_each(spark):
    media = spark.createDataFrame([(p,) for p in ("a/1.jpg", "a/1.mov", "a/2.jpg", "a/2.heic", "a/2.mov", "a/3.jpg", "a/3.mp4")], "path string")
    assert [(r.image, r.video) for r in M.live_pairs(media).collect()] == [("a/1.jpg", "a/1.mov")]


def test_conflict_hides_duplicate(spark):
    e = spark.createDataFrame([("p", "A"), ("p", "A"), ("p", "B"), ("q", "A"), ("q", "A"), ("r", "A")], "path string, sha256 string")
    assert rows(A.merge_archives(e, ["sha256"])) == [("p", 3, "conflict"), ("q", 2, "duplicate"), ("r", 1, "single")]


def test_all_conflicting_fields_are_reported(spark):
    m = spark.createDataFrame([(1, "h", 0, "a", "x", "1"), (1, "h", 1, "b", "y", "2"), (1, "g", 1, "c", None, "3"), (1, "g", 1, "d", "z", "3")], "byte_len int, sha256 string, rank int, path string, f string, g string")
    assert rows(A.resolve_metadata(m, ["f", "g"]).drop("byte_len")) == [("g", "z", "3", []), ("h", None, None, ["f", "g"])]


def test_pending_keeps_pairs_together(spark):
    plan = spark.createDataFrame([("a", 1), ("b", 1), ("c", None), ("d", None)], "operation_id string, pair_id int")
    done = spark.createDataFrame([("a",), ("c",)], "operation_id string")
    assert [r[0] for r in rows(C.pending(plan, done))] == ["a", "b", "d"]


def test_later_failure_reopens_a_key(spark):
    j = spark.createDataFrame([("k", 1, "created"), ("k", 2, "failed"), ("l", 1, "failed"), ("l", 3, "duplicate")], "key string, sequence int, outcome string")
    assert [r.key for r in J.completed(j, "key").collect()] == ["l"]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "path string, byte_len long, sha256 string, rank int, associations long")
    assert A.collapse(none).count() == 0
    assert tuple(P.plan_summary(none).first()) == (0, 0, 0)
    assert M.live_pairs(none).count() == 0


def test_results_do_not_depend_on_partitioning(spark):
    docs = spark.range(500).selectExpr("concat('d', id % 7, '/', id % 40, '.jpg') path", "id % 3 byte_len", "sha2(cast(id % 11 as string), 256) sha256", "cast(id % 2 as int) rank")
    expected = rows(A.collapse(docs))
    for n in (1, 3, 9):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        assert rows(A.collapse(docs.repartition(n))) == expected
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_json_rejects_duplicate_keys(spark):
    df = spark.createDataFrame([(1, '{"title":"a","title":"b"}'), (2, '{"title":"a","x":1}'), (3, "{"), (4, None)], "i int, j string")
    assert rows(D.parse_json(df, "j", {"title": "string"}).select("i", "title", "invalid")) == [(1, None, True), (2, "a", False), (3, None, True), (4, None, False)]


def test_ini_settings(spark):
    text = "[Picasa]\nname=Trip\n[a.jpg]\ncaption=one\ncaption=two\n"
    lines = D.ini_lines(spark.createDataFrame([("d/.picasa.ini", text)], "path string, text string"))
    assert rows(D.ini_settings(lines).select("section", "key", "value", "conflict")) == [("Picasa", "name", "Trip", False), ("a.jpg", "caption", "one", True)]
    albums, captions, found = D.read_ini(spark.createDataFrame([("d/.picasa.ini", text), ("e/.picasa.ini", "; c\n[Picasa]\nname=T\n[b.jpg]\ncaption = x = y\n")], "path string, text string"))
    assert rows(albums) == [("e", "T")] and rows(captions) == [("e", "b.jpg", "x = y")] and [r.paths for r in found.collect()] == [["d"]]


def test_effects_are_appended_once(spark, tmp_path):
    batch = spark.createDataFrame([("asset:1", 1), ("asset:1", 1), ("asset:2", 2)], "effect_key string, sequence int")
    write = sinks.append_effects(str(tmp_path / "j"))
    write(batch, 0)
    write(batch, 0)
    assert rows(sinks.read_effects(spark, str(tmp_path / "j"))) == [("asset:1", 1), ("asset:2", 2)]


def test_receipts_and_history_are_appended_once(spark, tmp_path):
    new = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "receipt_ref string, sequence int")
    for _ in range(2):
        sinks.append_receipts(new, str(tmp_path / "r"))
        sinks.append_history(new, str(tmp_path / "h"))
    assert sinks.read_stored(spark, str(tmp_path / "r")).count() == 2 and sinks.read_stored(spark, str(tmp_path / "h")).count() == 2
    (tmp_path / "broken" / "log").mkdir(parents=True)
    (tmp_path / "broken" / "log" / "0000000000000000000.json").write_text('{"batch": 0, "folder": "gone", "files": []}')
    with pytest.raises(Exception):  # noqa: B017
        sinks.append_receipts(new, str(tmp_path / "broken"))


def test_archive_manifest_and_report(spark):
    a, b = "00000000-0000-4000-8000-000000000001", "00000000-0000-4000-8000-000000000002"
    cols = "asset_id string, original_file_name string, target_path string, byte_len int, checksum_sha1 string"
    good, bad = (a, "x.jpg", f"assets/{a}/x.jpg", 1, "0" * 40), (b, "con.txt", f"assets/{b}/con.txt", 1, "0" * 40)
    assert rows(P.archive_violations(spark.createDataFrame([good], cols))) == []
    none = (b, "y.jpg", f"assets/{b}/y.jpg", None, "0" * 40)
    assert rows(P.archive_violations(spark.createDataFrame([good, good, bad, none], cols))) == [("asset", b), ("asset", b), ("asset_unique", a), ("asset_unique", b), ("path_unique", good[2])]
    side = "path string, byte_len int, sha1 string"
    want = spark.createDataFrame([("p", 3, "1"), ("q", 4, "2"), ("r", 5, "3")], side)
    have = spark.createDataFrame([("q", 4, "2"), ("r", 5, "9"), ("s", 1, "1")], side)
    assert rows(C.archive_report(want, have)) == [(1, 1, 1, 3)]
    assert rows(C.archive_report(want.limit(0), have)) == [(0, 0, 0, 0)]


def test_every_sql_twin_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_live_pairs_keep_names_as_they_are(spark):
    media = spark.createDataFrame([(p,) for p in ("A.JPG", "A.Mov", "/x/b.c.HeIc", "/x/b.c.MOV", "/d.jpeg", "/d.mov", "é/ü.TIFF", "é/ü.mov", "e/.jpg", "e/.mov", "f/g.webp", "F/g.mov")], "path string")
    assert sorted((r.image, r.video) for r in M.live_pairs(media).collect()) == [("/d.jpeg", "/d.mov"), ("/x/b.c.HeIc", "/x/b.c.MOV"), ("A.JPG", "A.Mov"), ("é/ü.TIFF", "é/ü.mov")]
