"""Checks in one pass, digest trees, numbering of any key, owners of hot contents, plan documents, facts of plans."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shoebox.operators import aliases as A
from shoebox.operators import convergence as C
from shoebox.operators import journal as J
from shoebox.operators import matching as M
from shoebox.plans import build as B
from shoebox.plans import digest_tree as G
from shoebox.plans import document as Y
from shoebox.plans import summary as P
from shoebox.plans.checks import Checks


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


H = "a" * 64
ASSET = "operation_id string, relative_path string, media_kind string, byte_len long, content_sha256 string, metadata array<struct<relative_path:string,kind:string,rule_id:string>>, normalized_metadata struct<description:string,taken_at_utc:string,location:struct<latitude:string,longitude:string>,albums:array<string>>, live_photo struct<pair_id:string,role:string>, evidence array<struct<rule_id:string,outcome:string>>"
SOURCE = "schema_version int, kind string, label string, fingerprint_sha256 string"


def asset(n, **more):
    base = {"operation_id": f"{n:064x}", "relative_path": f"p{n}", "media_kind": "image", "byte_len": 1, "content_sha256": H, "metadata": [], "normalized_metadata": None, "live_photo": None, "evidence": [("R", "o")]}
    return tuple((base | more).values())


def plan_tables(spark, assets, summary=None, version=2):
    table = spark.createDataFrame(assets, ASSET)
    stated = summary or (len(assets), sum(len(a[5]) for a in assets), 7)
    return table, spark.createDataFrame([], "severity string, rule_id string, code string, paths array<string>"), spark.createDataFrame([stated], "assets long, sidecars long, bytes_read long"), spark.createDataFrame([(version, "google_takeout", "x", H)], SOURCE)


def test_each_rule_of_a_plan(spark):
    fine = [asset(1), asset(2, normalized_metadata=("d", "2024-01-01T00:00:00Z", ("1", "2"), ["a", "b"])), asset(3, metadata=[("s", "json", "R")])]
    assert rows(P.normalized_plan_violations(*plan_tables(spark, fine))) == []
    bad = [asset(1), asset(1, relative_path="q"), asset(4, relative_path="q"), asset(5, content_sha256="x"), asset(6, byte_len=-1), asset(7, operation_id="short"), asset(8, evidence=[("", "o")]), asset(9, normalized_metadata=("d", "2024", None, ["b", "a"])), asset(10, normalized_metadata=(None, None, ("91", "2"), [""]))]
    got = Counter(P.normalized_plan_violations(*plan_tables(spark, bad, (9, 1, 7))).select("check_id", "key").collect())
    assert {tuple(k): n for k, n in got.items()} == {("operation_unique", f"{1:064x}"): 1, ("path_unique", "q"): 1, ("sha256", "p5"): 1, ("row", "p6"): 1, ("operation_id", "p7"): 1, ("rule_id", "p8"): 1, ("albums", "p9"): 1, ("taken_at", "p9"): 1, ("location", "p10"): 1, ("album_name", "p10"): 1, ("summary", "sidecars"): 1}
    assert ("metadata_in_version_1", "p2") in rows(P.normalized_plan_violations(*plan_tables(spark, fine, version=1)))
    assert rows(P.normalized_plan_violations(*plan_tables(spark, []))) == []


def test_the_assets_are_scanned_once(spark, tmp_path):
    from test_scans import Opens

    assets, findings, summary, source = plan_tables(spark, [asset(i) for i in range(20)])
    assets.coalesce(1).write.parquet(str(tmp_path / "assets"))
    table = spark.read.schema(ASSET).parquet(str(tmp_path / "assets"))
    watch = Opens(tmp_path / "assets")
    table.select(F.sum("byte_len")).collect()
    once, _ = watch.counts()
    watch = Opens(tmp_path / "assets")
    assert P.normalized_plan_violations(table, findings, summary, source).collect() == []
    assert watch.counts()[0] == once


def test_whole_upload_plans(spark):
    cols = "operation_id string, path string, byte_len long, sha256 string, pair_id string, role string, video_operation_id string, xmp struct<path:string,byte_len:long,sha256:string>, has_metadata boolean, albums array<string>"
    a, b, c = ("%064x" % i for i in range(3))
    fine = [(a, "p1", 2, H, "x", "image", b, ("s", 1, H), True, ["t", "u"]), (b, "p2", 3, H, "x", "video", None, None, False, ["t"]), (c, "p3", 4, H, None, None, None, None, None, None)]
    head = "operations long, media_bytes long, xmp long, pairs long, metadata_updates long, album_creates long, album_memberships long, max_mutations long"
    stated = lambda *x: spark.createDataFrame([x], head)
    df = spark.createDataFrame(fine, cols)
    assert rows(P.whole_upload_violations(df, stated(3, 9, 1, 1, 1, 2, 2, 8), 2)) == []
    assert rows(P.whole_upload_violations(df, stated(3, 9, 1, 1, 0, 0, 0, 0), 1)) == [("metadata_in_version_1", "p1"), ("metadata_in_version_1", "p2")]
    bad = spark.createDataFrame([(a, "p1", 0, H, "x", "image", c, ("", 1, H), True, []), (a, "p1", 3, "no", "y", "video", None, ("s", 0, H), False, [])], cols)
    assert rows(P.whole_upload_violations(bad, stated(3, None, 2, 1, 1, 0, 0, 3), 2)) == sorted([("dependency", a), ("empty", "p1"), ("operation_unique", a), ("path_unique", "p1"), ("sha256", "p1"), ("summary", "operations,media_bytes"), ("xmp", "p1"), ("xmp", "p1")])


def test_manifests_and_reports(spark):
    ident = "00000000-0000-4000-8000-000000000000"
    table = spark.createDataFrame([(ident, "a.jpg", f"assets/{ident}/a.jpg", 5, "b" * 40)], "asset_id string, original_file_name string, target_path string, byte_len long, checksum_sha1 string")
    head = "schema_version int, configuration_sha256 string, identity_sha256 string, major int, minor int, assets long, media_bytes long"
    manifest = lambda *x: spark.createDataFrame([x], head)
    assert rows(P.archive_manifest_violations(table, manifest(1, H, H, 3, 1, 1, 5))) == []
    assert rows(P.archive_manifest_violations(table, manifest(None, H, H, 3, 2, 1, 6))) == [("identity", H), ("schema", None), ("summary", "media_bytes")]
    report = spark.createDataFrame([(H, 1, 2, 3), ("c" * 64, 1, 5, 0), ("d" * 64, 1, 1, 1), ("e" * 64, 2, 5, 0)], "manifest_sha256 string, schema_version int, downloaded long, already_complete long")
    expected = spark.createDataFrame([(H, 5), ("c" * 64, 5), ("d" * 64, 5), ("e" * 64, 5)], "manifest_sha256 string, assets long")
    assert rows(P.archive_report_violations(report, expected)) == [("report", "d" * 64), ("report", "e" * 64)]
    assert rows(P.archive_report_violations(report, expected.limit(0))) == sorted([("report", x * 64) for x in "acde"])


def test_ids_of_effects(spark):
    key = "asset:" + H
    e = spark.createDataFrame([(1, key, "created", ""), (2, key, "created", "x" * 4097), (3, key, "created", "x" * 4096), (4, key, "failed", ""), (5, key, "failed", "x"), (6, key, "reused", None), (7, None, "failed", None), (8, key, "duplicate", "é" * 2049)], "sequence long, effect_key string, outcome string, remote_id string")
    assert rows(J.effect_violations(e)) == [(1, "id_missing"), (2, "id_missing"), (5, "id_unexpected"), (6, "id_missing"), (7, "key"), (8, "id_missing")]


def test_a_unique_check_counts_hot_values_once(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("v"), "id")
    assert rows(Checks.violations(Checks(F.col("id"), {"big": F.col("id") > 4998}, {"v": F.col("v")}).facts(df))) == [("big", "4999"), ("v", "hot")]


def test_drift_reads_only_what_differs(spark, tmp_path):
    base = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 > 0, F.concat(F.lit("v"), "id")).alias("v"))
    twice = base.unionByName(base.where("k < 3"))
    other = twice.withColumn("v", F.when(F.col("k") == 77, "new").when(F.col("k") == 80, F.lit("")).otherwise(F.col("v"))).where("k <> 500").unionByName(base.where("k = 1"))
    one, two = G.write_tree(twice, ["k"], str(tmp_path / "a"), 3, 1), G.write_tree(other, ["k"], str(tmp_path / "b"), 3, 1)
    assert rows(G.drift(one, two)) == rows(C.drift(twice, other)) and len(rows(G.drift(one, two))) == 6
    leaves, looked = G.differing_leaves(one, two)
    assert leaves.count() == 4 and looked[0] == 1 and all(n <= 16 * 4 for n in looked)
    same = G.write_tree(twice.repartition(7), ["k"], str(tmp_path / "c"), 3, 1)
    assert same.root() == one.root() and G.differing_leaves(one, same)[1] == [1, 0, 0, 0] and rows(G.drift(one, same)) == []
    again = G.read_tree(spark, str(tmp_path / "a"), 1)
    assert again == one and again.rows().count() == 20_003
    with pytest.raises(ValueError, match="shapes"):
        G.drift(one, G.write_tree(twice, ["k"], str(tmp_path / "d"), 2, 1))
    empty = G.write_tree(base.limit(0), ["k"], str(tmp_path / "e"), 3, 1)
    assert len(rows(G.drift(empty, G.write_tree(base.where("k < 5"), ["k"], str(tmp_path / "f"), 3, 1)))) == 5


def test_numbers_follow_any_key(spark):
    ids = [hashlib.md5(str(i).encode()).hexdigest() for i in range(3000)] + ["same"] * 500
    df = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, n int")
    out = P.numbered(df, "id", parts=8).collect()
    assert [r.id for r in sorted(out, key=lambda r: r.nth)] == sorted(ids) and sorted(r.nth for r in out) == list(range(1, 3501))
    pages = P.bounded_inventory(df.select("id", "n"), 100, 5000, 8).collect()
    assert Counter(r.page for r in pages) == {p: 100 for p in range(1, 36)}
    with pytest.raises(ValueError, match="limit"):
        P.bounded_inventory(df, 100, 10)
    assert P.bounded_inventory(df.limit(0), 10, 10).collect() == []


def test_ranges_of_keys_keep_their_bound(spark):
    df = spark.range(40_000).select(F.md5(F.col("id").cast("string")).alias("id"))
    ranges = df.repartitionByRange(8, "id", F.xxhash64("id")).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(ranges) == 8 and max(r["count"] for r in ranges) <= 2 * 40_000 / 8


def test_a_hot_content_is_no_tasks_work(spark):
    media = spark.range(9000).select(F.concat(F.lit("p"), F.col("id")).alias("path"), F.lit(1).cast("long").alias("byte_len"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 2000).cast("string")).alias("sha256"), F.lit(0).alias("rank"))
    out = A.owners(media, 8)
    want = {r.sha256: r.owner for r in A.collapse_owner(media).collect()}
    got = {r.path: r.owner for r in out.collect()}
    assert got == {r.path: want[r.sha256] for r in media.collect()}
    # what is dealt by content has no hot one in it
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    light = media.where("sha256 <> 'hot'").repartition(8, "byte_len", "sha256").groupBy(F.spark_partition_id()).count().collect()
    sizes = sorted(r["count"] for r in light)
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_documents_read_back_whole(spark, tmp_path):
    d = "Takeout/Google Photos/Trip/"
    media = spark.createDataFrame([(d + f"{i:03}.jpg", 3, f"{i % 40:064x}") for i in range(100)] + [(d + "A.jpg", 1, H), (d + "a.jpg", 2, "b" * 64)], "path string, byte_len long, sha256 string")
    side = spark.createDataFrame([(d + f"{i:03}.jpg.json", "json", 9, H, f'{{"title":"{i:03}.jpg","description":"é\\n{i}"}}') for i in range(0, 100, 3)] + [(d + "metadata.json", "json", 9, H, '{"title":"Trip"}'), (d + "x.xmp", "xmp", 1, H, "")], "path string, kind string, byte_len long, sha256 string, text string")
    plan = Y.with_source(B.build_plan("google_takeout", media, side), side, "my export")
    path = str(tmp_path / "plan")
    Y.write_document(plan, path)
    back = Y.read_document(spark, path)
    for name in ("assets", "findings", "summary", "source"):
        one, other = getattr(plan, name), getattr(back, name)
        assert one.columns == other.columns and one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty() and one.count() > 0, name
    assert (back.kind, back.version) == ("google_takeout", 2) and P.normalized_plan_violations(back.assets, back.findings, back.summary, back.source).collect() == []
    parts = [x.value for f in sorted((tmp_path / "plan" / "assets").glob("part-*")) for x in spark.read.text(str(f)).collect()]
    assert [re.search('"relative_path":"([^"]*)"', p)[1] for p in parts] == sorted(r.relative_path for r in plan.assets.collect())
    again = Y.with_source(B.build_plan("google_takeout", media.repartition(5), side), side, "my export")
    assert again.source.first() == plan.source.first()
    moved = Y.with_source(B.build_plan("google_takeout", media.where("path not like '%050%'"), side), side, "my export")
    assert moved.source.first().fingerprint_sha256 != plan.source.first().fingerprint_sha256
    (tmp_path / "plan" / "plan" / "_SUCCESS").unlink()
    with pytest.raises(ValueError, match="whole"):
        Y.read_document(spark, path)
    with pytest.raises(ValueError, match="source"):
        Y.write_document(B.build_plan("google_takeout", media, side), str(tmp_path / "other"))


def test_a_document_in_one_file(spark, tmp_path):
    (tmp_path / "plan.json").write_text('{"schema_version":1,"source":{"kind":"folder","label":"x","fingerprint_sha256":"%s","case_sensitive":true,"unicode_normalization":"nfc"},"assets":[{"operation_id":"o","relative_path":"a.jpg","media_kind":"image","byte_len":1,"content_sha256":"c","metadata":[],"live_photo":null,"evidence":[]}],\n"warnings":[{"rule_id":"W","code":"w","paths":["a"]}],"errors":[{"rule_id":"E","code":"e","paths":[]}],"summary":{"assets":1,"sidecars":0,"bytes_read":1}}' % H)
    plan = Y.read_document(spark, str(tmp_path / "plan.json"))
    assert (plan.kind, plan.version, tuple(plan.summary.first())) == ("folder", 1, (1, 0, 1)) and rows(plan.findings) == [("error", "E", "e", []), ("warning", "W", "w", ["a"])]
    assert [r.relative_path for r in plan.assets.collect()] == ["a.jpg"] and plan.source.first().fingerprint_sha256 == H


def test_facts_of_plans(spark):
    assets = spark.createDataFrame([asset(1, relative_path="d/a", metadata=[("d/a.json", "json", "R")], normalized_metadata=(None, None, None, ["t"])), asset(2, relative_path="d/b")], ASSET)
    found = spark.createDataFrame([("warning", "R", "content_identical_takeout_aliases", ["d/a", "e/a"])], "severity string, rule_id string, code string, paths array<string>")
    seen = [("discovered", p, "") for p in ("d/a", "d/b", "e/a")] + [("sidecar", "d/a.json", ""), ("duplicate", "e/a", ""), ("uploaded", "d/a", ""), ("album", "d/a", "t")]
    observed = lambda x: spark.createDataFrame(x, "check_id string, path string, value string")
    assert all(r.passed for r in C.plan_differential(assets, found, observed(seen)).collect())
    wrong = [*seen[1:], ("uploaded", "z", ""), ("updated", "d/b", ""), ("album", "d/a", "other")]
    got = {r.check_id: (r.passed, r.missing, r.unexpected) for r in C.plan_differential(assets, found, observed(wrong)).collect()}
    assert got == {"discovered": (False, 1, 0), "sidecar": (True, 0, 0), "duplicate": (True, 0, 0), "uploaded": (False, 1, 1), "updated": (False, 1, 1), "album": (False, 0, 1)}


def test_xmp_of_version_1(spark):
    assets = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "operation_id string")
    bridge = spark.createDataFrame([("a", "x.xmp"), ("b", "x.json"), ("c", "x.xmp"), ("c", "y.xmp")], "operation_id string, sidecar string")
    assert rows(M.bind_xmp(assets, bridge, 1)) == [("a", "x.xmp", "bound"), ("b", None, "unsupported"), ("c", None, "unsupported"), ("d", None, "bound")]
