"""Whole plans against fixed values of the plan format: four kinds of export with their paths, digests, documents, and the ids and fingerprints that
plans of them must have."""

import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from shoebox import diagnostics as D
from shoebox.plans import build as B
from shoebox.plans import summary as P
from shoebox.sources import documents as S
from shoebox.sources import archives, files

# Texts, digests, ids and fingerprints below must be as the plan format has them.
TAKEOUT = "Takeout/Google Photos/"
ALPHA = '{"title":"alpha.png","description":"synthetic alpha description","creationTime":{"timestamp":"1704060000","formatted":"ignored creation display"},"photoTakenTime":{"timestamp":"1704067200","formatted":"ignored capture display"},"geoData":{"latitude":1.25,"longitude":2.5},"geoDataExif":{"latitude":3.5,"longitude":-4.25}}\n'
BETA = '{"title":"beta.png","description":"synthetic beta description","creationTime":{"timestamp":"1704153600","formatted":"ignored local display"},"geoData":{"latitude":0,"longitude":0}}\n'


def tables(spark, media, sidecars):
    kinds = {"json": "json", "xmp": "xmp", "ini": "ini"}
    side = [(p, kinds[p.rsplit(".", 1)[1].lower()], len(t.encode()), hashlib.sha256(t.encode()).hexdigest(), t) for p, t in sidecars]
    return spark.createDataFrame(media, "path string, byte_len long, sha256 string"), spark.createDataFrame(side, "path string, kind string, byte_len long, sha256 string, text string")


def assets_of(plan):
    return {r.relative_path: r for r in plan.assets.collect()}


def findings_of(plan):
    return sorted((r.severity, r.rule_id, r.code, tuple(r.paths)) for r in plan.findings.collect())


def rules(rows):
    return [tuple(x) for x in rows]


def test_takeout_plan(spark):
    year, trip = TAKEOUT + "Photos from 2024/", TAKEOUT + "Synthetic Album/"
    same = "9359f8b9db230170541c3a80f4e449cafc1d44438275a652196527c863304cd6"
    media = [(year + "alpha.png", 73, same), (trip + "alpha.png", 73, same), (year + "beta.png", 71, "669daae152d0d59203b1fee14c341913df612939e2fd3a6dd7ef0b4d468e0caf"), (year + "café.png", 70, "7930c964970e54985d1149269c9608d2dfad0077e74ee1d958f30000f6e82724")]
    docs = [(year + "alpha.png.json", ALPHA), (trip + "alpha.png.json", ALPHA), (year + "beta.png.supplemental-metadata.json", BETA), (year + "café.png.json", '{"title":"café.png","description":"synthetic unicode description","photoTakenTime":{"timestamp":"1704240000"}}\n'), (trip + "metadata.json", '{"title":"Synthetic Album","description":"synthetic album description"}\n')]
    plan = B.build_plan("google_takeout", *tables(spark, media, docs))
    assets = assets_of(plan)
    assert {p: r.operation_id for p, r in assets.items()} == {
        year + "alpha.png": "aa89d5e7e206278580c6c41d5ba5db3612b240b73b7959385bd038df0b555b38",
        year + "beta.png": "40148f352c2cd7a2eed3585d52a22c7217e233a92693a3bfd84aa22b32765fcc",
        year + "café.png": "c23856a78514983bc7887f9e4628d095fc0e35b0bf63302a32c5e35b8fe70dd8",
    }
    alpha, beta = assets[year + "alpha.png"], assets[year + "beta.png"]
    assert rules(alpha.metadata) == [(year + "alpha.png.json", "json", D.TAKEOUT_TITLE), (trip + "alpha.png.json", "json", D.TAKEOUT_TITLE), (trip + "metadata.json", "json", D.TAKEOUT_ALBUM)]
    n = alpha.normalized_metadata
    assert (n.description, n.taken_at_utc, tuple(n.location), n.albums) == ("synthetic alpha description", "2024-01-01T00:00:00Z", ("3.5", "-4.25"), ["Synthetic Album"])
    assert (beta.normalized_metadata.location, beta.normalized_metadata.taken_at_utc, beta.normalized_metadata.albums) == (None, "2024-01-02T00:00:00Z", [])
    assert [e.rule_id for e in alpha.evidence] == [D.REGULAR_MEDIA, D.TAKEOUT_ALBUM, D.TAKEOUT_ALIAS, D.TAKEOUT_TITLE]
    assert findings_of(plan) == [("warning", D.TAKEOUT_ALIAS, "content_identical_takeout_aliases", (year + "alpha.png", trip + "alpha.png"))]
    assert tuple(plan.summary.first()) == (3, 5, 1296)
    source = spark.createDataFrame([(2, "google_takeout", "x", "0" * 64)], "schema_version int, kind string, label string, fingerprint_sha256 string")
    assert P.normalized_plan_violations(plan.assets, plan.findings, plan.summary, source).collect() == []
    wrong = source.withColumn("schema_version", F.lit(3))
    assert [r.check_id for r in P.normalized_plan_violations(plan.assets, plan.findings, plan.summary.withColumn("assets", F.lit(9).cast("long")), wrong).collect()] == ["schema_source", "summary"]
    side = tables(spark, media, docs)[1]
    assert P.ordered_fingerprint(plan.assets, side, plan.findings).first()[0] == "ca4227350c330e6d4f53e394f73762212d9f40aeac87dd7e01237172ce1534e3"
    plan.discard()


def test_takeout_conflicts_and_orphans(spark):
    d = TAKEOUT + "Trip/"
    media = [(d + "a.jpg", 1, "1" * 64), (d + "b.jpg", 1, "1" * 64), (d + "c.jpg", 2, "2" * 64), (d + "same1.jpg", 3, "3" * 64), (d + "same2.jpg", 4, "4" * 64)]
    docs = [(d + "a.jpg.json", '{"title":"a.jpg","description":"x"}'), (d + "b.jpg.json", '{"title":"b.jpg","description":"y"}'), (d + "c1.json", '{"title":"c.jpg","description":"x"}'), (d + "c2.json", '{"title":"c.jpg","description":"y"}'), (d + "same.json", '{"title":"none"}'), (d + "lone.json", '{"title":"z.jpg"}'), (d + "bad.json", '{"title":5}'), (d + "c.xmp", "<x/>"), (d + "big.json", '{"title":"' + "x" * 300_000 + '"}')]
    plan = B.build_plan("google_takeout", *tables(spark, media, docs))
    got = {(s, c): p for s, _, c, p in findings_of(plan)}
    assert got["error", "conflicting_takeout_description"] == (d + "a.jpg",) and got["error", "conflicting_takeout_asset_metadata"] == (d + "c.jpg", d + "c1.json", d + "c2.json")
    assert got["error", "ambiguous_takeout_metadata"] == (d + "same.json", d + "same1.jpg", d + "same2.jpg")
    assert got["warning", "takeout_metadata_without_media"] == (d + "lone.json",) and got["error", "invalid_takeout_json"] == (d + "bad.json",)
    assert got["error", "takeout_json_size_limit_exceeded"] == (d + "big.json",) and got["warning", "unsupported_takeout_metadata_family"] == (d + "c.xmp",)
    assert assets_of(plan)[d + "a.jpg"].normalized_metadata is None and assets_of(plan)[d + "c.jpg"].metadata == []


def test_takeout_titles(spark):
    media = [("d/a.jpg", 1, "1" * 64), ("d/b.jpg", 1, "2" * 64)]
    docs = [("d/1.json", '{"title":"a.jpg"}'), ("d/2.json", '{"title":"b.jpg"}'), ("d/3.json", '{"title":"b.jpg"}'), ("d/4.json", '{"title":"c.jpg"}')]
    plan = B.build_plan("google_takeout_v1", *tables(spark, media, docs))
    assert [(c, p) for _, _, c, p in findings_of(plan)] == [("multiple_takeout_sidecars_for_media", ("d/2.json", "d/3.json", "d/b.jpg")), ("takeout_media_without_json", ("d/b.jpg",)), ("takeout_title_without_media", ("d/4.json",))]
    assert rules(assets_of(plan)["d/a.jpg"].metadata) == [("d/1.json", "json", D.TAKEOUT_TITLE)]


def test_apple_plan(spark):
    d = "Albums/Synthetic Journey/"
    media = [(d + "café.png", 69, "3b7d62738b363c3bf0f01cfc016702418208db2a0c709a07e926c7ea6b20089b"), (d + "pair.mov", 58, "bb203c857e3fdafdf15f81b9774af23b2ee0df2879717d313202a572c6adaa72"), (d + "pair.png", 73, "00637d047201d9f974683c20a29f4ddf4e95ac282dd918618aeb3b929f30b573")]
    plan = B.build_plan("apple_photos", *tables(spark, media, [(d + "pair.xmp", "<x/>")]), mode="immediate")
    assets = assets_of(plan)
    assert {r.operation_id for r in assets.values()} == {"c5effe3c5174b4576c73f90f51e615cb8ada16acdde5fd86dcf92848ded4cbc5", "9472742e601e251817987bb12c5295c5297a628ec6460f3ce4c4738f2a2b39c7", "6a8fbac7d3837fd83dcd3cf9df0d1ca2fa66cd65b0bba5e0c5c6a8b3c797d9ae"}
    pair = assets[d + "pair.png"]
    assert tuple(pair.live_photo) == ("7d49a895d6b3a498ce38e5beb3b9d62b3e4cea08406cc41486ebb1c909f9805e", "image")
    assert [e.rule_id for e in pair.evidence] == [D.REGULAR_MEDIA, D.APPLE_FOLDER_ALBUM, D.SIDECAR_BASENAME, D.LIVE_PHOTO]
    assert pair.normalized_metadata.albums == ["Synthetic Journey"] and rules(pair.metadata) == [(d + "pair.xmp", "xmp", D.SIDECAR_BASENAME)]


def test_picasa_plan(spark):
    d = "Albums/Synthetic/"
    media = [(d + "20240102-030405-image.png", 69, "82ea26b98483108e97abd3efe54c140b9aaa76e9df76f22262fe574d07468c8d"), (d + "captioned.png", 69, "a3d81b8f11847aaff2db3a7bcc177fa4a85d748dc3771154000f9f9ddeeea285")]
    ini = "[Picasa]\nname=Synthetic Picasa Album\n[captioned.png]\ncaption=Synthetic caption\n[pair.png]\nstar=yes\n"
    plan = B.build_plan("picasa", *tables(spark, media, [(d + ".picasa.ini", ini), ("bad/.picasa.ini", "name=x\n"), ("two/.picasa.ini", "[a.jpg]\ncaption=1\n"), ("two/.PICASA.INI", "[a.jpg]\ncaption=1\n")]))
    assets = assets_of(plan)
    dated, captioned = assets[d + "20240102-030405-image.png"], assets[d + "captioned.png"]
    assert (dated.operation_id, captioned.operation_id) == ("1a722dc1acff0069e876747396f1742a72794f4c13d7454a965ae4e74bda022b", "487c02d245d6646d1b562e24050afefd2fd17d1c6b6a4283f7601c29a4acc911")
    assert (dated.normalized_metadata.taken_at_utc, captioned.normalized_metadata.description, dated.normalized_metadata.albums) == ("2024-01-02T03:04:05Z", "Synthetic caption", ["Synthetic Picasa Album"])
    assert [e.rule_id for e in dated.evidence] == [D.REGULAR_MEDIA, D.PICASA_ALBUM, D.PICASA_FILENAME_DATE]
    assert [p for _, _, c, p in findings_of(plan) if c == "invalid_picasa_ini"] == [("bad",), ("two",)]


def png(name):
    return name.encode() * 3


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """Upper-case extensions, spaces, decomposed letters, links, noise, repeated names."""
    root = tmp_path_factory.mktemp("a tree")
    for name in ("Case.PNG", "case.png", "alpha.JPG", "alpha.JPG.json", "nested dir/café.png", "nested dir/repeat.Mov", "other/repeat.Mov", "pair.mov", "pair.png", "pair.xmp", "lone.json", "skip.txt", "Recently Deleted/x.png", ".DS_Store"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(png(name))
    (root / "link.png").symlink_to(root / "pair.png")
    return root


def test_folder_scan_and_plan(spark, tree):
    media, sidecars, found = files.scan_media(spark, str(tree), skip=files.APPLE_NOISE)
    rows = {r.path: r for r in media.collect()}
    assert set(rows) == {"Case.PNG", "case.png", "alpha.JPG", "nested dir/café.png", "nested dir/repeat.Mov", "other/repeat.Mov", "pair.mov", "pair.png"}
    assert all(r.sha256 == hashlib.sha256(png(p.replace("é", "é"))).hexdigest() and r.byte_len == len(png(p.replace("é", "é"))) for p, r in rows.items())
    plan = B.build_plan("folder", media, sidecars, found)
    assert [(c, p) for _, _, c, p in findings_of(plan)] == [
        ("portable_case_collision", ("Case.PNG", "case.png")), ("known_apple_export_noise", (".DS_Store",)), ("known_apple_export_noise", ("Recently Deleted",)),
        ("duplicate_basename_across_directories", ("nested dir/repeat.Mov", "other/repeat.Mov")), ("symlink_not_followed", ("link.png",)), ("sidecar_without_media", ("lone.json",)),
    ]
    assert rules(assets_of(plan)["alpha.JPG"].metadata) == [("alpha.JPG.json", "json", D.SIDECAR_EXACT_NAME)] and assets_of(plan)["pair.mov"].live_photo.role == "video"
    with pytest.raises(ValueError, match="layout"):
        files.scan_media(spark, str(tree), prefix="Takeout/Google Photos")


def test_archives_equal_the_tree(spark, tree, tmp_path):
    names = [p for p in ("Case.PNG", "case.png", "alpha.JPG", "alpha.JPG.json", "pair.mov", "pair.png", "pair.xmp", "lone.json")]
    for part in (0, 1):
        with zipfile.ZipFile(tmp_path / f"p{part}.zip", "w") as z:
            for i, name in enumerate(names):
                if i % 2 == part or name == "pair.png":
                    z.writestr(name, png(name))
    with pytest.warns(UserWarning), zipfile.ZipFile(tmp_path / "p2.zip", "w") as z:
        z.writestr("twice.jpg", b"1")
        z.writestr("twice.jpg", b"2")
    media, sidecars, found = archives.scan_archives(spark, [f"file://{tmp_path}/p{i}.zip" for i in range(3)])
    assert {r.path: r.sha256 for r in media.collect()} == {p: hashlib.sha256(png(p)).hexdigest() for p in names if not p.endswith(("json", "xmp"))}
    assert sorted(r.path for r in sidecars.collect()) == ["alpha.JPG.json", "lone.json", "pair.xmp"]
    assert sorted((r.code, tuple(r.paths)) for r in found.collect()) == [("conflicting_takeout_archive_entry", ("twice.jpg",)), ("identical_takeout_archive_entry", ("pair.png",))]
    entries = archives.hash_entries(archives.judge(archives.list_archives(spark, [str(tmp_path / "p2.zip")])), 2)
    assert sorted(r.sha256 for r in entries.collect()) == sorted(hashlib.sha256(x).hexdigest() for x in (b"1", b"2"))
    with pytest.raises(ValueError, match="64"):
        archives.list_archives(spark, ["x"] * 65)
    with zipfile.ZipFile(tmp_path / "evil.zip", "w") as z:
        z.writestr("../evil.jpg", b"x")
    with pytest.raises(ValueError, match="unsafe_path"):
        archives.scan_archives(spark, [str(tmp_path / "evil.zip")])


def test_inventory_pages(spark, tmp_path):
    page = '{"assets":{"items":[%s],"count":%d,"nextPage":%s,"total":9}}'
    for listing, last in (("one", 4), ("two", 1)):
        (tmp_path / "in" / listing).mkdir(parents=True)
        for n in range(1, last + 1):
            (tmp_path / "in" / listing / f"{n}.json").write_text(page % (f'{{"id":"{listing}{n}"}}', 1, f'"{n + 1}"' if n < last else "null"))
    assets, pages = S.read_inventory(spark, str(tmp_path / "in" / "*"))
    from shoebox.operators.journal import page_gaps

    assert sorted(r.page for r in pages.collect()) == [1, 1, 2, 3, 4] and page_gaps(pages).collect() == []
    assert sorted(r.id for r in assets.collect()) == ["one1", "one2", "one3", "one4", "two1"]
    scope = spark.createDataFrame([("one1",), ("two1",)], "id string")
    assert sorted(map(tuple, S.read_albums(spark, str(tmp_path / "in" / "*"), scope).collect())) == [("one", "one1"), ("two", "two1")]
    (tmp_path / "in" / "one" / "2.json").unlink()
    assert [(r.page, r.gap) for r in page_gaps(S.read_inventory(spark, str(tmp_path / "in" / "o*"))[1]).collect()] == [(1, True)]


@pytest.mark.parametrize(
    ("text", "error"),
    [('{"title":"a.jpg"}', None), ('{"title":""}', "invalid"), ('{"title":"../a.jpg"}', "invalid"), ('{"title":"a","title":"b"}', "invalid"), ('{"title":"a","description":null}', None), ('{"title":"a","description":1}', "invalid"),
     ('{"title":"a","photoTakenTime":{"timestamp":"now"}}', "invalid"), ('{"title":"a","photoTakenTime":{}}', "invalid"), ('{"title":"a","geoData":{"latitude":91,"longitude":0}}', "invalid"), ('{"title":"a","geoData":{"latitude":1}}', "invalid"),
     ('{"title":"a","geoData":{"latitude":91,"longitude":0},"geoDataExif":{"latitude":0,"longitude":0}}', None), ('{"title":"a","geoData":"x"}', "invalid"), ("", "invalid")],
)
def test_sidecar_documents(spark, text, error):
    row = S.read_sidecar_json(tables(spark, [], [("d/a.json", text)])[1]).first()
    assert row.error == error and (row.title is None) == (error is not None)


def test_single_fold_of_version_4(spark):
    from shoebox.plans import document as Y

    d = "Albums/Synthetic/"
    media = [(d + "20240102-030405-image.png", 69, "82ea26b98483108e97abd3efe54c140b9aaa76e9df76f22262fe574d07468c8d"), (d + "captioned.png", 69, "a3d81b8f11847aaff2db3a7bcc177fa4a85d748dc3771154000f9f9ddeeea285"), (d + "pair.mov", 54, "fff51d63cbe5f7468f77cd021fbf4aa163a571ea326b109b95883a0b887be51f"), (d + "pair.png", 70, "08d84f8def566dabb601183fd5ac1b4272bb82c966369331aafeb4a3a6898afd")]
    side = tables(spark, media, [(d + ".picasa.ini", "[Picasa]\nname=Synthetic Picasa Album\n[captioned.png]\ncaption=Synthetic caption\n[pair.png]\nstar=yes\n"), (d + "pair.xmp", "<x/>")])
    plan = Y.with_source(B.build_plan("picasa", *side), side[1], "x", exact=True)
    assert plan.source.first().fingerprint_sha256 == "638fb912810a7167018785aa6fd999abea5bb071ec7539aad97538640fa31951"
    with pytest.raises(ValueError, match="too many"):
        P.json_fingerprint(plan.assets, plan.findings, 3)


def test_single_fold_of_version_3(spark):
    from shoebox.plans import document as Y

    d = "Albums/Synthetic Journey/"
    media = [(d + "café.png", 69, "3b7d62738b363c3bf0f01cfc016702418208db2a0c709a07e926c7ea6b20089b"), (d + "pair.mov", 58, "bb203c857e3fdafdf15f81b9774af23b2ee0df2879717d313202a572c6adaa72"), (d + "pair.png", 73, "00637d047201d9f974683c20a29f4ddf4e95ac282dd918618aeb3b929f30b573"), (d + "rendered-edited.png", 71, "ed4821e2d24c60de485980ead96092bc452262fe5f14c2dc0200f19970a00a12"), (d + "rendered.png", 71, "54e16240f6a8a447f033d6ef39932a7f1a41db249440aa81b9a5c883a48ea8c1")]
    media, side = tables(spark, media, [(d + "pair.xmp", "<x/>")])
    noise = spark.createDataFrame([("warning", "APPLE_EXPORT_NOISE_SKIPPED_V1", "known_apple_export_noise", [p]) for p in (".DS_Store", "Recently Deleted")], D.SCHEMA)
    plan = Y.with_source(B.build_plan("apple_photos", media, side, noise), side, "x", exact=True)
    assert plan.source.first().fingerprint_sha256 == "15b45ab9382549e08c3c8233bbd1636afdee28b6d5ea049b55761106666d36b7"


def test_rows_of_one_file_are_many_tasks_work(spark):
    """Documents of one small file are parsed by many tasks, not by one."""
    media = spark.range(400).select(F.expr("concat('d/', id, '.jpg')").alias("path"), F.lit(1).cast("long").alias("byte_len"), F.sha2(F.col("id").cast("string"), 256).alias("sha256")).coalesce(1)
    notes = media.select(F.concat("path", F.lit(".json")).alias("path"), F.lit("json").alias("kind"), F.lit(2).cast("long").alias("byte_len"), F.lit("{}").alias("text"))
    plan = B.build_plan("folder", media, notes)
    for table in plan.tables[:2]:
        shares = [r["count"] for r in table.groupBy(F.input_file_name()).count().collect()]
        assert sum(shares) == 400 and max(shares) < 400
