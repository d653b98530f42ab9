"""Scans of trees and archives: what is opened, listed and found, in awkward trees."""

import ctypes
import hashlib
import os
import struct
import unicodedata
import zipfile
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shoebox.plans import build as B
from shoebox.sources import archives, files


class Opens:
    """Counts how often the files and directories below a tree are opened, by the kernel's own watch."""

    OPEN, FOLDER = 0x20, 0x40000000

    def __init__(self, top):
        self.libc, self.paths = ctypes.CDLL(None, use_errno=True), {}
        self.fd = self.libc.inotify_init1(os.O_NONBLOCK)
        for folder, _, _ in os.walk(os.fsencode(top)):
            self.paths[self.libc.inotify_add_watch(self.fd, folder, self.OPEN)] = folder

    def counts(self):
        files_, folders = Counter(), Counter()
        while True:
            try:
                data = os.read(self.fd, 1 << 16)
            except BlockingIOError:
                return files_, folders
            at = 0
            while at < len(data):
                wd, mask, _, size = struct.unpack_from("iIII", data, at)
                name = data[at + 16 : at + 16 + size].rstrip(b"\0")
                at += 16 + size
                if mask & self.FOLDER:
                    if not name:
                        folders[self.paths[wd]] += 1
                else:
                    files_[os.path.join(self.paths[wd], name)] += 1


def made(top, names):
    for name in names:
        path = os.path.join(os.fsencode(top), name if isinstance(name, bytes) else os.fsencode(name))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(os.path.basename(path) * 3)


def codes(found):
    return sorted((r.code, tuple(r.paths)) for r in found.collect())


@pytest.fixture
def tree(tmp_path):
    wide = [f"wide/{i}/{j}.jpg" for i in range(6) for j in range(5)]
    deep = ["deep/" + "/".join("abcdefgh"[: i + 1]) + "/x.png" for i in range(8)]
    noise = ["@eaDir/hidden/a.jpg", "wide/Thumbs.DB", "wide/._x.jpg", "wide/0/RECENTLY DELETED/b.jpg"]
    made(tmp_path, [*wide, *deep, *noise, b"bad\xff.jpg", b"bad\xfe/in.jpg", "skip.txt", "a.JSON", "o" * 120 + ".jpg", "café.png", "café.png", "wide/.picasa.ini"])
    os.symlink(tmp_path / "a.JSON", tmp_path / "link.json")
    os.mkfifo(tmp_path / "pipe.jpg")
    (tmp_path / "shut.jpg").write_bytes(b"x")
    os.chmod(tmp_path / "shut.jpg", 0)
    return tmp_path


def test_each_file_is_opened_once_and_each_folder_listed_once(spark, tree):
    watch = Opens(tree)
    scan = files.scan_media(spark, str(tree), skip=files.APPLE_NOISE, max_path_bytes=100)
    media, sidecars = scan.media.collect(), scan.sidecars.collect()
    scan.findings.collect()
    opened, listed = watch.counts()
    assert set(opened.values()) == {1} and set(listed.values()) == {1}
    assert len(opened) == len(media) + len(sidecars) + 1  # and the one that must not be read
    assert not [p for p in (*opened, *listed) if b"eaDir" in p or b"DELETED" in p or b"._" in p]
    scan.discard()


def test_what_a_scan_finds(spark, tree):
    media, sidecars, found = files.scan_media(spark, str(tree), skip=files.APPLE_NOISE, max_path_bytes=100)
    rows = media.collect()
    assert len(rows) == 30 + 8 + 2 and Counter(r.path for r in rows)["café.png"] == 2
    assert {r.sha256 for r in rows if r.path == "café.png"} == {hashlib.sha256(n.encode() * 3).hexdigest() for n in ("café.png", "café.png")}
    assert all(r.created is None or abs(r.created - r.modified) < 60_000 for r in rows)
    assert sorted((r.path, r.kind, r.text) for r in sidecars.collect()) == [("a.JSON", "json", "a.JSON" * 3), ("wide/.picasa.ini", "ini", ".picasa.ini" * 3)]
    assert codes(found) == sorted([
        ("known_apple_export_noise", ("@eaDir",)), ("known_apple_export_noise", ("wide/._x.jpg",)), ("known_apple_export_noise", ("wide/0/RECENTLY DELETED",)), ("known_apple_export_noise", ("wide/Thumbs.DB",)),
        ("non_unicode_path", ("<non-unicode>",)), ("portable_path_too_long", ("<path-over-limit>",)), ("special_file_not_read", ("pipe.jpg",)), ("symlink_not_followed", ("link.json",)), ("unreadable_source_file", ("shut.jpg",)),
    ])
    plan = B.build_plan("folder", media, sidecars, found)
    assert ("native_paths_share_nfc_path", ("café.png",)) in codes(plan.findings)


@pytest.mark.parametrize("budget", [1, 3, 1000])
def test_walk_in_rounds_lists_all(spark, tree, budget):
    rows = files.walk(spark, f"file://{tree}", budget=budget).collect()
    want = {os.path.relpath(os.path.join(d, n), os.fsencode(tree)) for d, ds, fs in os.walk(os.fsencode(tree)) for n in ds + fs if b"\xfe" not in d}
    assert Counter(bytes(r.native) for r in rows) == Counter(want)
    assert all(r.path == unicodedata.normalize("NFC", bytes(r.native).decode()) for r in rows if r.kind == "file")


def test_limits_end_a_scan(spark, tree):
    with pytest.raises(ValueError, match="max_entries"):
        files.walk(spark, str(tree), max_entries=10, budget=5)
    with pytest.raises(ValueError, match="max_directory_entries"):
        files.walk(spark, str(tree), max_directory_entries=5)
    assert files.walk(spark, str(tree), max_entries=500, max_directory_entries=100).count() > 50
    with pytest.raises(ValueError, match="layout"):
        files.scan_media(spark, str(tree), prefix="wide/0/1.jpg")


def test_changed_files_are_found_and_kept(spark, tree):
    listed = files.walk(spark, str(tree)).where("path like 'wide/0/%.jpg' and kind = 'file'").withColumn("modified_ns", F.expr("case when path like '%1.jpg' then 0 else modified_ns end"))
    rows = {r.path: r for r in files.hash_files(listed, str(tree), 3).collect()}
    assert {p for p, r in rows.items() if r.trouble == "changed"} == {"wide/0/1.jpg"} and all(r.sha256 for r in rows.values())


def test_unreadable_folder(spark, tmp_path):
    made(tmp_path, ["a/x.jpg"])
    tree = files.Local(str(tmp_path))
    with pytest.raises(OSError):
        list(tree.list(b"gone"))
    frontier = spark.createDataFrame([(b"gone",), (b"",)], "native binary")
    rows = frontier.mapInArrow(files._listing(str(tmp_path), None, 4096, None, 1000), files.TREE).collect()
    assert sorted((r.kind, r.path) for r in rows) == [("directory", "a"), ("file", "a/x.jpg"), ("unreadable_directory", "gone")]


def test_tasks_are_filled_by_weight(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").cast("binary").alias("native"), F.expr("case when id < 10 then 100000 when id < 100 then 10000 else 100 + id % 50 end").alias("w"))
    sums = [r.w for r in files.deal(rows, F.col("w"), F.col("native"), 8).groupBy(F.spark_partition_id().alias("p")).agg(F.sum("w").alias("w")).collect()]
    assert len(sums) == 8 and max(sums) <= 2 * sum(sums) / 8
    assert files.deal(rows, F.col("w"), F.col("native"), 8).count() == 2000


def zipped(path, entries, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in entries:
            z.writestr(name, data)
    return f"file://{path}"


def test_a_large_part_is_shared_among_tasks(spark, tmp_path):
    entries = [(f"d/{i}.jpg", os.urandom(20_000) + b"\0" * 50_000) for i in range(60)] + [("d/a.json", b'{"x": 1}'), ("d/e.jpg", b"")]
    parts = [zipped(tmp_path / "p.zip", entries), zipped(tmp_path / "q.zip", entries[:3], zipfile.ZIP_STORED)]
    judged = archives.judge(archives.list_archives(spark, parts))
    hashed = archives.hash_entries(judged, 8)
    rows = hashed.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows if r.archive.endswith("p.zip")}) == 8 and not any(r.damaged for r in rows)
    want = {n: hashlib.sha256(d).hexdigest() for n, d in entries}
    assert all(r.sha256 == want[r.path] for r in rows) and len(rows) == 65
    scan = archives.scan_archives(spark, parts)
    assert codes(scan.findings) == [("identical_takeout_archive_entry", (f"d/{i}.jpg",)) for i in range(3)]
    assert scan.media.count() == 61 and [r.text for r in scan.sidecars.collect()] == ['{"x": 1}']


def test_bad_archives_are_refused(spark, tmp_path):
    fine = zipped(tmp_path / "f.zip", [("Takeout/Google Photos/a.jpg", b"a" * 999), ("other.jpg", b"x")])
    scan = archives.scan_archives(spark, [fine], prefix="Takeout/Google Photos")
    assert [r.path for r in scan.media.collect()] == ["Takeout/Google Photos/a.jpg"]
    with pytest.raises(ValueError, match="layout"):
        archives.scan_archives(spark, [fine], prefix="Nothing/here")
    with pytest.raises(ValueError, match="max_path_bytes"):
        archives.scan_archives(spark, [fine], max_path_bytes=10)
    with pytest.raises(ValueError, match="max_entries"):
        archives.scan_archives(spark, [fine], max_entries=1)
    with pytest.raises(ValueError, match="not a ZIP"):
        archives.scan_archives(spark, [str(tmp_path / "x.tar")])
    bad = tmp_path / "b.zip"
    zipped(bad, [("a.jpg", b"a" * 999)], zipfile.ZIP_STORED)
    data = bytearray(bad.read_bytes())
    data[100] ^= 1
    bad.write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        archives.scan_archives(spark, [str(bad)])
    bomb = zipped(tmp_path / "bomb.zip", [("a.jpg", b"\0" * 3_000_000)])
    with pytest.raises(ValueError, match="a.jpg"):
        archives.scan_archives(spark, [bomb])


def test_adapters(spark, tmp_path):
    made(tmp_path, ["x/a.jpg", "x/a.xmp", "Recently Deleted/b.jpg"])
    assert B.scan_source(spark, str(tmp_path), "apple_photos").media.count() == 1
    assert B.scan_source(spark, str(tmp_path), "folder").media.count() == 2
    with pytest.raises(ValueError, match="layout"):
        B.scan_source(spark, str(tmp_path), "google_takeout")
    own = B.SourceAdapter("folder", 1, B.match_folder, skip=files.Skip(("x",), ("Rec",)))
    B.register("own", own)
    try:
        with pytest.raises(ValueError, match="known"):
            B.register("own", own)
        scan = B.scan_source(spark, str(tmp_path), "own")
        assert scan.media.count() == 0 and codes(scan.findings) == [("known_apple_export_noise", ("Recently Deleted",)), ("known_apple_export_noise", ("x",))]
        assert B.build_plan("own", *scan).summary.first().assets == 0
        with pytest.raises(ValueError, match="no archives"):
            B.scan_source(spark, [str(tmp_path / "a.zip")], "own")
    finally:
        del B.ADAPTERS["own"]
    part = zipped(tmp_path / "a.zip", [("x/a.jpg", b"1"), ("Recently Deleted/b.jpg", b"2")])
    assert codes(B.scan_source(spark, [part], "apple_photos").findings) == [("known_apple_export_noise", ("Recently Deleted",))]


def test_version_1_takes_no_empty_titles(spark):
    side = spark.createDataFrame([("Takeout/Google Photos/Trip/metadata.json", "json", 12, "x", '{"title":""}')], "path string, kind string, byte_len long, sha256 string, text string")
    media = spark.createDataFrame([], "path string, byte_len long, sha256 string")
    assert codes(B.build_plan("google_takeout_v1", media, side).findings) == [("invalid_takeout_json", ("Takeout/Google Photos/Trip/metadata.json",))]
    assert codes(B.build_plan("google_takeout", media, side).findings) == []


def test_places():
    assert [files.place(u).top for u in ("/a b/c", "file:/a b/c", "file:///a b/c", "file:///a%20b/c")] == [b"/a b/c"] * 4


def test_shared_folder_must_be_named_on_a_cluster():
    from shoebox.sources.tables import shared_folder

    class Session:
        class conf:
            get = staticmethod(lambda key, other=None: other)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session())
    assert Path(__file__).exists()


def test_a_task_holds_the_texts_of_few_files(tmp_path):
    n = 3 * files.HELD_FILES
    (tmp_path / "a.json").write_bytes(b"{}")
    (tmp_path / "b.json").write_bytes(b"x" * files.TEXT_BYTES)
    for name, most in (("a.json", files.HELD_FILES), ("b.json", files.HELD_BYTES // files.TEXT_BYTES)):
        size, when = (s := os.stat(tmp_path / name)).st_size, s.st_mtime_ns
        rows = files._record([(name.encode(), name, "file", size, when)] * n if most > 100 else [(name.encode(), name, "file", size, when)] * 40, files.TREE)
        out = [b.num_rows for b in files._hashing(str(tmp_path))(iter([rows]))]
        assert sum(out) == rows.num_rows and max(out) <= most
