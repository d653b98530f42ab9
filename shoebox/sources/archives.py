"""Split archives as one tree (S-2): ZIP parts on any file system that pyarrow reaches.

The central directories are read first, one task a part; whatever a name or a directory entry forbids is settled there, before a byte is inflated. Then
entries are dealt to tasks by compressed bytes, so one large part is shared by many tasks. A task seeks to an entry's own offset and reads just its range; each entry
is inflated once, into both digests, and the result is written once.
"""

from __future__ import annotations

import base64
import hashlib
import stat
import struct
import zipfile
import zlib
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..diagnostics import PICASA_ARCHIVE_RULES, finding, gather
from ..functions import expr as X
from ..operators.aliases import merge_archives
from .files import BLOCK, HELD_BYTES, HELD_FILES, OPENING, TEXT_BYTES, Local, Scan, Skip, _record, deal, is_text, parted, place, require_prefix, tasks_for, wanted
from .tables import cut, discard

LISTED = "archive string, idx int, name string, size bigint, csize bigint, method int, flags int, symlink boolean, modified bigint, start bigint, crc bigint"
HASHED = "archive string, idx int, path string, byte_len bigint, sha256 string, sha1 string, text string, modified bigint, damaged boolean"
#: A local file header's mark and its length before the name.
HEADER_MARK, HEADER_BYTES = b"PK\x03\x04", 30


def _parted(archive: str) -> tuple:
    """(where the part lies, its name there)."""
    folder, _, name = archive.rpartition("/")
    return place(folder or ("/" if archive.startswith("/") else ".")), name.encode()


def list_archives(spark: SparkSession, archives: list[str], max_parts: int = 64) -> DataFrame:
    """First stage: the central directories of ZIP parts, paths or URIs -> LISTED without folders. More than ``max_parts`` are refused."""
    if not 0 < len(archives) <= max_parts:
        raise ValueError(f"limit exceeded: not 1 to {max_parts} archive parts")
    if bad := [a for a in archives if not a.lower().endswith(".zip")]:
        raise ValueError(f"not a ZIP file: {bad[0]}")

    def run(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                tree, name = _parted(archive)
                rows = []
                with tree.open(name) as file, zipfile.ZipFile(file) as z:
                    for i, e in enumerate(z.infolist()):
                        if not e.is_dir():
                            rows.append((archive, i, e.filename, e.file_size, e.compress_size, e.compress_type, e.flag_bits, stat.S_ISLNK(e.external_attr >> 16), _time(e), e.header_offset, e.CRC))
                        if len(rows) >= 10_000:
                            yield _record(rows, LISTED)
                            rows = []
                yield _record(rows, LISTED)

    return spark.createDataFrame([(a,) for a in sorted(archives)], "archive string").repartition(len(archives)).mapInArrow(run, LISTED)


def _time(entry: zipfile.ZipInfo) -> int | None:
    try:
        return int(datetime(*entry.date_time, tzinfo=UTC).timestamp() * 1000)
    except ValueError:
        return None


def judge(entries: DataFrame, max_bytes: int = 1 << 34, max_ratio: int = 200, grace: int = 1 << 20) -> DataFrame:
    """LISTED with ``path`` (NFC) and ``rejection``: why an entry must not be inflated, or null."""
    why = F.when(X.unsafe_entry(F.col("name")), "unsafe_path").when(F.col("symlink"), "symlink").otherwise(X.entry_rejection(*(F.col(c) for c in ("size", "csize", "method", "flags")), max_bytes, max_ratio, grace))
    return X.with_nfc(entries.withColumn("rejection", why).withColumn("path", F.col("name")))


def _inflated(file, start: int, csize: int, method: int):
    """The blocks of an entry, from its own range of the part."""
    file.seek(start)
    head = file.read(HEADER_BYTES)
    if len(head) < HEADER_BYTES or head[:4] != HEADER_MARK:
        raise zipfile.BadZipFile("no entry here")
    name, extra = struct.unpack("<HH", head[26:30])
    file.seek(start + HEADER_BYTES + name + extra)
    inflate = zlib.decompressobj(-15) if method else None
    while csize:
        block = file.read(min(BLOCK, csize))
        if not block:
            raise zipfile.BadZipFile("the part ends within an entry")
        csize -= len(block)
        while block and inflate:
            yield inflate.decompress(block, BLOCK)
            block = inflate.unconsumed_tail
        if not inflate:
            yield block
    if inflate:
        yield inflate.flush()


def hash_entries(judged: DataFrame, tasks: int) -> DataFrame:
    """Second stage: rows of ``judge`` without a rejection -> HASHED. damaged: what was read is not what the directory states."""

    def run(batches):
        opened, tree, name, file = None, None, None, None
        try:
            for batch in batches:
                out, held = [], 0
                for archive, idx, path, size, csize, method, modified, start, crc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if archive != opened:
                        if file:
                            file.close()
                        tree, name = _parted(archive)
                        opened, file = archive, tree.open(name)
                    long, short, n, check, kept, fine = hashlib.sha256(), hashlib.sha1(), 0, 0, [], True
                    try:
                        for block in _inflated(file, start, csize, method):
                            n += len(block)
                            if n > size:
                                break
                            check = zlib.crc32(block, check)
                            long.update(block)
                            short.update(block)
                            if is_text(path) and size <= TEXT_BYTES:
                                kept.append(block)
                    except (zipfile.BadZipFile, zlib.error):
                        fine = False
                    try:
                        text = b"".join(kept).decode() if is_text(path) and size <= TEXT_BYTES else None
                    except UnicodeDecodeError:
                        text = None
                    out.append((archive, idx, path, n, long.hexdigest(), base64.b64encode(short.digest()).decode(), text, modified, not fine or n != size or check != crc))
                    held += len(text or "")
                    if held >= HELD_BYTES or len(out) >= HELD_FILES:
                        yield _record(out, HASHED)
                        out, held = [], 0
                if out:
                    yield _record(out, HASHED)
        finally:
            if file:
                file.close()

    rows = judged.where("rejection is null").select("archive", "idx", "path", "size", "csize", "method", "modified", "start", "crc")
    return deal(rows, F.col("csize") + OPENING, F.concat_ws(":", "archive", "idx"), tasks).mapInArrow(run, HASHED)


def scan_archives(spark: SparkSession, archives: list[str], export: str = "takeout", prefix: str | None = None, skip: Skip | None = None, max_path_bytes: int = 4096, max_entries: int | None = None, tasks: int | None = None) -> Scan:
    """S-2, A-4: ZIP parts as one tree, as ``scan_media``. ``export``: takeout, apple or picasa; the latter two count an entry's time as part of its
    identity. Only what lies below ``prefix`` counts, and something must. An entry that is refused or damaged refuses the whole scan, as does a part that changes meanwhile."""
    directories = list_archives(spark, archives)
    before, listed = _facts(archives), cut(directories)
    try:
        judged = judge(listed)
        if max_entries is not None and listed.count() > max_entries:
            raise ValueError("limit exceeded: max_entries")
        if not judged.where(X.path_too_long(F.col("path"), max_path_bytes)).isEmpty():
            raise ValueError("limit exceeded: max_path_bytes")
        noise = skip.column(F.col("path")) if skip else F.lit(None).cast("string")
        judged = judged.withColumn("noise", noise)
        inside = judged.where("noise is null")
        if prefix:
            inside = require_prefix(inside, prefix)
        checked = inside if export == "takeout" else inside.where(wanted(F.col("path")))
        refused = judged.where("rejection = 'unsafe_path'").unionByName(checked.where("rejection is not null")).select("name", "rejection").head(1)
        if refused:
            raise ValueError(f"archive entry {refused[0].name}: {refused[0].rejection}")
        chosen = inside.where(wanted(F.col("path")))
        hashed = cut(hash_entries(chosen, tasks or tasks_for(spark, chosen, F.col("csize") + OPENING)))
        damaged = hashed.where("damaged").select("archive", "path").head(1)
        if damaged or _facts(archives) != before:
            discard(hashed)
            raise ValueError(f"archive entry {damaged[0].path}: damaged" if damaged else "an archive part changed during the scan")
    except ValueError:
        discard(listed)
        raise
    identity = ["byte_len", "sha256"] + (["modified"] if export != "takeout" else [])
    ini = F.lower(X.filename(F.col("path"))) == X.INI_NAME
    merged = cut(merge_archives(hashed.where(~ini), identity))
    names = ("identical_takeout_archive_entry", "conflicting_takeout_archive_entry") if export == "takeout" else ("identical_archive_entry", "conflicting_archive_entry")
    rules = PICASA_ARCHIVE_RULES if export == "picasa" else {}
    found = [finding(merged.where(f"outcome = '{o}'"), code, F.col("path"), rule=rules.get(code)) for o, code in zip(("duplicate", "conflict"), names, strict=True)]
    found.append(finding(judged.where("noise is not null"), "known_apple_export_noise", F.col("noise")))
    facts = ["byte_len", "sha256", "sha1", "text", "modified"]
    first = hashed.where(~ini).groupBy("path").agg(F.min_by(F.struct(*facts), F.struct("archive", "idx")).alias("x")).select("path", "x.*")
    every = first.join(merged.where("outcome <> 'conflict'").select("path"), "path", "left_semi").unionByName(hashed.where(ini).select("path", *facts))
    return Scan(*parted(every.withColumn("created", F.lit(None).cast("bigint"))), gather(*found), [listed, hashed, merged])


def _facts(archives: list[str]) -> list:
    """Length and time of each part; there are few."""
    out = []
    for archive in archives:
        tree, name = _parted(archive)
        if isinstance(tree, Local):
            with tree.open(name) as file:
                out.append(tree.facts(name, file))
        else:
            info = tree.system.get_file_info(tree._at(name))
            out.append((info.size, info.mtime_ns))
    return out
