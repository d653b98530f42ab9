"""File trees as tables of media and sidecars.

A walk in rounds: each round is one job over the frontier, the directories that are known but not listed. A task goes down from its directories until it has
listed ``budget`` entries and hands the rest to the next round, where they are dealt anew, so that no task lists a deep or wide subtree alone.
Names are bytes; what export noise covers is neither listed nor read. Then one pass opens every wanted file once and streams it in blocks through both digests,
in tasks filled by bytes. Both results are written once, and all that a scan returns reads them.
"""

from __future__ import annotations

import base64
import ctypes
import hashlib
import os
import stat
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..diagnostics import finding, gather
from ..functions import expr as X
from .tables import cut, discard, read_folder, shared_folder

BLOCK = 1 << 20
#: Sidecars up to so many bytes come with their text.
TEXT_BYTES = 1 << 20
#: A task sends on what it has read once so many bytes of text, or so many files, have come together.
HELD_BYTES, HELD_FILES = 1 << 23, 1000
#: What opening a file costs, as bytes read.
OPENING = 1 << 16
TREE = "native binary, path string, kind string, byte_len bigint, modified_ns bigint"
HASHED = "native binary, path string, byte_len bigint, sha256 string, sha1 string, text string, created bigint, modified bigint, trouble string"
#: Kinds of tree rows that are findings, with what stands for a path that can't be shown.
TROUBLE = {"non_unicode": ("non_unicode_path", "<non-unicode>"), "overlong": ("portable_path_too_long", "<path-over-limit>"), "unreadable_directory": ("unreadable_directory", None),
           "unreadable_metadata": ("unreadable_metadata", None), "symlink": ("symlink_not_followed", None), "special": ("special_file_not_read", None), "noise": ("known_apple_export_noise", None)}


class Local:
    """A folder of this machine's file system, by byte names."""

    def __init__(self, top: str):
        self.top = os.fsencode(os.path.abspath(top))

    def list(self, below: bytes) -> Iterator[tuple]:
        """(name, kind, length, modified in ns) of what is in a directory; kind is null where an entry can't be inspected."""
        with os.scandir(os.path.join(self.top, below)) as entries:
            for e in entries:
                try:
                    s = e.stat(follow_symlinks=False)
                except OSError:
                    yield e.name, "unreadable_metadata", 0, 0
                    continue
                kind = "symlink" if stat.S_ISLNK(s.st_mode) else "directory" if stat.S_ISDIR(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else "special"
                yield e.name, kind, s.st_size, s.st_mtime_ns

    def open(self, native: bytes):
        file = open(os.path.join(self.top, native), "rb", buffering=0)
        if not os.fstat(file.fileno()).st_mode & 0o444:
            file.close()
            raise PermissionError(native)
        return file

    def facts(self, native: bytes, file) -> tuple:
        """What changes when a file does; its path must still lead to the open file."""
        one, other = os.fstat(file.fileno()), os.stat(os.path.join(self.top, native))
        return (one.st_size, one.st_mtime_ns) if (one.st_dev, one.st_ino, one.st_size) == (other.st_dev, other.st_ino, other.st_size) else (-1, -1)

    def created(self, native: bytes) -> int | None:
        return _birth(os.path.join(self.top, native))


class Remote:
    """A folder of any file system that pyarrow reaches. It has no links, and its times of creation are not known."""

    def __init__(self, system, top: str):
        self.system, self.top = system, top.rstrip("/")

    def _at(self, below: bytes) -> str:
        return f"{self.top}/{below.decode()}".rstrip("/")

    def list(self, below: bytes) -> Iterator[tuple]:
        from pyarrow import fs

        kinds = {fs.FileType.Directory: "directory", fs.FileType.File: "file"}
        for info in self.system.get_file_info(fs.FileSelector(self._at(below))):
            yield info.base_name.encode(), kinds.get(info.type, "special"), info.size or 0, info.mtime_ns or 0

    def open(self, native: bytes):
        return self.system.open_input_file(self._at(native))

    def facts(self, native: bytes, file) -> tuple:
        return file.size(), self.system.get_file_info(self._at(native)).mtime_ns or 0

    def created(self, native: bytes) -> None:
        return None


def place(root: str) -> Local | Remote:
    """Where a tree or file lies: a path, or a URI of any file system that pyarrow can reach."""
    if "://" not in root and not root.startswith("file:"):
        return Local(root)
    from pyarrow import fs

    if root.startswith("file:") and "%" not in root:  # Spark writes such names as they are, with spaces
        return Local("/" + root.removeprefix("file:").lstrip("/"))
    system, top = fs.FileSystem.from_uri(root)
    return Local(top) if isinstance(system, fs.LocalFileSystem) else Remote(system, top)


@cache
def _libc():
    try:
        return ctypes.CDLL(None, use_errno=True).statx
    except (AttributeError, OSError):  # another system
        return None


def _birth(path: bytes) -> int | None:
    """A file's time of creation in ms, where the system tells it."""
    statx, out = _libc(), ctypes.create_string_buffer(256)
    asked = 0x800  # the time of creation; its seconds and nanoseconds stand at byte 80
    if not statx or statx(-100, path, 0, asked, out) or not int.from_bytes(out[0:4], "little") & asked:
        return None
    return int.from_bytes(out[80:88], "little", signed=True) * 1000 + int.from_bytes(out[88:92], "little") // 1_000_000


@dataclass(frozen=True)
class Skip:
    """Names of files and folders that an export leaves around: whole names in any case, and beginnings. Neither listed nor read below them."""

    names: tuple[str, ...]
    beginnings: tuple[str, ...] = ()

    def prefix(self, path: str) -> str | None:
        """The path up to its first such component."""
        parts = path.split("/")
        for i, part in enumerate(parts):
            if ascii_lower(part) in self.names or part.startswith(self.beginnings or ("\0",)):
                return "/".join(parts[: i + 1])
        return None

    def column(self, path: Column) -> Column:
        return X.skipped_prefix(path, self.names, self.beginnings)


def ascii_lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


APPLE_NOISE = Skip(X.NOISE, ("._",))


def _record(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [pa.field(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def _listing(root: str, skip: Skip | None, max_path_bytes: int, max_directory_entries: int | None, budget: int) -> Callable:
    def run(batches):
        tree, listed, rows = place(root), 0, []
        for batch in batches:
            stack = batch.column(0).to_pylist()
            while stack:
                below = stack.pop()
                if listed >= budget:
                    rows.append((below, None, "open", None, None))
                    continue
                here, own = (below.decode() if below else "."), 0
                try:
                    for name, kind, size, modified in tree.list(below):
                        native, own = (below + b"/" if below else b"") + name, own + 1
                        if max_directory_entries and own > max_directory_entries:
                            rows.append((below, unicodedata.normalize("NFC", here), "limit", None, None))
                            break
                        try:
                            path = unicodedata.normalize("NFC", native.decode())
                        except UnicodeDecodeError:
                            rows.append((native, None, "non_unicode", None, None))
                            continue
                        if len(path.encode()) > max_path_bytes:
                            rows.append((native, None, "overlong", None, None))
                        elif skip and (noise := skip.prefix(path)) is not None:
                            rows.append((native, noise, "noise", None, None))
                        else:
                            rows.append((native, path, kind, size, modified))
                            if kind == "directory":
                                stack.append(native)
                        if len(rows) >= 10_000:
                            yield _record(rows, TREE)
                            rows = []
                except OSError:
                    rows.append((below, unicodedata.normalize("NFC", here), "unreadable_directory", None, None))
                listed += own
        if rows:
            yield _record(rows, TREE)

    return run


def walk(spark: SparkSession, root: str, skip: Skip | None = None, max_path_bytes: int = 4096, max_entries: int | None = None, max_directory_entries: int | None = None, budget: int = 50_000) -> DataFrame:
    """All entries below root, as a table: TREE, paths in NFC. kind: file, directory, symlink, special, or a key of TROUBLE. Findings keep the walk
    going; a limit that is exceeded ends it. The first round is short, so that work spreads early."""
    at, frontier, known, rounds = shared_folder(spark), spark.createDataFrame([(bytearray(),)], "native binary"), 1, 0
    while known:
        run = _listing(root, skip, max_path_bytes, max_directory_entries, budget if rounds else min(budget, 1000))
        frontier.repartition(min(known, 10_000)).mapInArrow(run, TREE).write.parquet(f"{at}/round={rounds}")
        done = spark.read.schema(TREE).parquet(f"{at}/round={rounds}")
        frontier = done.where("kind = 'open'").select("native")
        known, seen, over = done.agg(F.count_if(F.col("kind") == "open"), F.count_if(~F.col("kind").isin("open", "limit")), F.count_if(F.col("kind") == "limit")).first()
        rounds, max_entries = rounds + 1, max_entries - seen if max_entries is not None else None
        if over:
            raise ValueError("limit exceeded: max_directory_entries")
        if max_entries is not None and max_entries < 0:
            raise ValueError("limit exceeded: max_entries")
    tree = read_folder(spark, at, TREE)
    out = tree.where("kind <> 'open'")
    out.cut_path = at
    return out


def deal(rows: DataFrame, weight: Column, key: Column, tasks: int) -> DataFrame:
    """rows in ``tasks`` partitions of about equal weight, heaviest first. The few rows that weigh a quarter of a task's share or more are dealt
    in turn, there and back; all others by a hash of their key."""
    total = rows.agg(F.sum(weight)).first()[0] or 0
    heavy = weight * 4 * tasks >= F.lit(total)  # at most 4 * tasks rows
    nth = F.row_number().over(Window.orderBy(F.desc("weight"), "key")) - 1
    lap, seat = F.floor(nth / tasks), F.pmod(nth, F.lit(tasks))
    few = rows.where(heavy).withColumns({"weight": weight, "key": key}).withColumn("slot", F.when(lap % 2 == 0, seat).otherwise(tasks - 1 - seat).cast("int"))
    many = rows.where(~heavy).withColumns({"weight": weight, "key": key}).withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(tasks)).cast("int"))
    return few.unionByName(many).repartitionById(tasks, "slot").sortWithinPartitions(F.desc("weight")).drop("slot", "weight", "key")


def tasks_for(spark: SparkSession, rows: DataFrame, weight: Column, task_bytes: int = 1 << 29) -> int:
    """Enough tasks for ``task_bytes`` each, but no fewer than two a core."""
    total = rows.agg(F.sum(weight)).first()[0] or 0
    return int(min(100_000, max(2 * spark.sparkContext.defaultParallelism, total // task_bytes)))


def digests(stream, keep: bool) -> tuple:
    """(length, sha256, base64 of sha1, text or null) of a stream, read in blocks."""
    long, short, n, kept, buffer = hashlib.sha256(), hashlib.sha1(), 0, [], memoryview(bytearray(BLOCK))
    while size := stream.readinto(buffer):
        long.update(buffer[:size])
        short.update(buffer[:size])
        n += size
        if keep and n <= TEXT_BYTES:
            kept.append(bytes(buffer[:size]))
    try:
        text = b"".join(kept).decode() if keep and n <= TEXT_BYTES else None
    except UnicodeDecodeError:
        text = None
    return n, long.hexdigest(), base64.b64encode(short.digest()).decode(), text


def is_text(path: str) -> bool:
    return path.lower().endswith((".json", ".ini"))


def _hashing(root: str) -> Callable:
    def run(batches):
        tree = place(root)
        for batch in batches:
            out, held = [], 0
            for native, path, _, size, modified in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    with tree.open(native) as file:
                        before = tree.facts(native, file)
                        n, long, short, text = digests(file, is_text(path))
                        changed = before != (size, modified) or tree.facts(native, file) != before or n != size
                    out.append((native, path, n, long, short, text, tree.created(native), modified // 1_000_000, "changed" if changed else None))
                    held += len(text or "")
                except OSError:
                    out.append((native, path, size, None, None, None, None, modified // 1_000_000, "unreadable"))
                if held >= HELD_BYTES or len(out) >= HELD_FILES:
                    yield _record(out, HASHED)
                    out, held = [], 0
            if out:
                yield _record(out, HASHED)

    return run


def hash_files(files: DataFrame, root: str, tasks: int) -> DataFrame:
    """TREE rows of files -> HASHED. Each file is opened once. trouble: unreadable (no digests), or changed since it was listed or while it was read."""
    return deal(files, F.col("byte_len") + OPENING, F.col("native"), tasks).mapInArrow(_hashing(root), HASHED)


@dataclass(frozen=True)
class Scan:
    """media: path, byte_len, sha256, sha1, created, modified (ms); sidecars: path, kind (json, xmp or ini), byte_len, sha256, text; findings."""

    media: DataFrame
    sidecars: DataFrame
    findings: DataFrame
    tables: list = field(default_factory=list)

    def __iter__(self):
        return iter((self.media, self.sidecars, self.findings))

    def discard(self) -> None:
        """Deletes the tables below this scan, once nothing reads them any more."""
        discard(*self.tables)


def wanted(path: Column) -> Column:
    return X.media_kind(path).isNotNull() | X.metadata_kind(path).isNotNull() | (F.lower(X.filename(path)) == X.INI_NAME)


def parted(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(media, sidecars) of entries with digests."""
    path = F.col("path")
    kind = F.when(F.lower(X.filename(path)) == X.INI_NAME, "ini").otherwise(X.metadata_kind(path))
    media = entries.where(X.media_kind(path).isNotNull()).select("path", "byte_len", "sha256", "sha1", "created", "modified")
    return media, entries.withColumn("kind", kind).where("kind is not null").select("path", "kind", "byte_len", "sha256", "text")


def scan_media(spark: SparkSession, root: str, prefix: str | None = None, skip: Skip | None = None, max_path_bytes: int = 4096, max_entries: int | None = None, max_directory_entries: int | None = None, tasks: int | None = None) -> Scan:
    """S-1, S-3: the media, sidecars and findings of the tree below root, a path or URI. Extensions count in any case. Whole files are hashed in
    blocks, whatever their length. Links and special files are not followed; with ``prefix`` the tree must have that directory, or this fails. Two
    names that are one in NFC are two rows. A file that changed meanwhile is a finding, with what was read."""
    tree = walk(spark, root, skip, max_path_bytes, max_entries, max_directory_entries)
    if prefix and tree.where((F.col("kind") == "directory") & (F.col("path") == prefix)).isEmpty():
        discard(tree)
        raise ValueError(f"unsupported layout: nothing below {prefix}")
    files = tree.where("kind = 'file'").where(wanted(F.col("path")))
    entries = cut(hash_files(files, root, tasks or tasks_for(spark, files, F.col("byte_len") + OPENING)))
    found = [finding(tree.where(F.col("kind") == kind), code, F.lit(shown) if shown else F.col("path")) for kind, (code, shown) in TROUBLE.items()]
    found += [finding(entries.where(F.col("trouble") == t), code, F.col("path")) for t, code in (("unreadable", "unreadable_source_file"), ("changed", "source_changed_during_scan"))]
    return Scan(*parted(entries.where("sha256 is not null")), gather(*found), [tree, entries])


def require_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """S-3: the rows whose path lies at or below prefix; fails if there are none."""
    inside = df.where((F.col("path") == prefix) | F.startswith("path", F.lit(prefix.rstrip("/") + "/")))
    if inside.isEmpty():
        raise ValueError(f"unsupported layout: nothing below {prefix}")
    return inside
