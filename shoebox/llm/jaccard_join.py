"""N-gram Jaccard join (operator 9): exact, with signature trees inside cells.

1.  Each text becomes a set of shingle fingerprints, and the set a class id (a fingerprint of the
    set). Equal sets are one class from here on, so exact copies cost nothing further. A second fingerprint of each set tells
    whether different sets got the same id; such ids are replaced by ids of both fingerprints.
2.  Two sets with Jaccard similarity >= t share one of the first |s| - ceil(t |s|) + 1 shingles of either, for any
    fixed order of all shingles. The order here is by fingerprint, with shingles that are frequent in
    the corpus last, which keeps groups small. For each shingle in such a
    prefix, the smallest class that has it leads a cell; classes join the cells of their leaders.
    Every pair that may link thus meets in a cell.
3.  In a cell, classes hang in a signature tree: a leaf has the class's bitmap and size, a node above it the OR of the
    bitmaps and the range of sizes. Two trees are traversed together and node pairs are pruned
    by the largest overlap that their bitmaps and sizes allow; bitmaps hold a fixed quarter of all shingles. This first runs on
    signatures alone, and what they allow joins classes into groups, so that each class is in one. Then it runs in each group with the
    whole sets, on which leaf pairs are checked. Only components are asked for, so pairs (and node pairs) that are already connected
    need no check, and a task returns fewer links than it has classes.
4.  A cell or group above ``block`` classes is cut into blocks. First each block is joined in itself, together with the same few
    classes (the cell's smallest ids) in all blocks, which ties the blocks' components to each other. Then only
    the classes outside the cell's largest component meet all classes of the cell, block by block; so a group of n
    near copies costs about n rows, and n * r / block where r classes stay outside.
5.  Components of the links come from ``components``; a component's number is its smallest doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, cut, discard, table, together, top_counts
from .components import components
from .kernels import LOWER, U, Words, lean, mix, text_slices, window_hash

BITS = 1 << 14
#: Shingles whose fingerprint has these bits clear are the sample that signatures hold: a quarter of all.
SAMPLE = U(3)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int):
    """(sorted distinct fingerprints of all texts, borders): k-word shingles, or all words of a shorter text."""
    words = Words(LOWER[buf], offs)
    texts = len(offs) - 1
    h, fits = words.windows(k)
    at = np.flatnonzero(fits)
    hashes, owner = h[at], words.text[at]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        own = np.array([_whole(words.hash[words.first[i] : words.first[i + 1]]) for i in short.tolist()], U)
        hashes, owner = np.concatenate([hashes, own]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(texts + 1))


def _whole(h: np.ndarray) -> np.uint64:
    return window_hash(h, len(h))[0] ^ U(len(h))


def class_ids(hashes: np.ndarray, border: np.ndarray, odd: np.ndarray, bits: int = 63) -> tuple[np.ndarray, np.ndarray]:
    """(a positive fingerprint of ``bits`` bits of each set, -1 for empty ones; a second fingerprint). The size goes into them.
    Fingerprints listed in ``odd`` (sorted) stand for several sets and are replaced by one of both."""
    size, both = np.diff(border), []
    for seed in (U(0x2545F4914F6CDD1D), U(0x9FB21C651E98DF25)):
        total = np.zeros(len(hashes) + 1, U)
        np.cumsum(mix(hashes ^ seed), out=total[1:])
        both.append(mix((total[border[1:]] - total[border[:-1]]) ^ mix(size.astype(U) + seed)))
    out, check = both[0] >> U(64 - bits), both[1].view(np.int64)
    if len(odd):
        many = odd[np.minimum(np.searchsorted(odd, out), len(odd) - 1)] == out
        out = np.where(many, mix(both[0] ^ both[1] * U(3)) >> U(1), out)
    return np.where(size > 0, out.astype(np.int64), -1), check


def least_overlap(a, b, percent: int):
    """Smallest intersection that sizes a and b need: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def signatures(hashes: np.ndarray, border: np.ndarray):
    """Per set: (packed bitmap of its sampled shingles, size, shingles outside the sample, sampled ones that share a bit)."""
    n, size = len(border) - 1, np.diff(border)
    owner = np.repeat(np.arange(n), size)
    inside = hashes & SAMPLE == 0
    owner, bit = owner[inside], ((hashes[inside] >> U(20)) % U(BITS)).astype(np.int64)
    sampled, packed, used = np.bincount(owner, minlength=n), np.zeros((n, BITS // 8), np.uint8), np.zeros(n, np.int64)
    first = np.append(0, np.cumsum(sampled))
    for lo in range(0, n, 256):  # unpacked bitmaps are large
        hi = min(lo + 256, n)
        bits = np.zeros((hi - lo, BITS), bool)
        bits[owner[first[lo] : first[hi]] - lo, bit[first[lo] : first[hi]]] = True
        packed[lo:hi], used[lo:hi] = np.packbits(bits, axis=1), bits.sum(1)
    return packed, size, size - sampled, sampled - used


class Tree:
    """Signature tree over classes. A node: OR of the bitmaps below it, least and most size, most shingles outside
    the sample, most sampled shingles that share a bit with another."""

    FANOUT = 8

    def __init__(self, bitmap: np.ndarray, size: np.ndarray, rest: np.ndarray, lost: np.ndarray, sets: list | None = None, exact: np.ndarray | None = None):
        order = np.lexsort((*bitmap[:, :2].T, size))  # neighbours are alike in size, then in their first bits
        self.order, self.sets, self.exact = order, sets and [sets[i] for i in order], None if exact is None else exact[order]
        self.levels = [(np.ascontiguousarray(bitmap[order]).view(U), size[order], size[order], rest[order], lost[order])]
        while len(self.levels[-1][0]) > self.FANOUT:
            b, lo, hi, rest, lost = self.levels[-1]
            at = np.arange(0, len(b), self.FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), *(np.maximum.reduceat(x, at) for x in (hi, rest, lost))))

    def __len__(self) -> int:
        return len(self.order)


def possible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether node pairs (i, j) may hold a linking pair, by size ranges and the largest possible overlap: shared
    bits, collisions, and everything outside the sample."""
    keep = (100 * a[2][i] >= percent * b[1][j]) & (100 * b[2][j] >= percent * a[1][i])
    every = np.flatnonzero(keep)
    for lo in range(0, len(every), 1024):  # gathered bitmaps are large
        at = every[lo : lo + 1024]
        x, y = i[at], j[at]
        shared = np.bitwise_count(a[0][x] & b[0][y]).sum(1)
        most = shared + np.minimum(a[4][x], b[4][y]) + np.minimum(a[3][x], b[3][y])
        keep[at] = np.minimum(most, np.minimum(a[2][x], b[2][y])) >= least_overlap(a[1][x], b[1][y], percent)
    return keep


class Forest:
    """Components of numbered classes: labels that node pairs are pruned by, and the links that made them."""

    def __init__(self, n: int):
        self.label, self.links, self.changes = np.arange(n), [], 0

    def join(self, a: int, b: int) -> None:
        low, high = sorted((self.label[a], self.label[b]))
        self.label[self.label == high] = low
        self.links.append((a, b))
        self.changes += 1

    def of_nodes(self, own: np.ndarray, levels: int) -> list[np.ndarray]:
        """Per level of a tree over the classes ``own``: the label that all leaves below a node share, or -1."""
        out = [self.label[own]]
        for _ in range(levels - 1):
            at = np.arange(0, len(out[-1]), Tree.FANOUT)
            low, high = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
            out.append(np.where(low == high, low, -1))
        return out


def shared_bits(sets: list, most: int = 1 << 16) -> np.ndarray | None:
    """Per set a bitmap of those of its shingles that another set here has too: their overlaps are exact. None if there are more than ``most`` such shingles."""
    values, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    if (n := int(often.sum())) > most:
        return None
    bit, owner, keep = (np.cumsum(often) - 1)[number], np.repeat(np.arange(len(sets)), [len(s) for s in sets]), often[number]
    out = np.zeros((len(sets), max(1, -(-n // 64))), U)
    np.bitwise_or.at(out, (owner[keep], bit[keep] // 64), U(1) << (bit[keep] % 64).astype(U))
    return out


def linking(left: Tree, right: Tree, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sets of leaves i and j link."""
    if left.exact is not None:
        both = np.bitwise_count(left.exact[i] & right.exact[j]).sum(1, dtype=np.int64)
    else:
        pairs = [(left.sets[x], right.sets[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        both = np.array([int((s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t).sum()) for s, t in pairs], np.int64)
    return 100 * both >= percent * (left.levels[0][1][i] + right.levels[0][1][j] - both)


def traverse(left: Tree, right: Tree, mine: np.ndarray, yours: np.ndarray, percent: int, found: Forest) -> None:
    """Dual traversal of two trees (or of one with itself) over the classes ``mine`` and ``yours``: joins linking pairs in ``found``; trees
    without sets join all pairs that signatures allow."""
    fan, same = np.arange(Tree.FANOUT), left is right
    marks = {"at": -1}

    def labels():
        if marks["at"] != found.changes:
            marks.update(at=found.changes, a=found.of_nodes(mine, len(left.levels)), b=found.of_nodes(yours, len(right.levels)))
        return marks["a"], marks["b"]

    def apart(la: int, lb: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = labels()
        return (a[la][i] < 0) | (a[la][i] != b[lb][j])

    def leaves(i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            keep = apart(0, 0, i, j)
            i, j = i[keep], j[keep]
            n = 64 if left.exact is None else 512
            x, y = i[:n], j[:n]
            if left.sets:
                keep = linking(left, right, x, y, percent)
                x, y = x[keep], y[keep]
            for a, b in zip(mine[x].tolist(), yours[y].tolist(), strict=True):
                if found.label[a] != found.label[b]:
                    found.join(a, b)
            i, j = i[n:], j[n:]

    def down(la: int, lb: int, i: np.ndarray, j: np.ndarray) -> None:
        keep = apart(la, lb, i, j)
        if same:
            keep &= (i < j) if la == 0 else (i <= j)
        i, j = i[keep], j[keep]
        keep = possible(left.levels[la], i, right.levels[lb], j, percent)
        i, j = i[keep], j[keep]
        if la == 0 and lb == 0:
            leaves(i, j)
            return
        go_a, go_b = la >= lb, lb >= la  # the higher node is opened, or both
        for lo in range(0, len(i), 512):  # a bounded number of node pairs at a time
            a, b = i[lo : lo + 512], j[lo : lo + 512]
            if go_a:
                a, b = (a[:, None] * Tree.FANOUT + fan).reshape(-1), np.repeat(b, Tree.FANOUT)
                fits = a < len(left.levels[la - 1][0])
                a, b = a[fits], b[fits]
            if go_b:
                a, b = np.repeat(a, Tree.FANOUT), (b[:, None] * Tree.FANOUT + fan).reshape(-1)
                fits = b < len(right.levels[lb - 1][0])
                a, b = a[fits], b[fits]
            down(la - go_a, lb - go_b, a, b)

    i, j = np.meshgrid(np.arange(len(left.levels[-1][0])), np.arange(len(right.levels[-1][0])), indexing="ij")
    down(len(left.levels) - 1, len(right.levels) - 1, i.reshape(-1), j.reshape(-1))


def forest(group: pa.Table, percent: int) -> pa.Table:
    """(u, v) links of one task: its classes with each other, or those of the left side with those of the right. Members
    come with their signatures, or with their whole sets."""
    ids, right = group["class"].to_numpy(), group["right"].to_numpy(zero_copy_only=False)
    order = np.lexsort((ids, right))
    order = order[np.append(True, (ids[order][1:] != ids[order][:-1]) | (right[order][1:] != right[order][:-1]))]
    ids, right = ids[order], right[order]
    if "members" in group.column_names:
        members = group["members"].combine_chunks()
        members = members.chunk(0) if isinstance(members, pa.ChunkedArray) else members
        values, border = members.values.to_numpy(zero_copy_only=False).view(U), members.offsets.to_numpy()
        sets = [np.sort(values[border[i] : border[i + 1]]) for i in order]
        exact = shared_bits(sets)
        parts = signatures(np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets])))
    else:
        sets = exact = None
        bitmap = np.frombuffer(b"".join(group["bitmap"].to_pylist()), np.uint8).reshape(-1, BITS // 8)
        parts = [bitmap[order], *(group[c].to_numpy()[order] for c in ("n", "rest", "lost"))]
    n = int((~right).sum())
    tree = lambda lo, hi: Tree(*(x[lo:hi] for x in parts), sets and sets[lo:hi], None if exact is None else exact[lo:hi])
    names, number = np.unique(ids, return_inverse=True)
    found = Forest(len(names))
    if n == len(ids) and n > 1:
        one = tree(0, n)
        traverse(one, one, number[one.order], number[one.order], percent, found)
    elif 0 < n < len(ids):
        a, b = tree(0, n), tree(n, len(ids))
        traverse(a, b, number[a.order], number[n:][b.order], percent, found)
    ends = np.array(found.links, np.int64).reshape(-1, 2)
    return pa.table({"u": pa.array(names[ends[:, 0]], pa.int64()), "v": pa.array(names[ends[:, 1]], pa.int64())})


TASK = ("cell", "low", "high")


def linked(cells: DataFrame, links_of, block: int, shared: int = 64) -> DataFrame:
    """(u, v) links that connect what links within the cells (cell, class). links_of: tasks (cell, low, high, right, class) -> links.

    Small cells are one task. See 4. above for the others; ``shared`` classes are in all blocks of a cell.
    """
    sizes = cut(cells.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1"))
    large = cells.join(sizes, "cell").withColumn("low", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    one = cells.join(sizes, "cell", "left_anti").select("cell", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(False).alias("right"), "class")
    if sizes.isEmpty():
        return links_of(one)
    first = Window.partitionBy("cell").orderBy("class")
    ties = large.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= shared).withColumn("low", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = large.select("cell", "low", "class").unionByName(ties.select("cell", "low", "class")).distinct()
    own = own.select("cell", "low", F.col("low").alias("high"), F.lit(False).alias("right"), "class")
    near = cut(links_of(one.unionByName(own)))
    named = components(near).select(F.col("node").alias("class"), "component")
    placed = cut(large.join(named, "class", "left").withColumn("component", F.coalesce("component", "class")))
    most = placed.groupBy("cell", "component").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    most = cut(most)
    out = cut(placed.join(most, "cell").where("component <> main").select("cell", "class", "blocks"))
    rest = cut(out.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")))
    left = out.join(rest, "cell").withColumn("low", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).withColumn("high", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = placed.join(rest, "cell").withColumn("high", F.col("low")).withColumn("low", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = left.select(*TASK, F.lit(False).alias("right"), "class").unionByName(right.select(*TASK, F.lit(True).alias("right"), "class"))
    far = links_of(tasks.withColumn("low", -1 - F.col("low")))
    return near.unionByName(far)


def frequent_shingles(docs: DataFrame, k: int, size: int) -> np.ndarray:
    """At most ``size`` shingles that many documents share, sorted. Counted over all documents: each Arrow batch sends on those
    that two or more of its texts have. They only set the order of shingles, so any result keeps the join exact."""

    def run(batches):
        for batch in batches:
            every = [shingle_sets(buf, offs, k)[0] for _, _, buf, offs in text_slices(batch.column(0), 1 << 18)]
            every = np.sort(np.concatenate(every)) if every else np.zeros(0, U)
            new = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, int)
            count = np.diff(np.append(new, len(every)))
            keep = count >= 2
            yield pa.RecordBatch.from_arrays([pa.array(every[new][keep].view(np.int64)), pa.array(count[keep])], ["key", "n"])

    counts = cut(docs.select(F.col("text").cast("string")).mapInArrow(lean(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n >= 8"))
    out = np.sort(top_counts(counts, size).select("key").toPandas()["key"].to_numpy(np.int64).view(U))
    discard(counts)
    return out


def prefix_of(hashes: np.ndarray, border: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, text) of each text's prefix in the order (frequent last, fingerprint)."""
    size = np.diff(border)
    owner = np.repeat(np.arange(len(size)), size)
    late = np.zeros(len(hashes), bool)
    if len(often):
        late = often[np.minimum(np.searchsorted(often, hashes), len(often) - 1)] == hashes
    order = np.lexsort((hashes, late, owner))
    rank = np.arange(len(hashes)) - np.repeat(border[:-1], size)
    length = size - -(-percent * size // 100) + 1
    keep = rank < length[owner]
    return hashes[order][keep], owner[keep]


def _grouped(docs: DataFrame, k: int, percent: int, block: int, frequent: int, bits: int = 63, shared: int = 64) -> tuple[DataFrame, DataFrame]:
    """docs (row, text, doc_id) -> (described: row, doc_id, n_shingles, class; lookup: class, group, for all classes with a text)."""
    spark = docs.sparkSession
    base = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), "row")

    def describe(odd):
        def run(batches):
            for batch in batches:
                for lo, hi, buf, offs in text_slices(batch.column(0)):
                    hashes, border = shingle_sets(buf, offs, k)
                    ids, check = class_ids(hashes, border, odd, bits)
                    yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[1:]), pa.array(np.diff(border)), pa.array(ids), pa.array(check)], ["doc_id", "row", "n_shingles", "class", "check"])

        return run

    odd = np.zeros(0, U)
    while True:
        described = cut(base.mapInArrow(lean(describe(odd)), "doc_id long, row long, n_shingles long, class long, check long"))
        clash = described.where("class >= 0").groupBy("class").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").select("class").toPandas()
        if clash.empty:  # as a rule: of c classes about c * c / 2**64 pairs clash
            break
        odd = np.union1d(odd, clash["class"].to_numpy(np.int64).view(U))
        discard(described)
    often = spark.sparkContext.broadcast((frequent_shingles(base, k, frequent), odd))

    def prefixes(batches):
        late, odd = often.value
        for batch in batches:
            seen = []
            for _, _, buf, offs in text_slices(batch.column(0), 1 << 18):
                hashes, border = shingle_sets(buf, offs, k)
                ids, _ = class_ids(hashes, border, odd, bits)
                key, owner = prefix_of(hashes, border, late, percent)
                seen.append(np.stack([key.view(np.int64), ids[owner]]))
            if seen:
                key, ids = np.concatenate(seen, 1)
                order = np.lexsort((ids, key))
                key, ids = key[order], ids[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(ids[new])], ["key", "class"])

    def signed(batches):
        for batch in batches:
            for _, _, buf, offs in text_slices(batch.column(0)):
                hashes, border = shingle_sets(buf, offs, k)
                bitmap, size, rest, lost = signatures(hashes, border)
                yield pa.RecordBatch.from_arrays([pa.array(class_ids(hashes, border, often.value[1], bits)[0]), pa.array([x.tobytes() for x in bitmap], pa.binary()), pa.array(size), pa.array(rest), pa.array(lost)], ["class", "bitmap", "n", "rest", "lost"])

    def whole(batches):
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch.column(0)):
                hashes, border = shingle_sets(buf, offs, k)
                sets = pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[1:]), sets], [*batch.schema.names[1:], "members"])

    def joined(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*TASK).applyInArrow(lambda g: forest(g, percent), "u long, v long")

    def by_signature(tasks: DataFrame) -> DataFrame:
        return joined(tasks.join(sign, "class"))

    def by_set(tasks: DataFrame) -> DataFrame:
        texts = base.join(tasks.join(holder, "class"), "row").select("text", *TASK, "right", "class")
        return joined(texts.mapInArrow(lean(whole), "cell long, low int, high int, right boolean, class long, members array<long>"))

    prefix = base.mapInArrow(lean(prefixes), "key long, class long")
    lead = prefix.groupBy("key").agg(F.min("class").alias("cell"), F.max("class").alias("last")).where("cell < last").select("key", "cell")
    cells = cut(prefix.join(lead, "key").select("cell", "class").distinct())
    # signatures: pairs that may link, and the groups they form
    sign = cut(base.mapInArrow(lean(signed), "class long, bitmap binary, n long, rest long, lost long").where("class >= 0").dropDuplicates(["class"]).join(cells.select("class").distinct(), "class", "left_semi"))
    near = cut(components(linked(cells, by_signature, block, shared)).select(F.col("component").alias("cell"), F.col("node").alias("class")))
    discard(cells, sign)
    # whole sets: each class is in one such group, and one of its rows stands for it
    holder = cut(described.where("class >= 0").join(near.select("class"), "class", "left_semi").groupBy("class").agg(F.min("row").alias("row")))
    groups = components(linked(near, by_set, block, shared))
    lookup = described.where("class >= 0").select("class").distinct().join(groups.withColumnRenamed("node", "class"), "class", "left").select("class", F.coalesce("component", "class").alias("group"))
    lookup = cut(lookup)
    discard(near, holder)
    often.destroy()
    return described, lookup


def _named(described: DataFrame, lookup: DataFrame, first) -> DataFrame:
    """(class, first): the smallest ``first`` among the rows of the class's group. Classes are aggregated before groups, and both tables are
    written before they are joined, so that Spark can split the join at a hot group."""
    own = cut(described.where("class >= 0").groupBy("class").agg(F.min(first).alias("first")))
    best = cut(own.join(lookup, "class").groupBy("group").agg(F.min("first").alias("first")))
    out = cut(lookup.join(best, "group").select("class", "first"))
    discard(own, best)
    return out


def join(docs: DataFrame, k: int = 5, percent: int = 80, block: int = 2048, frequent: int = 100_000, bits: int = 63, shared: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs.

    Texts whose sets have a Jaccard similarity of at least percent/100 link; component_id is the smallest
    doc_id that links lead to. Null, empty and blank texts have an empty set, link with
    nothing and keep their own id. Repeated rows link with each other (equal sets). A row with a null doc_id links like any other and takes
    the component_id of its group, null if no row there has an id. Other columns are ignored, whatever their names; an empty
    table gives no rows. docs must be read from files, so that rows are numbered alike whenever they are read.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id")).withColumn("row", F.monotonically_increasing_id())
    described, lookup = _grouped(rows, k, percent, block, frequent, bits, shared)
    named = _named(described, lookup, F.col("doc_id"))
    discard(lookup)
    out = described.join(named, "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("class") >= 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, block: int = 2048, frequent: int = 100_000) -> DataFrame:
    """docs with one row of each group of linked texts: the one with the smallest doc_id (rows without an id come last; among equal ids, such as
    different texts that share one, the first row read). Rows without a word link with nothing and stay. All columns stay, whatever their names."""
    text, rest = apart(docs)
    rows = docs.select(text, rest, F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    described, lookup = _grouped(rows.select("text", "doc_id", "row"), k, percent, block, frequent)
    best = _named(described, lookup, F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")).select("first.row").distinct()
    stay = cut(best.unionByName(described.where("class < 0").select("row")))
    discard(described, lookup)
    return together(rows.join(stay, "row", "left_semi").select("text", "rest"), docs)


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), k=4, percent=85)


ORACLE = {
    "op9_ngram_jaccard_join": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') g from (select *, unnest(range(1, greatest(len(ws) - 2, 2))) i from d where len(ws) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id u, b.doc_id v, count(*) i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * i >= 85 * (x.n + y.n - i)),
r as (select u, u v from (select distinct u from e) union select r.u, e.v from r join e on r.v = e.u)
select d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, coalesce(m.v, d.doc_id)) component_id
from d left join n using (doc_id) left join (select u doc_id, min(v) v from r group by u) m using (doc_id)"""
}
QUERIES = {"op9_ngram_jaccard_join": op9_ngram_jaccard_join}
