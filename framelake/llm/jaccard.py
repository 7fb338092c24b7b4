"""Exact Jaccard join of documents on sets of word n-grams, by pivots and Voronoi regions of the metric 1 - J.

Words are runs of characters other than ASCII white space, A-Z lower-cased; a document's set holds its distinct n-word
shingles (64-bit hashes of them), or its whole word sequence as one if it has fewer words. Null, empty and blank texts
have the empty set and link with nothing. Documents with the same set (128-bit digest) are one class; only classes are
compared. Repeated ids are rows of their own; a null id has a part in links and is never the smallest of a component.

How it joins. Almost all pairs of documents share nothing, so from any pivot nearly everything is at distance 1 and
no region would be smaller than the corpus. Pivots therefore get the classes that can be near them: two sets within the
threshold share one of their first (1 - t) n + 1 shingles in any fixed order, so the smallest class that has a shingle
there is the pivot of all other classes that do; the pivot's region holds them all. First, classes that cannot link with
any other leave: of the shingles whose hash is below a bound (RATE of all), those that no other class has are counted, and
a class with more than (1 - t) n of them is within the threshold of none. Among the classes that stay, shingles are ordered
by how many of them have it, the rarest first. So a passage that many documents share makes no region of its own, which
would grow with the corpus, but where it is most of a document.
Regions of at most LOCAL classes and ELEMENTS shingles are joined inside one task, larger ones by rounds of Spark joins.
Both go the same way, until nothing is left:
  - a region picks pivots among classes that aren't connected with most others yet; every class of it gets its exact
    distance to them and links with those within the threshold; pivots, which have been compared with all, leave;
  - a region whose classes are all connected ends;
  - each class joins the part of its nearest pivot (Voronoi), and a class at most `eps` beyond the radius of another
    pivot's part is copied there (triangle inequality: else it cannot link with any class at home there). The parts are
    the next regions, unless the copies outweigh what the division saves: then the region stays whole. A whole region
    too large for a task is compared with twice as many pivots each round, in blocks, so that the rounds stay few.
"""

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm import tokens
from framelake.llm.common import dropped, few, shuffle_partitions, staged
from framelake.llm.components import components

#: Most classes of a region, and shingles of all of them (8 bytes each), that one task joins.
LOCAL, ELEMENTS = 8192, 1 << 21
#: Most classes that are compared directly with one another; pivots of a region in a task, and at most in a round of joins.
DIRECT, PIVOTS, MOST_PIVOTS = 48, 8, 256
#: Copies for each class up to which a division is worth it.
COPIES = 2
#: The share of all shingles that are looked at to tell classes apart, and the bound of their 62-bit hashes.
RATE = 1 / 3
BOUND = int(RATE * (1 << 62))
SLICE = 1 << 18


def _multipliers(n: int) -> list[np.uint64]:
    return [np.uint64(int.from_bytes(hashlib.md5(f"shingle {i}".encode()).digest()[:8], "little") | 1) for i in range(n)]


def sliced(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(start, part) of the texts, about SLICE bytes each (or one longer text)."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > SLICE:
            yield start, texts.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, texts.slice(start)


def shingle_sets(texts: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """The sorted set of each text's shingle hashes."""
    by = _multipliers(n)
    for _, part in sliced(texts):
        words, first = tokens.words(part)
        count = max(0, len(words) - n + 1)
        grams = np.zeros(count, np.uint64)
        for k in range(n):
            grams += words[k : k + count] * by[k]
        grams = tokens.mixed(grams)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= n:
                some = np.sort(grams[a : b - n + 1])
                yield some[np.append(True, some[1:] != some[:-1])]
            elif b > a:  # the length keeps short sequences apart from each other and from shingles
                whole = np.array([b - a], np.uint64)
                for k in range(b - a):
                    whole += words[a + k : a + k + 1] * by[k]
                yield tokens.mixed(whole)
            else:
                yield np.zeros(0, np.uint64)


def class_of(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def classes(docs: DataFrame, n: int, paths: list[str]) -> DataFrame:
    """Staged (doc_id, row_key, n_shingles, digest, grams): row_key is a hash of the text, digest is the class's, null
    without words. A task gives a class's shingles below BOUND once, as 62-bit hashes."""

    def rows(batches):
        seen: set[bytes] = set()
        for batch in batches:
            sizes, keys, firsts = [], [], []
            for grams in shingle_sets(batch.column(2), n):
                key, size = class_of(grams), len(grams)
                first = None
                if size and key not in seen:
                    if len(seen) < 200_000:
                        seen.add(key)
                    place = (grams >> np.uint64(2)).view(np.int64)
                    first = place[: int(np.searchsorted(place, BOUND))]
                sizes.append(size), keys.append(key), firsts.append(first)
            yield pa.record_batch([*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))], ["doc_id", "row_key", "n_shingles", "digest", "grams"])
        pa.default_memory_pool().release_unused()

    kind = dict(docs.dtypes)["doc_id"]
    return staged(docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(rows, f"doc_id {kind}, row_key long, n_shingles long, digest binary, grams array<long>"), paths, pieces=True)


def able(numbered: DataFrame, percent: int, paths: list[str]) -> DataFrame:
    """Staged (c, n) of the classes that may link with another; numbered(c, n, grams) has all."""
    grams = numbered.select("c", F.explode("grams").alias("gram"))
    alone = grams.groupBy("gram").agg(F.min("c").alias("c"), F.count("*").alias("m")).where("m = 1").groupBy("c").agg(F.count("*").alias("own"))
    both = numbered.select("c", "n").join(alone, "c", "left")
    return staged(both.where(100 * F.coalesce("own", F.lit(0)) <= (100 - percent) * F.col("n")).drop("own"), paths)


def rarest(texts: DataFrame, n: int, percent: int, paths: list[str]) -> DataFrame:
    """Staged (c, n, gram): of each class of texts(c, blob) its first (1 - t) n + 1 shingles, the rarest first, as far as
    another class has them. Counted from the end, these are the ones from the (t n)-th on."""

    def rows(batches):
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                sets = [s.view(np.int64) for s in _unpacked(part.column(1).to_pylist(), n)]
                yield pa.record_batch([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["c", "grams"])
        pa.default_memory_pool().release_unused()  # the worker stays, beside those of the next stage

    held: list[str] = []
    sets = texts.mapInArrow(rows, "c long, grams array<long>")
    every = staged(sets.select("c", F.size("grams").cast("long").alias("n"), F.explode("grams").alias("gram")), held, pieces=True)
    several = every.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1")
    nth = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("m"), F.desc("gram")))
    first = every.join(several, "gram").withColumn("nth", nth).where(F.col("nth") >= F.ceil(F.col("n") * percent / 100))
    out = staged(first.select("c", "n", "gram"), paths)
    dropped(texts.sparkSession, held)
    return out


def texts_of(docs: DataFrame, wanted: DataFrame, paths: list[str]) -> DataFrame:
    """Staged (c, blob): a compressed text of each class of wanted(c, doc_id, row_key)."""
    found = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__key"), "text")
    same = F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__key") == F.col("row_key"))

    def packed(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([pack.compress(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())], ["c", "blob"])

    rows = found.join(F.broadcast(wanted) if few(wanted) else wanted, same).select("c", "text")
    return staged(rows.mapInArrow(packed, "c long, blob binary").dropDuplicates(["c"]), paths, pieces=True)


def _unpacked(blobs: list[bytes], n: int) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    return list(shingle_sets(pa.array([unpack.decompress(b).decode() for b in blobs], pa.string()), n))


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))


class Region:
    """One region's classes in a task: links that connect all of them that are within the threshold.

    Shingles that two classes or more have are numbered, so that a class is compared with many by a table look-up."""

    def __init__(self, sets: list[np.ndarray], groups: list[int], percent: int):
        self.order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        self.sizes = np.array([len(sets[i]) for i in self.order])
        every = np.concatenate([sets[i] for i in self.order])
        every.sort()
        several = np.unique(every[1:][every[1:] == every[:-1]])
        del every
        self.sets = [self.numbered(sets[i], several) for i in self.order]
        self.table = np.zeros(len(several), bool)
        self.percent, self.eps = percent, 1 - percent / 100 + 1e-9
        self.parent: dict[int, int] = {}
        self.group = [groups[i] for i in self.order]
        self.links: list[tuple[int, int]] = []

    @staticmethod
    def numbered(grams: np.ndarray, several: np.ndarray) -> np.ndarray:
        if not len(several):
            return np.zeros(0, np.int32)
        at = np.minimum(np.searchsorted(several, grams), len(several) - 1)
        return at[several[at] == grams].astype(np.int32)

    def root(self, i: int) -> int:
        return self.root_of(self.group[i])

    def root_of(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[a] = b
            self.links.append((self.order[i], self.order[j]))

    def flat(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([self.sets[i] for i in members]), np.concatenate([[0], np.cumsum([len(self.sets[i]) for i in members])])

    def measured(self, i: int, members: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distances of class i to members, which it links with where they are within the threshold."""
        self.table[self.sets[i]] = True
        upto = np.zeros(len(flat) + 1, np.int32)
        np.cumsum(self.table[flat], out=upto[1:])
        self.table[self.sets[i]] = False
        both = (upto[starts[1:]] - upto[starts[:-1]]).astype(np.int64)
        union = self.sizes[i] + self.sizes[members] - both
        for j in members[100 * both >= self.percent * union].tolist():
            self.link(i, j)
        return 1 - both / union

    def compare(self, members: np.ndarray) -> None:
        """All members with one another, but for sizes that are too far apart and what is connected: those outside the
        largest connected group with all, the others only with those."""
        flat, starts = self.flat(members)
        sizes = self.sizes[members]
        last = np.searchsorted(self.percent * sizes, 100 * sizes, side="right")
        first = np.searchsorted(100 * sizes, self.percent * sizes, side="left")
        roots = Counter(self.root(i) for i in members.tolist())
        most, n = roots.most_common(1)[0]
        few_left = 2 * n > len(members)
        for k, i in enumerate(members.tolist()):
            if few_left and self.root(i) == self.root_of(most):
                continue
            a, b = (int(first[k]) if few_left else k + 1), int(last[k])
            if a < b and any(self.root(j) != self.root(i) for j in members[a:b].tolist()):
                self.measured(i, members[a:b], flat[starts[a] : starts[b]], starts[a : b + 1] - starts[a])

    def join(self, members: np.ndarray | None = None) -> list[tuple[int, int]]:
        """members (all classes if None; places in order of size) by Voronoi parts."""
        members = np.arange(len(self.sets)) if members is None else members
        if len({self.root(i) for i in members.tolist()}) < 2:
            return self.links
        if len(members) <= DIRECT:
            self.compare(members)
            return self.links
        pivots = np.linspace(0, len(members) - 1, PIVOTS).astype(int)  # over all sizes
        flat, starts = self.flat(members)
        d = np.stack([self.measured(members[k], members, flat, starts) for k in pivots])
        del flat
        free = np.setdiff1d(np.arange(len(members)), pivots)
        d, rest = d[:, free], members[free]
        home = d.argmin(0)
        parts = []
        for k in range(PIVOTS):
            radius = d[k, home == k].max(initial=-1.0)
            parts.append(rest[d[k] <= radius + self.eps] if radius >= 0 else rest[:0])
        if sum(len(p) for p in parts) > COPIES * len(rest):
            self.compare(rest)
            return self.links
        for part in parts:
            self.join(part)
        return self.links


def _joined(sets: list[np.ndarray], groups: list[int], percent: int) -> list[tuple[int, int]]:
    if len(sets) > 2:
        return Region(sets, groups, percent).join()
    both = _shared(*sets) if len(sets) == 2 and groups[0] != groups[1] else 0
    return [(0, 1)] if both and 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both) else []


def links_inside(regions: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links within each region of regions(region, c, root), each region joined by one task, many in turn."""

    def run(rows: pa.Table) -> pa.RecordBatch:
        region = rows["region"].to_numpy()
        ends = [*(np.flatnonzero(np.diff(region)) + 1).tolist(), len(region)]
        sizes = np.cumsum(rows["n"].to_numpy())
        a, b, start = [], [], 0
        while start < len(region):
            stop = next((e for e in ends if e > start and sizes[e - 1] - sizes[start] > ELEMENTS // 4), ends[-1])
            sets = _unpacked(rows["blob"].slice(start, stop - start).to_pylist(), n)
            ids, roots = (rows[name].slice(start, stop - start).to_pylist() for name in ("c", "root"))
            lo = 0
            for hi in (e - start for e in ends if start < e <= stop):
                for i, j in _joined(sets[lo:hi], roots[lo:hi], percent):
                    a.append(ids[lo + i]), b.append(ids[lo + j])
                lo = hi
            start = stop
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def rows(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                region = part.column(0).to_numpy()
                cut = int(np.searchsorted(region, region[-1]))  # the last region may go on
                if cut or held and held[-1].column(0)[-1].as_py() != region[-1]:
                    yield run(pa.Table.from_batches([*held, part.slice(0, cut)] if cut else held))
                    held = []
                held.append(part.slice(cut))
        if held:
            yield run(pa.Table.from_batches(held))

    full = regions.join(texts, "c").select("region", "c", "root", "n", "blob")
    dealt = full.repartition(shuffle_partitions(regions.sparkSession), "region").sortWithinPartitions("region")
    return dealt.mapInArrow(rows, "a long, b long")


def distances(regions: DataFrame, chosen: DataFrame, texts: DataFrame, n: int, percent: int, paths: list[str]) -> DataFrame:
    """Staged (region, c, n, d array<double>, linked array<long>) of the classes of regions(region, c, n, members):
    distances to the region's pivots chosen(region, p) in the order of p, and pivots within the threshold. Pivots are
    compared with one another too: of each two the larger links with the smaller; their d is null.

    A region is dealt over as many tasks as it has times LOCAL classes; each gets the pivots first, then its classes."""
    shares = F.greatest(F.lit(1), F.ceil(F.col("members") / LOCAL)).cast("int")
    rows = regions.select("region", F.pmod(F.xxhash64("c"), shares).cast("int").alias("share"), F.lit(1).alias("role"), "c", "n")
    heads = regions.select("region", shares.alias("shares")).distinct().join(chosen, "region")
    heads = heads.select("region", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("role"), F.col("p").alias("c"), F.lit(0).cast("long").alias("n"))
    both = heads.unionByName(rows).join(texts, "c")
    dealt = both.select("region", "share", "role", "c", "n", "blob").repartition(shuffle_partitions(regions.sparkSession), "region", "share").sortWithinPartitions("region", "share", "role", "c")

    def measured(batches):
        at, pivots, sets, table, universe = None, [], [], None, None
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                keys = list(zip(*(part.column(i).to_pylist() for i in range(5))))
                out = []
                for (region, share, role, c, size), grams in zip(keys, _unpacked(part.column(5).to_pylist(), n)):
                    if (region, share) != at:
                        at, pivots, sets, table = (region, share), [], [], None
                    if role == 0:
                        pivots.append(c), sets.append(grams)
                        continue
                    if table is None:
                        universe = np.unique(np.concatenate(sets))
                        table = np.stack([np.isin(universe, s, assume_unique=True) for s in sets], axis=1)
                        sizes = np.array([len(s) for s in sets])
                    place = np.minimum(np.searchsorted(universe, grams), len(universe) - 1)
                    both = table[place[universe[place] == grams]].sum(0)
                    union = len(grams) + sizes - both
                    near = [p for p, yes in zip(pivots, 100 * both >= percent * union) if yes]
                    if c in pivots:
                        out.append((region, c, size, None, [p for p in near if p < c]))
                    else:
                        out.append((region, c, size, 1 - both / union, near))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()))
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 5, types)], ["region", "c", "n", "d", "linked"])

    return staged(dealt.mapInArrow(measured, "region long, c long, n long, d array<double>, linked array<long>"), paths, pieces=True)


def compared(regions: DataFrame, chosen: DataFrame, texts: DataFrame, n: int, percent: int, paths: list[str]) -> DataFrame:
    """Staged links (a, b) of the classes of regions(region, c, members) with the region's pivots chosen(region, p, n), which
    connect all that are within the threshold.

    Pivots are dealt over blocks of about ELEMENTS / 4 shingles, classes over shares of LOCAL; each task gets a block's pivots
    first, then a share's classes. It counts what they have in common by a sorted list of the pivots' shingles."""
    shares, blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / LOCAL)).cast("int"), F.greatest(F.lit(1), F.ceil(4 * F.sum("n") / ELEMENTS)).cast("int")
    about = regions.select("region", shares.alias("shares")).distinct().join(chosen.groupBy("region").agg(blocks.alias("blocks")), "region")
    heads = chosen.join(about, "region").select(
        "region", F.pmod(F.xxhash64("p"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("role"), F.col("p").alias("c")
    )
    rows = regions.join(about, "region").select(
        "region", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("c"), "shares").cast("int").alias("share"), F.lit(1).alias("role"), "c"
    )
    both = heads.unionByName(rows).join(texts, "c")
    dealt = both.select("region", "block", "share", "role", "c", "blob").repartition(shuffle_partitions(regions.sparkSession), "region", "block", "share").sortWithinPartitions("region", "block", "share", "role", "c")

    def top(parent: list[int], x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def linked(batches):
        at, pivots, sets, every = None, [], [], None
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                keys = list(zip(*(part.column(i).to_pylist() for i in range(5))))
                out = []
                for (region, block, share, role, c), grams in zip(keys, _unpacked(part.column(5).to_pylist(), n)):
                    if (region, block, share) != at:
                        at, pivots, sets, every = (region, block, share), [], [], None
                    if role == 0:
                        pivots.append(c), sets.append(grams)
                        continue
                    if every is None:
                        sizes = np.array([len(s) for s in sets])
                        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                        order = np.argsort(every, kind="stable")
                        every, owner, sets, parent = every[order], owner[order], [], list(range(len(sizes)))
                    first = np.searchsorted(every, grams)
                    many = np.searchsorted(every, grams, side="right") - first
                    places = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                    shared = np.bincount(owner[places], minlength=len(sizes))
                    near = [k for k in np.flatnonzero(100 * shared >= percent * (len(grams) + sizes - shared)).tolist() if pivots[k] != c]
                    for k in near:  # pivots that are connected already need one link
                        x, y = top(parent, k), top(parent, near[0])
                        if k == near[0] or x != y:
                            parent[x] = y
                            out.append((c, pivots[k]))
                yield pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in range(2)], ["a", "b"])

    return staged(dealt.mapInArrow(linked, "a long, b long"), paths, pieces=True)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _with_roots(regions: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return regions.withColumn("root", F.col("c"))
    roots = components(links)
    return regions.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))


def _open(regions: DataFrame) -> DataFrame:
    """Regions (region, c, n, whole, root) whose classes aren't all connected, with their size, whether a task can join them, and the
    root of most of their classes; of equal regions one stays."""
    groups = regions.groupBy("region", "root").agg(
        F.count("*").alias("classes"), F.sum("n").alias("elements"), F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("mark"), F.min("c").alias("least"), F.max("c").alias("most")
    )
    about = groups.groupBy("region").agg(
        F.sum("classes").alias("members"), F.sum("elements").alias("elements"), F.count("*").alias("groups"), F.max_by("root", F.struct("classes", "root")).alias("main"),
        F.sum("mark").alias("mark"), F.min("least").alias("least"), F.max("most").alias("most"),
    )
    one = about.where("groups > 1").groupBy("members", "mark", "least", "most").agg(F.min(F.struct("region", "elements", "main")).alias("r"))
    fits = (F.col("members") <= LOCAL) & (F.col("r.elements") <= ELEMENTS)
    return regions.join(one.select("r.region", "members", "r.main", fits.alias("fits")), "region")


def _round(regions: DataFrame, pivots: int, turn: int, texts: DataFrame, n: int, percent: int, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(next regions (region, c, n, whole), links) after one round over regions (region, c, n, root, members, main). The pivots
    are classes outside the main group, the smallest of each of so many hash buckets."""
    eps = 1 - percent / 100 + 1e-9
    bucket = F.pmod(F.xxhash64("c", F.lit(turn)), F.lit(pivots))
    chosen = staged(regions.where("root <> main").groupBy("region", bucket.alias("bucket")).agg(F.min("c").alias("p")).select("region", "p"), paths)
    measured = distances(regions.select("region", "c", "n", "members"), chosen, texts, n, percent, paths)
    links = measured.select(F.explode("linked").alias("b"), F.col("c").alias("a")).select("a", "b")
    placed = measured.where("d is not null").withColumn("home", F.array_position("d", F.array_min("d")).cast("int"))
    radius = placed.groupBy("region", "home").agg(F.max(F.element_at("d", F.col("home"))).alias("radius"))
    radii = staged(radius.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("home", "radius"))).alias("radii")), paths)  # an entry for each pivot
    near = F.filter(F.sequence(F.lit(1), F.size("d")), lambda k: F.element_at("d", k) <= F.coalesce(F.try_element_at("radii", k), F.lit(-1.0)) + eps)
    spread = placed.join(radii, "region").select("region", "c", "n", near.alias("parts"))
    about = spread.groupBy("region").agg(F.count("*").alias("rows"), F.sum(F.size("parts")).alias("copies"))
    worth = staged(about.select("region", (F.col("copies") <= COPIES * F.col("rows")).alias("divided")), paths)
    both = spread.join(worth, "region").withColumn("part", F.explode(F.when(F.col("divided"), F.col("parts")).otherwise(F.array(F.lit(0)))))
    return both.select(F.xxhash64("region", "part", F.lit(turn)).alias("region"), "c", "n", (~F.col("divided")).alias("whole")), links


def _round_of_whole(regions: DataFrame, pivots: int, turn: int, texts: DataFrame, n: int, percent: int, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """The same for whole regions, which keep their names: pivots are compared with all, and leave."""
    bucket = F.pmod(F.xxhash64("c", F.lit(turn)), F.lit(pivots))
    chosen = staged(regions.where("root <> main").groupBy("region", bucket.alias("bucket")).agg(F.min(F.struct(F.col("c").alias("p"), "n")).alias("one")).select("region", "one.*"), paths)
    links = compared(regions.select("region", "c", "members"), chosen, texts, n, percent, paths)
    left = regions.select("region", "c", "n").join(chosen.select("region", F.col("p").alias("c")), ["region", "c"], "left_anti")
    return left.withColumn("whole", F.lit(True)), links


def links_of(docs: DataFrame, known: DataFrame, n: int, percent: int, rows: list[str], paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """((doc_id, row_key, n_shingles, c), (a, b)): each row's class by number, and links between classes that connect all
    classes within the threshold (not all pairs). `rows` are the paths of known, which goes as soon as it may."""
    spark, early = docs.sparkSession, []
    distinct = known.where("grams is not null").select("digest", F.col("n_shingles").alias("n"), "grams").dropDuplicates(["digest"])
    numbered = staged(distinct.select(F.monotonically_increasing_id().alias("c"), "digest", "n", "grams"), early)
    names = staged(known.drop("grams").join(numbered.select("digest", "c"), "digest", "left").drop("digest"), paths)
    dropped(spark, rows)
    may = able(numbered.drop("digest"), percent, paths)
    dropped(spark, early)
    wanted = staged(names.join(may.select("c"), "c").groupBy("c").agg(F.min(F.struct("doc_id", "row_key")).alias("row")).select("c", "row.*"), paths)
    texts = texts_of(docs, wanted, paths)
    keyed = rarest(texts, n, percent, paths)
    pivots = keyed.groupBy("gram").agg(F.min("c").alias("p"), F.count("*").alias("m")).where("m > 1").select("gram", "p")
    shared = staged(keyed.join(pivots, "gram"), paths)
    # A pivot's region; where that is too large for a task, a region for each of its shingles if these overlap little.
    mine = shared.groupBy("p", "c", "n").agg(F.count("*").alias("grams"))
    about = mine.groupBy("p").agg(F.count("*").alias("members"), F.sum("n").alias("elements"), F.sum("grams").alias("rows"))
    large = staged(about.where(((F.col("members") > LOCAL) | (F.col("elements") > ELEMENTS)) & (F.col("rows") <= 4 * F.col("members"))).select("p"), paths)
    regions = mine.join(large, "p", "left_anti").select(F.col("p").alias("region"), "c", "n")
    apart = shared.join(large, "p", "left_semi").select(F.xxhash64("gram", F.lit(-1)).alias("region"), "c", "n")
    todo = staged(regions.unionByName(apart).withColumn("whole", F.lit(False)), paths)
    links, turn = [], 0
    while True:
        opened = staged(_open(_with_roots(todo, union(links) if links else None)), paths)
        links.append(staged(links_inside(opened.where("fits"), texts, n, percent), paths, pieces=True))
        todo = opened.where(~F.col("fits"))
        if todo.isEmpty():
            return names, union(links)
        nexts = []
        for whole, step, pivots in ((False, _round, min(MOST_PIVOTS, 2 * PIVOTS << turn)), (True, _round_of_whole, 2 * PIVOTS << turn)):
            part = todo.where(F.col("whole") == whole)
            if not part.isEmpty():
                left, new = step(part, pivots, turn, texts, n, percent, paths)
                nexts.append(left), links.append(new)
        todo, turn = staged(union(nexts), paths), turn + 1


def _components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Staged (doc_id, row_key, n_shingles, root): row_key is a hash of the text, root names the component, null without words."""
    rows: list[str] = []
    paths: list[str] = []
    names, links = links_of(docs, classes(docs, n, rows), n, percent, rows, paths)
    roots = components(links).withColumnRenamed("node", "c")
    out = staged(names.join(roots, "c", "left").select("doc_id", "row_key", "n_shingles", F.coalesce("root", "c").alias("root")))
    dropped(docs.sparkSession, paths)
    return out


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text): the smallest id that links reach."""
    rooted = _components(docs, n, percent)
    least = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rooted.join(least, "root", "left").select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs, of each component only the row with the smallest id (null last; of rows with that id, the one whose text
    has the smallest hash); columns as they are. Documents without words stay. Rows with the same id and text are taken
    for one and stay together."""
    rooted = _components(docs, n, percent).where("root is not null").withColumn("rank", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    first = rooted.groupBy("root").agg(F.min("rank").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    others = staged(rooted.join(first, "root").where(F.col("rank") > F.col("first")).select("doc_id", "row_key").distinct())
    others = others.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"))
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__key"))
    return docs.join(F.broadcast(others) if few(others) else others, same, "left_anti")
