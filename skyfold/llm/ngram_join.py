"""Set-similarity join on word shingles with count vectors in an R-tree, and its connected components.

1. One pass counts all shingles of the corpus in a sketch of fixed size. It only orders shingles (common ones last).
2. A second pass turns each text into its set: size, digest, counts of shingles in ``GROUPS`` hash groups (the point of
   the index) and its prefix, the first n - ceil(t * n) + 1 shingles in that order. Texts that are similar enough share
   a prefix shingle, so the prefix divides the join; copies and common shingles are already met within each batch.
3. Each text is compared with one leader per prefix shingle. Most links of large groups of near copies follow from
   these comparisons, as many as there are texts and not their square.
   Where many texts of a shingle stay apart, each is compared with a few more leaders.
4. Prefix shingles whose texts are still apart are joined in R-trees (of shingles with the same texts, one is): a node
   keeps the largest count of each group and the range of sizes below it, and the summed minima of its counts and a
   text's bound the overlap with anything below. A pair is passed on from the least shingle that both texts have there.
5. Every pair that the bound leaves is verified on the whole sets before it links.

Pairs inside a component that other links have already joined need no check of their own; components do not change.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm.common import FIRST_BASE, ByteWords, Rolling, lean, mixed, run_seed, shuffle_partitions
from skyfold.llm.components import components
from skyfold.session import stored

GROUPS = 256
SKETCH_BITS = 22
FILTER_BITS = 24
SLICES = 64
BLOCK = 1000
LEADERS = 4
LEADER_KEYS = 3
CARRIED = 32
CHANCE = 25
ROWS_PER_TASK = 20_000


class Shingles:
    """Sorted distinct shingle hashes of a text; a text of fewer words is one shingle."""

    def __init__(self, size: int, seed: int):
        self.size, self.words, self.rolling = size, ByteWords(seed), Rolling(FIRST_BASE)

    def of(self, text: str | None) -> np.ndarray:
        values = self.words.of((text or "").encode().lower())  # of bytes: only A-Z change
        if not len(values):
            return values
        n = min(self.size, len(values))
        return np.unique(self.rolling.windows(values, n) ^ mixed(np.full(1, n, np.uint64)))


def exact_shingles(text: str, size: int) -> set:
    """The shingles of a text themselves."""
    found = text.encode().lower().split()
    n = min(size, len(found))
    return set(zip(*(found[i:len(found) - n + 1 + i] for i in range(n))))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _cells(rows: DataFrame, hashes: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], bits: int, kind=np.int64) -> np.ndarray:
    """How many of the 64-bit hashes of all rows fall in each of 2^bits cells, or for bytes as ``kind`` whether any does.

    The size does not depend on the rows.
    """
    cells, width, marks = 1 << bits, (1 << bits) // SLICES, kind == np.uint8

    def count(batches):
        of, counts = hashes(), np.zeros(cells, kind)
        for batch in batches:
            at = (of(batch) & np.uint64(cells - 1)).astype(np.int64)
            if marks:
                counts[at] = 1
            else:
                counts += np.bincount(at, minlength=cells)
        pack = zstandard.ZstdCompressor(1)
        parts = [pack.compress(counts[i * width:(i + 1) * width].tobytes()) for i in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, kind)
        for x in table.column("counts"):
            part = np.frombuffer(zstandard.decompress(x.as_py()), kind)
            total = total | part if marks else total + part
        return pa.table({"slice": table.column("slice")[:1].cast(pa.int32()), "counts": pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())})

    found = rows.mapInArrow(lean(count), "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()
    out = np.zeros(cells, kind)
    for r in found:
        out[r["slice"] * width:(r["slice"] + 1) * width] = np.frombuffer(zstandard.decompress(r["counts"]), kind)
    return out


def _sketch(docs: DataFrame, size: int, seed: int) -> np.ndarray:
    def hashes():
        shingles = Shingles(size, seed)
        return lambda batch: np.concatenate([np.empty(0, np.uint64), *(shingles.of(x.as_py()) for x in batch.column(0))])
    return _cells(docs.select("text"), hashes, SKETCH_BITS)


def _among(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id some pair may name: a filter of fixed size that loses none and keeps few others."""
    named = pairs.select(F.explode(F.array("u", "v")).alias("id")).select(F.xxhash64("id").alias("h"))
    marks = _cells(named, lambda: lambda batch: batch.column(0).to_numpy().view(np.uint64), FILTER_BITS, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def keep(batches):
        marked = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            at = (batch.column(2).to_numpy().view(np.uint64) & np.uint64(len(marked) - 1)).astype(np.int64)
            yield batch.select([0, 1]).filter(pa.array(marked[at]))

    return docs.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(lean(keep), docs.select("id", "text").schema)


def point(shingles: np.ndarray) -> tuple[bytes, int]:
    """Counts by group as bytes, and the number they are multiplied by (rounded up, so that bounds hold)."""
    counts = np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=GROUPS)
    scale = 1
    while counts.max() > 255 * scale:
        scale *= 2
    return (-(-counts // scale)).astype(np.uint8).tobytes(), scale


def points_of(counts: pa.Array, scale: pa.Array) -> np.ndarray:
    packed = np.frombuffer(b"".join(counts.to_pylist()), np.uint8).reshape(-1, GROUPS)
    return packed * scale.to_numpy(zero_copy_only=False).astype(np.int32)[:, None]


SETS = "id {0}, n long, d1 long, d2 long, counts binary, scale int, keys array<long>, links array<struct<key:long,leader:{0}>>"


def _sets(docs: DataFrame, kind: str, sketch: np.ndarray, size: int, percent: int, seed: int) -> DataFrame:
    """One row per text; a shingle that several texts of a batch have in their prefix is a link to the first of them."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(sketch, np.iinfo(np.uint32).max).astype(np.uint32))
    common = 2 * int(sketch.mean()) + 8

    def make(batches):
        counts_of, shingles = shared.value, Shingles(size, seed)
        for batch in batches:
            ids = batch.column(0)
            n, d1, d2, points, scales, keys, sizes = [], [], [], [], [], [], []
            seen = set()
            valid = ids.is_valid().to_pylist()
            for i, value in enumerate(batch.column(1)):
                s = shingles.of(value.as_py())
                n.append(len(s))
                digest = xxhash.xxh3_128_digest(s.tobytes())
                a, b = np.frombuffer(digest, "<i8").tolist()
                d1.append(a), d2.append(b)
                packed, scale = point(s)
                points.append(packed), scales.append(scale)
                if not valid[i] or not len(s) or digest in seen:  # a copy within the batch has a leader: its equal
                    keys.append(s[:0]), sizes.append(0)
                    continue
                seen.add(digest)
                weight = counts_of[(s & np.uint64(len(counts_of) - 1)).astype(np.int64)]
                order = np.argsort(np.where(weight > common, weight, 0), kind="stable")
                prefix = s[order[:prefix_length(len(s), percent)]]
                keys.append(prefix), sizes.append(len(prefix))
            if not n:
                continue
            flat, owner = np.concatenate(keys), np.repeat(np.arange(len(n)), sizes)
            _, first, inverse = np.unique(flat, return_index=True, return_inverse=True)
            leader = owner[first][inverse.reshape(-1)]
            own = leader == owner
            offsets = lambda mask: pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[mask], minlength=len(n)))]), pa.int32())
            key = flat.view(np.int64)
            links = pa.StructArray.from_arrays([pa.array(key[~own]), ids.take(pa.array(leader[~own]))], names=["key", "leader"])
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                pa.array(points, pa.binary()), pa.array(scales, pa.int32()),
                pa.ListArray.from_arrays(offsets(own), pa.array(key[own])), pa.ListArray.from_arrays(offsets(~own), links)],
                names=["id", "n", "d1", "d2", "counts", "scale", "keys", "links"])

    return docs.mapInArrow(lean(make), SETS.format(kind))


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int, seed: int) -> DataFrame:
    """Of pairs (u, v), those whose sets are similar enough: by hashes first, and those that pass by their words."""
    named = _among(docs, pairs)
    left = named.select(F.col("id").alias("u"), F.col("text").alias("text_u"))
    right = named.select(F.col("id").alias("v"), F.col("text").alias("text_v"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "text_u", "text_v")

    def check(batches):
        shingles, last, kept = Shingles(size, seed), None, None

        def enough(both: int, a: int, b: int) -> bool:
            return 100 * both >= percent * (a + b - both)

        def by_words(a: str, b: str) -> bool:
            x, y = exact_shingles(a, size), exact_shingles(b, size)
            return enough(len(x & y), len(x), len(y))

        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = a.as_py(), b.as_py()
                if b != last:
                    last, kept = b, shingles.of(b)
                x = shingles.of(a)
                good.append(enough(len(np.intersect1d(x, kept, assume_unique=True)), len(x), len(kept)) and by_words(a, b))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(lean(check), pairs.select("u", "v").schema)


class Tree:
    """R-tree over count vectors, packed by halving at the median of the widest coordinate."""

    LEAF = 32

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.root = self._node(np.arange(len(points)))

    def _node(self, rows: np.ndarray):
        box = (self.points[rows].max(0), self.sizes[rows].min(), self.sizes[rows].max())
        if len(rows) <= self.LEAF:
            return box, rows, None
        values = np.column_stack([self.sizes[rows], self.points[rows]])
        axis = int(np.argmax(values.max(0) - values.min(0)))
        order = np.argsort(values[:, axis], kind="stable")
        half = len(rows) // 2
        return box, None, (self._node(rows[order[:half]]), self._node(rows[order[half:]]))

    def candidates(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        """(query, row) index arrays of all pairs whose bounds allow the similarity."""
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            (box, rows, children), asked = stack.pop()
            most, low, high = box
            # overlap o suffices for sizes a, b if 100 o >= percent (a + b - o); b is at least ``low`` here
            fits = (100 * high >= percent * sizes[asked]) & (100 * sizes[asked] >= percent * low)
            fits &= (100 + percent) * np.minimum(points[asked], most).sum(1) >= percent * (sizes[asked] + low)
            asked = asked[fits]
            if not len(asked):
                continue
            if children:
                stack += [(c, asked) for c in children]
                continue
            bound = np.minimum(points[asked][:, None, :], self.points[rows][None, :, :]).sum(2)
            q, r = np.nonzero((100 + percent) * bound >= percent * (sizes[asked][:, None] + self.sizes[rows][None, :]))
            yield asked[q], rows[r]


NO_KEY = np.iinfo(np.int64).max


def padded(lists: pa.Array) -> np.ndarray:
    """One row of ``CARRIED`` keys for each list, filled up with ``NO_KEY``."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(lists), CARRIED), NO_KEY)
    out[np.arange(CARRIED) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def share_lesser(a: np.ndarray, b: np.ndarray, key: int) -> np.ndarray:
    """Of each pair of rows: do they share a key below ``key``?"""
    return ((a[:, :, None] == b[:, None, :]) & (a < key)[:, :, None]).any((1, 2))


def _tree_pairs(members: DataFrame, points: DataFrame, kind: str, percent: int) -> DataFrame:
    """Pairs of different labels that share a key and pass the bounds of the R-tree.

    ``members``: (key, id, label). A key of more than ``BLOCK`` texts is
    dealt into blocks, and each pair of blocks is joined on its own; many small keys share a task.
    Each text brings its ``CARRIED`` least keys, and a pair that shares a lesser one of them than the key at hand is
    left to that. The least key two texts share is never left out, so none is lost; beyond those carried, a pair may come twice.
    """
    least = members.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("key")), 1, CARRIED).alias("least"))
    points = points.select("id", "n", "counts", "scale").join(least, "id")
    keys = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(keys, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    tasks = max(shuffle_partitions(members.sparkSession), members.count() // ROWS_PER_TASK)
    dealt = (dealt.select("key", "id", "label", "block", "lo", "hi").join(points, "id")
             .withColumn("task", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(tasks))))

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("lo", "ascending"), ("hi", "ascending")]).combine_chunks()
        column = lambda name: table.column(name).combine_chunks()
        ids, sizes, block = column("id"), column("n").to_numpy(), column("block").to_numpy()
        points, labels = points_of(column("counts"), column("scale")), column("label").to_numpy(zero_copy_only=False)
        key, lo, hi = column("key").to_numpy(), column("lo").to_numpy(), column("hi").to_numpy()
        carried = padded(column("least"))
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
        us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for start, end in zip(starts, [*starts[1:], len(key)]):
            rows = np.arange(start, end)
            mine, theirs = rows[block[rows] == lo[start]], rows[block[rows] == hi[start]]
            if not len(mine) or not len(theirs):
                continue
            for q, r in Tree(points[mine], sizes[mine]).candidates(points[theirs], sizes[theirs], percent):
                a, b = theirs[q], mine[r]
                keep = (labels[a] != labels[b]) & ((a < b) | (lo[start] != hi[start]))
                a, b = a[keep], b[keep]
                here = ~share_lesser(carried[a], carried[b], key[start])
                us.append(a[here]), vs.append(b[here])
        return pa.table({"u": ids.take(pa.array(np.concatenate(us))), "v": ids.take(pa.array(np.concatenate(vs)))})

    found = dealt.groupBy("task").applyInArrow(join, f"u {kind}, v {kind}")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def join_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: components of the links between similar texts.

    The graph's nodes are ids; rows that share an id share its component, which is the least id it reaches. Null and
    blank texts have an empty set, link with nothing and are components of their own; so are rows with a null id, whose
    component is null. Copies link like any similar texts. Other columns do not take part. An empty table gives no rows.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    seed = run_seed()
    sets = stored(_sets(source, kind, _sketch(source, size, seed), size, percent, seed), "sets")
    points = sets.filter("n > 0 and id is not null").select("id", "n", "d1", "d2", "counts", "scale")

    # Copies: every text to the least id with its digest.
    classes = points.groupBy("d1", "d2").agg(F.min("id").alias("v"), F.count("*").alias("copies")).filter("copies > 1")
    same = points.join(classes.drop("copies"), ["d1", "d2"]).filter("id <> v").select(F.col("id").alias("u"), "v")

    # Leaders: a key has at most one row per batch by now. Texts that share only one of many prefix shingles with a
    # leader are left to the trees; most meet there by chance.
    by_key = Window.partitionBy("key")
    keyed = sets.select("id", F.col("n").cast("int").alias("n"), F.explode("keys").alias("key"))
    keyed = keyed.select("key", "id", "n", F.min("id").over(by_key).alias("leader"), F.max("id").over(by_key).alias("last"))
    across = keyed.filter("leader < last").select("key", "id", "n", "leader")
    within = sets.select("id", F.col("n").cast("int").alias("n"), F.explode("links").alias("x")).select("x.key", "id", "n", "x.leader")
    links = stored(across.union(within), "links")
    shared = links.filter("id <> leader").groupBy(F.col("id").alias("u"), F.col("leader").alias("v")).agg(F.count("*").alias("keys"), F.first("n").alias("n"))
    pairs = _bounded(shared.filter((F.col("keys") > 1) | (F.col("n") <= CHANCE)).select("u", "v"), points, percent)
    edges = stored(same.union(_verified(pairs, source, size, percent, seed)), "links")
    found = components(edges)

    # Keys whose texts are still apart: large ones try more leaders, then all that is left goes through the trees.
    every = stored(_different(links), "members")
    members = stored(_apart(every, found), "members")
    again = _bounded(_more_leaders(members).join(pairs, ["u", "v"], "left_anti"), points, percent)
    found = _joined(found, stored(_verified(again, source, size, percent, seed), "links"))
    members = stored(_apart(members.select("key", "id"), found), "members")
    rest = _tree_pairs(members, points, kind, percent).join(pairs.union(again), ["u", "v"], "left_anti")
    found = _joined(found, stored(_verified(stored(rest, "pairs"), source, size, percent, seed), "links"))
    return sets.join(found, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _different(links: DataFrame) -> DataFrame:
    """(key, id): the texts of each key; of keys with the same texts one stays."""
    every = links.select("key", "id").union(links.select("key", F.col("leader").alias("id")))
    every = every.repartition(shuffle_partitions(links.sparkSession), "key").dropDuplicates(["key", "id"])
    marks = F.bit_xor(F.xxhash64("id")).alias("s1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("s2")
    chosen = every.groupBy("key").agg(F.count("*").alias("texts"), *marks).groupBy("texts", "s1", "s2").agg(F.min("key").alias("key"))
    return every.join(chosen.select("key"), "key", "left_semi")


def _apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id, label): members (key, id) of the keys whose texts are in several components, with those."""
    of = found.select(F.col("node").alias("id"), F.col("component").alias("label"))
    named = members.join(of, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    several = named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("key")
    return named.join(several, "key", "left_semi")


def _more_leaders(members: DataFrame) -> DataFrame:
    """Pairs (u, v) of texts with ``LEADERS`` texts in other components, from their ``LEADER_KEYS`` least large keys.

    They only spare the trees work: what they don't join, those meet in any case.
    """
    picks = [F.min(F.struct(F.xxhash64("id", F.lit(j)).alias("h"), F.col("id").alias("leader"), F.col("label").alias("other"))) for j in range(LEADERS)]
    chosen = members.groupBy("key").agg(F.count("*").alias("texts"), F.array(*picks).alias("picks")).filter(F.col("texts") > 2 * LEADERS)
    few = F.flatten(F.slice(F.sort_array(F.collect_list(F.struct("key", "picks"))), 1, LEADER_KEYS)["picks"])
    tried = members.join(chosen.select("key", "picks"), "key").groupBy("id", "label").agg(F.array_distinct(few).alias("picks"))
    other = F.filter("picks", lambda p: p["other"] != F.col("label"))
    pairs = tried.select("id", F.explode(other).alias("p"))
    return pairs.select(F.greatest("id", "p.leader").alias("u"), F.least("id", "p.leader").alias("v")).distinct()


def _joined(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (node, component) after more edges."""
    if edges.isEmpty():
        return found
    return components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(edges))


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs of different sets that the sizes and the summed minima allow."""
    side = lambda name, at: points.select(F.col("id").alias(at), *[F.col(c).alias(c + name) for c in ("n", "counts", "scale", "d1", "d2")])
    both = pairs.join(side("_u", "u"), "u").join(side("_v", "v"), "v").filter("d1_u <> d1_v or d2_u <> d2_v")
    both = both.filter(f"100 * least(n_u, n_v) >= {percent} * greatest(n_u, n_v)").select("u", "v", "n_u", "n_v", "counts_u", "counts_v", "scale_u", "scale_v")

    def check(batches):
        for batch in batches:
            n_u, n_v = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            bound = np.minimum(points_of(batch.column(4), batch.column(6)), points_of(batch.column(5), batch.column(7))).sum(1)
            yield batch.select([0, 1]).filter(pa.array((100 + percent) * bound >= percent * (n_u + n_v)))

    kept = both.mapInArrow(lean(check), pairs.select("u", "v").schema)
    return stored(kept.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "pairs")
