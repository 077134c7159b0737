"""Substring dedup: Rabin-Karp hashes of every window of words, counted over the whole corpus.

Documents are dealt into blocks by a hash. A block hashes all its windows and settles repeats inside itself; of each
different window it sends one entry to the bucket of its hash, packed in arrays: the hash and the least document id
that has the window in the block. A bucket finds the least id of each hash over all blocks and answers each block with
one bit per entry: does a smaller document have it? The block hashes its texts again (its rows come from the same
shuffle) and merges the removed windows into maximal intervals of words.

A window that fills a third of the corpus is thus one entry per block. Words are hashed with a seed drawn for the run, so
no text can be made to collide. Windows are told apart by 64 bits, and by the bucket, which is taken from an independent hash: with n different windows and b buckets, n * n / (b * 2^65) are expected to be
taken for another one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import FIRST_BASE, SECOND_BASE, ByteWords, Rolling, run_seed, shuffle_partitions, text_bytes

BLOCK_BYTES = 8 << 20
BLOCKS_PER_TASK = 8
ENTRIES = 2_000_000


class Block:
    """Windows of the documents of one block, in order of (id, text)."""

    def __init__(self, table: pa.Table, size: int, buckets: int, seed: int):
        order = pa.compute.sort_indices(table.select(["id", "text"]), [("id", "ascending"), ("text", "ascending")])
        self.table, self.size = table.take(order), size
        hashes, first, second = ByteWords(seed), Rolling(FIRST_BASE), Rolling(SECOND_BASE)
        ids, known = self.table.column("id"), self.table.column("id").is_valid().to_pylist()
        self.words, windows, places = [], [], []
        for text, ok in zip(self.table.column("text"), known):
            values = hashes.of((text.as_py() or "").encode())
            self.words.append(len(values))
            values = values if ok else values[:0]  # a document without id neither removes nor loses anything
            windows.append(first.windows(values, size))
            places.append(((second.windows(values, size) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32))
        self.counts = np.array([len(w) for w in windows])
        self.ids = ids.fill_null(0).to_numpy()
        self.owner = np.repeat(np.arange(len(windows)), self.counts)
        h, bucket = np.concatenate([*windows, np.empty(0, np.uint64)]), np.concatenate([*places, np.empty(0, np.uint64)])
        _, at, self.inverse = np.unique(h, return_index=True, return_inverse=True)
        self.inverse = self.inverse.reshape(-1)
        # Entries by bucket, then by place; the first occurrence is in the least id.
        self.order = np.lexsort((at, bucket[at]))
        self.at = at[self.order]
        self.hash, self.bucket, self.least = h[self.at], bucket[self.at].astype(np.int64), self.ids[self.owner[at]]

    def entries(self):
        """(bucket, hashes, ids) per bucket that has any."""
        found, starts = np.unique(self.bucket, return_index=True)
        for bucket, lo, hi in zip(found.tolist(), starts, [*starts[1:], len(self.bucket)]):
            yield bucket, self.hash[lo:hi], self.ids[self.owner[self.at[lo:hi]]]

    def removed(self, answers: dict[int, np.ndarray]) -> np.ndarray:
        """Which windows occur in a smaller document, here or (by the answers) elsewhere."""
        elsewhere = np.zeros(len(self.order), bool)
        found, starts = np.unique(self.bucket, return_index=True)
        for bucket, lo, hi in zip(found.tolist(), starts, [*starts[1:], len(self.bucket)]):
            if bucket in answers:
                elsewhere[self.order[lo:hi]] = answers[bucket][:hi - lo]
        return elsewhere[self.inverse] | (self.ids[self.owner] > self.least[self.inverse])


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ids come in rising order: runs as differences and lengths."""
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    runs, lengths = ids[starts], np.diff(np.concatenate([starts, [len(ids)]]))
    steps = np.concatenate([runs[:1], np.diff(runs)]).astype("<i8")
    planes = steps.view(np.uint8).reshape(-1, 8).T.tobytes() + lengths.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(runs).to_bytes(4, "little") + zstandard.compress(planes, 1)


def _unpack_ids(data: bytes) -> np.ndarray:
    n, planes = int.from_bytes(data[:4], "little"), np.frombuffer(zstandard.decompress(data[4:]), np.uint8)
    steps = np.ascontiguousarray(planes[:8 * n].reshape(8, n).T).view("<i8").reshape(-1)
    lengths = np.ascontiguousarray(planes[8 * n:].reshape(4, n).T).view("<u4").reshape(-1)
    return np.repeat(np.cumsum(steps), lengths)


def _bucket(table: pa.Table) -> pa.Table:
    """Answers of one bucket to its blocks."""
    hashes = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
    ids = np.concatenate([_unpack_ids(x.as_py()) for x in table.column("ids")])
    sizes = [len(h) for h in hashes]
    _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    least = np.full(int(inverse.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, inverse.reshape(-1), ids)
    bits = np.split(ids > least[inverse.reshape(-1)], np.cumsum(sizes)[:-1])
    rows = [(block, zstandard.compress(np.packbits(b).tobytes(), 1)) for block, b in zip(table.column("block").to_pylist(), bits) if b.any()]
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([table.column("bucket")[0].as_py()] * len(rows), pa.int64()),
                     "bits": pa.array([r[1] for r in rows], pa.binary())})


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept_text): words covered by windows that a smaller document also has.

    ``removed`` are maximal intervals [start, end) of word numbers; ``kept_text`` is the rest, joined by single blanks.
    Null and blank texts have no words, texts of fewer than ``size`` words no window. Documents with equal ids remove
    nothing from each other; rows without id are returned unchanged in words. The id is an integer. Other columns do
    not take part. An empty table gives no rows.
    """
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    size_of_text, least = text_bytes(docs.select(F.col(f"`{text}`").alias("text"))), shuffle_partitions(spark)
    blocks, buckets = max(least, 1 + size_of_text // BLOCK_BYTES), max(least, 1 + size_of_text // 6 // ENTRIES)
    source = docs.select(F.pmod(F.xxhash64(f"`{doc_id}`", f"`{text}`"), F.lit(blocks)).alias("block"), F.col(f"`{doc_id}`").cast("long").alias("id"),
                         F.col(f"`{text}`").alias("text")).repartition(max(least, blocks // BLOCKS_PER_TASK), "block")

    seed = run_seed()

    def send(table: pa.Table) -> pa.Table:
        rows = [(b, h.tobytes(), _pack_ids(i)) for b, h, i in Block(table, size, buckets, seed).entries()]
        return pa.table({"block": pa.array([table.column("block")[0].as_py()] * len(rows), pa.int64()), "bucket": pa.array([r[0] for r in rows], pa.int64()),
                         "hashes": pa.array([r[1] for r in rows], pa.binary()), "ids": pa.array([r[2] for r in rows], pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = {b: np.unpackbits(np.frombuffer(zstandard.decompress(x.as_py()), np.uint8)).astype(bool)
                   for b, x in zip(right.column("bucket").to_pylist(), right.column("bits"))}
        block = Block(left, size, buckets, seed)
        gone, start = block.removed(answers), 0
        removed, n_removed, kept = [], [], []
        for n, count, value in zip(block.words, block.counts, block.table.column("text")):
            hit, start = np.flatnonzero(gone[start:start + count]), start + count
            if not len(hit):
                removed.append([]), n_removed.append(0), kept.append(b" ".join((value.as_py() or "").encode().split()).decode())
                continue
            edges = np.zeros(n + 1, np.int64)
            np.add.at(edges, hit, 1)
            np.add.at(edges, hit + size, -1)
            inside = np.cumsum(edges[:n]) > 0
            turn = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))).reshape(-1, 2)
            found = value.as_py().encode().split()
            removed.append(turn.tolist()), n_removed.append(int(inside.sum()))
            kept.append(b" ".join(w for w, x in zip(found, inside) if not x).decode())
        return pa.table({"doc_id": block.table.column("id"), "n_words": pa.array(block.words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                         "removed": pa.array(removed, pa.list_(pa.list_(pa.int32()))), "kept_text": pa.array(kept, pa.string())})

    sent = source.groupBy("block").applyInArrow(send, "block long, bucket long, hashes binary, ids binary")
    if buckets > least:  # more buckets than the session's shuffles have tasks
        sent = sent.repartition(buckets, "bucket")
    answers = sent.groupBy("bucket").applyInArrow(_bucket, "block long, bucket long, bits binary")
    out = source.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        finish, "doc_id long, n_words long, n_removed long, removed array<array<int>>, kept_text string")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
