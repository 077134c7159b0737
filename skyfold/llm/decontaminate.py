"""Benchmark decontamination: windows of benchmark words as a broadcast hash set, scanned over every text.

No shuffle: each task looks its own documents up. The windows of a block of items are sorted arrays of hashes and places
in the items' words, about five bytes for each byte of text, made once on the driver and broadcast. A benchmark of more
than ``block_bytes`` of text is split by a hash of its items; each block is then a pass of its own over the documents,
written in between, so a worker holds one block at a time. A hash hit is verified word by word before it counts.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.llm.common import FIRST_BASE, ByteWords, Rolling, lean, run_seed, text_bytes, without
from skyfold.session import stored

# Bytes of words (digits, lower-case letters, everything beyond ASCII); upper-case letters count as
# their lower-case ones, all other bytes separate.
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                      T.StructField("items", T.ArrayType(T.StringType())),
                      T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("clean_text", T.StringType())])


def normal_words(text: str) -> list[bytes]:
    return text.encode().translate(TABLE).split()


class Windows:
    """Windows of one block of items: sorted hashes, and where in the items' words each begins."""

    def __init__(self, items: list[tuple[str | None, str]], size: int, seed: int):
        self.seed = seed
        words, rolling = ByteWords(seed), Rolling(FIRST_BASE)
        texts, counts, self.names, found = [], [], [], {}
        for item, text in items:
            joined = b" ".join(normal_words(text))
            hashes = words.of(joined)
            n = min(size, len(hashes))
            if n:
                found.setdefault(n, []).append((sum(counts[-1:]), rolling.windows(hashes, n)))
                texts.append(joined), self.names.append(item), counts.append(sum(counts[-1:]) + len(hashes))
        self.first = np.array([0, *counts], np.int64)  # number of each item's first word
        self.text = b" ".join(texts)
        breaks = np.flatnonzero(np.frombuffer(self.text, np.uint8) == 32)
        self.starts, self.ends = np.concatenate([[0], breaks + 1]).astype(np.int32), np.concatenate([breaks, [len(self.text)]]).astype(np.int32)
        self.tables = {}
        for n, parts in found.items():
            hashes = np.concatenate([h for _, h in parts])
            places = np.concatenate([np.arange(first, first + len(h), dtype=np.int32) for first, h in parts])
            order = np.argsort(hashes, kind="stable")
            marks = np.zeros(1 << max(10, int(4 * len(hashes)).bit_length()), bool)
            marks[(hashes & np.uint64(len(marks) - 1)).astype(np.int64)] = True
            self.tables[n] = hashes[order], places[order], np.packbits(marks)
        self.seen: dict[tuple[int, int], dict[bytes, set[str]]] = {}

    def items_of(self, n: int, at: int) -> dict[bytes, set[str]]:
        """Windows (their words) of one hash, beginning at entry ``at``, with the items that have them; kept once asked for."""
        if (n, at) not in self.seen:
            hashes, places, _ = self.tables[n]
            out: dict[bytes, set[str]] = {}
            for place in places[at:np.searchsorted(hashes, hashes[at], "right")].tolist():
                name = self.names[np.searchsorted(self.first, place, "right") - 1]
                out.setdefault(self.text[self.starts[place]:self.ends[place + n - 1]], set()).update([] if name is None else [name])
            self.seen[n, at] = out
        return self.seen[n, at]

    def find(self, found: list[bytes], rolling: Rolling) -> tuple[np.ndarray | None, set[str]]:
        """Which words are hit (None: none) and which items occur."""
        digest, seed = xxhash.xxh3_64_intdigest, self.seed
        values = np.fromiter((digest(w, seed) for w in found), np.uint64, len(found))
        hit, items = None, set()
        for n, (hashes, _, marks) in self.tables.items():
            h = rolling.windows(values, n)
            bit = (h & np.uint64(8 * len(marks) - 1)).astype(np.int64)
            near = np.flatnonzero((marks[bit >> 3] >> (7 - (bit & 7))) & 1)
            entry = np.minimum(np.searchsorted(hashes, h[near]), len(hashes) - 1)
            for i, at in zip(near[hashes[entry] == h[near]].tolist(), entry[hashes[entry] == h[near]].tolist()):
                names = self.items_of(n, at).get(b" ".join(found[i:i + n]))
                if names is not None:
                    if hit is None:
                        hit = np.zeros(len(found), bool)
                    hit[i:i + n] = True
                    items |= names
        return hit, items


def spans_of(hit: np.ndarray) -> list[list[int]]:
    """Maximal runs of true values as [start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def cut(text: str, spans: list[list[int]]) -> str:
    """The text without the given runs of words; what stands between two kept words stays."""
    data, at, kept = text.encode(), [m.span() for m in WORD.finditer(text.encode())], []
    last = 0
    for start, end in spans:
        kept.append(data[last:at[start][0]])
        last = at[end - 1][1]
    return b"".join([*kept, data[last:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  size: int = 10, block_bytes: int = 32 << 20, output: str = "decontam") -> DataFrame:
    """``docs`` with a struct ``output``: n_words, n_hit, items, spans of hit words, clean_text.

    A window is ``size`` consecutive words of an item; an item of fewer words is one window. A null or blank text has
    no words, is never hit and stays as it is; items without words have no windows. An item without id hits words but
    is not listed. Repeated items and rows change nothing. ``clean_text`` is the text without hit words. Texts may be long;
    an empty table, or an empty benchmark, is fine. Other columns pass unchanged; an earlier column named ``output`` is replaced.
    """
    docs = without(docs, output)
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("text")).filter("text is not null").distinct()
    blocks, seed = 1 + text_bytes(items) // block_bytes, run_seed()
    schema = T.StructType([*docs.schema.fields, T.StructField(output, FOUND)])
    out = docs
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block) if blocks > 1 else items
        shared = docs.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in part.collect()], size, seed))  # about block_bytes of text
        out = out.mapInArrow(_scan(shared, text, output, block > 0, block == blocks - 1), schema)
        if block < blocks - 1:
            out = stored(out, "decontam")
    return out


def _scan(shared, text: str, output: str, more: bool, last: bool):
    def scan(batches):
        windows, rolling = shared.value, Rolling(FIRST_BASE)
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                          ("spans", pa.list_(pa.list_(pa.int32()))), ("clean_text", pa.string())])
        for batch in batches:
            earlier = batch.column(batch.schema.get_field_index(output)).to_pylist() if more else repeat(None)
            rows = []
            for value, before in zip(batch.column(batch.schema.get_field_index(text)), earlier):
                value = value.as_py()
                found = normal_words(value or "")
                hit, names = windows.find(found, rolling)
                if before and before["n_hit"]:
                    hit = np.zeros(len(found), bool) if hit is None else hit
                    for start, end in before["spans"]:
                        hit[start:end] = True
                    names = names | set(before["items"])
                spans = [] if hit is None else spans_of(hit)
                clean = cut(value, spans) if last and spans else value
                rows.append({"n_words": len(found), "n_hit": 0 if hit is None else int(hit.sum()), "items": sorted(names), "spans": spans,
                             "clean_text": clean})
            kept = [c for i, c in enumerate(batch.columns) if not (more and batch.schema.names[i] == output)]
            names = [n for n in batch.schema.names if not (more and n == output)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, kind)], names=[*names, output])
    return lean(scan)
