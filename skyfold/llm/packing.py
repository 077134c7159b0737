"""Best-fit packing of documents into token sequences by minimum bin slack.

Tokenizing is one Arrow pass. Pieces of equal length are interchangeable, so packing needs only how many pieces each
length has: at most ``capacity`` counts, whatever the corpus. Minimum bin slack runs on those counts and yields
patterns ("so many sequences, each of these lengths"); a pattern is used as often as its lengths last. Pieces then find
their place by their rank among the pieces of their length, which salted windows and prefix sums of counts give
without one task seeing a whole length.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm.common import lean
from skyfold.session import stored

CAPACITY = 1024
END_OF_TEXT = 2
# Where words cannot be encoded one by one: white space other than single blanks and line ends, or a special token.
ODD = re.compile(r"[^\S \n]| {2}| \n|\n |\n\n|<\|endoftext\|>")


def as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Token ids of whole texts.

    The vocabulary splits texts before every blank or line end that starts a word, so ids of a text are those of its
    words in a row; words are encoded once, up to a bound of remembered words, by the same vocabulary as ranks. Texts
    with other white space go whole through the tokenizer that defines the ids, which is loaded when the first comes.
    """

    LIMIT = 200_000

    def __init__(self, tokenizer: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken
        self.tokenizer = tokenizer
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.word = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, bytes] = {}

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.tokenizer)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if ODD.search(text):
            return as_bytes(self.whole.encode(text, add_special_tokens=False).ids)
        first, *rest = text.replace("\n", " \n").split(" ")
        known, parts = self.known, [as_bytes(self.word.encode_ordinary(first))]
        for word in rest:
            got = known.get(word)
            if got is None:
                got = as_bytes(self.word.encode_ordinary(word if word[:1] == "\n" else " " + word))
                if len(known) < self.LIMIT:
                    known[word] = got
            parts.append(got)
        return b"".join(parts)


ENCODERS: dict[tuple[str, str], Encoder] = {}


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; all but the first are full."""
    first = n - (n - 1) // capacity * capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenized(docs: DataFrame, tokenizer: str, ranks: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
              with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (32-bit, little-endian)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def encode(batches):
        if (tokenizer, ranks) not in ENCODERS:
            ENCODERS[tokenizer, ranks] = Encoder(tokenizer, ranks)
        encoder, end = ENCODERS[tokenizer, ranks], np.array([END_OF_TEXT], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                data = encoder.ids(value.as_py() or "") + end
                for k, (s, n) in enumerate(cut_points(len(data) // 4, capacity)):
                    part = data[4 * s:4 * (s + n)]
                    row.append(i), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(lean(encode), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def fullest(counts: dict[int, int], capacity: int) -> list[int]:
    """Lengths of the fullest sequence that holds the largest available length.

    Reachable sums are the bits of one number; a copy of length n joins by a shift of n. The sums before each copy
    lead back from the largest reachable sum to its lengths. Larger lengths are tried first.
    """
    lengths = sorted(counts, reverse=True)
    chosen, room = [lengths[0]], capacity - lengths[0]
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for n in lengths:
        if n > room:
            continue
        for _ in range(min(counts[n] - (n == lengths[0]), room // n)):
            before, reach = reach, (reach | reach << n) & mask
            if reach == before:
                break
            steps.append((n, before))
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    for n, before in reversed(steps):
        if not before >> total & 1:
            chosen.append(n)
            total -= n
    return chosen


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, pieces of each length in each): every sequence is the fullest that is left.

    At most about capacity * ln(capacity) patterns, as each use leaves fewer pieces of some length than it needs.
    """
    left, found = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        chosen: dict[int, int] = {}
        for n in fullest(left, capacity):
            chosen[n] = chosen.get(n, 0) + 1
        times = min(left[n] // k for n, k in chosen.items())
        found.append((times, chosen))
        for n, k in chosen.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return found


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Stored ``pieces`` (any columns, lengths 1 to capacity) with sequence_id and offset."""
    spark = pieces.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(8, 1 + pieces.count() // 100_000)))
    salted = pieces.withColumn("salt", salt)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    rows, used, sequence = [], dict.fromkeys(totals, 0), 0
    for times, chosen in patterns(totals, capacity):
        offset = 0
        for n, k in sorted(chosen.items(), reverse=True):
            rows.append((n, used[n], used[n] + times * k, k, sequence, offset))
            used[n] += times * k
            offset += n * k
        sequence += times
    plan = spark.createDataFrame(rows, "length long, low long, high long, each long, sequence long, base long")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(order).cast("long") - 1).join(starts, ["length", "salt"])
    ranked = ranked.withColumn("nth", F.col("nth") + F.col("before")).drop("before", "salt")
    # The plan's size is bounded by the capacity alone (see patterns), so it may be broadcast.
    found = ranked.join(F.broadcast(plan), ["length"]).filter("nth >= low and nth < high")
    step = F.col("nth") - F.col("low")
    return found.select(*pieces.columns, (F.col("sequence") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
                        (F.col("base") + step % F.col("each") * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, ranks: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` with their sequence and place in it.

    A document is its ids and an end mark; null and empty texts are the mark alone. Only documents longer than
    ``capacity`` are cut. An empty table gives no rows; repeated rows and null ids are documents like any other.
    Columns other than the id and the text do not take part.
    """
    return placed(stored(tokenized(docs, tokenizer, ranks, doc_id, text, capacity, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each whole sequence, from ``pack(..., with_ids=True)``; at most ``capacity`` ids a row."""
    part = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(part.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
