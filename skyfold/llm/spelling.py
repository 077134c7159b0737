"""Groups of spelling variants: vocabulary words one edit apart, found by composing finite-state machines.

The vocabulary's minimised acceptor A is composed with a transducer E of one edit and with A again. E copies symbols,
edits once (replaces or inserts one; deleting is inserting seen from the other word) and copies to the end. Before the
edit both copies of A are in the same state; after it the rest must be in the right languages of two states, whose
intersection is computed once for each pair of states. An inserted symbol must differ from the one that follows in the other word, so
that each pair has one path.

Initial states part the work. Words of at least m symbols one edit apart share their first m // 2 symbols, or the edit is
among those and they share their last m - m // 2. A partition is thus the state of the composition behind a prefix, or
before a suffix with a bound on where the edit may be, and each pair belongs to exactly one. Partitions of more than
``LIMIT`` words are parted again by the same rule on what is left of their words, by lengths of both words; that ends
at words of two symbols, so no partition is larger than ``LIMIT`` or the square of the alphabet, whatever words share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import shuffle_partitions
from skyfold.session import stored

# Which symbols make words, which are lower-cased, and which occurrences lose a symbol.
LETTERS, UPPER, LOWER, MISPRINT = "A-Za-zÀ-ÿ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", 199
LIMIT = 20_000
ROWS_PER_TASK = 50_000


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): lower-cased runs of letters with the misprints of the rule, of enough symbols and occurrences."""
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))  # shorter runs cannot count
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    misprint = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = rows.select(F.when(F.col("h") % MISPRINT == 0, misprint).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


class State:
    """A state of the acceptor: symbols to states, and how many words end at or behind it."""

    __slots__ = ("final", "arcs", "count", "edits")

    def __init__(self):
        self.final, self.arcs, self.count, self.edits = 0, {}, 0, None

    def steps(self) -> Iterator[tuple[str, State, int]]:
        """(symbol, state, words before those behind it) of each arc."""
        before = self.final
        for symbol, state in self.arcs.items():
            yield symbol, state, before
            before += state.count


def acceptor(words: list[str]) -> State:
    """Minimised acceptor of sorted different words; equal right languages are one state."""
    register: dict = {}
    path, last = [State()], ""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            state = path.pop()
            key = (state.final, *((c, id(s)) for c, s in state.arcs.items()))
            state.count = state.final + sum(s.count for s in state.arcs.values())
            path[-1].arcs[last[len(path) - 1]] = register.setdefault(key, state)

    for word in words:
        shared = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        close(shared)
        for symbol in word[shared:]:
            state = State()
            path[-1].arcs[symbol] = state
            path.append(state)
        path[-1].final, last = 1, word
    close(0)
    path[0].count = path[0].final + sum(s.count for s in path[0].arcs.values())
    return path[0]


class Composition:
    """The acceptor, one edit, and the acceptor again, over the words of one partition."""

    def __init__(self, words: list[str]):
        self.root, self.shared = acceptor(words), {}

    def common(self, p: State, q: State, but: str = "") -> list[tuple[int, int]]:
        """Numbers, behind each of two states, of the rests both accept; those that begin with ``but`` are left out."""
        before = {c: (s, k) for c, s, k in q.steps()}
        pairs = [(0, 0)] if p.final and q.final else []
        for symbol, state, k in p.steps():
            if symbol != but and symbol in before:
                other, m = before[symbol]
                pairs += [(k + x, m + y) for x, y in self.rests(state, other)]
        return pairs

    def rests(self, p: State, q: State) -> list[tuple[int, int]]:
        """``common`` kept for each pair of states, without recursion."""
        todo = [(p, q)]
        while todo:
            a, b = todo[-1]
            if (a, b) in self.shared:
                todo.pop()
                continue
            if a is b:
                self.shared[a, b] = [(i, i) for i in range(a.count)]
                continue
            open_pairs = [(s, b.arcs[c]) for c, s in a.arcs.items() if c in b.arcs and (s, b.arcs[c]) not in self.shared]
            if open_pairs:
                todo += open_pairs
            else:
                self.shared[a, b] = self.common(a, b)
        return self.shared[p, q]

    def edits(self, state: State) -> list[tuple[int, int]]:
        """Pairs of words behind a state that part there: one symbol replaced, or one inserted."""
        if state.edits is None:
            found, steps = [], list(state.steps())
            for i, (symbol, p, k) in enumerate(steps):
                for _, q, m in steps[i + 1:]:
                    found += [(k + x, m + y) for x, y in self.rests(p, q)]
                found += [(x, k + y) for x, y in self.common(state, p, but=symbol)]
            state.edits = found
        return state.edits

    def pairs(self, limit: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pairs of words one edit apart, the edit before place ``limit``."""
        out, todo = [], [(self.root, 0, 0)]
        while todo:
            state, first, depth = todo.pop()
            out += [(first + x, first + y) for x, y in self.edits(state)]
            if limit is None or depth + 1 < limit:
                todo += [(s, first + k, depth + 1) for _, s, k in state.steps() if s.count > 1]
        both = np.array(out, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def _parts(words: DataFrame, least_length: int) -> DataFrame:
    """(key, rest, lo, before, shorter, word, n): each word in the partitions of its first and of its last symbols."""
    half = least_length // 2
    tail = least_length - half
    size = F.length("word")

    def part(side: str, key: Column, rest: Column, lo: int, before: int | None) -> Column:
        return F.struct(F.concat(F.lit(side), key).alias("key"), rest.alias("rest"), F.lit(lo).alias("lo"), F.lit(before).cast("int").alias("before"),
                        F.lit(None).cast("int").alias("shorter"))

    both = F.array(part("P", F.left("word", F.lit(half)), F.substr("word", F.lit(half + 1)), tail, None),
                   part("S", F.right("word", F.lit(tail)), F.left("word", size - tail), half, half))
    return words.select(F.explode(both).alias("p"), "word", "n").select("p.*", "word", "n")


def _parted(rows: DataFrame) -> DataFrame:
    """Partitions taken apart: by the length of the shorter word of a pair, and by halves of that."""
    size = F.length("rest")
    lengths = F.when(F.col("shorter").isNotNull(), F.array("shorter")).otherwise(F.array(size, size - 1))
    rows = rows.withColumn("c", F.explode(lengths)).filter("c >= lo").withColumn("half", F.expr("c div 2").cast("int"))
    tail = F.col("c") - F.col("half")

    def part(side: str, key: Column, rest: Column, lo: Column, before: Column) -> Column:
        return F.struct(F.concat("key", F.lit("|"), F.col("c").cast("string"), F.lit("|" + side), key).alias("key"), rest.alias("rest"), lo.alias("lo"), before.alias("before"))

    both = F.array(part("P", F.left("rest", F.col("half")), F.substr("rest", F.col("half") + 1), tail, F.col("before") - F.col("half")),
                   part("S", F.right("rest", tail), F.left("rest", size - tail), F.col("half"), F.least("before", "half")))
    out = rows.select(F.explode(both).alias("p"), "word", "n").select("p.*", F.col("p.lo").alias("shorter"), "word", "n")
    return out.filter("before is null or before > 0")  # else no place is left for the edit


def partitions(words: DataFrame, least_length: int, limit: int = LIMIT) -> DataFrame:
    """All partitions, none of more than ``limit`` words unless its words have two symbols at most."""
    done, rows = None, _parts(words, least_length)
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("words"), F.max(F.coalesce("shorter", F.length("rest"))).alias("most"))
        large = stored(sizes.filter((F.col("words") > limit) & (F.col("most") > 1)).select("key"), "large")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        fine = rows.join(large, "key", "left_anti")
        done = fine if done is None else done.unionByName(fine)
        rows = stored(_parted(rows.join(large, "key", "left_semi")), "parted")


NEAR = "word string, n_near long, best_n long, best string"


def near_words(words: DataFrame, least_length: int = 6, limit: int = LIMIT) -> DataFrame:
    """(word, n_near, best_n, best) of each word with near ones: how many, and of those with the largest n the first by code points."""
    rows = partitions(words, least_length, limit)
    tasks = max(shuffle_partitions(words.sparkSession), 2 * words.count() // ROWS_PER_TASK)
    columns = ["key", "rest", "before", "shorter", "word", "n"]

    def summary(group: list[tuple]) -> Iterator[tuple]:
        """One partition's near words of each of its words."""
        _, rests, limits, lengths, found, counts = zip(*group)
        a, b = Composition(list(rests)).pairs(limits[0])
        if lengths[0] is not None:  # pairs of two longer words are another partition's
            size = np.array([len(r) for r in rests])
            mine = np.minimum(size[a], size[b]) == lengths[0]
            a, b = a[mine], b[mine]
        if not len(a):
            return
        n, rank = np.array(counts), np.empty(len(found), np.int64)
        rank[sorted(range(len(found)), key=found.__getitem__)] = np.arange(len(found))
        of, near = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((rank[near], -n[near], of))
        of, near = of[order], near[order]
        start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        for word, best, count in zip(of[start].tolist(), near[start].tolist(), np.diff([*start, len(of)]).tolist()):
            yield found[word], count, counts[best], found[best]

    def enumerate_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, out = [], []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                              names=["word", "n_near", "best_n", "best"])
            out.clear()
            return made

        for part in batches:
            for row in zip(*(part.column(k).to_pylist() for k in range(len(columns)))):
                if group and group[0][0] != row[0]:
                    out.extend(summary(group) if len(group) > 1 else ())
                    group = []
                group.append(row)
            if len(out) > 10_000:
                yield batch()
        out.extend(summary(group) if len(group) > 1 else ())
        if out:
            yield batch()

    parts = rows.select(*columns).repartition(tasks, "key").sortWithinPartitions("key", "rest").mapInArrow(enumerate_pairs, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("order"), F.col("best").alias("word")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.order")).alias("best_n"), F.col("b.word").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where following forms ends. Steps double, and n grows at each, so few are needed."""
    now = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stored(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5, ratio: int = 5,
             limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each vocabulary word.

    Near words differ by one symbol inserted, deleted or replaced. The form is the near word of largest n (ties: the
    first by code points) if that is at least ``ratio`` times the word's n, else null; the root is where forms lead, a
    word without form is its own. Null and empty texts have no words, a null id counts as an empty one in the rule of
    misprints, equal rows count as often as they come. Texts and runs may be long; a task holds one text, or one
    partition of ``limit`` words. Other columns take no part. An empty table gives no rows.
    """
    words = stored(vocabulary(docs, doc_id, text, least_length, least_count), "vocabulary")
    near = near_words(words, least_length, limit)
    formed = F.col("best_n") >= ratio * F.col("n")
    out = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "near")
    ends = roots(out.filter("form is not null").select("word", "form"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
