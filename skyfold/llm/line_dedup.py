"""Line dedup: overlapping windows of three lines, hashed and matched over the whole corpus.

Native: DataFrame expressions only. A window is two independent 64-bit hashes of its lines. Equal windows are counted
with partial aggregation, so a window in a third of all documents sends one row per task; the join that finds its
later copies is an ordinary shuffle join, whose large keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import NOT_SPACE, without


def windows(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(h1, h2, id, row, i): every window of ``size`` consecutive lines with a word in it."""
    lines = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(f"`{doc_id}`", f"`{text}`").alias("row"),
                        F.split(F.col(f"`{text}`"), "\n", -1).alias("lines"))
    start = F.sequence(F.lit(0), F.size("lines") - size)
    line = lambda i, k: F.get(F.col("lines"), i + k)
    pair = F.transform(start, lambda i: F.struct(
        i.alias("i"), F.xxhash64(*[line(i, k) for k in range(size)]).alias("h1"),
        F.xxhash64(F.lit(7), *[line(i, k) for k in reversed(range(size))]).alias("h2"),
        F.greatest(*[line(i, k).rlike(NOT_SPACE) for k in range(size)]).alias("full")))
    found = lines.filter(F.size("lines") >= size).select("id", "row", F.explode(pair).alias("x"))
    return found.filter("x.full").select("x.h1", "x.h2", "id", "row", "x.i")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3,
                   output: str = "line_dedup") -> DataFrame:
    """``docs`` with a struct ``output``: n_lines, n_removed, kept_text; an earlier column of that name is replaced.

    Order is (doc_id, place in the text), null ids first; of equal windows the first stays and the lines of every
    later one go, unless no line of the window has a word. Windows are judged on the input. Texts with fewer lines
    than a window, and null texts, are unchanged. Rows equal in id and text count as one document: they get the same
    result. Rows with equal ids and other texts are ordered by a hash of the text. Extra columns pass unchanged. A text may
    be long, its lines are one array; an empty table stays empty.
    """
    docs = without(docs, output)
    found = windows(docs, doc_id, text, size)
    place = F.struct("id", "row", "i")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = found.join(first, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    # Duplicate rows repeat a place; the set has at most as many places as the text has lines.
    places = later.groupBy(F.col("row").alias("removed_row"), F.col("id").alias("removed_id")).agg(F.sort_array(F.collect_set("i")).alias("at"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.xxhash64(f"`{doc_id}`", f"`{text}`").alias("row"),
                      F.col(f"`{doc_id}`").alias("own_id"), F.col(f"`{text}`").alias("t"))
    # By id and, among rows with equal ids, by a hash of the text.
    joined = own.join(places, (F.col("row") == F.col("removed_row")) & F.col("own_id").eqNullSafe(F.col("removed_id")), "left")
    joined = joined.select("own", "t", "at", F.split(F.coalesce("t", F.lit("")), "\n", -1).alias("lines"))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + (size - 1)))))
    joined = joined.withColumn("covered", covered)
    rest = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "covered")
    kept = F.array_join(F.transform(rest, lambda i: F.get(F.col("lines"), i)), "\n")
    result = F.struct(F.size("lines").cast("long").alias("n_lines"), F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")).cast("long").alias("n_removed"),
                      F.when(F.col("covered").isNull(), F.col("t")).otherwise(kept).alias("kept_text"))
    return joined.select("own", result.alias(output)).select("own.*", output)
