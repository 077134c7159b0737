"""Secret scans over a trigram inverted index.

Native: DataFrame expressions only. Each rule's regular expression yields a Boolean query over trigrams (alternatives of
trigrams that every match must contain). Postings (trigram, row) are kept for the trigrams that occur in some query;
rows whose postings satisfy a rule's query are its candidates and are verified with the expression itself. Rules
without a mandatory trigram scan every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import running_totals, without


@dataclass(frozen=True)
class Rule:
    """A match counts if ``group`` has at least ``least`` characters."""
    kind: str
    regex: str
    group: int = 0
    least: int = 1
    quick: str | None = None  # a cheaper expression that every counting match contains


# The three base rules, and further public key formats.
BASE = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16}"),
]
RULES = BASE + [
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z]{2,10}://[^/\s:@]{1,64}:[^/\s:@]{1,64}@"),
]
MOST_ALTERNATIVES = 64


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Alternatives of trigrams (of lower-cased text), one of which every match satisfies; an empty set is no demand."""
    paths = _walk(re._parser.parse(regex), [("", frozenset())])
    found = {grams | _grams(tail) for tail, grams in paths}
    least = [q for q in found if not any(other < q for other in found)]
    return sorted(least, key=sorted) if all(least) else [frozenset()]


def _grams(run: str) -> frozenset[str]:
    return frozenset(run[i:i + 3] for i in range(len(run) - 2))


def _broken(paths):
    return [("", grams | _grams(tail)) for tail, grams in paths]


def _walk(parts, paths):
    """Paths (literal run so far, trigrams so far) through a parsed expression."""
    for op, value in parts:
        name = str(op)
        if name == "LITERAL":
            paths = [(tail + chr(value).lower(), grams) for tail, grams in paths]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value) and len(value) <= 8:
            paths = [(tail + chr(c).lower(), grams) for tail, grams in paths for _, c in value]
        elif name == "SUBPATTERN":
            paths = _walk(value[-1], paths)
        elif name == "BRANCH":
            paths = [p for option in value[1] for p in _walk(option, paths)]
        elif name == "MAX_REPEAT" and value[1] == 1 and value[0] == 0:
            paths = paths + _walk(value[2], paths)
        elif name == "MAX_REPEAT" and value[0] == value[1] <= 8:
            for _ in range(value[0]):
                paths = _walk(value[2], paths)
        else:
            paths = _broken(paths)
        paths = list(dict.fromkeys(paths))
        if len(paths) > MOST_ALTERNATIVES:
            paths = [("", frozenset())]
    return paths


def postings(docs: DataFrame, text: str, trigrams: list[str]) -> DataFrame:
    """(trigram, id, row): which rows contain which of the given trigrams, in lower case."""
    found = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("low"), t))
    low = docs.select("id", "row", F.lower(F.col(f"`{text}`")).alias("low"))
    return low.select("id", "row", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(id, row, kinds): rows whose postings satisfy a rule's query; a row has at most as many postings as there are trigrams."""
    sets = index.groupBy("id", "row").agg(F.collect_set("trigram").alias("grams"))
    every = lambda grams: reduce(Column.__and__, [F.array_contains("grams", g) for g in sorted(grams)])
    kinds = [F.when(reduce(Column.__or__, [every(g) for g in query]), F.lit(kind)) for kind, query in queries.items()]
    return sets.select("id", "row", F.array_compact(F.array(*kinds)).alias("kinds")).filter(F.size("kinds") > 0)


def match_spans(text: Column, rule: Rule, order: int) -> Column:
    """Structs (start, order, end, kind) of the counting matches in code points, in order.

    The texts between matches and the matches themselves add up to the places.
    """
    whole, of = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    between = F.split(text, rule.regex, -1)

    def with_ends(f):
        steps = F.transform(f["whole"], lambda x, k: F.length(F.get(f["between"], k)) + F.length(x))
        return F.struct(f["whole"].alias("whole"), f["of"].alias("of"), running_totals(steps).alias("ends"))

    def spans(f):
        found = F.transform(f["whole"], lambda x, k: F.struct(
            (F.get(f["ends"], k) - F.length(x)).alias("start"), F.lit(order).alias("order"), F.get(f["ends"], k).alias("end"),
            F.lit(rule.kind).alias("kind"), F.length(F.get(f["of"], k)).alias("counts")))
        return F.filter(found, lambda s: s["counts"] >= rule.least)

    # A one-element array names the matches, so that each expression is evaluated once.
    named = F.array(F.struct(whole.alias("whole"), of.alias("of"), between.alias("between")))
    return F.when(text.rlike(rule.quick or rule.regex), F.transform(F.transform(named, with_ends), spans)[0])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: list[Rule] = RULES, output: str = "secrets") -> DataFrame:
    """``docs`` with ``output``: an array of (start, order, end, kind), by start and then in the order of ``rules``.

    Matches are leftmost and do not overlap within a kind; places are code points, ends exclusive. Null and empty texts
    have none. Rows equal in id and text share their postings. A text may be long; an empty table stays empty. Extra
    columns pass unchanged, an earlier column named ``output`` is replaced.
    """
    docs = without(docs, output)
    queries = {r.kind: q for r in rules if all(q := trigram_query(r.regex))}
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(f"`{doc_id}`").alias("id"),
                      F.xxhash64(f"`{doc_id}`", f"`{text}`").alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    grams = sorted({g for query in queries.values() for option in query for g in option})
    if grams:
        # By id and, among rows with equal ids, by a hash of the text.
        named = candidates(postings(own, "t", grams), queries).withColumnsRenamed({"id": "found_id", "row": "found_row"})
        marked = own.join(named, (F.col("row") == F.col("found_row")) & F.col("id").eqNullSafe(F.col("found_id")), "left")
    else:
        marked = own.withColumn("kinds", F.lit(None).cast("array<string>"))
    parts = []
    for order, rule in enumerate(rules):
        matched = match_spans(F.col("t"), rule, order)
        if rule.kind in queries:
            matched = F.when(F.array_contains("kinds", rule.kind), matched)
        parts.append(matched.alias(f"part{order}"))
    step = marked.select("own", *parts)
    present = F.array_compact(F.array(*[f"part{i}" for i in range(len(rules))]))
    spans = F.array_sort(F.flatten(present))
    return step.select("own", F.transform(spans, lambda s: F.struct(s["start"], s["order"], s["end"], s["kind"])).alias(output)).select("own.*", output)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
