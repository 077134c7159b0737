"""Quality rules, line first: failing lines go, then documents that lost too much text.

Native: DataFrame expressions only, one pass over the rows, no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import NOT_SPACE, SPACE, without, words

# Symbols that are counted; signs that end or structure a sentence, in Latin, Chinese and Japanese, Indic,
# Arabic and Syriac, Armenian, Ethiopic, Hebrew, Mongolian and Georgian script, and letters of scripts that write
# without such signs (Thai, Lao, Tibetan, Myanmar, Khmer); separators and words of navigation bars; phrases of page
# furniture, and for each phrase a part that every match contains in lower case.
SYMBOLS = "#*$%&|<>"
SENTENCE = (r"[.!?:;,…。！？、，；：．।॥؟،؛۔܀։՜՝՞።፣፤፥፦፧׃׀᠂᠃჻"
            "\u0E00-\u0EFF\u0F00-\u0FFF\u1000-\u109F\u1780-\u17FF]")
SEPARATOR = r"\s[|»›>•·]\s"
NAVIGATION = (r"(?i)^\s*(home|menu|login|log in|sign in|sign up|register|search|contact( us)?|about( us)?|next|previous|back|"
              r"skip to content|site map|sitemap|read more|share|tweet|print|top)\s*$")
BOILERPLATE = (r"(?i)(all rights reserved|cookie policy|we use cookies|accept (all )?cookies|privacy policy|terms of (use|service)|"
               r"enable javascript|subscribe to our newsletter|follow us on|click here to|lorem ipsum)")


FURNITURE = ["all rights reserved", "cookie", "privacy policy", "terms of ", "enable javascript", "newsletter", "follow us on", "click here to", "lorem ipsum"]


def _count(text: Column, regex: str) -> Column:
    return F.size(F.split(text, regex, -1)) - 1


def _blank(line: Column) -> Column:
    return ~line.rlike(NOT_SPACE)


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def line_passes(line: Column, symbols_in_text: Column | None = None, furniture_in_text: Column | None = None, sentence: str = SENTENCE,
                navigation: str = NAVIGATION, boilerplate: str = BOILERPLATE) -> Column:
    """The rules of a line; a line without words passes (it is layout).

    Punctuation: at most one symbol to three words, and a line of 20 words or more has some sentence sign, or a letter of
    a script that has none. Navigation: not a known link label, and not three or more segments of at most three words on
    average. Boilerplate: none of the phrases. What is known of the whole text (symbols, possible phrases) spares its
    lines a test.
    """
    n = F.regexp_count(line, F.lit(NOT_SPACE + "+"))
    symbols = _symbols(line) if symbols_in_text is None else F.when(symbols_in_text == 0, 0).otherwise(_symbols(line))
    phrases = line.rlike(boilerplate) if furniture_in_text is None else furniture_in_text & line.rlike(boilerplate)
    segments = _count(line, SEPARATOR) + 1
    fails = ((3 * symbols > n) | ((n >= 20) & ~line.rlike(sentence)) | line.rlike(navigation)
             | ((segments >= 3) & (n <= 3 * segments)) | phrases)
    return _blank(line) | ~fails


def window_hashes(w: Column) -> Column:
    """A 64-bit hash of every window of three words of an array; null for fewer than three words."""
    n = F.size(w)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))


def repeated_at(placed: Column) -> Column:
    """Places, ascending, of the windows that occur twice or more, from structs (h, i) sorted by hash."""
    twice = F.transform(placed, lambda x, k: F.when((F.get(placed, k - 1)["h"] == x["h"]) | (F.get(placed, k + 1)["h"] == x["h"]), x["i"]))
    return F.sort_array(F.filter(twice, lambda p: p.isNotNull()))


def covered_words(at: Column) -> Column:
    """Words that windows of three words at the given ascending places cover together."""
    steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x)


# Fields of the result.
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text", "n_lines",
          "n_lines_removed", "lost"]


def assess(docs: DataFrame, text: str = "text", max_lost: float = 0.5, output: str = "quality", sentence: str = SENTENCE,
           navigation: str = NAVIGATION, boilerplate: str = BOILERPLATE, furniture: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` with the measures and the verdict in one struct named ``output``.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_text, n_lines,
    n_lines_removed, lost (share of word characters in removed lines). ``kept`` is false where the base rules fail or
    more than ``max_lost`` of the word characters went. Other expressions for the rules may be given; ``furniture`` then
    lists lower-case texts one of which every boilerplate phrase contains (none given: every line is tested). Null and
    empty texts have no words and fail, long ones are one row's arrays, an empty table stays empty; any other column may hold anything, also one named like a field; an earlier column named ``output`` is replaced.
    """
    docs = without(docs, output)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    step = docs.select(own.alias("own"), t.alias("t"))
    step = step.select("own", "t", words(F.col("t")).alias("w"), F.split("t", "\n", -1).alias("lines"))
    if furniture is None:
        furniture = FURNITURE if boilerplate == BOILERPLATE else []
    lower = F.lower("t")
    maybe = reduce(Column.__or__, [F.contains(lower, F.lit(p)) for p in furniture]) if furniture else F.lit(True)
    step = step.select("*", _symbols(F.col("t")).cast("long").alias("n_symbols"), maybe.alias("furniture"))
    passes = lambda x: line_passes(x, F.col("n_symbols"), F.col("furniture"), sentence, navigation, boilerplate)
    step = step.select(
        "own", F.size("w").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"), "n_symbols",
        F.filter("lines", lambda x: ~_blank(x)).alias("full"), F.filter("lines", passes).alias("passed"),
        window_hashes(F.col("w")).alias("hashes"))
    # Sorting is left to the texts that have a repeated window at all.
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("placed", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), placed))
    step = step.withColumn("at", repeated_at(F.col("placed"))).withColumn("clean_text", F.array_join("passed", "\n"))
    left = F.when(F.size("passed") == F.col("n_lines"), F.col("word_chars")).otherwise(F.length(F.regexp_replace("clean_text", SPACE + "+", "")))
    step = (step
            .withColumn("n_dup_lines", (F.size("full") - F.size(F.array_distinct("full"))).cast("long"))
            .withColumn("n_repeat_words", F.coalesce(covered_words(F.col("at")), F.lit(0)).cast("long"))
            .withColumn("n_lines_removed", F.col("n_lines") - F.size("passed"))
            .withColumn("lost", F.when(F.col("word_chars") > 0, 1 - left / F.col("word_chars")).otherwise(0.0))
            .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
            .withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_lost)))
    # A generator keeps a later filter on the verdict above all this; pushed down, it would repeat every expression.
    return step.select("own", F.explode_outer(F.array(F.struct(*FIELDS))).alias(output)).select("own.*", output)
