"""Op 8: a threshold table compiled into one projection.

Words are runs of anything but space and the controls tab to carriage return. THRESHOLDS names a ratio, the least and
largest value that pass, and the number of words from which the rule holds; compile_rules turns the rows into one
Column. Nothing is shuffled, nothing leaves the JVM.

Edge cases: a null or empty text has no words and fails the base; texts of any length are taken whole; rows that repeat
are rated one by one; an empty table gives no rows. Columns of the input whose names `rate` gives to its own are replaced;
`passes` is a predicate and leaves all columns as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, let

# Stop words of English, French, Spanish and German.
STOP_WORDS = (
    "the of and to in that is for it on with as are this by from be or an at not "
    "de la le les et des un une que qui dans pour par sur est au aux en "
    "el los se del las con no es al lo "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine"
).split()

#: (ratio, least, largest, words from which it holds)
THRESHOLDS = [
    ("mean_word_length", 2.0, 14.0, 10),
    ("symbols_per_word", None, 0.1, 10),
    ("exclamations_per_word", None, 0.1, 10),
    ("upper_case_words", None, 0.5, 10),
    ("stop_words", 0.03, None, 40),
    ("duplicate_lines", None, 0.5, 10),
]


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words covered by windows of the given width that occur more than once in the array."""
    n = F.size(words)
    windows = lambda h: F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    def covered(h: Column) -> Column:
        def found(s: Column) -> Column:
            same = lambda k: F.get(s, k)["h"] == F.get(s, k + 1)["h"]
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(same(k), F.lit(False)) | ((k > 0) & F.coalesce(same(F.greatest(k - 1, F.lit(0))), F.lit(False))))
            places = F.array_sort(F.transform(at, lambda k: F.get(s, k)["i"]))
            gaps = lambda r: F.transform(r, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(r, k + 1) - x, F.lit(width))))
            return F.aggregate(let(places, gaps), F.lit(0).cast("long"), lambda a, x: a + x)

        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, found))

    return F.when(n < width, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: let(windows(h), covered)))


def compile_rules(values: dict[str, Column], n_words: Column, table=None) -> Column:
    """True where every row of the table passes."""
    checks = []
    for name, least, largest, since in THRESHOLDS if table is None else table:
        v = values[name]
        ok = F.lit(True)
        ok = ok if least is None else ok & (v >= least)
        ok = ok if largest is None else ok & (v <= largest)
        checks.append((n_words < since) | F.coalesce(ok, F.lit(True)))
    return reduce(lambda a, b: a & b, checks, F.lit(True))


def measured(text: Column) -> Column:
    """What the rules read of a text, as one struct."""
    text = F.coalesce(text, F.lit(""))
    stop = sorted({y for x in STOP_WORDS for y in (x, x.capitalize())})

    def measures(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\t\\n\\u000B\\f\\r]"))
        pair = let(lines, lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("dup")))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            pair.alias("lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda x: x.isin(stop))).alias("stop"),
            F.char_length(F.regexp_replace(text, "[^!]+", "")).alias("exclamations"),
            F.size(F.filter(words, lambda x: x.rlike("^\\P{Ll}*\\p{Lu}\\P{Ll}*\\p{Lu}\\P{Ll}*$"))).alias("upper"),
        )

    return let(F.filter(F.split(text, SPACES), lambda x: x != ""), measures)


def judged(m: Column, table=None) -> dict[str, Column]:
    """The columns of `rate` from what was measured."""
    n = m["n_words"]
    over = lambda c, d=n: F.when(d > 0, c / d)
    values = {
        "mean_word_length": over(m["word_chars"]),
        "symbols_per_word": over(m["n_symbols"]),
        "exclamations_per_word": over(m["exclamations"]),
        "upper_case_words": over(m["upper"]),
        "stop_words": over(m["stop"]),
        "duplicate_lines": over(m["lines"]["dup"], m["lines"]["n"]),
    }
    failed = (n < 10) | (100 * m["n_repeat_words"] > 20 * n)
    return {
        "n_words": n,
        "word_chars": m["word_chars"],
        "n_symbols": m["n_symbols"],
        "n_dup_lines": m["lines"]["dup"].cast("long"),
        "n_repeat_words": m["n_repeat_words"],
        "base_failed": failed,
        "kept": ~failed & compile_rules(values, n, table),
    }


def passes(text: Column, table=None) -> Column:
    """Whether a text passes the base rules and every row of the table."""
    return let(measured(text), lambda m: judged(m, table)["kept"])


def rate(docs: DataFrame, table=None, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept in one projection."""
    name = fresh("measured", docs.columns)
    return docs.withColumn(name, measured(F.col(text_col))).withColumns(judged(F.col(name), table)).drop(name)
