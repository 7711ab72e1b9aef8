"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Very common words of the corpus's languages.
STOP_WORDS = "the of and to in is that it for on with as was be by this are from or a de la le les et des en du un une que el los las y por se der die und das den von zu mit ist nicht ein eine auf".split()


@dataclass(frozen=True)
class Rule:
    """A text fails if the measure is outside low..high (either may be None: open)."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Measures are columns of `measured`. Rates are 0 where there is nothing to divide by.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 16.0),
    Rule("symbol_ratio", "symbols_per_word", None, 0.3),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("duplicate_lines", "duplicate_line_ratio", None, 0.6),
    Rule("long_lines", "words_per_line", None, 100_000.0),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column, width: int) -> Column:
    """Words under windows of `width` words that stand twice or more; windows are told apart by a 64-bit hash."""
    n = F.size(words)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    def count(h: Column) -> Column:
        marked = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return _let(F.array_sort(marked), starts)

    def starts(s: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("bigint")), F.transform(s, lambda x: x.h))
        after = F.concat(F.transform(F.slice(s, 2, F.size(s)), lambda x: x.h), F.array(F.lit(None).cast("bigint")))
        near = F.arrays_zip(s.alias("s"), F.slice(before, 1, F.size(s)).alias("b"), after.alias("a"))
        twice = F.filter(near, lambda x: (x.s.h == x.b) | (x.s.h == x.a))
        return _let(F.array_sort(F.transform(twice, lambda x: x.s.i)), covered)

    def covered(at: Column) -> Column:
        following = F.concat(F.slice(at, 2, F.size(at)), F.array(F.element_at(at, -1) + width))
        return F.when(F.size(at) == 0, 0).otherwise(F.aggregate(F.zip_with(at, following, lambda a, b: F.least(b - a, F.lit(width))), F.lit(0), lambda x, y: x + y))

    return F.when(n < width + 1, 0).otherwise(_let(_let(F.transform(words, lambda w: F.xxhash64(w)), windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(count(h))))


def measured(docs: DataFrame) -> DataFrame:
    """Columns row (all of docs, as a struct) and the measures. A null text has no words and no lines."""
    text = F.coalesce("row.text", F.lit(""))
    rows = docs.select(F.struct("*").alias("row"))
    long = lambda c: c.cast("long")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    by_word = lambda w: F.struct(
        long(F.size(w)).alias("n_words"),
        long(F.aggregate(w, F.lit(0), lambda n, x: n + F.length(x))).alias("word_chars"),
        long(_repeated_words(w, 8)).alias("n_repeat_words"),
        long(F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS)))).alias("n_stop_words"),
    )
    by_line = lambda x: F.struct(long(F.size(x)).alias("n_lines"), long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    rows = rows.select("row", long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"), _let(words, by_word).alias("w"), _let(lines, by_line).alias("l"))
    rows = rows.select("row", "n_symbols", "w.*", "l.*")
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return rows.withColumns(
        {
            "mean_word_chars": rate("word_chars", "n_words"),
            "symbols_per_word": rate("n_symbols", "n_words"),
            "stop_word_ratio": rate("n_stop_words", "n_words"),
            "duplicate_line_ratio": rate("n_dup_lines", "n_lines"),
            "words_per_line": rate("n_words", "n_lines"),
        }
    )


def compiled(rules: tuple[Rule, ...]) -> Column:
    """Names of the rules that fail, as one expression."""
    fails = []
    for r in rules:
        outside = F.lit(False)
        outside = outside | (F.col(r.measure) < r.low) if r.low is not None else outside
        outside = outside | (F.col(r.measure) > r.high) if r.high is not None else outside
        fails.append(F.when(outside, F.lit(r.name)))
    return F.array_compact(F.array(*fails))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measured(docs) with failed_rules (names), base_failed and kept. Every row of docs stays, repeated or not.

    base_failed: under 20 words, or over 30 % of the words within 8-word windows that repeat.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = measured(docs).withColumns({"failed_rules": compiled(rules), "base_failed": base})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row."""
    rows = judge(docs.select("doc_id", "text"))
    return rows.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same for DuckDB, from the same table of rules."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    tests = [f"coalesce({r.measure}, 0) < {r.low}" for r in rules if r.low is not None] + [f"coalesce({r.measure}, 0) > {r.high}" for r in rules if r.high is not None]
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS gram
      FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 9)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(least(8, coalesce(following - i, 8))) AS n_repeat_words
      FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS following FROM t) GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop_words FROM w LEFT JOIN c USING (r)),
q AS (SELECT *, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(n_words, 0) AS symbols_per_word,
             n_stop_words / nullif(n_words, 0) AS stop_word_ratio, n_dup_lines / nullif(n_lines, 0) AS duplicate_line_ratio,
             n_words / nullif(n_lines, 0) AS words_per_line,
             n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(tests)}) AS kept FROM q"""
