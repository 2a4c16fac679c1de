"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a condition on a row's text, written out in full: what it needs is computed
inside it, so a rule that is not reached costs nothing (``CASE WHEN`` evaluates its
branches one by one). On a sample, each rule's work per row (characters read, words
hashed and sorted) and the combinations of rules that reject are counted in one
pass; then the rule that rejects most of what is left for its work comes first, and
so on. The work is counted, not timed, so the order is the same on every run; and it
never changes which rows are kept, only how much work that takes.

Everything is computed in the row: words, windows and lines are arrays of the row,
repeated windows are found by sorting hashes, so nothing is shuffled however often
a line or a passage occurs in the corpus. The metrics that a caller wants for every
row (``with_metrics``) are columns beside the cascade, which then reads them.

Defined results: a null text counts as an empty one, which has no words and so
fails; repeated rows and null ids keep their rows; only the id and the text are
looked at, so further columns with any names are harmless; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import SPACE_CLASS, documents

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
#: Rows on which work and selectivities are estimated, about.
SAMPLE_ROWS = 2000
TEXT, WORD_LIST = "`text`", "`__words`"
NOT_BLANK = r"[^\\x20\\x09-\\x0D]"


@dataclass(frozen=True)
class Rule:
    """Rejects the rows for which the SQL condition over metrics and ``text`` holds.

    ``work``: what that takes in a row, in characters read; a word that is hashed
    and sorted counts as sixteen.
    """

    name: str
    condition: str
    work: str = "char_length(text)"


#: The first two are the base.
BASE_RULES = (Rule("few_words", "n_words < 20", "1"), Rule("repeats", "100 * n_repeat_words > 30 * n_words", "16 * n_words"))
RULES = (
    *BASE_RULES,
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("dup_lines", "10 * n_dup_lines > 3 * n_lines", "3 * char_length(text)"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
    Rule("shouting", f"2 * (char_length(text) - char_length(translate(text, '{CAPITALS}', ''))) > word_chars", "2 * char_length(text)"),
)


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeat_words(words: str) -> str:
    """SQL: words of an array that lie in a window of 8 words which the array holds twice or more.

    Equal windows become neighbours when (hash, position) pairs are sorted; the
    words that the repeated windows cover follow from the gaps between their
    positions. Rows without a repeated window stop after one distinct count.
    """
    w = WINDOW
    windows = f"transform(sequence(0, size(hashes) - {w}), i -> xxhash64(slice(hashes, i + 1, {w})))"
    repeated = "filter(pairs, (x, k) -> get(pairs, k - 1).h <=> x.h OR get(pairs, k + 1).h <=> x.h)"
    covered = f"aggregate(transform(places, (p, k) -> least({w}, coalesce(get(places, k + 1) - p, {w}))), 0L, (s, x) -> s + x)"
    places = _let(f"sort_array(transform({repeated}, x -> x.i))", "places", covered)
    pairs = _let("sort_array(transform(windows, (h, i) -> struct(h AS h, i AS i)))", "pairs", places)
    found = _let(windows, "windows", f"CASE WHEN size(array_distinct(windows)) = size(windows) THEN 0L ELSE {pairs} END")
    return _let(f"transform({words}, x -> xxhash64(x))", "hashes", f"CASE WHEN size(hashes) < {w} THEN 0L ELSE {found} END")


#: Each metric of a row as SQL over its text and its words.
METRICS = {
    "n_words": f"CAST(size({WORD_LIST}) AS LONG)",
    "word_chars": f"CAST(char_length(translate({TEXT}, '{SPACES}', '')) AS LONG)",
    "n_symbols": f"CAST(char_length({TEXT}) - char_length(translate({TEXT}, '{SYMBOLS}', '')) AS LONG)",
    "n_lines": f"CAST(size(filter(split({TEXT}, '\n'), x -> x RLIKE '{NOT_BLANK}')) AS LONG)",
    "n_dup_lines": _let(f"filter(split({TEXT}, '\n'), x -> x RLIKE '{NOT_BLANK}')", "lines", "CAST(size(lines) - size(array_distinct(lines)) AS LONG)"),
    "n_repeat_words": repeat_words(WORD_LIST),
}


def spelled(sql: str) -> str:
    """A condition with its metrics written out."""
    return re.sub(r"\b(?:" + "|".join(METRICS) + r")\b", lambda m: f"({METRICS[m[0]]})", sql)


def word_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, __words``."""
    rows = df.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("__words", F.array_remove(F.split("text", f"{SPACE_CLASS}+"), ""))


def metric_columns(names: tuple[str, ...] | dict = METRICS) -> list[Column]:
    return [F.expr(METRICS[n]).alias(n) for n in names]


def order_rules(rows: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """``(rule, work a row, share rejected of what is left)`` in the order to test them.

    The sample is the rows whose hash is in the share that holds about ``sample_rows``
    of all. It comes to the driver as one row for each combination of rules that
    rejects, with the sums of the rules' work.
    """
    share = min(1.0, sample_rows / max(1, rows.count()))
    sample = rows.where(F.pmod(F.xxhash64(id_col, F.left("text", F.lit(64))), F.lit(1 << 30)) < int(share * (1 << 30)))
    hits = [F.coalesce(F.expr(spelled(r.condition)), F.lit(False)).alias(f"hit{k}") for k, r in enumerate(rules)]
    works = [F.expr(spelled(r.work)).cast("double").alias(f"work{k}") for k, r in enumerate(rules)]
    seen = sample.select(*hits, *works).groupBy(*[f"hit{k}" for k in range(len(rules))]).agg(F.count("*").alias("n"), *[F.sum(f"work{k}").alias(f"work{k}") for k in range(len(rules))])
    groups = [r.asDict() for r in seen.collect()]
    n = max(1, sum(g["n"] for g in groups))
    work = [max(1.0, sum(g[f"work{k}"] for g in groups) / n) for k in range(len(rules))]
    out, left, open_ = [], groups, set(range(len(rules)))
    while open_:
        rest = max(1, sum(g["n"] for g in left))
        rejected = {k: sum(g["n"] for g in left if g[f"hit{k}"]) / rest for k in open_}
        best = min(open_, key=lambda k: (-rejected[k] / work[k], work[k], rules[k].name))
        out.append((rules[best], work[best], rejected[best]))
        open_.remove(best)
        left = [g for g in left if not g[f"hit{best}"]]
    return out


def cascade(rules: list[Rule], ready: bool = False) -> Column:
    """The name of the first rule that rejects the row, in this order; null for kept rows.

    ``ready``: the metrics are columns of the row, as the caller wants them for all rows.
    """
    test = lambda rule: F.expr(rule.condition if ready else spelled(rule.condition))
    first, *rest = rules
    out = F.when(test(first), first.name)
    for rule in rest:
        out = out.when(test(rule), rule.name)
    return out


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, with_metrics: bool = True) -> DataFrame:
    """``id, text``, the metrics if asked for, ``rejected_by`` (the first rejecting rule in the cascade's order) and ``kept``."""
    rows = word_rows(df, id_col, text_col)
    order = [rule for rule, _, _ in order_rules(rows, rules, id_col)]
    made = rows.select(id_col, "text", *metric_columns()) if with_metrics else rows
    made = made.withColumn("rejected_by", cascade(order, with_metrics)).drop("__words")
    return made.withColumn("kept", F.col("rejected_by").isNull())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality_rules(documents(spark, sf_dir))
    failed = F.expr(" OR ".join(f"({r.condition})" for r in BASE_RULES))  # over the metric columns
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), m AS (
  SELECT rid, doc_id, text, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars,
         length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines
  FROM w
), win AS (
  SELECT rid, i, array_to_string(list_slice(words, i, i + 7), ' ') AS k
  FROM w, unnest(range(1, greatest(1, len(words) - 6))) AS t(i)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT rid, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid
), a AS (
  SELECT m.*, coalesce(cov.n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 3 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR 2 * (length(text) - length(translate(text, '{CAPITALS}', ''))) > word_chars) AS kept
FROM b
"""
