"""Quality rules as a short-circuit cascade, in DataFrame and SQL functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, let, words

#: Rows of the sample on which cost and selectivity are estimated, and how often each rule is timed on it.
SAMPLE_ROWS, REPEATS = 2000, 3


@dataclass(frozen=True)
class Rule:
    """``reject``: SQL over a text ``t`` (null is empty) and its words ``w``, true where a document is rejected; null
    counts as false."""

    name: str
    reject: str


def repeat_words(w: str) -> str:
    """SQL for the number of words that lie in a 3-word window found twice or more in the array ``w``.

    Windows are hashed; hash and position are packed into one long (the position in the low bits), so that sorting
    brings equal windows together, and whole hashes are compared. Positions of repeated windows cover three words each,
    less what overlaps. Time n log n for a text of any length.
    """
    at = "cast(s[{0}] & m as int)"
    repeated = (
        f"(k > 0 and h[{at.format('k - 1')}] = h[{at.format('k')}])"
        f" or (k < size(s) - 1 and h[{at.format('k + 1')}] = h[{at.format('k')}])"
    )
    covered = "aggregate(transform(p, (x, k) -> if(k = 0, 3L, least(3L, x - p[k - 1]))), 0L, (a, x) -> a + x)"
    body = let(
        f"sort_array(filter(transform(s, (x, k) -> if({repeated}, x & m, -1L)), x -> x >= 0))", "p", covered
    )
    body = let("sort_array(transform(h, (x, i) -> shiftleft(x, b) | i))", "s", body)
    body = let("shiftleft(1L, b) - 1", "m", body)
    body = let("length(bin(size(h)))", "b", body)
    body = let("transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))", "h", body)
    return let(w, "w", f"if(size(w) < 4, 0L, {body})")


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines`` (long) of the whole text.

    Null and empty texts count zero throughout. ``n_lines``: lines that have a word. New columns replace old ones of
    the same name.
    """
    t = f"coalesce(`{text_col}`, '')"
    lines = rf"filter(split({t}, '\\n'), x -> x rlike r'[^\x20\x09-\x0D]')"
    counted = docs.withColumns(
        {
            "_w": F.expr(words(f"`{text_col}`")),
            "_lines": F.expr(let(lines, "l", "named_struct('n', size(l), 'd', size(l) - size(array_distinct(l)))")),
        }
    )
    return counted.withColumns(
        {
            "n_words": F.expr("cast(size(_w) as bigint)"),
            "word_chars": F.expr(rf"cast(length(regexp_replace({t}, r'{SPACE}', '')) as bigint)"),
            "n_symbols": F.expr(f"cast(size(regexp_extract_all({t}, '[#*$%&|<>]', 0)) as bigint)"),
            "n_dup_lines": F.expr("cast(_lines.d as bigint)"),
            "n_repeat_words": F.expr(repeat_words("_w")),
            "n_lines": F.expr("cast(_lines.n as bigint)"),
        }
    ).drop("_w", "_lines")


#: Base rule of the contract over the counts.
BASE_FAILED = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"

_LINES = r"filter(split(t, '\\n'), x -> x rlike r'[^\x20\x09-\x0D]')"
_CHARS = rf"length(regexp_replace(t, r'{SPACE}', ''))"


def _lines_like(pattern: str, share: str) -> str:
    """SQL: more than ``share`` tenths of the lines that have a word match ``pattern``."""
    return let(_LINES, "l", f"10 * size(filter(l, x -> x rlike r'{pattern}')) > {share} * size(l)")


#: The base rule of the contract.
BASE_RULES = (
    Rule("too_short", "size(w) < 50"),
    Rule("repeats", f"100 * {repeat_words('w')} > 50L * size(w)"),
)

#: Rules beyond the base, with the bounds of published web-corpus filters: many symbols, odd word lengths, words without
#: letters, repeated lines, lines that break off, lists. Each does its own work on the text.
MORE_RULES = (
    Rule("symbols", "10 * size(regexp_extract_all(t, '[#*$%&|<>]', 0)) > size(w)"),
    Rule("short_words", f"{_CHARS} < 3 * size(w)"),
    Rule("long_words", f"{_CHARS} > 10 * size(w)"),
    Rule("no_letters", r"10 * size(filter(w, x -> x rlike r'\p{L}')) < 8 * size(w)"),
    Rule("repeated_lines", let(_LINES, "l", "10 * (size(l) - size(array_distinct(l))) > 3 * size(l)")),
    Rule("broken_lines", _lines_like(r"(\.\.\.|…)[\x20\x09-\x0D]*$", "3")),
    Rule("lists", _lines_like(r"^[\x20\x09-\x0D]*[-*•]", "9")),
)

ALL_RULES = BASE_RULES + MORE_RULES


def over_text(sql: str, text_col: str) -> Column:
    """``sql`` over a text ``t`` and its words ``w``; the words are split once for a row, whatever the rules need of them."""
    return F.expr(let(f"coalesce(`{text_col}`, '')", "t", let(words("t"), "w", sql)))


#: Nanoseconds of the task's machine.
_CLOCK = "cast(reflect('java.lang.System', 'nanoTime') as bigint)"


def rate_rules(sample: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", repeats: int = REPEATS) -> tuple[list[float], dict[tuple[bool, ...], int]]:
    """Seconds that each rule needs for ``sample``, and how many rows have which verdicts of the rules, in one job.

    Each rule runs ``repeats`` times on each text, between two looks at the clock; the shortest time counts.
    """
    if not rules:
        return [], {}

    def timed(reject):
        run = f"named_struct('a', {_CLOCK}, 'r', coalesce({reject}, false), 'b', {_CLOCK})"
        return let(f"array({', '.join([run] * repeats)})", "x", "named_struct('d', array_min(transform(x, y -> y.b - y.a)), 'r', x[0].r)")

    rated = sample.select(over_text("array(" + ", ".join(timed(r.reject) for r in rules) + ")", text_col).alias("v"))
    seconds = [F.sum(F.col("v")[i]["d"]).alias(f"d{i}") for i in range(len(rules))]
    counted = rated.groupBy(F.transform("v", lambda x: x["r"]).alias("f")).agg(F.count("*").alias("n"), *seconds).collect()
    cost = [max(1e-9, sum(r[f"d{i}"] for r in counted) / 1e9) for i in range(len(rules))]
    return cost, {tuple(r["f"]): r["n"] for r in counted}


def rough(cost: list[float]) -> list[float]:
    """Costs in steps of four times, counted from the least: what differs by less is measured alike."""
    least = min(cost, default=1.0)
    return [4.0 ** round(math.log(c / least, 4)) for c in cost]


def rank_rules(rules: tuple[Rule, ...], cost: list[float], verdicts: dict[tuple[bool, ...], int]) -> list[Rule]:
    """``rules`` ordered: each time the one that rejects most per cost of what the earlier ones let through; ties by name."""
    ordered, left, rows = [], sorted(range(len(rules)), key=lambda i: rules[i].name), dict(verdicts)
    while left:
        rejects = {i: sum(n for f, n in rows.items() if f[i]) for i in left}
        best = max(left, key=lambda i: (rejects[i] + 0.01) / cost[i])
        ordered.append(rules[best])
        left.remove(best)
        rows = {f: n for f, n in rows.items() if not f[best]}
    return ordered


def order_rules(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> list[Rule]:
    """``rules`` by rejections per second on a sample of about ``sample_rows`` rows, the most effective first.

    The verdict of a cascade does not depend on the order; only its cost does. Costs are taken roughly, so that the order is
    the same whenever the sample is. What reaches the driver are times and counts of verdicts of the bounded sample.
    """
    n = docs.count()
    sample = docs.select(text_col) if n <= sample_rows else docs.select(text_col).sample(fraction=sample_rows / n, seed=1)
    sample = cut(sample.coalesce(docs.sparkSession.sparkContext.defaultParallelism))
    cost, verdicts = rate_rules(sample, rules, text_col)
    return rank_rules(rules, rough(cost), verdicts)


def verdict(ordered: list[Rule], text_col: str = "text") -> Column:
    """True where no rule rejects; a later rule is evaluated only for what the earlier ones let through."""
    case = "".join(f" when {r.reject} then false" for r in ordered)
    return over_text(f"case{case} else true end", text_col) if ordered else F.lit(True)


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = ALL_RULES, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that every rule lets through. Null texts have no words; equal rows get equal verdicts."""
    return docs.where(verdict(order_rules(docs, rules, sample_rows, text_col), text_col))
