"""Quality rules as a short-circuit cascade of plain column expressions.

All measures come from the row itself, so the plan is one scan without an exchange.
The rules beyond the base are tried on a bounded sample: each rule's run time and
share of rejections order the cascade by rejections per second, and one CASE chain
stops at the first rule that rejects. The order changes the cost, never the verdict.

Defined cases: a null text has no words; texts without words fail the base; repeated
rows are judged alike; extra columns pass through. Sample bound: ``SAMPLE_ROWS`` rows of at
most ``SAMPLE_BYTES`` bytes; with no such row the rules keep the order of their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import SPACES, WORD_GAP, cut, fresh

#: Rows on which the rules' costs and rejections are estimated, and the largest text among them.
SAMPLE_ROWS, SAMPLE_BYTES = 500, 1 << 16
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Measures:
    """The columns a rule may use: the text, its words and what is already counted."""

    text: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], Column]


def word_array(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP, -1))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all uses in ``body``, also inside further lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shift(name: str, value: Column, bits: Column) -> Column:
    return F.call_function(name, value, bits)


def _neighbours(a: Column, n: Column) -> Column:
    """Each element of a sorted array with the ones before and after it, or its own complement at the ends."""
    first, last = F.array(F.bitwise_not(F.element_at(a, 1))), F.array(F.bitwise_not(F.element_at(a, -1)))
    return F.arrays_zip(a.alias("x"), F.concat(first, F.slice(a, F.lit(1), n - 1)).alias("p"),
                        F.concat(F.slice(a, F.lit(2), n - 1), last).alias("q"))


def repeat_words(words: Column) -> Column:
    """Words inside a 3-word window whose words occur twice or more in the text.

    A window is a long of hash bits above its position, so one sort of longs brings
    equal windows together; the position takes only the bits that this text needs. The
    words decide: where neighbours of equal bits differ, the windows are sorted by words.
    """

    def covered(it: Column) -> Column:
        w, n, bits = it["w"], it["n"], it["b"]
        # three views of the words, moved by one each
        windows = F.arrays_zip(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), F.slice(w, F.lit(3), n))
        packed = F.sort_array(F.transform(windows, lambda x, i: _shift("shiftleft", F.xxhash64(x), bits) + i))

        def twice(s: Column) -> Column:
            pairs = F.filter(_neighbours(s, n), lambda z: (_shift("shiftright", z["x"].bitwiseXOR(z["p"]), bits) == 0)
                             | (_shift("shiftright", z["x"].bitwiseXOR(z["q"]), bits) == 0))
            return _let(pairs, exact)

        def window(x: Column) -> Column:
            at = x.bitwiseAND(it["m"] - 1).cast("int")
            return F.struct(*(F.element_at(w, at + i).alias(f"w{i}") for i in (1, 2, 3)))

        def exact(pairs: Column) -> Column:
            place = lambda z: z["x"].bitwiseAND(it["m"] - 1)
            mixed_up = F.exists(pairs, lambda z: (_shift("shiftright", z["x"].bitwiseXOR(z["q"]), bits) == 0)
                                & (window(z["x"]) != window(z["q"])))
            by_words = F.sort_array(F.transform(pairs, lambda z: F.struct(window(z["x"]).alias("t"), place(z).alias("at"))))
            sure = lambda s: F.filter(F.transform(s, lambda z, i: F.when(
                ((i > 0) & (F.get(s, i - 1)["t"] == z["t"])) | ((i + 1 < F.size(s)) & (F.get(s, i + 1)["t"] == z["t"])),
                z["at"])), lambda x: x.isNotNull())
            return _let(F.sort_array(F.when(mixed_up, _let(by_words, sure)).otherwise(F.transform(pairs, place))), count)

        def count(low: Column) -> Column:
            return _let(low, lambda p: F.aggregate(
                F.arrays_zip(p.alias("x"), F.concat(F.array(F.lit(-3).cast("long")), p).alias("b")),
                F.lit(0).cast("long"), lambda acc, z: F.when(z["x"].isNull(), acc).otherwise(
                    acc + F.least(F.lit(3).cast("long"), z["x"] - z["b"]))))

        return F.when(n < 2, F.lit(0).cast("long")).otherwise(_let(packed, twice))

    bits = F.length(F.bin(F.size(words).cast("long")))
    return _let(F.struct(words.alias("w"), (F.size(words) - 2).alias("n"), bits.alias("b"),
                         _shift("shiftleft", F.lit(1).cast("long"), bits).alias("m")), covered)


def symbol_heavy(m: Measures) -> Column:
    return m.n_symbols * 10 > m.n_words


def odd_word_length(m: Measures) -> Column:
    return (m.word_chars < m.n_words * 2) | (m.word_chars > m.n_words * 15)


def repeated_lines(m: Measures) -> Column:
    """More than half of the lines with a word repeat an earlier one."""
    return m.n_dup_lines * 2 > F.regexp_count(m.text, F.lit(r"(?md)^[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D]"))


def few_letter_words(m: Measures) -> Column:
    """Fewer than four in five words hold a letter."""
    bare = F.regexp_count(m.text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]+(?![^\x20\x09-\x0D])"))
    return bare * 5 > m.n_words


def shouting(m: Measures) -> Column:
    """Capitals are over three in ten of the characters in words."""
    return F.regexp_count(m.text, F.lit(r"\p{Lu}")) * 10 > m.word_chars * 3


def list_only(m: Measures) -> Column:
    """Over nine in ten of the lines with a word open with a bullet."""
    lines = F.regexp_count(m.text, F.lit(r"(?md)^[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D]"))
    return F.regexp_count(m.text, F.lit("(?md)^[\\x20\\x09]*[-*•][\\x20\\x09]")) * 10 > lines * 9


RULES = tuple(Rule(f.__name__, f) for f in (symbol_heavy, odd_word_length, repeated_lines, few_letter_words, shouting,
                                            list_only))


def with_measures(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with the five base measures; the dict gives each measure's column in the result."""
    names = {k: fresh(docs, k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    words, lines = fresh(docs, "q_words"), fresh(docs, "q_lines")
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.withColumn(words, word_array(F.col("text"))).withColumn(
        lines, F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    return split.withColumns({
        names["n_words"]: F.size(words).cast("long"),
        names["word_chars"]: F.char_length(F.array_join(words, "")).cast("long"),
        names["n_symbols"]: F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        names["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        names["n_repeat_words"]: repeat_words(F.col(words)),
    }).drop(words, lines), names


def _measures(names: dict[str, str]) -> Measures:
    return Measures(F.coalesce(F.col("text"), F.lit("")), *(F.col(names[k]) for k in
                                                            ("n_words", "word_chars", "n_symbols", "n_dup_lines")))


def base_failed(names: dict[str, str]) -> Column:
    return (F.col(names["n_words"]) < MIN_WORDS) | (
        F.col(names["n_repeat_words"]) * 100 > F.col(names["n_words"]) * MAX_REPEAT_PERCENT)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a bounded sample, best first."""
    # collected, as a limit inside a plan takes that many rows from every partition of the table
    first = docs.select("text").where(F.octet_length("text") <= SAMPLE_BYTES).limit(sample_rows).collect()
    measured, names = with_measures(docs.sparkSession.createDataFrame([(r[0],) for r in first], "text string"))
    sample = cut(measured)
    found = {}
    for rule in rules:
        hits = F.coalesce(F.sum(rule.rejects(_measures(names)).cast("int")), F.lit(0))
        spent = []
        for _ in range(2):
            began = time.perf_counter()
            n = sample.agg(hits.alias("n")).first()[0]
            spent.append(time.perf_counter() - began)
        found[rule.name] = n / min(spent)
    return sorted(rules, key=lambda r: (-found[r.name], r.name))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES,
           sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, dict[str, str]]:
    """docs with the measures, ``base_failed`` and ``kept``; the dict gives the columns' names."""
    ordered = order_rules(docs, rules, sample_rows)
    out, names = with_measures(docs)
    m, verdict = _measures(names), F.when(base_failed(names), F.lit(False))
    for rule in ordered:
        verdict = verdict.when(rule.rejects(m), F.lit(False))
    failed, kept = fresh(docs, "base_failed"), fresh(docs, "kept")
    out = out.withColumn(failed, base_failed(names)).withColumn(kept, verdict.otherwise(F.lit(True)))
    return out, names | {"base_failed": failed, "kept": kept}


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that pass, with their own columns."""
    out, names = judged(docs, rules, sample_rows)
    # a filter below the measures would repeat them for each of its terms; it does not pass a partition number
    here = fresh(out, "q_here")
    held = out.withColumn(here, F.spark_partition_id()).where(F.col(names["kept"]) & (F.col(here) >= 0))
    return held.select(*(F.col(f"`{c}`") for c in docs.columns))
