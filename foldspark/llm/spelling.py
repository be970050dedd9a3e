"""Spelling variants: words one edit apart, found by sorting permuterm rotations.

A word p c s, marked with a terminator and turned so that its character c stands last, reads
s $ p c. All words that differ from it in this one character share the prefix s $ p, and the
word without it, p s, turned to s $ p, is that prefix itself. So the rotations are sorted by
the prefix that leaves out the edited character (the shorter words' rotations enter whole),
range-partitioned, and each group of equal prefixes is scanned once: every member learns the
number of its neighbours there and the best of them, the group's first in order of
occurrences, or the second if it is the first itself. No pairs are made. A group holds one
word per character, so the alphabet bounds it (at most 91 rows for the runs of the query);
there is no hot group, whatever the words' occurrences.

A character that stands in a run of equal ones can be left out at each place of the run with
one result; only the first place counts, so every pair is counted once.

Counting is a hash aggregate with partial sums before its shuffle. The words and the forms
are written tables, so lost executors repeat no counting.

Defined cases: null texts and words have no part; a null doc_id deletes nothing; words that
hold the terminator (U+0000) have no neighbours; empty tables give empty results; other
columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foldspark.llm.common import LOWER, UPPER, cut, partitions

#: The letters of a run, the least length and occurrences of a word, and a
#: form's least advantage.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
LEAST_CHARS, LEAST_COUNT, ADVANTAGE = 6, 5, 5
END = "\0"


def without(word: Column, i: Column) -> Column:
    """word without its code point i (from 0)."""
    return F.concat(F.substring(word, F.lit(1), i), F.substring(word, i + 2, F.char_length(word)))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): lower-cased runs of at least six letters, some with a letter deleted by keyed hash, and occurrences.

    A shorter run cannot give a word, so the pattern starts at six letters.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{LEAST_CHARS},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    marked = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    words = marked.select(F.when(F.col("h") % 199 == 0, without(F.col("run"), at)).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= LEAST_CHARS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= LEAST_COUNT)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, word, n, skips, first): every rotation of every marked word.

    ``skips`` 1: the rotation's last character is left out of the prefix; ``first``: it is the
    first of a run of equal ones. ``skips`` 0: the whole rotation.
    """
    chars = F.char_length("word")
    turned = words.where(~F.contains("word", F.lit(END))).select(
        "word", "n", F.explode(F.sequence(F.lit(0), chars)).alias("i"))
    i = F.col("i")
    head, rest = F.substring("word", F.lit(1), i), F.substring(F.col("word"), i + 1, chars)
    whole = turned.select(F.concat(rest, F.lit(END), head).alias("prefix"), "word", "n",
                          F.lit(0).alias("skips"), F.lit(False).alias("first"))
    starts = (i == 0) | (F.substring("word", i + 1, F.lit(1)) != F.substring("word", i, F.lit(1)))
    skipped = turned.where(i < chars).select(
        F.concat(F.substring(F.col("word"), i + 2, chars), F.lit(END), head).alias("prefix"), "word", "n",
        F.lit(1).alias("skips"), starts.alias("first"))
    return whole.unionByName(skipped)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): near-word count, and the near word of most occurrences, smallest first.

    ``words`` has one row per word; those without a near word have no row in the result.
    """
    turned = rotations(words)
    parts = partitions(words, 4 << 20)
    placed = turned.repartitionByRange(parts, "prefix")     # the windows below need no other exchange
    group = W.partitionBy("prefix")
    order = group.orderBy(F.col("n").desc(), "word").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    top = F.struct((-F.col("n")).alias("neg"), "word")
    scanned = placed.select(
        "word", "skips", "first", F.first(top).over(order).alias("a"), F.nth_value(top, 2).over(order).alias("b"),
        F.sum("skips").over(group).alias("skipping"), F.sum(1 - F.col("skips")).over(group).alias("wholes"),
        F.sum(F.when(F.col("first"), 1).otherwise(0)).over(group).alias("firsts"))
    near = F.when(F.col("skips") == 1, F.col("skipping") - 1 + F.when(F.col("first"), F.col("wholes")).otherwise(0)).otherwise(F.col("firsts"))
    found = scanned.where("b is not null").select(
        "word", near.alias("near"), F.when(F.col("a.word") == F.col("word"), F.col("b")).otherwise(F.col("a")).alias("best"))
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return best.select("word", "n_near", (-F.col("best.neg")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form (word, form): the last one that forms lead to.

    Every form has more occurrences than its word, so there is no cycle; each round doubles
    the steps taken.
    """
    links = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("at"), F.col("root").alias("next"))
        told = cut(links.join(onward, links["root"] == onward["at"], "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = told.select("word", "root")
        if told.where("moved").isEmpty():
            return links


def variants(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every row of words (word, n; one row per word)."""
    words = cut(words.select("word", "n").where("word is not null"))
    near = cut(neighbours(words))
    better = F.col("best_n") >= ADVANTAGE * F.col("n")
    formed = cut(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n")))
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Variants of all words of the documents."""
    return variants(word_counts(docs))
