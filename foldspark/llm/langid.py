"""Language identification with interpolated Kneser-Ney character models.

One model per language over letters in lower case and single gaps, up to ``ORDER``
characters: for each order a sorted array of n-gram hashes beside their log probabilities,
and one of context hashes beside the weights that they pass to the shorter order. Counts,
discounts and probabilities come from Spark joins and sums; the driver gathers the finished
arrays, order by order. A text's cross-entropy under each model, divided by its length,
picks the language; a softmax whose sharpness is calibrated on documents that were not
counted gives the score, and texts whose best cross-entropy exceeds nearly all of those
documents' are flagged as rejected.

The models are fitted on a bounded sample: at most about ``DOCS`` labelled documents a
language and ``ALL_DOCS`` of all languages, of ``DOC_CHARS`` characters at most, and half as
many again for calibration; a language with fewer than ``FEW`` such documents also takes
pieces of its longer ones. Arrays hold only what a language has seen, so the models grow
with the sample, not with the number of languages times all n-grams.
Every text is scored whole. Defined cases: a null text and one without letters give
``und`` and 0; ties go to the first language by name; without labels every text is ``und``.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm.bagminhash import GOLDEN, mix
from foldspark.llm.common import cut

ORDER, DOCS, ALL_DOCS, DOC_CHARS, FEW = 5, 800, 12_800, 40_000, 10
#: The chance of a character that no model knows.
FLOOR = 1.0 / 2_000
UNKNOWN = "und"
CHUNK = 1 << 20


@functools.lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """For every code point the code of its lower-case letter, 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single gaps of the texts with ORDER gaps between texts, and each one's text (-1: a gap between)."""
    texts = [t or "" for t in texts]
    space = "\0" * ORDER
    joined = space + space.join(texts) + space
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    codes = letter_codes()[points]
    size = np.array([len(t) for t in texts])
    ends = np.cumsum(size + ORDER) + ORDER
    owner = np.full(len(codes), -1, np.int64)
    first = ends - ORDER - size
    owner[np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())] = np.repeat(
        np.arange(len(texts)), size)
    before = np.concatenate([[0], codes[:-1]])
    keep = (codes != 0) | (before != 0) | (owner < 0)
    return codes[keep], owner[keep]


def grams(codes: np.ndarray) -> list[np.ndarray]:
    """grams(codes)[n][i]: hash of the n characters that end at i; n from 0 to ORDER."""
    out = [np.full(len(codes), np.uint64(1))]
    c = (codes.astype(np.uint64) + np.uint64(1)) * GOLDEN
    for _ in range(ORDER):
        before = np.empty_like(out[-1])
        before[0], before[1:] = np.uint64(1), out[-1][:-1]
        out.append(mix(before + c))
    return out


def _chunks(texts: list[str | None]):
    at, held, size = 0, [], 0
    for t in texts:
        held.append(t)
        size += len(t or "") + 50
        if size >= CHUNK:
            yield at, held
            at, held, size = at + len(held), [], 0
    if held:
        yield at, held


def _count(languages: list[str]):
    """Map batches of (text, lang) to (lang, n, gram, context, suffix, times); lang is the place in languages."""
    code = {x: i for i, x in enumerate(languages)}

    def run(batches):
        for batch in batches:
            frame = batch.to_pandas()
            for lang, part in frame.groupby("lang"):
                for _, texts in _chunks(part["text"].tolist()):
                    codes, owner = characters(texts)
                    h, at = grams(codes), np.flatnonzero(owner >= 0)
                    for n in range(1, ORDER + 1):
                        gram, first, times = np.unique(h[n][at], return_index=True, return_counts=True)
                        where = at[first]
                        yield pa.record_batch(
                            [pa.array(np.full(len(gram), code[lang], np.int32)), pa.array(np.full(len(gram), n, np.int32)),
                             pa.array(gram.view(np.int64)), pa.array(h[n - 1][where - 1].view(np.int64)),
                             pa.array(h[n - 1][where].view(np.int64)), pa.array(times.astype(np.int64))],
                            ["lang", "n", "gram", "context", "suffix", "times"])

    return run


def smoothed(counts: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Interpolated Kneser-Ney: for each order (lang, gram, chance), and (lang, n, context, passed) of all orders.

    The longest grams weigh what they occur, shorter ones in how many ways longer grams
    continue to them. A context gives up the discount of each kind that follows it.
    """
    n = F.col("n")
    ways = counts.where(n > 1).groupBy("lang", (n - 1).alias("n"), F.col("suffix").alias("gram")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"))
    shorter = counts.where(n < ORDER).drop("times").join(ways, ["lang", "n", "gram"])
    weighed = cut(shorter.unionByName(counts.where(n == ORDER).withColumn("weight", F.col("times").cast("double")).drop("times")))
    once, twice = F.count_if(F.col("weight") == 1), F.count_if(F.col("weight") == 2)
    discount = F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.when(once > 0, once / (once + 2 * twice)).otherwise(0.5)))
    discounts = F.broadcast(weighed.groupBy("lang", "n").agg(discount.alias("discount")))    # one row per language and order
    contexts = cut(weighed.groupBy("lang", "n", "context").agg(
        F.sum("weight").alias("total"), F.count(F.lit(1)).alias("kinds")).join(discounts, ["lang", "n"]).select(
        "lang", "n", "context", "total", "discount", (F.col("discount") * F.col("kinds") / F.col("total")).alias("passed")))
    own = weighed.join(contexts, ["lang", "n", "context"]).select(
        "lang", "n", "gram", "suffix", "passed", (F.greatest(F.col("weight") - F.col("discount"), F.lit(0.0)) / F.col("total")).alias("kept"))
    own, orders = cut(own), []
    for k in range(1, ORDER + 1):
        here = own.where(n == k)
        if k == 1:
            below = F.lit(FLOOR)
        else:
            lower = orders[-1].select("lang", F.col("gram").alias("suffix"), F.col("chance").alias("below"))
            here, below = here.join(lower, ["lang", "suffix"]), F.col("below")
        orders.append(cut(here.select("lang", "gram", (F.col("kept") + F.col("passed") * below).alias("chance"))))
    return orders, contexts.select("lang", "n", "context", "passed")


def _arrays(table: DataFrame, n_languages: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each language the sorted hashes of a table (lang, hash, value) and the values' logarithms."""
    held = table.toArrow()
    lang, hashes, value = (held.column(i).to_numpy() for i in range(3))
    hashes = hashes.view(np.uint64)
    order = np.lexsort((hashes, lang))
    cuts = np.searchsorted(lang[order], np.arange(n_languages + 1))
    hashes, logs = hashes[order], np.log(value[order]).astype(np.float32)
    return [(hashes[a:b], logs[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def _find(sorted_hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted hash in a sorted array, -1 where it is missing."""
    if not len(sorted_hashes):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_hashes, wanted), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == wanted, at, -1)


class Models:
    """Sorted hash arrays of each language: grams[n - 1][j] and passes[n - 1][j] are (hashes, logarithms)."""

    def __init__(self, languages: list[str], grams: list[list], passes: list[list]):
        self.languages, self.grams, self.passes = languages, grams, passes
        self.sharpness, self.limits = 30.0, np.full(len(languages), np.inf)
        self.none = np.float32(np.log(FLOOR))

    def _logs(self, j: int, h: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Log probability under language j of the character at each place, given those before it."""
        score, left = np.zeros(len(at), np.float32), np.arange(len(at))
        for n in range(ORDER, 0, -1):                  # longest first; what is missing goes on to the shorter order
            hashes, logs = self.grams[n - 1][j]
            found = _find(hashes, h[n][at[left]])
            hit = found >= 0
            score[left[hit]] += logs[found[hit]]
            left = left[~hit]
            if not len(left):
                return score
            hashes, logs = self.passes[n - 1][j]
            context = _find(hashes, h[n - 1][at[left] - 1])
            known = context >= 0
            score[left[known]] += logs[context[known]]
        score[left] += self.none
        return score

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of every text under every language, and its number of letters."""
        k = len(self.languages)
        out, letters = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
        for start, part in _chunks(texts):
            codes, owner = characters(part)
            at = np.flatnonzero(owner >= 0)
            if not len(at):
                continue
            h, mine = grams(codes), owner[at]
            # the longest gram decides the chance, so each one is looked up once
            _, first, place = np.unique(h[ORDER][at], return_index=True, return_inverse=True)
            size = np.maximum(np.bincount(mine, minlength=len(part)), 1)
            for j in range(k):
                logs = self._logs(j, h, at[first])
                out[start:start + len(part), j] = -np.bincount(mine, logs[place], len(part)) / size
            letters[start:start + len(part)] = np.bincount(mine[codes[at] != 0], minlength=len(part))
        return out, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of every text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        entropy, letters = self.entropies(texts)
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(texts)), best]
        score = 1.0 / np.exp(-self.sharpness * (entropy - least[:, None])).sum(axis=1)
        lang = [self.languages[b] if n else UNKNOWN for b, n in zip(best, letters)]
        return lang, np.where(letters > 0, score, 0.0), (letters == 0) | (least > self.limits[best])

    def calibrate(self, texts: list[str], truth: list[str]) -> None:
        """Sharpness by likelihood, and per language a limit that one right document in two hundred passes."""
        entropy, letters = self.entropies(texts)
        code = np.array([self.languages.index(t) for t in truth])
        use = letters > 0
        if not use.any():
            return
        e, c = entropy[use], code[use]
        rows = np.arange(len(e))
        gap = e - e.min(axis=1, keepdims=True)
        cost = {s: (np.log(np.exp(-s * gap).sum(axis=1)) + s * gap[rows, c]).mean() for s in 2.0 ** np.arange(0, 10)}
        self.sharpness = min(cost, key=cost.get)
        right = e.argmin(axis=1) == c
        for j in range(len(self.languages)):               # languages with few documents share one limit
            mine = e[right & (c == j), j]
            mine = mine if len(mine) >= 20 else e[right].min(axis=1)
            if len(mine) >= 20:
                self.limits[j] = np.quantile(mine, 0.995)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _pieces(doc_chars: int):
    """Map batches of (doc_id, lang, text) to pieces of whole lines; a line over the bound is divided."""

    def run(batches):
        for batch in batches:
            for doc_id, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                out, held, size = [], [], 0
                for line in text.split("\n"):
                    for at in range(0, max(1, len(line)), doc_chars):
                        part = line[at:at + doc_chars]
                        if held and size + len(part) + 1 > doc_chars:
                            out.append("\n".join(held))
                            held, size = [], 0
                        held.append(part)
                        size += len(part) + 1
                out.append("\n".join(held))
                yield pa.record_batch([pa.array([doc_id] * len(out), pa.int64()), pa.array([lang] * len(out), pa.string()),
                                       pa.array(out, pa.string()), pa.array(range(len(out)), pa.int32())],
                                      ["doc_id", "lang", "text", "piece"])

    return run


def fit(labelled: DataFrame, docs: int = DOCS, doc_chars: int = DOC_CHARS) -> Models:
    """Models from (doc_id, text, lang) rows."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    short = F.char_length("text") <= doc_chars
    per = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count_if(short).alias("n")).collect()}
    usable = known.where(short).select("doc_id", "text", "lang", F.lit(None).cast("int").alias("piece"))
    scarce = [lang for lang, n in per.items() if n < FEW]
    if scarce:                                              # these also learn from pieces of their long documents
        pieces = known.where(F.col("lang").isin(scarce) & ~short).select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(
            _pieces(doc_chars), "doc_id long, lang string, text string, piece int")
        for r in pieces.groupBy("lang").agg(F.count("*").alias("n")).collect():
            per[r["lang"]] += r["n"]
        usable = usable.unionByName(pieces)
    if not per:
        return Models([], [], [])
    docs = min(docs, max(1, ALL_DOCS // len(per)))
    shares = F.broadcast(usable.sparkSession.createDataFrame(           # one row per language
        [(lang, min(1.0, 1.5 * docs / max(n, 1)), n < FEW) for lang, n in per.items()], "lang string, share double, few boolean"))
    draw = lambda salt: F.pmod(F.xxhash64("doc_id", "piece", F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # all documents of languages with few are counted, none calibrate
    sample = usable.join(shares, "lang").where(draw(1) < F.col("share")).select(
        "text", "lang", ((draw(2) < 2 / 3) | F.col("few")).alias("count"))
    languages = sorted(per)
    counts = cut(sample.where("count").select("text", "lang").mapInArrow(
        _count(languages), "lang int, n int, gram long, context long, suffix long, times long").groupBy(
        "lang", "n", "gram", "context", "suffix").agg(F.sum("times").alias("times")))
    orders, contexts = smoothed(counts)
    k = len(languages)
    grams_of = [_arrays(t, k) for t in orders]
    passes_of = [_arrays(contexts.where(F.col("n") == n).select("lang", "context", "passed"), k) for n in range(1, ORDER + 1)]
    seen = [j for j in range(k) if len(grams_of[0][j][0])]              # a language without a character has no model
    models = Models([languages[j] for j in seen], *([[t[j] for j in seen] for t in x] for x in (grams_of, passes_of)))
    held = sample.where(~F.col("count")).select("text", "lang").toArrow().to_pylist()
    held = [(r["text"], r["lang"]) for r in held if r["lang"] in set(models.languages)]
    models.calibrate([t for t, _ in held], [x for _, x in held])
    return models


def predicted(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)      # bounded by the sample it was fitted on

    def run(batches):
        for batch in batches:
            lang, score, rejected = shared.value.predict(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                   pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean")
