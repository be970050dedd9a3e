"""Removal of every byte inside a string of ``least`` bytes that also starts elsewhere.

Recursive induction over sampled suffixes, with all sorting left to Spark's disk-backed
shuffles. A suffix is sampled where a 64-byte gram has the least hash among the grams of
some ``least``-byte window; a window depends on nothing but its own bytes, so equal windows
have equal samples at the same distance, and every window belongs to one sampled suffix.
Suffix tuples get names and are brought together by them:

* the gram itself is a common prefix of all windows of a sample; where its name occurs once,
  no window of it repeats;
* the union of a sample's windows has a name too; where that occurs twice, all of them repeat;
* the rest induce tuples for narrower ranges of windows (64, 8 and 1 wide): the bytes that
  all windows of a range share decide again whether any can repeat, their union whether all
  do. Only the ends of repeated passages go down to single windows.

Names are 64-bit polynomial hashes of the bytes with their place, mixed; the work is in
proportion to the input, and a passage that a third of all documents hold is a hot key of
counts that are combined before the shuffle and of joins that split skew.

Defined cases: a null or empty text has no bytes; documents shorter than ``least`` lose
nothing; equal rows are copies of each other, also when the id repeats; matches may
overlap and never cross documents.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.bagminhash import GOLDEN, mix
from foldspark.llm.common import cut

LEAST, GRAM = 400, 64
WIDTHS = (64, 8, 1)
#: Bytes of a text that are looked at together; longer texts go in pieces that overlap by a window.
PIECE = 1 << 20
BASE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LETTERS = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GOLDEN)


class Powers:
    """Powers of the base and of its inverse modulo 2^64, grown as needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            size = 1 << int(np.ceil(np.log2(n)))
            for name, step in (("up", BASE), ("down", INVERSE)):
                held = np.full(size, step)
                held[0] = 1
                setattr(cls, name, np.multiply.accumulate(held))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    Powers.reach(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTERS[data] * Powers.up[:len(data)], out=out[1:])
    return out


def names(sums: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Names of the strings [start, end), told apart by their length and a salt."""
    raw = (sums[end] - sums[start]) * Powers.down[start]
    return mix(mix(raw + (end - start).astype(np.uint64) * GOLDEN) + salt.astype(np.uint64) * GOLDEN).view(np.int64)


def samples(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, first, last): each sampled position with the first and the last window that belongs to it."""
    n, s = len(data), least - GRAM + 1
    sums = prefix_sums(data)
    at = np.arange(n - GRAM + 1)
    g = mix((sums[at + GRAM] - sums[at]) * Powers.down[at])
    rows = -(-len(g) // s)
    high = np.full(rows * s, np.uint64(0xFFFFFFFFFFFFFFFF))
    high[:len(g)] = g
    bits = np.uint64((1 << (2 * s).bit_length()) - 1)
    local = np.arange(s, dtype=np.uint64)
    high = (high & ~bits).reshape(rows, s)
    # least hash of each window, the leftmost among equals: the end of its block or the start of the next one
    end = np.minimum.accumulate((high | local)[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    begin = np.minimum.accumulate(high | (local + np.uint64(s)), axis=1).reshape(-1)
    p = np.arange(n - least + 1)
    gram = p // s * s + (np.minimum(end[p], begin[p + s - 1]) & bits).astype(np.int64)
    first = np.flatnonzero(np.diff(gram, prepend=-1))
    return gram[first], p[first], np.append(first[1:], len(p)) - 1


def _pieces(data: np.ndarray, least: int):
    for start in range(0, max(len(data) - least + 1, 0), PIECE):
        yield start, data[start:start + PIECE + least - 1]


def _tuples(least: int):
    """Suffix tuples of every text: place, windows, and the names of their gram and of their union."""
    columns = ["doc", "mark", "gram", "first", "last", "core", "whole"]

    def run(batches):
        for batch in batches:
            doc, mark = batch.column(0), batch.column(1)
            texts = batch.column(2).cast(pa.binary())
            out, counts = [], np.zeros(len(doc), np.int64)
            for i, text in enumerate(texts):
                data = np.frombuffer(text.as_buffer() if text.is_valid else b"", np.uint8)
                for start, piece in _pieces(data, least):
                    gram, first, last = samples(piece, least)
                    sums = prefix_sums(piece)
                    core = names(sums, gram, gram + GRAM, np.zeros(len(gram), np.int64))
                    whole = names(sums, first, last + least, gram - first + 1)
                    out.append((gram + start, first + start, last + start, core, whole))
                    counts[i] += len(gram)
            if not out:
                continue
            row = pa.array(np.repeat(np.arange(len(doc)), counts))
            flat = [np.concatenate(x) for x in zip(*out)]
            yield pa.record_batch([doc.take(row), mark.take(row), *(pa.array(x) for x in flat)], columns)

    return run, "doc long, mark long, gram long, first long, last long, core long, whole long"


def _repeated(rows: DataFrame, column: str) -> DataFrame:
    """The values of a column that occur twice or more, as a table: a join with it can split hot values."""
    return cut(rows.groupBy(column).agg(F.count("*").alias("c")).where("c > 1").select(F.col(column).alias(f"{column}_again")))


def _settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled, going on): tuples whose whole repeats, and those that need narrower ranges.

    A tuple goes on if its core repeats and its whole does not. One of each settled kind
    goes on too where open tuples share its core (``seen``): it is their possible partner.
    """
    held = cut(rows.join(_repeated(rows, "core"), F.col("core") == F.col("core_again"), "left_semi"))
    again = _repeated(held, "whole")
    held = cut(held.join(again, F.col("whole") == F.col("whole_again"), "left").withColumn(
        "all", F.col("whole_again").isNotNull()).drop("whole_again"))
    is_open = ~F.col("all") & ~F.col("seen")
    cores = cut(held.where(is_open).select(F.col("core").alias("c")).distinct())
    names_ = [c for c in held.columns if c not in ("whole", "all", "seen")]
    partners = held.where(~is_open).join(cores, F.col("core") == F.col("c"), "left_semi").groupBy("whole").agg(
        F.min(F.struct(*names_)).alias("one")).select("one.*", F.lit(True).alias("seen"))
    going = held.where(is_open).select(*names_, "seen").unionByName(partners)
    return held.where("all"), going


def _contexts(least: int):
    """The bytes of the windows that are not settled."""
    def run(batches):
        for batch in batches:
            doc, mark, texts, lists = (batch.column(i) for i in range(4))
            texts = texts.cast(pa.binary())
            rows, parts = [], []
            for i, text in enumerate(texts):
                data = text.as_py()
                for x in lists[i].as_py():
                    rows.append((i, x["gram"], x["first"], x["last"], x["seen"]))
                    parts.append(data[x["first"]:x["last"] + least])
            if rows:
                i, gram, first, last, seen = (np.array(x) for x in zip(*rows))
                at = pa.array(i)
                yield pa.record_batch(
                    [doc.take(at), mark.take(at), pa.array(gram), pa.array(first), pa.array(last), pa.array(seen),
                     pa.array(parts, pa.binary())], ["doc", "mark", "gram", "first", "last", "seen", "bytes"])

    return run, "doc long, mark long, gram long, first long, last long, seen boolean, bytes binary"


def _induced(least: int, width: int, wider: int):
    """Tuples of the ranges of ``width`` distances inside each open range of ``wider`` ones."""
    columns = ["at", "doc", "mark", "gram", "seen", "lo", "hi", "core", "whole"]
    most = least - GRAM

    def run(batches):
        for batch in batches:
            at, doc, mark, grams, last, data, open_ranges = (batch.column(c) for c in (
                "at", "doc", "mark", "gram", "last", "bytes", "ranges"))
            rows, seen, lo, hi, core, whole = [], [], [], [], [], []
            firsts = batch.column("first").to_numpy(zero_copy_only=False)
            gram, final = (x.to_numpy(zero_copy_only=False) for x in (grams, last))
            for i in range(batch.num_rows):
                piece = np.frombuffer(data[i].as_buffer(), np.uint8)
                sums = prefix_sums(piece)
                g = gram[i] - firsts[i]                               # the gram's place in the bytes
                low, high = gram[i] - final[i], gram[i] - firsts[i]   # distances from windows to the gram
                found = [(np.arange(max(low, x["r"] * wider) // width, min(high, x["r"] * wider + wider - 1) // width + 1),
                          x["seen"]) for x in open_ranges[i].as_py()]
                k = np.concatenate([x[0] for x in found])
                seen.append(np.concatenate([np.full(len(x[0]), x[1]) for x in found]))
                begin, end = k * width, np.minimum(k * width + width - 1, most)
                a, b = np.maximum(begin, low), np.minimum(end, high)
                lo.append(a)
                hi.append(b)
                core.append(names(sums, g - begin, g + least - end, begin + 1))
                whole.append(names(sums, g - b, g + least - a, a * 1024 + b + 1))
                rows.append(len(k))
            if rows:
                row = pa.array(np.repeat(np.arange(len(rows)), rows))
                flat = [np.concatenate(x) for x in (seen, lo, hi, core, whole)]
                yield pa.record_batch([at.take(row), doc.take(row), mark.take(row), grams.take(row),
                                       *(pa.array(x) for x in flat)], columns)

    return run, "at long, doc long, mark long, gram long, seen boolean, lo long, hi long, core long, whole long"


def repeated_windows(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc, mark, start, end): byte ranges that cover what repeats; ranges of a document may overlap."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("mark"), "text").where(
        F.octet_length("text") >= least)
    run, schema = _tuples(least)
    settled, going = _settle(cut(texts.mapInArrow(run, schema)).withColumn("seen", F.lit(False)))
    found = settled.select("doc", "mark", F.col("first").alias("start"), (F.col("last") + least).alias("end"))
    still = going.groupBy(F.col("doc").alias("d"), F.col("mark").alias("m")).agg(
        F.collect_set(F.struct("gram", "first", "last", "seen")).alias("windows"))
    run, schema = _contexts(least)
    open_texts = texts.join(still.hint("shuffle_hash"), F.col("doc").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
    held = cut(open_texts.select("doc", "mark", "text", "windows").mapInArrow(run, schema).withColumn(
        "at", F.monotonically_increasing_id()))
    ranges, wider = held.select("at", F.array(F.struct(F.lit(0).cast("long").alias("r"), "seen")).alias("ranges")), 1 << 20
    for width in WIDTHS:
        run, schema = _induced(least, width, wider)
        settled, going = _settle(cut(held.drop("seen").join(ranges, "at").mapInArrow(run, schema)))
        start, end = F.col("gram") - F.col("hi"), F.col("gram") - F.col("lo") + least
        found = found.unionByName(settled.select("doc", "mark", start.alias("start"), end.alias("end")))
        ranges = going.groupBy("at").agg(F.collect_list(F.struct(
            F.floor(F.col("lo") / width).cast("long").alias("r"), "seen")).alias("ranges"))
        wider = width
    return found


def merged(ranges: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of sorted or unsorted ranges; ranges that touch are one run."""
    if not ranges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.array(sorted(ranges), np.int64)
    ends = np.maximum.accumulate(pairs[:, 1])
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:, 0] > ends[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(pairs) - 1)
    return pairs[new, 0], ends[last]


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (start, end) and the bytes that stay, for every row of docs."""
    cover = repeated_windows(docs, least).groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = texts.join(cover.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("doc")) & (F.xxhash64("text") == F.col("mark")),
                        "left").select("doc_id", "text", "found")

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            rows = []
            for text, found in zip(texts, batch.column(2).to_pylist()):
                text = text or b""
                starts, ends = merged([(x["start"], x["end"]) for x in found or []])
                edges = [0, *np.stack([starts, ends], 1).ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((len(text), len(text) - len(kept), list(zip(starts.tolist(), ends.tolist())), kept))
            spans = [[{"start": a, "end": b} for a, b in r[2]] for r in rows]
            yield pa.record_batch(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([len(r[2]) for r in rows], pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array([r[3] for r in rows], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, "
                                  "spans array<struct<start: long, end: long>>, kept binary")


def brute_force(texts: list[bytes], least: int = LEAST) -> list[np.ndarray]:
    """For tests: a mask of removed bytes for each text, by looking every window up."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - least + 1):
            seen[t[p:p + least]] = seen.get(t[p:p + least], 0) + 1
    out = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for p in range(len(t) - least + 1):
            if seen[t[p:p + least]] > 1:
                mask[p:p + least] = True
        out.append(mask)
    return out
