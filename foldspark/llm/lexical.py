"""Ranked lexical search by scanning documents with an automaton of all item terms.

Items are queries against all documents, and no index of the documents is built. The terms
of all items become one Aho-Corasick automaton whose patterns carry a boundary character on
both sides; a text, with everything between its terms turned into that character, is read
through it once, and the outputs are the item terms that occur in it as whole terms. That
scan leaves one row per document: its length in terms and the occurrences of item terms.
From these rows come N, L and each term's document frequency; a second pass over them maps
terms to items and keeps each task's k best documents of each item, and a window over these
ranks them. So a document is never paired with all items outside one task's matrix.

Size: the automaton and the terms' items are broadcast. Items are dealt to blocks by hash
so that a block's terms stay near BLOCK_BYTES; every block has its own automaton, scan
and ranking, and each item is in one block. A scan is written to the shared folder, so a
lost executor repeats only its own tasks. Terms that every document holds are no hot key:
nothing is shuffled by term but counts that are summed before.

Integer arithmetic is 64 bits wide throughout; weights are taken in doubles and floored.

Defined cases: null and empty texts have no terms and are in neither N nor any ranking;
items without terms, or without a document of score above 0, have no row; every row of the
items is an item of its own, repeated ids too; every row of the documents is a document;
equal scores go by ascending doc_id, null last; empty tables give empty results; other
columns are not used.
"""

from __future__ import annotations

import collections
import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foldspark.llm.common import LOWER, UPPER, cut

#: Bytes that no term holds (all terms' other bytes are from 0x30 on), and the
#: scale of scores.
_TERM = set(b"0123456789" + UPPER.encode() + LOWER.encode()) | set(range(128, 256))
TABLE = bytes(ord(chr(b).lower()) if b in UPPER.encode() else b if b in _TERM else 32 for b in range(256))
SCALE = 1_000_000_000
#: Bytes of terms in a block of items, and cells of a task's matrix of documents by items.
BLOCK_BYTES, CELLS = 16 << 20, 2_000_000


def spread(text: str | None) -> bytes:
    """The bytes of a text with A-Z lower-cased and one boundary at each place outside its terms."""
    return b" " + (text or "").encode().translate(TABLE) + b" "


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, term, times): the terms of every row of the items; item numbers the rows."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = [(i, key, term, n) for i, key, t in zip(*(c.to_pylist() for c in batch.columns))
                   for term, n in collections.Counter(spread(t).split()).items()]
            item, key, term, n = zip(*out) if out else ((), (), (), ())
            yield pa.record_batch([pa.array(item, pa.int64()), pa.array(key, batch.column(1).type),
                                   pa.array(term, pa.binary()), pa.array(n, pa.int64())], ["item", "item_id", "term", "times"])

    return rows.mapInArrow(run, f"item long, item_id {kind}, term binary, times long")


def automaton(terms: list[bytes]) -> ahocorasick.Automaton:
    """Patterns with their boundaries, read as one character per byte; outputs are positions in terms."""
    machine = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        machine.add_word(f" {term.decode('latin-1')} ", i)
    machine.make_automaton()
    return machine


def scanned(docs: DataFrame, terms: list[bytes], doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, found, tf): per document with a term, its length in terms and the item terms it holds."""
    machine = docs.sparkSession.sparkContext.broadcast(automaton(terms) if terms else None)

    def run(batches):
        read = machine.value
        for batch in batches:
            ids, ns, found, tf, ends = [], [], [], [], [0]
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                line = spread(t.as_py())
                inside = np.frombuffer(line, np.uint8) != 32
                n = int(np.count_nonzero(inside[1:] & ~inside[:-1]))
                if n:
                    held = collections.Counter(i for _, i in read.iter(line.decode("latin-1"))) if read is not None else {}
                    ids.append(key)
                    ns.append(n)
                    found.extend(held.keys())
                    tf.extend(held.values())
                    ends.append(len(found))
            at = pa.array(ends, pa.int32())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()),
                                   pa.ListArray.from_arrays(at, pa.array(found, pa.int32())),
                                   pa.ListArray.from_arrays(at, pa.array(tf, pa.int64()))], ["doc_id", "n", "found", "tf"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n long, found array<int>, tf array<bigint>")


class Best:
    """The k best (score, doc_id) of each item among the documents a task has seen."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)      # the least score that can still matter
        self.kept = [np.zeros(0, np.int64)] * 4                 # item, score, doc_id is null, doc_id

    def add(self, scores: np.ndarray, lost: np.ndarray, ids: np.ndarray) -> None:
        """scores: documents by items."""
        row, item = np.nonzero(scores >= self.floor)
        new = [item, scores[row, item], lost[row], ids[row]]
        self.kept = [np.concatenate(x) for x in zip(self.kept, new)]
        item, score, lost, ids = self.kept
        order = np.lexsort((ids, lost, -score, item))
        first = np.searchsorted(item[order], item[order])
        self.kept = [x[order[np.arange(len(order)) - first < self.k]] for x in self.kept]
        item, score = self.kept[:2]
        size = np.bincount(item, minlength=len(self.floor))
        last = np.cumsum(size) - 1
        full = size >= self.k
        self.floor[full] = score[last[full]]


def _scored(counts: DataFrame, weights: np.ndarray, starts: np.ndarray, items: np.ndarray, times: np.ndarray,
            n_items: int, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of each item; term i is in items[starts[i]:starts[i + 1]]."""
    shared = counts.sparkSession.sparkContext.broadcast((weights, starts, items, times))
    step = max(1, CELLS // n_items)

    def run(batches):
        weight, start, item_of, times_of = shared.value
        best = Best(n_items, k)
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                m = 25 + 75 * batch.column(1).to_numpy(zero_copy_only=False) * n_docs // n_terms
                lists = batch.column(2)
                doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                term = lists.flatten().to_numpy(zero_copy_only=False)
                tf = batch.column(3).flatten().to_numpy(zero_copy_only=False)
                gain = weight[term] * (SCALE * tf // (1000 * tf + 8 * m[doc]))
                some = gain > 0
                doc, term, gain = doc[some], term[some], gain[some]
                width = start[term + 1] - start[term]
                at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(start[term], width)
                scores = np.zeros(batch.num_rows * n_items, np.int64)
                np.add.at(scores, np.repeat(doc, width) * n_items + item_of[at], np.repeat(gain, width) * times_of[at])
                ids = batch.column(0)
                best.add(scores.reshape(batch.num_rows, n_items), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64),
                         ids.fill_null(0).to_numpy(zero_copy_only=False))
        item, score, lost, ids = best.kept
        yield pa.record_batch([pa.array(item, pa.int32()), pa.array(ids, mask=lost.astype(bool)), pa.array(score)],
                              ["item", "doc_id", "score"])

    return counts.mapInArrow(run, "item int, doc_id long, score long")


def _ranked_block(docs: DataFrame, terms: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """(item_id, rank, doc_id, score) of one block of items."""
    spark = docs.sparkSession
    # a block's terms are bounded by the dealing into blocks
    held = terms.select("item", "item_id", "term", "times").toArrow().sort_by([("item", "ascending")])
    keys, local = np.unique(held.column("item").to_numpy(), return_inverse=True)
    words = sorted(set(held.column("term").to_pylist()))
    code = {w: i for i, w in enumerate(words)}
    term = np.array([code[w] for w in held.column("term").to_pylist()], np.int64)
    counts = cut(scanned(docs, words, doc_id, text))
    n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r[0]: r[1] for r in counts.select(F.explode("found").alias("i")).groupBy("i").count().collect()}
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(words))], np.int64)
    order = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[order], np.arange(len(words) + 1))
    times = held.column("times").to_numpy()
    best = _scored(counts, weights, starts, local[order], times[order], max(len(keys), 1), n_docs, max(n_terms, 1), k)
    first = np.unique(local, return_index=True)[1]
    names = pa.table({"item": pa.array(np.arange(len(keys)), pa.int32()), "item_id": held.column("item_id").take(pa.array(first))})
    ids = spark.createDataFrame(names)
    window = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = best.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    return top.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0; doc_id is an integer."""
    terms = cut(item_terms(items, item_id, item_text))
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    out = None
    for b in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else terms
        one = _ranked_block(docs, own, k, doc_id, text)
        out = one if out is None else out.unionByName(one)
    return out
