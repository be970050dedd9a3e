"""Line dedup: sorted hash ranges, first occurrences streamed, compressed keep bitmaps.

Every line becomes one narrow row (hash of its key, document, position). The rows
are range-partitioned by (hash, document) and sorted inside each range, so one pass
that remembers a single hash sees the first document of every key; a key held by a
third of all rows simply spans many ranges. Only what the neighbour range decides,
the first document of a range's leading hash, is settled afterwards from two marker
rows per range. The result is one compressed bitmap per document that loses lines.

Defined cases: a null or empty text is one empty line; lines whose key has fewer than
``min_chars`` code points always stay; rows that share a doc_id are one document; rows
with a null doc_id are told apart by their text and count as later than every other.
Extra columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import LOWER, SPACES, UPPER, cut, fresh, partitions

DROP, HEAD, TAIL = 0, 1, 2


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACES))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_rows(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(h1, h2, doc, mark, pos) of every line whose key is long enough; 96 bits of hash."""
    lines = docs.select(
        F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("mark"),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc", "mark", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "doc", "mark", "pos")


def _stream(batches):
    """Rows of one range in order: emits lines to drop, and the markers of its first and last hash."""
    last = None            # (h1, h2, is_null, doc, mark) of the first document of the hash at hand
    leading = None         # the first hash of the range
    names = ["kind", "h1", "h2", "doc", "mark", "pos"]
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, mark, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "mark", "pos"))
        null = batch.column("doc").is_null().to_numpy(zero_copy_only=False)
        doc = batch.column("doc").fill_null(0).to_numpy(zero_copy_only=False)
        n = len(h1)
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        carried = last is not None and last[0] == h1[0] and last[1] == h2[0]
        new[0] = not carried
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        at = np.maximum(start, 0)
        first_null, first_doc, first_mark = null[at], doc[at], mark[at]
        if carried:
            old = start < 0
            first_null = np.where(old, last[2], first_null)
            first_doc = np.where(old, last[3], first_doc)
            first_mark = np.where(old, last[4], first_mark)
        same = (null == first_null) & (doc == first_doc) & (~null | (mark == first_mark))
        if leading is None:
            leading = (h1[0], h2[0])
        head = same & (h1 == leading[0]) & (h2 == leading[1])
        out = ~same | head
        kind = np.where(head, HEAD, DROP).astype(np.int32)
        last = (h1[-1], h2[-1], first_null[-1], first_doc[-1], first_mark[-1])
        yield pa.record_batch([pa.array(kind[out]), pa.array(h1[out]), pa.array(h2[out]),
                               pa.array(doc[out], mask=null[out]), pa.array(mark[out]), pa.array(pos[out])], names)
    if last is not None:
        yield pa.record_batch([pa.array([TAIL], pa.int32()), pa.array([last[0]]), pa.array([last[1]]),
                               pa.array([None if last[2] else last[3]], pa.int64()), pa.array([last[4]]),
                               pa.array([-1], pa.int32())], names)


def repeated_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc, mark, pos) of every line that is not in the first document holding its key."""
    rows = cut(line_rows(docs, min_chars))
    n = partitions(rows)
    keys = [F.col("h1").asc(), F.col("h2").asc(), F.col("doc").asc_nulls_last()]
    ranges = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys, "mark", "pos")
    seen = cut(ranges.mapInArrow(_stream, "kind int, h1 long, h2 int, doc long, mark long, pos int"))
    # the first document of a range's leading hash stays unless another range holds an earlier one
    order = F.struct(F.col("doc").isNull().alias("n"), F.coalesce("doc", F.lit(0)).alias("d"),
                     F.when(F.col("doc").isNull(), F.col("mark")).otherwise(0).alias("m"))
    edge = seen.where(F.col("kind") != DROP).withColumn("who", order)
    first = edge.groupBy("h1", "h2").agg(F.min("who").alias("first"))
    late = edge.where(F.col("kind") == HEAD).join(first, ["h1", "h2"]).where(F.col("who") > F.col("first"))
    return seen.where(F.col("kind") == DROP).select("doc", "mark", "pos").unionByName(late.select("doc", "mark", "pos"))


def _pack(frames):
    """Positions to drop as a compressed keep bitmap: bit i is line i; lines past its end stay."""
    for frame in frames:
        maps = []
        for dropped in frame["gone"]:
            keep = np.ones(-(-(int(dropped.max()) + 1) // 8) * 8, bool)      # whole bytes
            keep[dropped] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 6))
        yield pd.DataFrame({"doc": frame["doc"], "mark": frame["mark"], "bitmap": maps})


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc, mark, bitmap): one row for each document that loses lines."""
    gone = repeated_lines(docs, min_chars).groupBy("doc", "mark").agg(F.collect_set("pos").alias("gone"))
    return gone.mapInPandas(_pack, "doc long, mark long, bitmap binary")


def kept_lines(text: str | None, bitmap: bytes | None) -> tuple[int, int, str]:
    """Lines before, lines dropped, and the text that stays."""
    text = text or ""
    if bitmap is None:
        return text.count("\n") + 1, 0, text
    lines = text.split("\n")
    keep = np.ones(len(lines), bool)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)).astype(bool)[:len(lines)]
    keep[:len(bits)] = bits
    stay = [x for x, k in zip(lines, keep) if k]
    return len(lines), len(lines) - len(stay), "\n".join(stay)


def with_bitmaps(docs: DataFrame, min_chars: int = 10) -> tuple[DataFrame, str]:
    """All rows of docs with their bitmap (null: nothing dropped) in a new column of the returned name."""
    doc, mark, bitmap = (fresh(docs, x) for x in ("ln_doc", "ln_mark", "ln_bitmap"))
    maps = keep_bitmaps(docs, min_chars).select(
        F.col("doc").alias(doc), F.col("mark").alias(mark), F.col("bitmap").alias(bitmap))
    same = docs["doc_id"].cast("long").eqNullSafe(maps[doc]) & (F.xxhash64(docs["text"]) == maps[mark])
    return docs.join(maps.hint("shuffle_hash"), same, "left").drop(doc, mark), bitmap


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """The rows of docs with their remaining text; a document may end up empty, none goes."""
    marked, bitmap = with_bitmaps(docs, min_chars)
    at, names = docs.columns.index("text"), docs.columns

    def apply(batches):
        for batch in batches:
            texts, maps = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            new = [t if m is None else kept_lines(t, m)[2] for t, m in zip(texts, maps)]
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(new, pa.string())
            yield pa.record_batch(columns, names)

    return marked.mapInArrow(apply, docs.schema)


def line_digests(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and the hash of the text that stays, one row for each row of docs."""
    marked, _ = with_bitmaps(docs.select("doc_id", "text"), min_chars)

    def digest(batches):
        for batch in batches:
            done = [kept_lines(t, m) for t, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), pa.array([d[0] for d in done], pa.int64()),
                 pa.array([d[1] for d in done], pa.int64()),
                 pa.array([hashlib.sha256(d[2].encode()).hexdigest() for d in done], pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return marked.mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
