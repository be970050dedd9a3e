"""Near-duplicates by BagMinHash over bags of five-word shingles.

A text is a bag of shingles with counts. Component i of its signature is the smallest
point of Poisson processes over (time, level): the levels 0, 1, 2, 4, ... of the counts
split each shingle's process into dyadic blocks of unit intensity, a point falls on a
uniform component and level, and a shingle of count w owns the levels below w. Equal
components then have the chance of the weighted Jaccard similarity of the bags. Blocks
yield their points in order of time, and a block stops when its next point is later than
the largest component so far, so most shingles need a single point.

Bands of the signature give buckets. Bags that are equal become one node first. In each
bucket every member is verified against the most crowded one (the centre of a group of
edited copies), exactly, by the overlap of the bags. Members of a bucket that end up in
different classes are then verified with each other: pair by pair in small buckets, unless
their distances to the shared centre (1 - similarity is a metric) already rule a link out,
and in blocks of bags that only return links in large ones. A group of edited copies thus
needs one comparison each; only members that are apart from its centre need more, and no
link between candidates is given up.

Chance of missing a pair in all bands at similarity 0.8: (1 - 0.8**4)**24 < 4e-6.
Defined cases: a text of fewer than five words is one shingle of all its words; null,
empty and blank texts are copies of each other and of nothing else; the kept row of a class has its smallest
doc_id, null ids last; repeated rows are copies; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import cut, fresh
from foldspark.llm.graph import components

SHINGLE, SIMILARITY, ROWS, BANDS = 5, 0.8, 4, 24
CHUNK_WORDS = 400_000
#: A bucket with more pairs left than PAIRS is compared in blocks of LEFT by RIGHT bags, fewer
#: where a side's bags pass BLOCK_BYTES together (16 bytes a shingle).
PAIRS, LEFT, RIGHT, BLOCK_BYTES = 400, 256, 1024, 64 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and the offset of each text's first one (one more at the end)."""
    bare = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    split = pc.ascii_split_whitespace(bare)
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths[pc.equal(bare, "").to_numpy(zero_copy_only=False)] = 0
    words = split.flatten()
    words = words.filter(pc.not_equal(words, "")).dictionary_encode()
    known = pd.util.hash_array(words.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    codes = words.indices.to_numpy(zero_copy_only=False)
    return (known[codes] if len(codes) else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(lengths)])


def shingle_hashes(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle, and the offset of each text's first one."""
    counts = np.diff(offsets)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    ends = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(offsets[:-1] - ends[:-1], n) + np.arange(ends[-1])
    last = np.repeat(offsets[1:], n)
    total = np.zeros(ends[-1], np.uint64)
    for j in range(SHINGLE):
        at = first + j
        inside = at < last
        part = words[np.minimum(at, len(words) - 1)] if len(words) else np.zeros(0, np.uint64)
        total = mix(total + np.where(inside, part | np.uint64(1), np.uint64(0)) + GOLDEN)
    return total, ends


def bags(shingles: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text with their counts, and the offsets of the texts."""
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    order = np.lexsort((shingles, doc))
    s, d = shingles[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(s)))
    return s[at], counts, np.searchsorted(d[at], np.arange(len(ends)))


def signatures(keys: np.ndarray, counts: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """One row of ``size`` smallest times for each bag; rows of empty bags are infinite."""
    n = len(starts) - 1
    out = np.full((n, size), np.inf)
    doc = np.repeat(np.arange(n), np.diff(starts))
    # dyadic blocks of levels: [0, 1), [1, 2), [2, 4), ... up to the count
    blocks = np.where(counts > 1, np.ceil(np.log2(np.maximum(counts, 2))).astype(np.int64) + 1, 1)
    row = np.repeat(np.arange(len(keys)), blocks)
    level = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    own = np.minimum(counts[row] - low, width)
    seed, doc, time = mix(keys[row] + level.astype(np.uint64) * GOLDEN), doc[row], np.zeros(len(row))
    latest = np.full(n, np.inf)
    while len(seed):
        seed = seed + GOLDEN
        a = mix(seed)
        b = mix(a ^ GOLDEN)
        time = time - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53) / (size * width)
        soon = time < latest[doc]
        seed, doc, time, width, own, b = seed[soon], doc[soon], time[soon], width[soon], own[soon], b[soon]
        inside = (b >> np.uint64(32)).astype(np.float64) * width < own * 2.0 ** 32
        place = ((b & np.uint64(0xFFFFFFFF)) * np.uint64(size)) >> np.uint64(32)
        np.minimum.at(out.reshape(-1), doc[inside] * size + place[inside].astype(np.int64), time[inside])
        latest = out.max(axis=1) if size else latest
    return out


def _chunks(texts: pa.Array):
    """Slices of a column with a bounded number of bytes, one text at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // (CHUNK_WORDS * 6)
    starts = np.concatenate([np.flatnonzero(np.diff(part, prepend=-1)), [len(sizes)]])
    for a, b in zip(starts[:-1], starts[1:]):
        yield int(a), texts.slice(int(a), int(b - a))


def _sketch(batches):
    names = ["row", "f1", "f2", "n", "bands"]
    for batch in batches:
        for at, texts in _chunks(batch.column(1)):
            keys, counts, starts = bags(*shingle_hashes(*word_hashes(texts)))
            sig = signatures(keys, counts, starts, ROWS * BANDS).view(np.uint64).reshape(len(texts), BANDS, ROWS)
            band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2]).copy()
            for r in range(ROWS):
                band = mix(band + sig[:, :, r] * GOLDEN + np.uint64(r))
            each = mix(keys + mix(counts.astype(np.uint64)))      # sums over a bag tell equal bags
            total = lambda x: np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
            sums = [total(each), total(mix(each ^ GOLDEN)), total(counts.astype(np.uint64))]
            f1, f2, n = (s[starts[1:]] - s[starts[:-1]] for s in sums)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS),
                                             pa.array(band.view(np.int64).reshape(-1)))
            yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(f1.view(np.int64)),
                                   pa.array(f2.view(np.int64)), pa.array(n.astype(np.int64)), lists], names)


def _bag_rows(batches):
    for batch in batches:
        for at, texts in _chunks(batch.column(1)):
            keys, counts, starts = bags(*shingle_hashes(*word_hashes(texts)))
            both = [np.concatenate([keys[a:b], counts[a:b].astype(np.uint64)]).tobytes() for a, b in zip(starts[:-1], starts[1:])]
            yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(both, pa.binary())], ["node", "bag"])


def overlap(a, b) -> float:
    """Weighted Jaccard similarity of two bags."""
    x, y = np.frombuffer(a, np.uint64).reshape(2, -1), np.frombuffer(b, np.uint64).reshape(2, -1)
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = np.minimum(x[1][i], y[1][j]).sum()
    return float(both) / float(x[1].sum() + y[1].sum() - both)


def _verify(batches):
    for batch in batches:
        left, right = batch.column(2), batch.column(3)      # read in place: a batch of long bags is large
        sims = [overlap(x.as_buffer(), y.as_buffer()) for x, y in zip(left, right)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], ["a", "b", "sim"])


def _similarities(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b, sim) of every pair, exactly."""
    one = held.select(F.col("node").alias("a"), F.col("bag").alias("x"))
    two = held.select(F.col("node").alias("b"), F.col("bag").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(
        _verify, "a long, b long, sim double")


def _block_links(crowd: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Links of the minor members of large buckets with all members, compared in blocks; only links come out."""
    members = crowd.select("main", "node").distinct()
    minor = crowd.where("label <> main").select("main", "node").distinct()
    size = cut(held.select("node", F.octet_length("bag").cast("long").alias("bytes")))
    total = lambda t, bags: t.join(size, "node").groupBy("main").agg(
        F.ceil(F.greatest(F.count("*") / bags, F.sum("bytes") / BLOCK_BYTES)).alias("blocks"))
    sizes = cut(total(members, RIGHT).withColumnRenamed("blocks", "rb").join(total(minor, LEFT).withColumnRenamed("blocks", "lb"), "main"))
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = minor.join(sizes, "main").select("main", "node", F.lit(True).alias("left"), spot("lb").alias("i"), every("rb").alias("j"))
    right = members.join(sizes, "main").select("main", "node", F.lit(False).alias("left"), every("lb").alias("i"), spot("rb").alias("j"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        side = frame["left"].to_numpy()
        node = frame["node"].to_numpy()
        bag = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in frame["bag"]]
        r = np.flatnonzero(~side)
        keys, counts = (np.concatenate([bag[k][n] for k in r]) for n in (0, 1))
        owner = np.repeat(np.arange(len(r)), [bag[k].shape[1] for k in r])
        order = np.argsort(keys, kind="stable")
        keys, counts, owner = keys[order], counts[order].astype(np.int64), owner[order]
        total = np.array([bag[k][1].sum() for k in r], np.int64)
        out = []
        for k in np.flatnonzero(side):
            mine, times = bag[k]
            a, b = np.searchsorted(keys, mine), np.searchsorted(keys, mine, "right")
            n = b - a
            at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(owner[at], np.minimum(counts[at], np.repeat(times.astype(np.int64), n)), len(r))
            near = both >= similarity * (total + int(times.sum()) - both)
            out += [(node[k], x) for x in node[r[near]] if x != node[k]]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": pairs.min(axis=1, initial=np.iinfo(np.int64).max), "b": pairs.max(axis=1, initial=-1)})

    return left.unionByName(right).join(held, "node").groupBy("main", "i", "j").applyInPandas(compare, "a long, b long")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a row number that stays, written to the shared folder."""
    row = fresh(docs, "bm_row")
    return cut(docs.withColumn(row, F.monotonically_increasing_id())), row


def classes(rows: DataFrame, row: str, similarity: float = SIMILARITY) -> DataFrame:
    """(row, f1, f2, n, node, label): the node of equal bags and the class of every row."""
    sketch = cut(rows.select(F.col(row).alias("row"), "text").mapInArrow(
        _sketch, "row long, f1 long, f2 long, n long, bands array<long>"))
    nodes = cut(sketch.groupBy("f1", "f2", "n").agg(F.min("row").alias("node"), F.any_value("bands").alias("bands")))
    bands = nodes.where("n > 0").select("node", F.posexplode("bands").alias("band", "h"))
    crowds = bands.groupBy("band", "h").agg(F.count("*").alias("c")).where("c > 1")
    crowded = cut(bands.join(crowds, ["band", "h"]))
    degree = crowded.groupBy("node").agg(F.sum("c").alias("degree"))
    ranked = crowded.join(degree, "node").withColumn("who", F.struct("degree", (-F.col("node")).alias("low")))
    # a table, so that the join can split the rows of a hot bucket
    centre = cut(ranked.groupBy("band", "h").agg((-F.max("who")["low"]).alias("centre")))
    members = cut(crowded.join(centre, ["band", "h"]).select("band", "h", "node", "centre"))
    spokes = members.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    involved = members.select(F.col("node").alias("at")).distinct()
    held = cut(rows.select(F.col(row).alias("row"), "text").join(involved.hint("shuffle_hash"), F.col("row") == F.col("at"), "left_semi")
               .mapInArrow(_bag_rows, "node long, bag binary"))
    known = cut(_similarities(spokes, held))
    links = known.where(F.col("sim") >= similarity).select("a", "b")
    first = components(links)
    # members of one bucket that are still apart
    labelled = members.join(first, "node", "left").withColumn("label", F.coalesce("label", "node")).join(
        known.select(F.col("a").alias("node"), F.col("b").alias("centre"), "sim"), ["node", "centre"], "left").withColumn(
        "far", 1 - F.coalesce("sim", F.lit(1.0)))
    mixed = labelled.groupBy("band", "h").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"),
        F.max(F.when(F.col("node") == F.col("centre"), F.col("label"))).alias("main")).where("lo <> hi")
    apart = cut(labelled.where("node <> centre").join(mixed.select("band", "h", "main"), ["band", "h"]))
    sizes = apart.groupBy("band", "h").agg(F.count("*").alias("s"), F.sum((F.col("label") != F.col("main")).cast("long")).alias("f"))
    sized = apart.join(sizes.where("f > 0"), ["band", "h"])
    few = sized.where(F.col("f") * F.col("s") <= PAIRS)
    near = F.abs(F.col("far") - F.col("far2")) <= 1 - similarity + 1e-9
    others = few.select("band", "h", F.col("node").alias("b"), F.col("label").alias("label2"), F.col("far").alias("far2"))
    minor = few.where("label <> main").select("band", "h", F.col("node").alias("a"), "label", "far")
    rest = minor.join(others, ["band", "h"]).where((F.col("label") != F.col("label2")) & near).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    blocks = _block_links(sized.where(F.col("f") * F.col("s") > PAIRS), held, similarity)
    found = cut(_similarities(rest, held).where(F.col("sim") >= similarity).select("a", "b").unionByName(blocks))
    final = first if found.isEmpty() else components(links.unionByName(found))
    return sketch.drop("bands").join(nodes.drop("bands"), ["f1", "f2", "n"]).join(final, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))


def duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (its class's smallest doc_id), class_size, kept."""
    rows, row = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return _with_classes(rows, row, similarity).select("doc_id", "class_id", "class_size", "kept")


def _with_classes(rows: DataFrame, row: str, similarity: float) -> DataFrame:
    ids = rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    member = cut(ids.join(classes(rows, row, similarity).select("row", "label"), "row", "left").withColumn(
        "label", F.coalesce("label", "row")))
    who = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")
    # a table, so that the join can split the rows of a large class
    best = cut(member.groupBy("label").agg(F.min(who).alias("best"), F.count("*").alias("class_size")))
    return member.join(best, "label").select(
        "row", "doc_id", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("best.row") == F.col("row")).alias("kept"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs without those that another row of their class stands for."""
    rows, row = numbered(docs)
    gone = _with_classes(rows, row, similarity).where(~F.col("kept")).select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
