"""Near-duplicate vectors by an inverted multi-index over product cells.

Two codebooks, one for each half of the normalised vectors, form a grid; a vector lies in
the cell of its nearest centroid pair, inside its label. Every vector walks the cells by
growing sum of its two half distances (the multi-sequence order) and is compared with
their members, exactly and in double precision. How many cells it visits is calibrated:
sampled vectors are moved to exactly the link threshold in random directions, and the
visits must reach the moved vector's cell with the target chance. A link is found from
either end, so the recall is higher than the target; tests measure it by brute force.

Equal vectors of a label become one node with a count first. Cells are compared in
blocks of bounded members and visitors, so a crowded cell is many tasks. A block lists no
pairs: it returns how many links each of its vectors has there, counting a link that both
ends can find only from the smaller one, and a spanning forest of the links, which is
enough for the components. So what comes out grows with the vectors, not with the links.
Codebooks are fitted on at most ``SAMPLE`` vectors; every vector is indexed. The grid grows
with the largest label up to ``MOST_CENTROIDS`` squared cells. Defined cases: a vector
that is null, empty, zero, or holds a null or non-finite number, or has no label, links
with nothing and is kept; vectors of different length never link; repeated rows are
copies of one vector; component_id is null only where every id of a component is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import cut
from foldspark.llm.graph import components

THRESHOLD, RECALL = 0.93, 0.99
SAMPLE, CELL_GOAL, MOST_CENTROIDS, BLOCK, VISITORS = 20_000, 128, 1024, 1024, 4096


def normal(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square over- or underflows."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of each row's nearest centre, with a bounded table of distances."""
    step = max(1, (1 << 22) // len(centres))
    return np.concatenate([_distances(x[a:a + step], centres).argmin(axis=1) for a in range(0, len(x), step)])


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None]


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means centres of a sample."""
    rng = np.random.default_rng(7)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)]
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        held = np.bincount(near, minlength=k)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return centres


def cells_in_order(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], visits: int) -> np.ndarray:
    """The first ``visits`` cells of each row's multi-sequence order, nearest first."""
    half = books[0].shape[1]
    one, two = _distances(x[:, :half], books[0]), _distances(x[:, half:], books[1])
    k = len(books[0])
    if visits >= k * k:
        sums = (one[:, :, None] + two[:, None, :]).reshape(len(x), -1)
        return np.argsort(sums, axis=1, kind="stable")
    # among the first v sums, ranks (p, q) of the sorted lists satisfy (p + 1) * (q + 1) <= v
    a, b = np.argsort(one, axis=1, kind="stable"), np.argsort(two, axis=1, kind="stable")
    p, q = (g.ravel() for g in np.meshgrid(np.arange(k), np.arange(k), indexing="ij"))
    front = (p + 1) * (q + 1) <= visits
    p, q = p[front], q[front]
    sums = np.take_along_axis(one, a, 1)[:, p] + np.take_along_axis(two, b, 1)[:, q]
    first = np.argsort(sums, axis=1, kind="stable")[:, :visits]
    return np.take_along_axis(a[:, p] * k + b[:, q], first, 1)


def needed_visits(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], threshold: float, recall: float) -> int:
    """Cells to visit so that a vector at the threshold is reached with chance ``recall``."""
    rng = np.random.default_rng(11)
    x = x[:2_000]
    away = rng.standard_normal(x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    moved = threshold * x + np.sqrt(1 - threshold ** 2) * normal(away)
    half = books[0].shape[1]
    ranks = []
    for row, near in zip(x, moved):
        one, two = (_distances(y[None], c)[0] for y, c in zip((row[:half], row[half:]), books))
        p, q = (int(nearest(y[None], c)[0]) for y, c in zip((near[:half], near[half:]), books))
        # cells whose sum is smaller than that of the moved vector's cell
        ranks.append(1 + int(np.searchsorted(np.sort(two), one[p] + two[q] - one).sum()))
    return sorted(ranks)[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]


def forest(near: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of a table of links between rows and columns (ids; both may hold one)."""
    out, top = [], {}

    def root(x):
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    some = np.flatnonzero(near.any(axis=1))
    claimed = np.full(near.shape[1], -1)
    for i in some:                                          # a column seen before stands for all its earlier rows
        at = np.flatnonzero(near[i])
        firsts = at[claimed[at] < 0]
        earlier = np.unique(claimed[at[claimed[at] >= 0]], return_index=True)[1]
        for j in [*firsts.tolist(), *at[claimed[at] >= 0][earlier].tolist()]:
            a, b = int(rows[i]), int(columns[j])
            x, y = root(a), root(b)
            if x != y:
                top[x] = y
                out.append((min(a, b), max(a, b)))
        claimed[at] = i
    return out


def _verify(threshold: float):
    """Map a block to rows (a, b, n): a link of its forest, or (b null) n more links of a."""
    names = ("a", "b", "n")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        member = frame["visitor"].to_numpy() == 0
        m, v = frame[member], frame[~member]
        if not len(m) or not len(v):
            return pd.DataFrame({c: pd.Series(dtype="Int64") for c in names})
        ids, own = v["node"].to_numpy(), m["node"].to_numpy()
        near = normal(np.stack(v["embedding"].to_numpy())) @ normal(np.stack(m["embedding"].to_numpy())).T >= threshold
        near &= ids[:, None] != own[None]
        links = forest(near, ids, own)
        # a link whose other end comes to this end's cell too is counted from the smaller id only
        cells, homes = m["cells"].to_numpy(), v["home"].to_numpy().astype(np.int64)
        width = 1 + max(int(homes.max()), max(int(c.max()) for c in cells))
        visits = np.unique(np.concatenate([j * width + c.astype(np.int64) for j, c in enumerate(cells)]))
        for a in range(0, len(ids), 512):
            part = near[a:a + 512]
            i, j = np.nonzero(part)
            key = j * width + homes[a + i]
            at = np.minimum(np.searchsorted(visits, key), len(visits) - 1)
            part[i, j] = (visits[at] != key) | (ids[a + i] < own[j])
        counts = near.astype(np.int64)
        n = [counts @ m["copies"].to_numpy(), v["copies"].to_numpy() @ counts]
        node, n = np.concatenate([ids, own]), np.concatenate(n)
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"a": pd.array(np.concatenate([a, node[n > 0]]), "Int64"),
                             "b": pd.array([*b.tolist(), *[None] * int((n > 0).sum())], "Int64"),
                             "n": pd.array([*[None] * len(a), *n[n > 0].tolist()], "Int64")})

    return run


def vector_links(nodes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Rows (a, b, n): links a < b that span the components, and (b null) summands of the nodes' numbers of linked vectors.

    nodes has (node, label, embedding, copies) with valid, distinct vectors of one length.
    """
    spark = nodes.sparkSession
    groups = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    if not groups[1]:
        return spark.createDataFrame([], "a long, b long, n long")
    share = min(1.0, SAMPLE / groups[1])
    draw = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = nodes.where(draw < share).select("embedding").limit(2 * SAMPLE).toPandas()
    if sample.empty:
        sample = nodes.select("embedding").limit(SAMPLE).toPandas()
    x = normal(np.stack(sample["embedding"].to_numpy()))
    k = int(min(MOST_CENTROIDS, max(4, np.ceil(np.sqrt(groups[0] / CELL_GOAL)))))
    half = max(1, x.shape[1] // 2)
    books = (codebook(x[:, :half], k), codebook(x[:, half:], k))
    visits = needed_visits(x, books, threshold, recall)
    held = spark.sparkContext.broadcast(books)              # two codebooks of MOST_CENTROIDS rows at most

    def walk(frames):
        for f in frames:
            if len(f):
                order = cells_in_order(normal(np.stack(f["embedding"].to_numpy())), held.value, visits)
                yield pd.DataFrame({"node": f["node"], "label": f["label"], "copies": f["copies"], "embedding": f["embedding"],
                                    "cells": list(order.astype(np.int32))})

    kind = nodes.schema["embedding"].dataType.simpleString()
    walked = cut(nodes.select("node", "label", "copies", "embedding").mapInPandas(
        walk, f"node long, label long, copies long, embedding {kind}, cells array<int>"))
    # blocks of a cell's members and of its visitors, by their exact numbers
    home = F.element_at("cells", 1)
    members = walked.select("node", "label", "copies", "embedding", "cells", home.alias("home"), home.alias("cell"))
    visitors = walked.select("node", "label", "copies", "embedding", F.lit(None).cast("array<int>").alias("cells"), home.alias("home"),
                             F.explode("cells").alias("cell"))
    held_rows = members.groupBy("label", "cell").agg(F.count("*").alias("m"))
    come = walked.select("label", F.explode("cells").alias("cell")).groupBy("label", "cell").agg(F.count("*").alias("v"))
    plan = cut(held_rows.join(come, ["label", "cell"]).select(
        "label", "cell", F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("v") / VISITORS).cast("int").alias("vb")))
    spot = F.xxhash64("node")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocks = members.join(plan, ["label", "cell"]).withColumn("i", F.pmod(spot, F.col("mb").cast("long")).cast("int")).withColumn(
        "j", each("vb")).withColumn("visitor", F.lit(0)).unionByName(
        visitors.join(plan, ["label", "cell"]).withColumn("j", F.pmod(spot, F.col("vb").cast("long")).cast("int")).withColumn(
            "i", each("mb")).withColumn("visitor", F.lit(1)))
    return blocks.groupBy("label", "cell", "i", "j").applyInPandas(_verify(threshold), "a long, b long, n long")


def vector_classes(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = cut(vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
                              F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("embedding")))
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)) & F.exists(
        "embedding", lambda x: x != 0)
    nodes = cut(rows.where(fine).groupBy("label", "embedding").agg(F.min("row").alias("node"), F.count("*").alias("copies")))
    lengths = [r[0] for r in nodes.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("c")).orderBy("n").collect()]
    links = None                                            # one index for each length of vectors
    for n in lengths:
        part = vector_links(nodes.where(F.size("embedding") == n), threshold, recall)
        links = part if links is None else links.unionByName(part)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    found = cut(links)
    degree = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("near"))
    label = components(found.where("b is not null").select("a", "b"))
    known = nodes.join(degree, "node", "left").join(label.withColumnRenamed("label", "root"), "node", "left").select(
        F.col("label").alias("l"), F.col("embedding").alias("e"),
        (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    placed = rows.join(known, (rows["label"] == known["l"]) & (rows["embedding"] == known["e"]), "left").select(
        "row", "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "row").alias("root"))
    placed = cut(placed)
    least = placed.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return placed.join(least, "root").select("vec_id", "n_links", "component_id",
                                             F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
