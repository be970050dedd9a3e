"""Linear and logistic models over wide rows: many penalised fits in lock step by L-BFGS.

A row is a few dense columns and a list of positions that are one (sparse one-hot codes).
Rows are packed once into blocks of arrays in the shared folder and in executor storage.
Each step of all fits (folds, penalties) is one job: tasks return loss and gradient of every
live fit at its trial point, merged in a tree on executors; the driver only moves the
weights. L1 penalties use the orthant-wise form of the same steps. Fits whose gradients
together pass ``SENT_BYTES`` go in several groups.

A fit minimises mean loss + l1 |w|_1 + l2 |w|^2 / 2 with free intercepts, where the loss is
half the squared error, the log loss (one output for two classes, else one per class), or
for ``ovr`` the sum of the classes' own log losses against the rest. ``Solved.converged``
tells whether the (sub)gradient came below the tolerance.
"""

from __future__ import annotations

import pickle
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import kept_table, remove_table
from .ranks import plan_bytes

LOSSES = ("squared", "log", "ovr")
NO_FOLD = -1
#: Rows of a block, bytes of gradients that one job returns, vectors of curvature kept for a fit.
BLOCK_ROWS, SENT_BYTES, MEMORY = 100_000, 64 << 20, 8
#: Bytes of packed rows for a task.
TASK_BYTES = 16 << 20


@dataclass(frozen=True)
class Fit:
    """One model: rows outside the fold ``without`` (all rows for -1)."""

    without: int = NO_FOLD
    l1: float = 0.0
    l2: float = 0.0


@dataclass
class Block:
    fold: np.ndarray
    y: np.ndarray
    dense: np.ndarray          # rows x dense columns
    starts: np.ndarray         # places of the rows' positions
    hot: np.ndarray            # positions that are one

    def scores(self, w: np.ndarray) -> np.ndarray:
        """rows x outputs for weights (outputs x [dense, hot, intercept])."""
        d = self.dense.shape[1]
        z = self.dense @ w[:, :d].T + w[:, -1]
        if len(self.hot):
            row = np.repeat(np.arange(len(self.y)), np.diff(self.starts))
            for k in range(len(w)):
                z[:, k] += np.bincount(row, w[k, d + self.hot], len(self.y))
        return z

    def gradient(self, slope: np.ndarray, width: int) -> np.ndarray:
        """outputs x width: the sum of slope times row."""
        d, out = self.dense.shape[1], np.zeros((slope.shape[1], width))
        out[:, :d] = slope.T @ self.dense
        out[:, -1] = slope.sum(axis=0)
        if len(self.hot):
            row = np.repeat(np.arange(len(self.y)), np.diff(self.starts))
            for k in range(len(out)):
                out[k, d:-1] = np.bincount(self.hot, slope[row, k], width - d - 1)
        return out

    def outside(self, fold: int) -> Block:
        """The rows outside a fold."""
        if fold == NO_FOLD:
            return self
        return self.rows(self.fold != fold)

    def rows(self, on: np.ndarray) -> Block:
        size = np.diff(self.starts)
        return Block(self.fold[on], self.y[on], self.dense[on], np.concatenate([[0], np.cumsum(size[on])]),
                     self.hot[np.repeat(on, size)])


def log_loss(z: np.ndarray, y: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Loss of every row and its slope in each score."""
    if kind == "squared":
        e = z - y[:, None]
        return e[:, 0] ** 2 / 2, e
    if kind == "ovr" or z.shape[1] == 1:
        hot = (y[:, None] == (np.arange(z.shape[1]) if z.shape[1] > 1 else 1)).astype(float)
        return (np.logaddexp(0, z) - hot * z).sum(axis=1), np.exp(-np.logaddexp(0, -z)) - hot
    top = z.max(axis=1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(axis=1, keepdims=True)
    rows, code = np.arange(len(y)), y.astype(int)
    slope = e / total
    slope[rows, code] -= 1
    return np.log(total[:, 0]) + top[:, 0] - z[rows, code], slope


def _pack(n_dense: int):
    """Map batches (fold, y, dense array, positions) to pickled blocks."""

    def run(batches):
        held, n = [], 0

        def block():
            fold, y, dense, sizes, hot = (np.concatenate(x) for x in zip(*held))
            one = Block(fold, y, dense, np.concatenate([[0], np.cumsum(sizes)]), hot)
            return pa.record_batch([pa.array([pickle.dumps(one, 5)], pa.binary())], ["block"])

        for batch in batches:
            dense = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_dense)
            lists = batch.column(3)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), dense,
                         np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield block()
                held, n = [], 0
        if held:
            yield block()

    return run


class Rows:
    """Packed rows of df; a context manager that frees them."""

    def __init__(self, df: DataFrame, dense: Sequence[str], y: str, hot: str | None = None, hot_width: int = 0, fold: str | None = None):
        self.dense, self.width = list(dense), len(dense) + hot_width + 1
        fold_of = F.col(fold).cast("int") if fold else F.lit(0)
        packed = df.select(
            F.coalesce(fold_of, F.lit(NO_FOLD - 1)).alias("fold"), F.col(y).cast("double").alias("y"),
            F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in dense]).cast("array<double>").alias("dense"),
            (F.col(hot).cast("array<int>") if hot else F.array().cast("array<int>")).alias("hot")).filter("y IS NOT NULL")
        self.table, self.path = kept_table(packed.mapInArrow(_pack(len(self.dense)), "block binary"))
        parts = max(1, -(-plan_bytes(self.table) // TASK_BYTES))          # every step is a job, so small rows are few tasks
        self.rdd: RDD = self.table.rdd.map(lambda r: bytes(r[0])).coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)

    def __enter__(self) -> Rows:
        return self

    def __exit__(self, *_) -> None:
        self.rdd.unpersist()
        remove_table(self.table.sparkSession, self.path)


def _merged(blocks: RDD, per_block) -> np.ndarray | None:
    """Sum of an array over all blocks, added in a tree on executors; None without blocks."""
    def add(a, b):
        return b if a is None else a if b is None else a + b

    def partial(data: Iterator[bytes]):
        total = None
        for x in data:
            total = add(total, per_block(pickle.loads(x)))
        yield total

    return blocks.mapPartitions(partial).treeReduce(add, depth=2) if blocks.getNumPartitions() else None


@dataclass
class Solved:
    weights: np.ndarray                        # outputs x [dense, hot, intercept]
    value: float = np.inf
    steps: int = 0
    converged: bool = False


@dataclass
class _Path:
    """The state of one fit: its point, trial point and curvature pairs."""

    fit: Fit
    w: np.ndarray
    trial: np.ndarray
    value: float = np.inf
    smooth: np.ndarray | None = None           # gradient without the l1 term
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    direction: np.ndarray | None = None
    step: float = 1.0
    steps: int = 0
    tries: int = 0
    done: bool = False
    converged: bool = False

    def _pseudo(self, free: np.ndarray) -> np.ndarray:
        """Gradient of the whole objective, the steepest one where |w| has a corner."""
        g, l1 = self.smooth, self.fit.l1 * ~free
        if not self.fit.l1:
            return g
        up, down = g + l1, g - l1
        at_corner = np.where(down > 0, down, np.where(up < 0, up, 0.0))
        return np.where(self.w > 0, up, np.where(self.w < 0, down, at_corner))

    def receive(self, value: float, smooth: np.ndarray, free: np.ndarray, tol: float, max_steps: int) -> None:
        """Take the objective at the trial point: accept and go on, or shorten the step."""
        value += self.fit.l1 * np.abs(self.trial[~free]).sum()
        if self.direction is not None:
            moved = self.trial - self.w
            if not value <= self.value + 1e-4 * float(self._pseudo(free) @ moved):
                self.step, self.tries = self.step / 2, self.tries + 1
                if self.tries > 30:                # no lower point at the precision of the sums
                    self.done = True
                self._try(free)
                return
            change = smooth - self.smooth
            if moved @ change > 1e-12 * np.sqrt((moved @ moved) * (change @ change)):
                self.pairs = [*self.pairs, (moved, change)][-MEMORY:]
        gain = self.value - value
        self.w, self.value, self.smooth, self.steps, self.tries = self.trial, value, smooth, self.steps + 1, 0
        pseudo = self._pseudo(free)
        flat = np.abs(pseudo).max(initial=0.0) < tol
        if flat or gain < 1e-12 * abs(value) or self.steps > max_steps:
            self.done, self.converged = True, bool(flat or gain < 1e-12 * abs(value))
            return
        self.direction = self._newton(-pseudo)
        if self.fit.l1:
            self.direction = np.where(self.direction * pseudo < 0, self.direction, 0.0)
        if self.direction @ pseudo >= 0:
            self.direction, self.pairs = -pseudo, []
        self.step = 1.0 if self.pairs else min(1.0, 1.0 / max(np.abs(pseudo).sum(), 1e-300))
        self._try(free)

    def _newton(self, q: np.ndarray) -> np.ndarray:
        """Two-loop recursion over the kept pairs."""
        held = []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (y @ s)
            q = q - a * y
            held.append((a, s, y))
        if self.pairs:
            s, y = self.pairs[-1]
            q = q * ((s @ y) / (y @ y))
        for a, s, y in reversed(held):
            q = q + s * (a - (y @ q) / (y @ s))
        return q

    def _try(self, free: np.ndarray) -> None:
        trial = self.w + self.step * self.direction
        if self.fit.l1:                            # no weight crosses zero in one step
            side = np.where(self.w != 0, np.sign(self.w), -np.sign(self._pseudo(free)))
            trial = np.where(free | (trial * side > 0), trial, 0.0)
        self.trial = trial


def solve(rows: Rows, fits: Sequence[Fit], loss: str, outputs: int = 1, tol: float = 1e-6, max_steps: int = 1000,
          start: dict[Fit, np.ndarray] | None = None) -> dict[Fit, Solved]:
    """All fits on the packed rows."""
    size = outputs * rows.width
    group = max(1, SENT_BYTES // (8 * (size + 2)))
    out: dict[Fit, Solved] = {}
    fits = list(dict.fromkeys(fits))
    for a in range(0, len(fits), group):
        out |= _solve_group(rows, fits[a:a + group], loss, outputs, tol, max_steps, start or {})
    late = [f for f, s in out.items() if not s.converged]
    if late:
        warnings.warn(f"{len(late)} of {len(out)} fits did not converge in {max_steps} steps", stacklevel=2)
    return out


def _solve_group(rows: Rows, fits: Sequence[Fit], loss: str, outputs: int, tol: float, max_steps: int,
                 start: dict[Fit, np.ndarray]) -> dict[Fit, Solved]:
    width, context = rows.width, rows.table.sparkSession.sparkContext
    free = np.zeros((outputs, width), bool)
    free[:, -1] = True
    free = free.ravel()
    begin = [np.array(start.get(f, np.zeros((outputs, width))), float).ravel() for f in fits]
    paths = [_Path(f, w, w) for f, w in zip(fits, begin)]
    while live := [p for p in paths if not p.done]:
        now = context.broadcast([(p.fit.without, p.trial.reshape(outputs, width)) for p in live])   # SENT_BYTES at most

        def sums(block: Block) -> np.ndarray:
            parts = {}
            total = np.zeros((len(now.value), outputs * width + 2))
            for i, (without, w) in enumerate(now.value):
                if without not in parts:
                    parts[without] = block.outside(without)
                part = parts[without]
                value, slope = log_loss(part.scores(w), part.y, loss)
                total[i, 0], total[i, 1], total[i, 2:] = value.sum(), len(part.y), part.gradient(slope, width).ravel()
            return total

        got = _merged(rows.rdd, sums)
        now.destroy()
        if got is None or (got[:, 1] == 0).any():
            raise ValueError("a fit has no rows")
        for p, (value, n, *_), flat in zip(live, got[:, :2], got[:, 2:]):
            penalised = np.where(free, 0.0, p.trial)
            p.receive(value / n + p.fit.l2 * float(penalised @ penalised) / 2, flat / n + p.fit.l2 * penalised, free, tol, max_steps)
    return {p.fit: Solved(p.w.reshape(outputs, width), p.value, p.steps, p.converged) for p in paths}


def held_out(rows: Rows, solved: dict[Fit, Solved], loss: str) -> dict[Fit, float]:
    """Mean loss of every fit on the fold it left out, in one pass (squared: mean squared error)."""
    fits = [f for f in solved if f.without != NO_FOLD]
    context = rows.table.sparkSession.sparkContext
    out: dict[Fit, float] = {}
    group = max(1, SENT_BYTES // (8 * max(s.weights.size for s in solved.values())))
    for a in range(0, len(fits), group):
        part = fits[a:a + group]
        now = context.broadcast([(f.without, solved[f].weights) for f in part])

        def sums(block: Block) -> np.ndarray:
            total = np.zeros((len(now.value), 2))
            for i, (without, w) in enumerate(now.value):
                own = block.rows(block.fold == without)
                total[i] = log_loss(own.scores(w), own.y, loss)[0].sum() * (2 if loss == "squared" else 1), len(own.y)
            return total

        got = _merged(rows.rdd, sums)
        now.destroy()
        out |= {f: float(s / n) if n else np.nan for f, (s, n) in zip(part, got)}
    return out


def with_scores(df: DataFrame, weights: np.ndarray, dense: Sequence[str], hot: str | None = None, name: str = "_z") -> DataFrame:
    """df with the array of scores (one for each output) in a new column; the weights are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(weights)        # as large as a fit's gradient
    dense, names = list(dense), [*df.columns, name]
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    packed = df.withColumns({
        "_dense": F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in dense]).cast("array<double>"),
        "_hot": F.coalesce(F.col(hot).cast("array<int>"), F.array().cast("array<int>")) if hot else F.array().cast("array<int>")})

    def run(batches):
        w = shared.value
        for batch in batches:
            n, lists = batch.num_rows, batch.column(batch.num_columns - 1)
            x = batch.column(batch.num_columns - 2).flatten().to_numpy(zero_copy_only=False).reshape(n, len(dense))
            starts = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))]).astype(np.int64)
            block = Block(np.zeros(n), np.zeros(n), x, starts, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.record_batch([*batch.columns[:-2], pa.array(block.scores(w).tolist(), pa.list_(pa.float64()))], names)

    return packed.mapInArrow(run, schema)
