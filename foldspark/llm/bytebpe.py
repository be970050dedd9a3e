"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is cut by the vocabulary's pattern, and each match is merged by itself. Leaf i of a
match's tree holds the rank of the pair whose left token starts at byte i, joined with i, so
that the root is the leftmost pair of least rank. A merge joins the pair at the root: it
switches off the right token's leaf and renews the leaves of the two live neighbours, each
on one path to the root. A match of n bytes takes n log n steps, however long it is.

Each distinct match is merged once per worker (a bounded cache of short matches that starts
anew when full; longer ones are merged each time). The new short matches of a slice are
merged side by side: their trees are rows of one table, and every step does each row's next
merge. Texts stay whole; a batch is cut into slices of bounded bytes between texts. Executors get the vocabulary by broadcast (one file,
under FILE_LIMIT); nothing is shuffled, so a lost executor repeats only its own tasks.

Defined cases: null and empty texts have no ids and decode to no bytes; other columns pass,
and new ones take names that are still free; ids that are null or not in the vocabulary, and
bytes after the last whole id, decode to nothing; names of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from foldspark.llm.common import fresh

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
FILE_LIMIT = 64 << 20
#: Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Matches kept in a worker's cache, the bytes of the longest one kept, rows of a table of
#: trees, bytes of a slice.
KEPT, KEPT_BYTES, TREES, SLICE = 500_000, 64, 4096, 4 << 20


class Merges:
    """The ranks of a vocabulary, and the merges of one match."""

    def __init__(self, data: bytes):
        pairs = [line.split() for line in data.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.longest = max(map(len, self.ranks), default=0)
        top = max(self.ranks.values(), default=-1) + 1
        spelled = [b""] * (top + 1)
        for token, rank in self.ranks.items():
            spelled[rank] = token
        self.spelled, self.top = pa.array(spelled, pa.binary()), top
        self.cache: dict[str, bytes] = {}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)])
        # every way to join two tokens to a third: sorted keys, and the third's rank
        joins = [(self.ranks[a] << 32 | self.ranks[b], rank) for token, rank in self.ranks.items() for a, b in (
            (token[:i], token[i:]) for i in range(1, len(token))) if a in self.ranks and b in self.ranks]
        self.keys, self.joined = np.array(sorted(joins), np.int64).reshape(-1, 2).T

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one match."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ranks, n = self.ranks, len(piece)
        half = 1 << (n - 1).bit_length()              # leaves half .. 2 * half - 1, leaf i for byte i
        none = (self.top + 1) * half
        tree = [none] * (2 * half)
        for i in range(n - 1):
            rank = ranks.get(piece[i:i + 2])
            if rank is not None:
                tree[half + i] = rank * half + i
        for at in range(half - 1, 0, -1):
            left, right = tree[2 * at], tree[2 * at + 1]
            tree[at] = left if left < right else right
        after, before = list(range(1, n + 1)), list(range(-1, n))   # neighbours of live tokens, by first byte

        def renew(i: int, key: int) -> None:
            at = half + i
            tree[at] = key
            while at > 1:
                key = min(key, tree[at ^ 1])
                at >>= 1
                if tree[at] == key:
                    break
                tree[at] = key

        def pair(i: int) -> int:
            """The leaf of the pair that starts with the live token at byte i."""
            middle = after[i]
            if middle >= n or after[middle] - i > self.longest:
                return none
            rank = ranks.get(piece[i:after[middle]])
            return none if rank is None else rank * half + i

        while tree[1] < none:
            i = tree[1] & (half - 1)
            gone = after[i]
            after[i] = after[gone]
            before[after[i]] = i
            renew(gone, none)
            renew(i, pair(i))
            if i:
                renew(before[i], pair(before[i]))
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at:after[at]]])
            at = after[at]
        return out

    def _ranks_of(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        """The ranks of pairs of tokens, ``none`` where two tokens do not join."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.joined[at], none)

    def merge_rows(self, pieces: list[bytes], half: int) -> list[bytes]:
        """Packed ids of matches of at most ``half`` bytes; row r of the table is the tree of match r."""
        n, bits, top = len(pieces), half.bit_length() - 1, self.top + 1
        size = np.array([len(p) for p in pieces])
        token = self.bytes[np.frombuffer(b"".join(p.ljust(half, b"\0") for p in pieces), np.uint8).reshape(n, half)]
        place, row = np.arange(half), np.arange(n)
        live = place < size[:, None]
        after, before = np.tile(place + 1, (n, 1)), np.tile(np.append(place, half) - 1, (n, 1))
        none = top << bits
        tree = np.full((n, 2 * half), none, np.int64)
        ranks = self._ranks_of(token[:, :-1], token[:, 1:], top)
        tree[:, half:-1] = np.where(live[:, 1:] & (ranks < top), ranks << bits | place[:-1], none)
        at = half
        while at > 1:
            tree[:, at // 2:at] = np.minimum(tree[:, at:2 * at:2], tree[:, at + 1:2 * at:2])
            at //= 2

        def renew(rows, leaf, key):
            at = half + leaf
            tree[rows, at] = key
            for _ in range(bits):
                key = np.minimum(key, tree[rows, at ^ 1])
                at >>= 1
                tree[rows, at] = key

        while True:
            root = tree[row, 1]
            row = row[root < none]
            if not len(row):
                break
            root = root[root < none]
            i, rank = root & (half - 1), root >> bits
            gone = after[row, i]
            end = after[row, gone]
            after[row, i], before[row, end], token[row, i], live[row, gone] = end, i, rank, False
            renew(row, gone, none)
            ends = end >= size[row]
            pair = self._ranks_of(rank, token[row, np.where(ends, 0, end)], top)
            renew(row, i, np.where(ends | (pair == top), none, pair << bits | i))
            inner = np.flatnonzero(i > 0)
            rows, first = row[inner], before[row[inner], i[inner]]
            pair = self._ranks_of(token[rows, first], rank[inner], top)
            renew(rows, first, np.where(pair == top, none, pair << bits | first))
        ids, ends = token[live].astype("<u4").tobytes(), np.cumsum(live.sum(axis=1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many matches."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(p) > KEPT_BYTES:
                out[k] = np.array(self.merge(p), "<u4").tobytes()
            else:
                groups.setdefault(1 << (len(p) - 1).bit_length(), []).append(k)
        for half, at in groups.items():
            for a in range(0, len(at), TREES):
                part = at[a:a + TREES]
                for k, ids in zip(part, self.merge_rows([pieces[k] for k in part], half)):
                    out[k] = ids
        return out

    def encode(self, texts: list[str | None], matches) -> list[bytes]:
        """The ids of whole texts, four little-endian bytes each."""
        cache, split = self.cache, [matches(t or "") for t in texts]
        new = list({x for found in split for x in found} - cache.keys())
        made = dict(zip(new, self.merge_many([x.encode() for x in new])))
        if len(cache) + len(made) > KEPT:
            cache.clear()
            new = list({x for found in split for x in found} - made.keys())
            made |= zip(new, self.merge_many([x.encode() for x in new]))
        cache |= made
        out = [b"".join(map(cache.__getitem__, found)) for found in split]
        for x in made:
            if len(x) > KEPT_BYTES:
                del cache[x]
        return out

    def decode(self, runs: list[bytes | None]) -> list[bytes]:
        """The bytes of each run of packed ids."""
        runs = [r[:len(r) & -4] if r else b"" for r in runs]
        ids = np.frombuffer(b"".join(runs), "<u4")
        spelled = self.spelled.take(pa.array(np.minimum(ids, self.top).astype(np.int64)))
        sizes = pc.binary_length(spelled).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        whole = memoryview(spelled.buffers()[2] or b"")          # a fresh array, its data starts at 0
        at = np.concatenate([[0], np.cumsum([len(r) // 4 for r in runs], dtype=np.int64)])
        return [bytes(whole[a:b]) for a, b in zip(ends[at[:-1]].tolist(), ends[at[1:]].tolist())]


@functools.lru_cache(maxsize=2)
def compiled(data: bytes) -> Merges:
    """The tables of a vocabulary, built once per worker."""
    return Merges(data)


def vocabulary(path: str = VOCABULARY) -> bytes:
    data = Path(path).read_bytes()
    if len(data) > FILE_LIMIT:
        raise ValueError(f"a vocabulary of {len(data)} bytes is too large to broadcast")
    return data


def slices(batch: pa.RecordBatch, at: int):
    """The batch in parts whose column ``at`` has bounded bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.append(np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE, prepend=-1)), len(sizes))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield batch.slice(a, b - a)


def encoded(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, text: str = "text",
            keep_text: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """docs with n_tokens and the packed ids (four little-endian bytes each) of every whole text.

    The dict gives the names of the new columns ``ids`` and ``n_tokens``; ``unpacked`` makes
    an array of ids. ``keep_text`` False leaves the text out of the result.
    """
    names = {c: fresh(docs, c) for c in ("ids", "n_tokens")}
    data = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    at = docs.columns.index(text)
    through = [i for i in range(len(docs.columns)) if keep_text or i != at]
    schema = StructType([docs.schema[i] for i in through] + [
        StructField(names["ids"], BinaryType()), StructField(names["n_tokens"], LongType())])

    def run(batches):
        machine, matches = compiled(data.value), regex.compile(pattern).findall
        for whole in batches:
            for batch in slices(whole, at):
                ids = machine.encode(batch.column(at).to_pylist(), matches)
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.record_batch([*(batch.column(i) for i in through), pa.array(ids, pa.binary()), counts], schema.names)

    return docs.mapInArrow(run, schema), names


def decoded(rows: DataFrame, ids: str = "ids", path: str = VOCABULARY) -> tuple[DataFrame, str]:
    """rows with the bytes of their packed ids in a new column of the returned name.

    Bytes, since ids need not end where a character ends; ``F.decode(column, 'utf-8')`` makes text.
    """
    name = fresh(rows, "decoded")
    data = rows.sparkSession.sparkContext.broadcast(vocabulary(path))
    at = rows.columns.index(ids)
    schema = StructType([*rows.schema.fields, StructField(name, BinaryType())])

    def run(batches):
        machine = compiled(data.value)
        for whole in batches:
            for batch in slices(whole, at):
                back = pa.array(machine.decode(batch.column(at).to_pylist()), pa.binary())
                yield pa.record_batch([*batch.columns, back], schema.names)

    return rows.mapInArrow(run, schema), name


def unpacked(packed: bytes | None) -> list[int]:
    """The ids that a packed value holds."""
    return np.frombuffer((packed or b"")[:len(packed or b"") & -4], "<u4").tolist()
