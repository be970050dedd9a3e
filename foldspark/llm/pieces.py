"""SentencePiece encoding and decoding as a shortest path through a composed transducer.

Three machines are compiled from the model file: the normaliser (spaces become U+2581,
one in front), the pieces as a trie whose arcs spell each piece, and a byte fallback that
spells a character without a piece as its UTF-8 bytes. A merge model adds an acceptor of
piece pairs: two neighbouring pieces have weight 0 if merging their joined characters
gives back exactly these two, else no arc. Composed with an input the lattice is walked
once from left to right, keeping for each position the best weight of each last piece
(min, plus), where the weights are the pieces' negative log probabilities. Under the pair
acceptor one finite path leads to each position, the model's own encoding of what lies
before it, so there the search takes long arcs first and leaves a position for good when
no path goes on from it.

No piece spans the start of a run of U+2581, nor a character that is in no longer piece,
so a text is cut there, and each distinct part is composed once per worker (bounded
caches). Executors get the model's bytes by broadcast (one file, under MODEL_LIMIT).

Defined cases: null and empty texts have no ids; control pieces are never matched, their
names in a text are ordinary characters; U+2581 in a text decodes as a space; models with
a compiled character map or user-defined pieces are refused.
"""

from __future__ import annotations

import functools
import math
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import fresh

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MODEL_LIMIT = 64 << 20
#: Fixed values of the model format.
SPACE, NORMAL, UNKNOWN, USER, BYTE, UNIGRAM, MERGES = "▁", 1, 2, 4, 6, 1, 2
#: Parts kept in a worker's cache, the longest one kept, and piece pairs kept.
PARTS, PART_CHARS, PAIRS = 400_000, 40, 1_500_000


def _fields(data: bytes):
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at:at + size]
        at += size


class Transducer:
    def __init__(self, model: bytes):
        pieces, scores, kinds = [], [], []
        self.kind, self.prefix, squeeze = UNIGRAM, True, True
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                pieces.append(f[1].decode())
                scores.append(float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(f.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(_fields(value))
                if f.get(2):
                    raise ValueError("models with a compiled character map are not supported")
                self.prefix, squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
        if self.kind not in (UNIGRAM, MERGES) or USER in kinds:
            raise ValueError("only unigram and merge models without user-defined pieces are supported")
        self.squeeze, self.pieces, self.scores = squeeze, pieces, scores
        self.vocabulary = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == BYTE}
        self.unknown = kinds.index(UNKNOWN)
        self.trie: dict = {}
        for p, i in self.vocabulary.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i                                  # the arc that ends a piece
        worst = min((scores[i] for i in self.vocabulary.values()), default=0.0)
        self.missing = 10.0 - worst                       # weight of a character without a piece
        longer = {c for p in self.vocabulary if len(p) > 1 for c in p}
        inner = any(SPACE in p.lstrip(SPACE) for p in self.vocabulary)
        #: line ends stand alone where no longer piece has one; pieces never span the start of a run of spaces
        stop = "\n" if "\n" not in longer else ""
        self.parts = None if inner else re.compile(f"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+" + (f"|[{stop}]" if stop else ""))
        self.cache: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        spelled = [bytes([int(p[3:5], 16)]) if k == BYTE else (p.replace(SPACE, " ").encode() if k in (NORMAL, UNKNOWN) else b"")
                   for p, k in zip(pieces, kinds)]
        self.spelled = pa.array(spelled, pa.large_binary())

    def merged(self, text: str) -> list[str]:
        """The merge rules on a few characters: the best-scored neighbours first, leftmost among equals."""
        symbols = list(text)
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                found = self.vocabulary.get(symbols[i] + symbols[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if at < 0:
                return symbols
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]

    def joins(self, left: int, right: int) -> bool:
        """Whether the pair acceptor has the arc from piece left to piece right; left -1 begins an input."""
        key = (left + 1) * len(self.pieces) + right
        found = self.pairs.get(key)
        if found is None:
            pair = [self.pieces[right]] if left < 0 else [self.pieces[left], self.pieces[right]]
            found = self.merged("".join(pair)) == pair
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def path(self, part: str) -> list[int]:
        """Ids along the shortest path of one part."""
        return self._finite_path(part) if self.kind == MERGES else self._least_path(part)

    def _fallback(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def _arcs(self, part: str, i: int) -> list[tuple[int, int]]:
        """(piece, end) of the pieces that begin at i, short ones first; piece -1 is the byte fallback."""
        node, out = self.trie, []
        for j in range(i, len(part)):
            node = node.get(part[j])
            if node is None:
                break
            piece = node.get("")
            if piece is not None:
                out.append((piece, j + 1))
        if not out or out[0][1] > i + 1:
            out.insert(0, (-1, i + 1))
        return out

    def _finite_path(self, part: str) -> list[int]:
        """The only path that the pair acceptor leaves: each position is entered once."""
        n, size, pairs = len(part), len(self.pieces), self.pairs
        at, last, arcs = 0, -1, self._arcs(part, 0)
        behind: list[tuple[int, int, list]] = []
        dead: set[int] = set()
        while at < n:
            while arcs:
                piece, end = arcs.pop()
                if end in dead:
                    continue
                if piece >= 0:
                    ok = pairs.get((last + 1) * size + piece)
                    if not (self.joins(last, piece) if ok is None else ok):
                        continue
                behind.append((at, last, arcs))
                at, last = end, piece
                arcs = self._arcs(part, end) if end < n else []
                break
            else:
                dead.add(at)
                at, last, arcs = behind.pop()
        ends = [b[0] for b in behind[1:]] + [n]
        used = [b[1] for b in behind[1:]] + [last]
        out: list[int] = []
        for i, end, piece in zip([0, *ends], ends, used):
            out.extend([piece] if piece >= 0 else self._fallback(part[i:end]))
        return out

    def _least_path(self, part: str) -> list[int]:
        n = len(part)
        best = [(0.0, -1, -1)] + [(math.inf, -1, -1)] * n       # weight, position before, piece
        for i in range(n):
            for piece, end in self._arcs(part, i):
                weight = best[i][0] + (self.missing if piece < 0 else -self.scores[piece])
                if weight < best[end][0]:
                    best[end] = (weight, i, piece)
        at, out = n, []
        while at > 0:
            _, before, piece = best[at]
            out.append([piece] if piece >= 0 else self._fallback(part[before:at]))
            at = before
        return [x for ids in reversed(out) for x in ids]

    def normal(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as the bytes of 32-bit numbers."""
        if not text:
            return b""
        text = self.normal(text)
        found = [text] if self.parts is None else self.parts.findall(text)
        cache = self.cache
        try:
            return b"".join([cache[x] for x in found])
        except KeyError:
            pass
        out = []
        for x in found:
            ids = cache.get(x)
            if ids is None:
                ids = np.array(self.path(x), np.int32).tobytes()
                if len(x) <= PART_CHARS:
                    if len(cache) >= PARTS:
                        cache.clear()
                    cache[x] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        spelled = self.spelled.take(pa.array(ids))
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(spelled).to_numpy(zero_copy_only=False))]).astype(np.int64)
        whole = b"".join(spelled.to_pylist()) if spelled.offset else memoryview(spelled.buffers()[2] or b"").tobytes()
        out = []
        for a, b in zip(ends[offsets[:-1]], ends[offsets[1:]]):
            text = whole[a:b].decode("utf-8", "replace")
            out.append(text[1:] if self.prefix and text.startswith(" ") else text)
        return out


@functools.lru_cache(maxsize=2)
def compiled(model: bytes) -> Transducer:
    """The machines of a model, built once per worker."""
    return Transducer(model)


def _model_bytes(path: str) -> bytes:
    data = Path(path).read_bytes()
    if len(data) > MODEL_LIMIT:
        raise ValueError(f"a model of {len(data)} bytes is too large to broadcast")
    return data


def encoded(docs: DataFrame, model_path: str = MODEL, keep_text: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """docs with ids, n_tokens and round_trip (the ids decode to the text); the dict gives the columns' names.

    ``keep_text`` False leaves the text out of the result.
    """
    names = {c: fresh(docs, c) for c in ("ids", "n_tokens", "round_trip")}
    model = docs.sparkSession.sparkContext.broadcast(_model_bytes(model_path))
    columns = [c for c in docs.columns if keep_text or c != "text"]
    at, limit = docs.columns.index("text"), 8 << 20
    through = [docs.columns.index(c) for c in columns]
    out_names = [*columns, *names.values()]

    def run(batches):
        machine = compiled(model.value)
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.append(np.flatnonzero(np.diff(np.cumsum(sizes) // limit, prepend=-1)), len(sizes))
            for a, b in zip(cuts[:-1], cuts[1:]):
                batch = whole.slice(int(a), int(b - a))
                texts = batch.column(at).to_pylist()
                runs = [machine.encode(t) for t in texts]
                offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in runs])]).astype(np.int32)
                ids = np.frombuffer(b"".join(runs), np.int32)
                back = machine.decode(ids, offsets)
                same = pa.array([x == (t or "") for x, t in zip(back, texts)])
                new = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                       pa.array(np.diff(offsets).astype(np.int64)), same]
                yield pa.record_batch([batch.column(i) for i in through] + new, out_names)

    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType
    schema = StructType([docs.schema[docs.columns.index(c)] for c in columns] + [
        StructField(names["ids"], ArrayType(IntegerType())), StructField(names["n_tokens"], LongType()),
        StructField(names["round_trip"], BooleanType())])
    return docs.mapInArrow(run, schema), names


def decoded(rows: DataFrame, ids: str = "ids", model_path: str = MODEL) -> tuple[DataFrame, str]:
    """rows with the text of their ids in a new column of the returned name.

    Null lists give an empty text; ids that are null or not in the vocabulary give nothing.
    """
    name = fresh(rows, "decoded")
    model = rows.sparkSession.sparkContext.broadcast(_model_bytes(model_path))

    def run(batches):
        machine = compiled(model.value)
        known = len(machine.spelled)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            runs = [np.array([i for i in x or () if i is not None and 0 <= i < known], np.int32) for x in lists.to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            flat = np.concatenate(runs) if runs else np.zeros(0, np.int32)
            yield pa.record_batch([*batch.columns, pa.array(machine.decode(flat, offsets), pa.string())],
                                  [*batch.schema.names, name])

    from pyspark.sql.types import StringType, StructField, StructType
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, StringType())])), name
