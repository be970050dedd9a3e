"""Personal data: fixed patterns, and spans added by a semi-Markov conditional random field.

The patterns give the base spans. The field then segments the tokens around every digit
and every ``@``: a segment of at most ``SPAN`` tokens and ``CHARS`` characters, a single token, or
an unbroken run of key characters, both of any length, may be an entity of one kind, scored
by features of the whole span (its shape, lengths, checks such as Luhn, and what stands
before and after it), all other tokens are segments of one. Dynamic programming over
segment ends chooses boundaries and kinds together; it is exact, since an entity needs a
digit or ``@`` and so lies inside such a window. A found span is added where it overlaps
no base span. Besides the four base kinds the field knows ``secret`` (keys, passwords).

Weights are learnt by the conditional likelihood (forward-backward over segments) on a
bounded sample: about ``WINDOWS`` windows from at most ``DOCS`` lines, labelled by
the patterns and by assignments of long mixed strings. The lines are different ones drawn
by a keyed hash over the whole table, half from all and half in equal parts from the lines
of each kind, so every kind that occurs in such a line is seen wherever it stands; the order of
rows and files plays no part. A sampled secret is seen again shortened to other lengths, after other
cue words and as a key of capitals, so that the field does not learn the one form that a table
happens to hold. A segment of fewer than 7 characters is never an entity. Defined cases: a null or empty text
has no spans; offsets are code points, ends exclusive; repeated rows are judged alike.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import cut

KINDS = ("email", "ip", "card", "phone", "secret")
SPAN, CHARS, DOCS, WINDOWS, PER_LINE, ROUNDS, BOUND = 16, 80, 2_000, 900, 4, 5, 4_000

TRIGGER = re.compile("[0-9@]")
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
#: The patterns of the contract; possessive where giving back can never help.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"(?:token|password|secret|key)\s*=\s*\"?([0-9A-Za-z_-]{12,})|\b([A-Z]{4}[A-Z0-9]{16})\b")
#: What the pattern for secrets looks for before them, and its key of capitals.
CUES, CAPITALS = ("token", "password", "secret", "key"), re.compile("[A-Z]{4}[A-Z0-9]{16}")
CUE = re.compile(r"([^\W\d_]+)\s*[=:]?\s*[\"']?$")
#: Unbroken runs as in keys and tokens, with padding; each is a candidate whatever its length.
RUNS = (re.compile(r"[0-9A-Za-z_-]+"), re.compile(r"[0-9A-Za-z_-]+(?:[.+/~][0-9A-Za-z_-]+)*={0,2}"))
JOINED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-.+/~")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str):
    """Leftmost non-overlapping matches, from one @ to the next."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches that pass their checks."""
    out = [(a, 0, b) for a, b in emails(text)]
    if TRIGGER.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            d = digits_of(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(text: str, at: int) -> bool:
    """Whether the characters on both sides of a place belong to one unbroken run."""
    return 0 < at < len(text) and text[at - 1] in JOINED and text[at] in JOINED


def windows(text: str):
    """Token spans of every stretch around triggers: (start, end) lists, up to SPAN tokens wider on both sides."""
    stop = 0
    for line in re.finditer(r"[^\n]+", text):
        if not TRIGGER.search(text, line.start(), line.end()):
            continue
        before: list[tuple[int, int]] = []
        held: list[tuple[int, int]] = []
        quiet = unbroken = 0
        for m in TOKEN.finditer(text, line.start(), line.end()):
            stop = m.end()
            hot = TRIGGER.search(text, m.start(), stop) is not None
            if hot:
                if not held:
                    held = before[-max(SPAN, unbroken if joined(text, m.start()) else 0):]
                held.append((m.start(), stop))
                quiet = 0
            elif held:
                held.append((m.start(), stop))
                quiet += 1
                if quiet >= SPAN and not joined(text, stop):
                    yield held
                    before, held, unbroken = held[-SPAN:], [], 0
            else:
                before.append((m.start(), stop))
                if not joined(text, m.start()):
                    unbroken = 0
                unbroken += 1
                if len(before) > 4 * max(SPAN, unbroken):
                    before = before[-max(SPAN, unbroken):]
        if held:
            yield held


def shape(text: str) -> str:
    """Runs of letters, digits and the other characters, without their lengths."""
    out = []
    for c in text:
        k = "9" if "0" <= c <= "9" else "a" if c.isalpha() else " " if c.isspace() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def candidates(text: str, tokens: list[tuple[int, int]]):
    """(i, j) of segments that could be entities: bounded, with a digit or @, and with enough characters."""
    hot = [TRIGGER.search(text, a, b) is not None for a, b in tokens]
    found: set[tuple[int, int]] = set()
    begin, end = {t[0]: i for i, t in enumerate(tokens)}, {t[1]: j for j, t in enumerate(tokens, 1)}
    inside: set[int] = set()
    for run in RUNS if tokens else ():                     # longer than a segment only where nothing breaks the run
        for m in run.finditer(text, tokens[0][0], tokens[-1][1]):
            i, j = begin.get(m.start()), end.get(m.end())
            if i is not None and j is not None and (j - i > SPAN or m.end() - m.start() > CHARS) and any(hot[i:j]):
                found.add((i, j))
                if run is RUNS[0]:                         # and such a key is never divided
                    inside.update(x for t in tokens[i:j] for x in t if m.start() < x < m.end())
    for i in range(len(tokens)):
        if i and tokens[i - 1][1] == tokens[i][0] and text[tokens[i][0]].isalnum() and text[tokens[i][0] - 1].isalnum():
            continue                                       # never begins inside a run of letters and digits
        if tokens[i][0] in inside:
            continue
        seen = False
        for j in range(i + 1, min(len(tokens), i + SPAN) + 1):
            seen = seen or hot[j - 1]
            a, b = tokens[i][0], tokens[j - 1][1]
            if b - a > CHARS and j - i > 1 or j - i > 1 and tokens[j - 1][0] - tokens[j - 2][1] > 1:
                break
            if b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
                continue
            if seen and b - a >= 7 and b not in inside:
                found.add((i, j))
    yield from sorted(found)


def features(text: str, a: int, b: int) -> list[str]:
    """Features of a whole span."""
    span = text[a:b]
    d = digits_of(span)
    parts = span.split(".")
    before = text[max(0, a - 24):a].split()[-1:] or [""]
    kind = shape(span)
    octets = len(parts) == 4 and all(p.isdigit() and p.isascii() and int(p) <= 255 for p in parts)
    size = min(b - a, 47) if RUNS[1].fullmatch(span) else b - a            # long keys count as the longest usual ones
    cue = CUE.search(text, max(0, a - 32), a)
    cued = cue is not None and cue[1].lower() in CUES and not set(text[cue.end(1):a]).isdisjoint("=:")
    whole = RUNS[0].fullmatch(span) is not None and len(d) < b - a         # one run with a letter
    return ["bias", f"cued={cued}", f"run={whole}", f"run cued={whole and cued}", f"run of 12={whole and b - a >= 12}",
            f"run of 12 cued={whole and cued and b - a >= 12}", f"capitals={CAPITALS.fullmatch(span) is not None}",
            f"shape={kind[:24]}", f"digits={min(len(d), 20)}", f"luhn={12 <= len(d) <= 19 and luhn(d)}",
            f"octets={octets}", f"at={min(span.count('@'), 2)}", f"dots={min(span.count('.'), 4)}", f"gap={' ' in span}",
            f"length={size // 6}", f"first={shape(span[0])}", f"last={shape(span[-1])}", f"plus={span[0] == '+'}",
            f"mixed={len(d) > 3 and 'a' in kind and not set(kind) - {'a', '9'}}", f"before={before[0][-10:].lower()}",
            f"left={shape(text[a - 1:a])}", f"right={shape(text[b:b + 1])}"]


class Field:
    """Weights by feature and kind; kind -1 (no entity) has score 0."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}

    def scores(self, names: list[str]) -> np.ndarray:
        total = np.full(len(KINDS), -1.0)
        for n in names:
            w = self.weights.get(n)
            if w is not None:
                total = total + w
        return total

    def lattice(self, text: str, tokens: list[tuple[int, int]]):
        ends: dict[int, list] = defaultdict(list)
        for i, j in candidates(text, tokens):
            names = features(text, tokens[i][0], tokens[j - 1][1])
            ends[j].append((i, names, self.scores(names)))
        return ends

    def decode(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the best segmentation."""
        ends = self.lattice(text, tokens)
        best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
        for j in range(1, len(tokens) + 1):
            best[j] = best[j - 1]
            for i, _, s in ends.get(j, ()):
                k = int(s.argmax())
                if best[i] + s[k] > best[j]:
                    best[j], back[j] = best[i] + float(s[k]), (i, k)
        out, j = [], len(tokens)
        while j > 0:
            if back[j] is None:
                j -= 1
                continue
            i, k = back[j]
            out.append((tokens[i][0], k, tokens[j - 1][1]))
            j = i
        return out[::-1]

    def learn(self, text: str, tokens: list[tuple[int, int]], truth: set[tuple[int, int, int]], rate: float) -> None:
        """One step up the conditional likelihood of a window's true segmentation."""
        ends, n = self.lattice(text, tokens), len(tokens)
        ahead = np.zeros(n + 1)
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - 1]] + [ahead[i] + x for i, _, s in ends.get(j, ()) for x in s])
        behind = np.zeros(n + 1)
        starts: dict[int, list] = defaultdict(list)
        for j, found in ends.items():
            for i, _, s in found:
                starts[i].append((j, s))
        for i in range(n - 1, -1, -1):
            behind[i] = np.logaddexp.reduce([behind[i + 1]] + [behind[j] + x for j, s in starts.get(i, ()) for x in s])
        for j, found in ends.items():
            for i, names, s in found:
                step = -np.exp(ahead[i] + s + behind[j] - ahead[n])
                for k in range(len(KINDS)):
                    if (tokens[i][0], k, tokens[j - 1][1]) in truth:
                        step[k] += 1.0
                if np.abs(step).max() > 1e-3:
                    for f in names:
                        w = self.weights.get(f)
                        self.weights[f] = step * rate if w is None else w * (1 - 1e-4) + step * rate


def silver(text: str) -> set[tuple[int, int, int]]:
    found = set(base_spans(text))
    for m in SECRET.finditer(text):
        g = 1 if m.group(1) else 2
        if TRIGGER.search(m.group(g)):
            found.add((m.start(g), 4, m.end(g)))
    return found


def varied(text: str, spans: list[tuple[int, int]], rng: np.random.Generator):
    """(line, its secret's span) of other secrets in the place of each one: shortened, after another cue, in capitals."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    for a, b in spans:
        size = int(rng.integers(12, 31))
        short = text[a:b][:size]
        if len(short) >= 12 and TRIGGER.search(short):
            yield text[:a] + short + text[b:], (a, a + len(short))
            lead = f"{CUES[rng.integers(len(CUES))]}{'=' if rng.random() < 0.5 else ' = '}"
            line = text[:a].rsplit(" ", 3)[0] + " " + lead
            yield line + short + " " + text[b:].lstrip("\"'"), (len(line), len(line) + len(short))
        key = "".join(letters[i] for i in rng.integers(0, 26, 4)) + "".join(letters[i] for i in rng.integers(0, 32, 15)) + str(rng.integers(10))
        yield text[:a] + key + text[b:], (a, a + 20)
        yield f"{text[:a].rsplit(' ', 3)[0]} {key} {text[b:]}", (len(text[:a].rsplit(" ", 3)[0]) + 1, len(text[:a].rsplit(" ", 3)[0]) + 21)


def strata(limit: int) -> list[int]:
    """How many lines each stratum gives: one for every silver kind, and a last one that every line belongs to."""
    return [max(1, limit // (2 * len(KINDS)))] * len(KINDS) + [max(1, limit // 2)]


def _least(limit: int):
    """Map batches of (line, key) to each stratum's (stratum, key, line) of the least keys in the task."""
    quota = strata(limit)

    def run(batches):
        held: list[dict[int, str]] = [{} for _ in quota]

        def shrink(s: int) -> None:
            held[s] = {k: held[s][k] for k in sorted(held[s])[:quota[s]]}

        for batch in batches:
            for line, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for s in {len(KINDS), *(k for _, k, _ in silver(line))}:
                    held[s][key] = line
                    if len(held[s]) >= 4 * quota[s]:
                        shrink(s)
        for s in range(len(quota)):
            shrink(s)
            yield pa.record_batch([pa.array([s] * len(held[s]), pa.int32()), pa.array(list(held[s]), pa.int64()),
                                   pa.array(list(held[s].values()), pa.string())], ["stratum", "key", "line"])

    return run


def sample(docs: DataFrame, limit: int = DOCS) -> list[list[str]]:
    """Different lines of each stratum with the least keyed hashes in the whole table, least first."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where(
        F.col("line").rlike("[0-9@]") & (F.char_length("line") <= BOUND))
    keyed = lines.select("line", F.shiftrightunsigned(F.xxhash64("line", F.lit(5)), 2).alias("key"))
    # each task keeps its own least keys; buckets by size of the key then bound what is gathered here
    narrow = cut(keyed.mapInArrow(_least(limit), "stratum int, key long, line string").withColumn(
        "bucket", F.floor(F.log2(F.col("key") + 1.0) * 16).cast("int")))
    per = narrow.groupBy("stratum", "bucket").agg(F.countDistinct("key").alias("n")).orderBy("stratum", "bucket").collect()
    quota = strata(limit)
    last, seen = {}, [0] * len(quota)
    for r in per:
        if seen[r["stratum"]] < quota[r["stratum"]]:
            last[r["stratum"]] = r["bucket"]
        seen[r["stratum"]] += r["n"]
    wanted = F.lit(False)
    for s, bucket in last.items():
        wanted = wanted | ((F.col("stratum") == s) & (F.col("bucket") <= bucket))
    rows = narrow.where(wanted).select("stratum", "key", "line").distinct().collect()
    out: list[list[str]] = [[] for _ in quota]
    for r in sorted(rows, key=lambda r: (r["key"], r["line"])):
        if len(out[r["stratum"]]) < quota[r["stratum"]]:
            out[r["stratum"]].append(r["line"])
    return out


def fit(docs: DataFrame, limit: int = DOCS) -> Field:
    """Weights from lines with triggers, at most ``limit`` of them and of BOUND characters."""
    drawn = sample(docs, limit)
    kinds = [(line, k) for turn in itertools.zip_longest(*drawn[:-1]) for k, line in enumerate(turn) if line is not None]
    field, examples, used, rng = Field(), [], set(), np.random.default_rng(5)
    for pair in itertools.zip_longest(kinds, ((line, None) for line in drawn[-1])):     # in turn one of a kind, one of all
        for text, kind in filter(None, pair):
            if text in used:
                continue
            used.add(text)
            truth = silver(text)
            found = list(windows(text))
            if kind is not None:                           # the windows that show the kind come first
                spans = [(a, b) for a, k, b in truth if k == kind]
                found.sort(key=lambda w: not any(w[0][0] <= a and b <= w[-1][1] for a, b in spans))
            examples += [(text, w, truth) for w in found[:PER_LINE]]
            if kind == KINDS.index("secret"):
                for other, (a, b) in itertools.islice(varied(text, spans, rng), 4):
                    labels = {x for x in silver(other) if x[2] <= a or b <= x[0]} | {(a, KINDS.index("secret"), b)}
                    examples += [(other, w, labels) for w in windows(other) if w[0][0] <= a and b <= w[-1][1]][:1]
        if len(examples) >= WINDOWS:
            break
    for r in range(ROUNDS):
        for at in rng.permutation(len(examples)):
            field.learn(*examples[at], rate=0.3 / (1 + r))
    return field


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, base and added spans), by start and kind."""
    base = base_spans(text)
    if not TRIGGER.search(text):
        return base, base
    added = []
    for tokens in windows(text):
        for a, k, b in field.decode(text, tokens):
            if all(b <= x or y <= a for x, _, y in base) and all(b <= x or y <= a for x, _, y in added[-4:]):
                added.append((a, k, b))
    return base, sorted(base + added)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts of base spans, their digest, all spans, and how many were added, for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(field)       # bounded by the sample it was fitted on
    names = ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "n_added", "base_sha256", "spans"]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = all_spans(text or "", shared.value)
                kinds = [sum(1 for s in base if s[1] == k) for k in range(4)]
                rows.append((*kinds, len(every) - len(base), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
            columns = list(zip(*rows)) if rows else [()] * 7
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string")
