"""Brute force and edge cases of spelling variants, lexical search and byte-level BPE."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

import __spark_entry__ as entry_module
from foldspark.llm import bytebpe, lexical, spelling

SCHEMA = "doc_id long, text string, ids int, n_tokens string, word string, n int, item int, decoded int, score int"


def made_texts():
    rng = random.Random(7)
    stems = ["".join(rng.choice("abcdeéÀ") for _ in range(rng.randint(5, 9))) for _ in range(60)]

    def bent(w):
        i, kind = rng.randrange(len(w)), rng.randrange(3)
        return w[:i] + ("" if kind == 0 else rng.choice("xyzÿ")) + w[i + (kind < 2):]

    def long(n):
        return " ".join(bent(w) if rng.random() < 0.1 else w for w in rng.choices(stems, k=n))

    texts = [None, "", " \n\t ", "one", long(4000), long(300).upper(), "a" * 20000, "aaaaaab aaaaab aaaaaaab " * 9, "日本語 text٣٤ ½x",
             "it's  we'll\n\n  x   \n", "!!! ??? ...", "  x\u0085y", "bookkeeper bokkeeper bookeeper bookkeepers " * 7,
             "emoji 👩‍👩‍👧 <|endoftext|> \0 tail", "0123456789 " * 50]
    return texts + [long(150) for _ in range(25)] + ["the same tie", "the same tie", "The-Same_Tie!"]


@pytest.fixture(scope="module")
def table(spark):
    """Null, repeated and unordered ids, repeated rows, and columns with names used inside."""
    rows = [(100 - i if i % 9 else None, t, i, "x", "y", 1, 2, 3, 4) for i, t in enumerate(made_texts())]
    rows += [rows[5], rows[5], rows[7]]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), [(r[0], r[1]) for r in rows]


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# -- spelling variants


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words_of(rows):
    counts = collections.Counter()
    for key, text in rows:
        for raw in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(raw)
            h = None if key is None else zlib.crc32(f"{key}:{run}".encode())
            if h is not None and h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def variants_of(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    best = {w: min(xs, key=lambda x: (-words[x], x)) for w, xs in near.items() if xs}
    form = {w: x for w, x in best.items() if words[x] >= 5 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def got_variants(df):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_spelling_variants_equal_brute_force(table):
    docs, rows = table
    want = variants_of(words_of(rows))
    assert sum(r[1] is not None for r in want) > 5
    assert got_variants(spelling.spelling_variants(docs)) == want


def test_neighbours_of_random_words(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))): rng.choice([5, 7, 40, 300, 9000]) for _ in range(260)}
    words["$a$"], words[""], words["日本"], words["日"] = 5, 5, 5, 25
    df = spark.createDataFrame([(w, n, 1) for w, n in words.items()] + [(None, 3, 1)], "word string, n long, root int")
    want = variants_of(words)
    assert any(r[1] != r[2] for r in want if r[1])          # some forms have a form themselves
    assert got_variants(spelling.variants(df)) == want


def test_words_with_the_terminator_have_no_neighbours(spark):
    df = spark.createDataFrame([("abc\0def", 5), ("abcdef", 50)], "word string, n long")
    assert {r["word"]: r["n_near"] for r in spelling.variants(df).collect()} == {"abc\0def": 0, "abcdef": 0}


def test_no_words(nothing):
    assert spelling.spelling_variants(nothing).collect() == []


# -- lexical search


def terms(text):
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text or ""))


def searched(rows, items, k):
    held = [(key, collections.Counter(terms(t))) for key, t in rows]
    held = [(key, c) for key, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        asked, scores = collections.Counter(terms(text)), []
        for key, c in held:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // n_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m))
                    for w, times in asked.items() if w in c)
            if s > 0:
                scores.append((-s, key is None, key or 0, key))
        out += [(item, i + 1, key, -s) for i, (s, _, _, key) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "block_bytes"), [(10, lexical.BLOCK_BYTES), (3, 400)])
def test_search_equals_brute_force(spark, table, k, block_bytes):
    docs, rows = table
    texts = [t for t in made_texts() if t and len(t) < 5000]
    items = [(i, t[:200]) for i, t in enumerate(texts[:12])] + [
        (90, None), (91, ""), (92, "nowhere found"), (93, "the same tie"), (93, "the same tie THE"), (None, "one"), (94, "日本語 ½x"), (95, "a" * 20000)]
    frame = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    got = [tuple(r) for r in lexical.ranked(docs, frame, k, block_bytes=block_bytes).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == searched(rows, items, k)


def test_search_of_nothing(spark, table, nothing):
    docs, _ = table
    items = spark.createDataFrame([(1, "the same tie")], "item_id long, text string")
    assert lexical.ranked(nothing, items).collect() == []
    assert lexical.ranked(docs, items.limit(0)).collect() == []


def test_best_keeps_ties_by_id():
    rng = np.random.default_rng(0)
    scores, ids = rng.integers(0, 4, (500, 6)), rng.permutation(500)
    lost = (ids % 7 == 0).astype(np.int64)
    best = lexical.Best(6, 5)
    for a in range(0, 500, 60):
        best.add(scores[a:a + 60], lost[a:a + 60], ids[a:a + 60])
    for j in range(6):
        want = sorted((-scores[i, j], lost[i], ids[i]) for i in range(500) if scores[i, j] > 0)[:5]
        mine = best.kept[0] == j
        assert [(-s, n, i) for _, s, n, i in zip(*(x[mine] for x in best.kept))] == want


# -- byte-level BPE


@pytest.fixture(scope="module")
def library():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(table, library):
    docs, rows = table
    out, names = bytebpe.encoded(docs)
    assert names == {"ids": "_ids", "n_tokens": "_n_tokens"}
    back, name = bytebpe.decoded(out, names["ids"])
    got = sorted((r["doc_id"] or -1, r["text"] or "", bytebpe.unpacked(r["_ids"]), r["_n_tokens"], bytes(r[name])) for r in back.collect())
    want = sorted((k or -1, t or "", library.encode_ordinary(t or ""), len(library.encode_ordinary(t or "")), (t or "").encode()) for k, t in rows)
    assert name == "_decoded" and got == want


def test_merges_of_random_bytes(library, monkeypatch):
    machine, rng = bytebpe.compiled(bytebpe.vocabulary()), random.Random(1)
    for n in (1, 2, 3, 5, 8, 17, 64, 65, 300, 5000):
        for letters in ("ab", "aaab", "theran", "  \n", "éüa日"):
            piece = "".join(rng.choice(letters) for _ in range(n))
            assert machine.merge(piece.encode()) == library._encode_single_piece(piece.encode()), (n, letters)
    pieces = ["".join(rng.choice(a) for _ in range(rng.randint(1, 64))).encode() for a in ("ab", "theran ", "éüa日", "aaab") for _ in range(400)]
    want = [library._encode_single_piece(p) for p in pieces]
    for rows in (4096, 7):                                 # side by side, in one table and in several
        monkeypatch.setattr(bytebpe, "TREES", rows)
        assert [bytebpe.unpacked(x) for x in machine.merge_many(pieces)] == want


def test_the_cache_starts_anew(library, monkeypatch):
    machine, matches = bytebpe.Merges(bytebpe.vocabulary()), regex.compile(bytebpe.PATTERN).findall
    monkeypatch.setattr(bytebpe, "KEPT", 40)
    texts = [f"word{i} other{i % 7} the {'x' * (i * 3)}" for i in range(60)]
    for a in range(0, 60, 9):
        got = machine.encode([*texts[a:a + 9], None, ""], matches)
        assert [bytebpe.unpacked(x) for x in got] == [*map(library.encode_ordinary, texts[a:a + 9]), [], []]
    assert len(machine.cache) < 100 and max(map(len, machine.cache)) <= bytebpe.KEPT_BYTES


def test_every_vocabulary_merges_like_the_library():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    machine = bytebpe.Merges(bytebpe.vocabulary(path))
    for x in ("Donaudampfschifffahrtsgesellschaft", "наоборот" * 40, "数据处理" * 9):
        assert machine.merge(x.encode()) == own._encode_single_piece(x.encode())


def test_bad_ids_decode_to_nothing(spark, library):
    good = np.array(library.encode_ordinary("hello there"), "<u4").tobytes()
    rows = [(0, good), (1, None), (2, b""), (3, good + b"\1\2"), (4, np.array([2**32 - 1, 50256, 50257], "<u4").tobytes() + good)]
    back, name = bytebpe.decoded(spark.createDataFrame(rows, "k int, ids binary"))
    assert {r["k"]: bytes(r[name]) for r in back.collect()} == {0: b"hello there", 1: b"", 2: b"", 3: b"hello there", 4: b"hello there"}


def test_bpe_of_no_rows(nothing):
    out, names = bytebpe.encoded(nothing, keep_text=False)
    assert out.collect() == [] and "text" not in out.columns
    assert bytebpe.decoded(out, names["ids"])[0].collect() == []


def test_bpe_query(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = entry_module.queries()["op13_byte_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
