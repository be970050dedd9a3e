"""The corpus pipeline against its parts in plain Python."""

import collections
import re

import corpus_pipeline
from foldspark.session import cut
from test_text_operators import bag, key_of, measures


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        tables.append(cut(stage(spark, tables[-1], sf)))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert tables[-1].columns == docs.columns
    good = {r.doc_id: r.text for r in tables[1].collect()}
    for i, r in rows.items():
        n_words, chars, symbols, dup, repeat = measures(r.text)
        if n_words < 50 or 2 * repeat > n_words or 10 * symbols > n_words:
            assert i not in good
    owner = {}
    for i in sorted(good):
        for x in good[i].split("\n"):
            owner.setdefault(key_of(x), i)
    lines = {r.doc_id: r.text for r in tables[2].collect()}
    assert lines == {i: "\n".join(x for x in t.split("\n") if len(key_of(x)) < 10 or owner[key_of(x)] == i) for i, t in good.items()}
    bags, label = {i: bag(t) for i, t in lines.items()}, {i: i for i in lines}
    ids = sorted(lines)
    for i in ids:
        for j in ids:
            if j < i:
                m = sum((bags[i] & bags[j]).values())
                if m >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - m):
                    a, b = label[i], label[j]
                    label = {k: min(a, b) if x in (a, b) else x for k, x in label.items()}
    kept = {r.doc_id: r.text for r in tables[3].collect()}
    assert set(kept) == set(label.values())
    mixed = collections.Counter(r.doc_id for r in tables[4].collect())
    assert set(mixed) == set(kept)
    tokens = tables[5].collect()
    assert collections.Counter(r.doc_id for r in tokens) == mixed and all(r.round_trip for r in tokens)
    assert all(r.n_tokens == 0 if not kept[r.doc_id] else r.n_tokens > 0 for r in tokens)


def test_names_of_the_stages():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and all(re.fullmatch("[a-z -]+", n) for n in names)
