"""Spelling variants against brute force over all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.llm import spelling

SF = "/root/testdata/sf0.001"
UP = {i: i + 32 for i in range(65, 91)}


def one_edit(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_counts(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def brute(rows):
    counts = plain_counts(rows)
    # Each word under itself and under itself without any one letter: near words share one.
    shared = {}
    for w in counts:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            shared.setdefault(key, []).append(w)
    near = {w: set() for w in counts}
    for group in shared.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    forms = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, len(near[w]), counts.get(forms[w])))
    return sorted(out)


def grouped(df):
    return sorted(tuple(r) for r in spelling.group_variants(df).collect())


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = grouped(docs)
    assert got == expected
    assert any(form for _, form, *_ in got) and any(r != w and f != r for w, f, r, *_ in got)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (None, "Hello HELLO hello hallo"), (3, "hallo Hallo hallo hallo"),
        (3, "hallo Hallo hallo hallo"), (4, "Élan-élanx ÉLANX Élanx élanx élanx"), (5, "×÷×÷× " * 3),
        (6, "日本語日本語 " * 4), (7, "word5word wordword " * 3), (8, "x" * 3000 + " "),
        (9, ("y" * 2999 + " ") * 3 + ("y" * 3000 + " ") * 9 + ("y" * 1000 + "z" + "y" * 1999 + " ") * 4),
        (10, "colour " * 40 + "color " * 9 + "colr " * 5 + "colors " * 4 + "kolor " * 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = df.withColumn("word", F.lit(1)).withColumn("n", F.lit("n")).withColumn("m", F.lit(2))
    got = grouped(clash)
    assert got == brute(rows)
    by_word = {r[0]: r for r in got}
    assert by_word["kolor"][1:3] == ("color", "colour")
    assert grouped(df.where("doc_id = 1")) == grouped(df.where("doc_id = 99")) == []


def test_half_of_all_words_share_a_half(spark):
    """A key of very many words is cut into blocks without losing a pair."""
    rng = np.random.default_rng(7)
    words = {"abcd" + "".join(rng.choice(list("abcdef"), 4)) for _ in range(900)}
    words |= {"".join(rng.choice(list("abcdef"), rng.integers(5, 10))) for _ in range(900)}
    rows = [(w, int(n)) for w, n in zip(sorted(words), rng.integers(3, 99, len(words)))]
    df = spark.createDataFrame(rows, "word string, n long")
    counts = dict(rows)
    found = spelling.near_words(df, part_words=64, block_words=50).collect()
    got = {r.word: (r.n_near, r.near_n, r.near) for r in found}
    expected = {}
    for w in counts:
        near = [v for v in counts if one_edit(w, v)]
        if near:
            best = min(near, key=lambda v: (-counts[v], v))
            expected[w] = (len(near), counts[best], best)
    assert got == expected


WORD = st.text("abé", min_size=1, max_size=7)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORD, min_size=1, max_size=80, unique=True))
def test_bitsets_match_definition(words):
    every = np.ones(len(words), bool)
    query, near, _, _ = spelling.near_pairs(words, every, every)
    got = sorted(zip(query.tolist(), near.tolist()))
    pairs = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b)]
    assert got == pairs


def test_ratio_below_two_is_refused(spark):
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    with pytest.raises(ValueError):
        spelling.group_variants(df, ratio=1)
