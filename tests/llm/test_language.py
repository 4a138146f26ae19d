"""Rank-order profiles against a plain version, and held-out accuracy."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from vecloom.llm import language

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not words:
        return Counter()
    line = " " + " ".join(words) + " "
    out = Counter(c for c in line if c != " ")
    for n in (2, 3):
        out.update(line[i : i + n] for i in range(len(line) - n + 1))
    return out


def code(gram):
    value = 0
    for c in gram:
        value = value << 21 | ord(c)
    return value


def ranked(counts, size):
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]


def brute(rows, size=language.PROFILE):
    totals = {}
    for doc_id, text, lang in rows:
        if doc_id is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % 3 != 1:
            totals.setdefault(lang, Counter()).update(plain_grams(text))
    profiles = {k: {g: i for i, g in enumerate(ranked(v, size))} for k, v in totals.items() if v}
    out = []
    for doc_id, text, _ in rows:
        own = ranked(plain_grams(text), size)
        if not own or not profiles:
            out.append((doc_id, "und", 0.0))
            continue
        gaps = {
            k: sum(abs(p[g] - i) if g in p else size for i, g in enumerate(own))
            for k, p in profiles.items()
        }
        best = min(sorted(gaps), key=gaps.get)
        out.append((doc_id, best, round(1 - gaps[best] / (size * len(own)), 9)))
    return sorted(out, key=repr)


def predicted(df, profiles):
    rows = language.identify(df, profiles, [F.col("doc_id")]).collect()
    return sorted(((r.doc_id, r.lang_pred, round(r.score, 9)) for r in rows), key=repr)


def test_matches_plain_version_and_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    got = predicted(docs, language.learn(docs))
    assert got == brute(rows)
    lang = {i: x for i, _, x in rows}
    held = [(i, p) for i, p, _ in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(lang[i] == p for i, p in held) / len(held) > 0.97


def test_odd_rows(spark):
    rows = [
        (1, None, "en"), (2, "", "en"), (3, "123 --- !!", "de"), (4, "Straße ÜBER", "de"),
        (5, "the cat", "en"), (5, "the cat", "en"), (None, "le chat", "fr"), (7, "x", None),
        (8, "日本 語", "ja"), (9, "İstanbul ǅ ﬁ", "tr"), (10, "word " * 50_000, "en"),
        (11, "a-b", "en"), (12, " a", "de"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df = df.withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit("clash"))
    assert predicted(df, language.learn(df)) == brute(rows)
    held = {r.doc_id: r.h for r in df.select("doc_id", language.held_out().alias("h")).collect()}
    assert held[None] is False
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in held.items() if i)


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    profiles = language.learn(df)
    assert profiles == {}
    assert predicted(df, profiles) == [(1, "und", 0.0)]
    assert predicted(df.filter("doc_id = 0"), profiles) == []
