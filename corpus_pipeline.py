"""A corpus from ``documents``: known languages, no near copies, no personal data, mixed to
target weights, as token ids.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept. ``run`` writes
each stage to the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from vecloom.llm import byte_bpe, language, mixing, pii, simhash
from vecloom.session import even_scan, materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark, docs, sf_dir):
    """Documents whose language is recognised; those without a letter, or as far from every
    profile as a text can be, go."""
    docs = docs.select(*COLUMNS)
    profiles = language.learn(docs)
    found = language.identify(docs, profiles, [F.col(c) for c in COLUMNS])
    known = F.col("lang_pred") != language.UNKNOWN
    return found.filter(known & (F.col("score") >= language.MIN_SCORE)).select(*COLUMNS)


def one_of_copies(spark, docs, sf_dir):
    """One document of each group of near copies: three-word shingles, two bits."""
    return simhash.keep_one(docs.select(*COLUMNS), shingle=3, max_bits=2)


def without_personal_data(spark, docs, sf_dir):
    """Personal data replaced by its kind; ``n_chars`` follows the text."""
    docs = docs.select(*COLUMNS)
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def target_mix(spark, docs, sf_dir):
    """Each document as often as the mix of sources takes it."""
    return mixing.repeat_documents(docs.select(*COLUMNS))


def token_ids(spark, docs, sf_dir):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode(
        docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, with_ids=True
    )


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_copies),
    ("personal_data", without_personal_data),
    ("mix", target_mix),
    ("tokens", token_ids),
]

# Boosted trees, profiles and fingerprints have no SQL form; a test holds the rows against a
# brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = even_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
