"""Token counts and byte-level BPE against the libraries, on odd and ordinary texts."""

import gc
import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers as P
import pytest
import regex
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from vecloom.llm import byte_bpe, piece_counts, texts
from vecloom.llm.merges import merge_parts

SF = "/root/testdata/sf0.001"
MODEL = P.path("piece_bpe_32k.model")
RANKS = P.path("byte_bpe_50k.tiktoken")

ODD = [
    None, "", " ", "  a  b ", "\n\n a\tb\x00", " " * 700 + "x", "▁▁ a▁ b", "<s>x</s> <0x41>",
    "ab" * 900, "a" * 3000, "'ll I'll WE'VE", "ﬁ ½ Ａ　x​", "日本語テキスト", "😀" * 50,
    "\r\n\r\n  x", "é" * 20, "same", "same", "word " * 60_000, "=-" * 800, "\x1c\x1d \x85",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "n", 0) for i, t in enumerate(ODD)] + [(None, "x y", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int")


def reference_ids():
    ranks = byte_bpe.load_ranks(RANKS)
    made = tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return lambda text: made.encode_ordinary(text or "")


def reference_pieces():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return lambda text: len(model.encode(text or ""))


def test_piece_counts_of_odd_texts(odd):
    rows = piece_counts.token_counts(odd, MODEL, limit=40).collect()
    own = {t.doc_id: t.text for t in odd.collect()}
    count = reference_pieces()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        text = own[r.doc_id]
        assert r.n_tokens == count(text), text and text[:20]
        assert r.n_bytes == len((text or "").encode())
        assert r.over_limit == (r.n_tokens > 40)


def test_bpe_of_odd_texts(odd):
    rows = byte_bpe.encode(odd, RANKS, P.PATTERN, with_ids=True).collect()
    own = {t.doc_id: t.text for t in odd.collect()}
    ids = reference_ids()
    for r in rows:
        text = own[r.doc_id] or ""
        assert r.ids == ids(text), text[:20]
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_decode_round_trip(odd):
    coded = byte_bpe.encode(odd, RANKS, P.PATTERN, with_ids=True)
    back = byte_bpe.decode(coded, RANKS, F.col("ids"))
    own = {t.doc_id: t.text for t in odd.collect()}
    for r in back.collect():
        assert bytes(r.decoded).decode() == (own[r.doc_id] or "")


def test_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = {r.doc_id: r.text for r in docs.collect()}
    ids, pieces = reference_ids(), reference_pieces()
    coded = byte_bpe.encode(docs, RANKS, P.PATTERN, with_ids=True).collect()
    counts = piece_counts.token_counts(docs, MODEL).collect()
    assert len(coded) == len(counts) == len(own)
    assert all(r.ids == ids(own[r.doc_id]) for r in coded)
    assert all(r.n_tokens == pieces(own[r.doc_id]) for r in counts)


def test_empty_table(odd):
    none = odd.filter("doc_id < 0")
    assert piece_counts.token_counts(none, MODEL).count() == 0
    assert byte_bpe.encode(none, RANKS, P.PATTERN).count() == 0


def test_plain_pattern_finds_the_same():
    rng = random.Random(5)
    chars = [chr(c) for c in range(byte_bpe.PLAIN_BELOW)] + list(" \n'stab12 ") * 30
    full, cut = regex.compile(P.PATTERN), byte_bpe.cutter(P.PATTERN)
    for _ in range(300):
        text = "".join(rng.choices(chars, k=80))
        assert cut(text) == full.findall(text)


def test_matrix_and_heap_agree():
    ranks = byte_bpe.load_ranks(RANKS)
    table = byte_bpe.PairTable(ranks)
    rng = random.Random(6)
    pieces = ["".join(rng.choices("thaningoe .", k=rng.randint(1, 90))).encode() for _ in range(300)]
    found = byte_bpe.encode_pieces(pieces, ranks, table)
    for piece, ids in zip(pieces, found):
        whole = ranks.get(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        wanted = [whole] if whole is not None else [ranks[p] for p in merge_parts(parts, ranks)]
        assert np.frombuffer(ids, "<u4").tolist() == wanted


def test_equal_ranks_merge_leftmost_first():
    assert merge_parts("aaaaa", {"aa": 1, "aaaa": 2}) == ["aaaa", "a"]
    assert merge_parts("abcab", {"bc": 0, "ab": 1, "abc": 2}) == ["abc", "ab"]


def test_pieces_are_bounded(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["x" * 3_000_000, None, "y" * 3_000_000, "", "z"]})
    parts = list(texts.pieces(batch, 0))
    assert [p.num_rows for p in parts] == [1, 1, 1, 2]
    assert sum(p.num_rows for p in parts) == 5


def test_caches_are_bounded_in_bytes():
    """Long matches, each of them new, leave nothing behind."""
    runs = [random.Random(i).choice("abcdefgh") * 20_000 + str(i) for i in range(40)]
    kernel = byte_bpe.encoder(byte_bpe.load_ranks(RANKS), r"[a-z0-9]+")(False)
    kernel(runs[:1])
    gc.collect()
    tracemalloc.start()
    for run in runs:
        kernel([run])
    gc.collect()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1_000_000
    assert byte_bpe.CACHE_SIZE * byte_bpe.CACHE_CHARS * 8 < 100_000_000
    assert piece_counts.CACHE_SIZE * piece_counts.CACHE_CHARS * 4 < 100_000_000


def test_matches_longer_than_the_cache_takes(spark):
    runs = ["x" * n for n in (47, 48, 49, 200)] * 2 + ["hello " * 9, "x" * 49 + " hello"]
    df = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")
    ids, count = reference_ids(), reference_pieces()
    got = {r.doc_id: r.n_tokens for r in byte_bpe.encode(df, RANKS, P.PATTERN).collect()}
    assert got == {i: len(ids(t)) for i, t in enumerate(runs)}
    got = {r.doc_id: r.n_tokens for r in piece_counts.token_counts(df, MODEL).collect()}
    assert got == {i: count(t) for i, t in enumerate(runs)}
