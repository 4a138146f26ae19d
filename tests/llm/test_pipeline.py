"""The pipeline against a plain version, stage by stage, and on odd rows."""

from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import public_tokenizers as P
import tiktoken
from test_language import brute as plain_languages
from test_mixing import plain_targets
from test_pii import plain as plain_spans
from test_simhash import brute_components, brute_fingerprint

from vecloom.llm import byte_bpe, language, mixing, pii

SF = "/root/testdata/sf0.001"


def plain_kept(rows):
    """Rows that the language and near-copy stages keep."""
    score = {i: (lang, s) for i, lang, s in plain_languages([r[:3] for r in rows])}
    known = [
        r for r in rows
        if score[r[0]][0] != language.UNKNOWN and score[r[0]][1] >= language.MIN_SCORE
    ]
    parts = brute_components([(r[0], brute_fingerprint(r[1])) for r in known])
    first = {i for i, _, component in parts if i == component}
    return [r for r in known if r[0] in first]


def plain_redacted(rows, detector):
    """Base spans come from the patterns as stated, further ones from the detector."""
    out = []
    for doc_id, text, lang, source in rows:
        base = [(pii.KINDS.index(k), a, b) for k, a, b in plain_spans(text)]
        ((own, every),) = pii.all_spans([text], detector)
        assert own == base
        chars = list(text)
        for kind, a, b in sorted(every, key=lambda s: -s[1]):
            assert all(x[1] >= b or x[2] <= a for x in every if x != (kind, a, b))
            chars[a:b] = [f"[{pii.KINDS[kind].upper()}]"]
        out.append((doc_id, "".join(chars), lang, source))
    return out


def plain_copies(rows):
    """How often each document is taken, whole documents only."""
    import hashlib

    sizes = {r[0]: len(r[1].split()) for r in rows}
    totals = defaultdict(int)
    for r in rows:
        totals[r[3]] += sizes[r[0]]
    targets, out = plain_targets(totals), Counter()
    for source, total in totals.items():
        goal, before = int(targets[source] + 0.5), 0
        own = [r[0] for r in rows if r[3] == source]
        for i in sorted(own, key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest()):
            part = max(0, min(sizes[i], goal - goal // total * total - before))
            before += sizes[i]
            out[i] = goal // total + (2 * part >= sizes[i])
    return out


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    kept = plain_kept(rows)
    stages = dict(pipeline.STAGES)
    one = stages["language"](spark, docs, SF)
    two = stages["near_copies"](spark, one, SF)
    assert two.columns == docs.columns
    assert sorted(r.doc_id for r in two.collect()) == sorted(r[0] for r in kept)
    clean = plain_redacted(kept, pii.fit(two))
    copies = plain_copies(clean)
    ranks = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    wanted = Counter()
    for doc_id, text, _, _ in clean:
        wanted[(doc_id, tuple(reference.encode_ordinary(text)))] += copies[doc_id]
    got = Counter((r.doc_id, tuple(r.ids)) for r in pipeline.run(spark, SF).collect())
    assert got == +wanted


def test_odd_rows(spark):
    words = "the cat and the dog went to see a house by the sea "
    rows = [
        (1, words * 4, "en", "a", 10), (1, words * 4, "en", "a", 10), (2, words * 4, None, None, None),
        (3, None, "en", "a", 0), (4, "", "de", "b", 0), (5, "12 34 --", "en", "b", 5),
        (None, "der Hund und die Katze " * 5, "de", "b", 1), (6, "der Hund ging " * 9, "de", "b", 1),
        (7, words + "a@b.cc", "en", "c", 3), (8, words * 9_000, "en", "c", 3),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "'clash' AS score", "1 AS __row")
    given = docs
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        found = docs.collect()
        if name != "tokens":
            assert docs.columns == pipeline.COLUMNS, name
        if name == "near_copies":
            assert Counter(r.doc_id for r in found)[1] <= 1
            assert not {3, 4, 5} & {r.doc_id for r in found}
        if name == "personal_data":
            assert [r.text for r in found if r.doc_id == 7] == [words + "[EMAIL]"]
            assert all(r.n_chars == len(r.text) for r in found)
    assert found
    docs = given.filter("doc_id = 99")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_mix_weights_are_the_contract():
    assert (mixing.WEIGHTS, mixing.SHARE, mixing.EPOCHS) == ((5, 2, 1), 1.5, 2)
