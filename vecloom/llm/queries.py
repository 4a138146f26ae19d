"""Registered queries of this subpackage and their SQL twins.

Each query applies its operator to the whole of its table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm import (
    byte_bpe,
    graph_index,
    language,
    lexical,
    licenses,
    line_quality,
    mixing,
    pii,
    piece_counts,
    quality,
    simhash,
    spelling,
    warc,
)
from vecloom.session import even_scan


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of ``documents``; a table in few small files is spread over the cores."""
    return even_scan(read(spark, sf_dir, "documents").select("doc_id", "text", *columns))


def op1_graph_neighbours(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    found = graph_index.nearest(rows, F.col("vec_id") % 20 == 0, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_language(spark, sf_dir):
    docs = texts(spark, sf_dir, "lang")
    profiles = language.learn(docs)
    keep = [F.col("doc_id"), language.held_out().alias("held_out")]
    return language.identify(docs, profiles, keep)


def op3_source_mix(spark, sf_dir):
    mixed = mixing.mix_documents(texts(spark, sf_dir, "source"))
    return mixed.withColumn("target", F.round("target", 6))


def op4_byte_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode(texts(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op5_quality_rules(spark, sf_dir):
    return quality.apply_rules(texts(spark, sf_dir))


def op6_warc_packages(spark, sf_dir):
    pages = even_scan(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.round_trip(pages).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op7_personal_data(spark, sf_dir):
    docs = texts(spark, sf_dir)
    return pii.find(docs, pii.fit(docs), [F.col("doc_id")])


def op8_licenses(spark, sf_dir):
    """Documents as files of a tree by source, language and hundreds of ids, where the first
    of a hundred is named as the licence file of its directory."""
    docs = texts(spark, sf_dir, "source", "lang")
    name = F.when(F.col("doc_id") % 100 == 0, "LICENSE").otherwise(
        F.concat(F.col("doc_id"), F.lit(".txt"))
    )
    path = F.concat_ws("/", "source", "lang", F.expr("doc_id div 100"), name)
    files = docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")
    return licenses.scan(files).select(
        F.col("id").alias("doc_id"), "path", "license", "basis",
        F.round("score", 6).alias("score"), "from_dir",
    )


def op9_piece_counts(spark, sf_dir):
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_counts.token_counts(texts(spark, sf_dir), model)


def op10_simhash(spark, sf_dir):
    found = simhash.near_duplicates(texts(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op11_lexical_search(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark")
    found = lexical.search(texts(spark, sf_dir), items, k=10)
    return found.withColumnRenamed("id", "doc_id")


def op12_line_quality(spark, sf_dir):
    docs = texts(spark, sf_dir)
    field = line_quality.fit(docs, read(spark, sf_dir, "labels"))
    keep = [F.col("doc_id"), line_quality.held_out().alias("held_out")]
    return line_quality.score(docs, field, keep)


def op13_spelling_variants(spark, sf_dir):
    return spelling.group_variants(texts(spark, sf_dir))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


# -- SQL twins ------------------------------------------------------------------------------

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIX = rf"""
    WITH sized AS (
        SELECT doc_id, source, len({WORDS})::bigint AS size,
               md5('42:' || coalesce(doc_id::varchar, md5(coalesce(text, '')))) AS h
        FROM documents),
    sources AS (
        SELECT source, sum(size)::bigint AS source_size,
               [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
        FROM sized GROUP BY source),
    -- Sources by the level at which they are full: those before the first that is not.
    levels AS (
        SELECT *, 2.0 * source_size / w AS full_at,
               coalesce(sum(2 * source_size) OVER below, 0) AS full_below,
               sum(w) OVER () - coalesce(sum(w) OVER below, 0) AS w_left,
               1.5 * sum(source_size) OVER () AS total,
               row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS k
        FROM sources
        WINDOW below AS (ORDER BY 2.0 * source_size / w, source NULLS LAST
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (SELECT arg_min((total - full_below) / w_left, k) FILTER (
                  (total - full_below) <= full_at * w_left) AS l FROM levels),
    targets AS (
        SELECT source, source_size,
               least(coalesce(l, 1e300) * w, 2.0 * source_size)::double AS target
        FROM levels, level),
    placed AS (
        SELECT s.*, source_size, target, round(target)::bigint AS goal,
               coalesce(sum(size) OVER (
                   PARTITION BY s.source ORDER BY h, doc_id NULLS FIRST, size
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before
        FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
    wholes AS (
        SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS n FROM placed)
    SELECT doc_id, size, source_size, round(target, 6) AS target,
           (n * size + greatest(0, least(size, goal - n * source_size - before)))::bigint AS taken
    FROM wholes"""


STOP_LIST = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

RULE_SQL = " AND ".join(
    f"({bound})"
    for measure, of, least, most in quality.RULES
    for bound in (
        [f"{measure} >= {of or 1} * {least}::double"] * (least is not None)
        + [f"{measure} <= {of or 1} * {most}::double"] * (most is not None)
    )
)

QUALITY = rf"""
    WITH docs AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS words,
               list_filter(string_split(coalesce(text, ''), chr(10)),
                           lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM documents),
    windows AS (
        SELECT r, i, words[i : i + 2] AS w FROM (
            SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM docs)),
    twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
    covered AS (
        SELECT r, count(DISTINCT i + k)::bigint AS n FROM twice, range(3) t(k) GROUP BY r),
    measured AS (
        SELECT doc_id, len(words)::bigint AS n_words,
               length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint AS word_chars,
               len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint AS n_symbols,
               len(list_filter(words, lambda w: lower(w) IN ({STOP_LIST})))::bigint
                   AS n_stop_words,
               len(lines)::bigint AS n_lines,
               (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines,
               coalesce(n, 0)::bigint AS n_repeat_words
        FROM docs LEFT JOIN covered USING (r)),
    judged AS (
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
        FROM measured)
    SELECT *, NOT base_failed AND {RULE_SQL} AS kept FROM judged"""

# Base 32 of a SHA-1: five hexadecimal digits make four characters.
BASE32 = """list_aggregate(list_transform(range(32), lambda i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)),
    'string_agg', '')"""

WARC = f"""
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
               min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
        FROM pages)
    SELECT page_id, strlen(html)::bigint AS payload_bytes, {BASE32} AS payload_digest,
           CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END
               AS record_type,
           CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
    FROM p"""

def quoted(text: str) -> str:
    return text.replace("'", "''")


LEXICAL_TERMS = r"""regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

LEXICAL = f"""
    WITH items AS (
        SELECT q, item_id, unnest(list_distinct(terms)) AS term FROM (
            SELECT row_number() OVER () AS q, item_id, {LEXICAL_TERMS} AS terms FROM benchmark)),
    docs AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce({LEXICAL_TERMS}, []) AS terms
        FROM documents),
    whole AS (
        SELECT count(*) FILTER (len(terms) > 0)::bigint AS n, sum(len(terms))::bigint AS l
        FROM docs),
    tf AS (
        SELECT r, doc_id, len::bigint AS len, term, count(*)::bigint AS tf FROM (
            SELECT r, doc_id, len(terms) AS len, unnest(terms) AS term FROM docs)
        WHERE term IN (SELECT term FROM items) GROUP BY ALL),
    weights AS (
        SELECT term, floor(1000 * ln((2 * any_value(n) + 2)::double / (2 * count(*) + 1)))::bigint
            AS w
        FROM tf, whole GROUP BY term),
    scores AS (
        SELECT q, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
               sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len * n) // l))))::bigint
                   AS score
        FROM items JOIN tf USING (term) JOIN weights USING (term), whole GROUP BY q, r)
    SELECT item_id, (row_number() OVER best)::int AS rank, doc_id, score
    FROM scores WHERE score > 0
    WINDOW best AS (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)
    QUALIFY row_number() OVER best <= 10"""

TERM_LIST = "regexp_extract_all(lower({}), '" + licenses.TERM + "')"
TEMPLATE_ROWS = ", ".join(
    f"({i}, '{name}', '{quoted(text)}')" for i, (name, text) in enumerate(licenses.TEMPLATES)
)

LICENSES = rf"""
    WITH docs AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
               concat_ws('/', source, lang, doc_id // 100,
                         CASE WHEN doc_id % 100 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END)
                   AS path
        FROM documents),
    templates(t, license, text) AS (VALUES {TEMPLATE_ROWS}),
    template_tf AS (
        SELECT t, license, term, count(*) AS tf
        FROM (SELECT t, license, unnest({TERM_LIST.format('text')}) AS term FROM templates)
        GROUP BY ALL),
    vocabulary AS (SELECT DISTINCT term FROM template_tf),
    total AS (SELECT count(*) AS n FROM docs),
    df AS (
        SELECT term, count(DISTINCT r) AS df
        FROM (SELECT r, unnest({TERM_LIST.format('text')}) AS term FROM docs)
        JOIN vocabulary USING (term) GROUP BY term),
    idf AS (
        SELECT term, ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0 AS idf
        FROM vocabulary LEFT JOIN df USING (term), total),
    template_w AS (
        SELECT t, license, term, tf * idf AS w,
               sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY t)) AS size,
               regexp_matches(term, '[0-9]')::int AS number,
               sum(regexp_matches(term, '[0-9]')::int) OVER (PARTITION BY t) AS numbers
        FROM template_tf JOIN idf USING (term)),
    units AS (
        SELECT r, row_number() OVER (PARTITION BY r ORDER BY NOT is_line, i) AS u, is_line, unit
        FROM (
            SELECT r, true AS is_line, generate_subscripts(l, 1) AS i, unnest(l) AS unit
            FROM (SELECT r, string_split(text, chr(10)) AS l FROM docs)
            UNION ALL
            SELECT r, false, generate_subscripts(l, 1), unnest(l)
            FROM (SELECT r, list_filter(regexp_split_to_array(text, '\n[ \t\r]*\n'),
                                        lambda p: contains(p, chr(10))) AS l FROM docs)
            UNION ALL
            SELECT r, false, 1000000000, text FROM docs
            WHERE regexp_matches(path, '{licenses.FILE_NAME}')
               OR regexp_matches(lower(text), '{licenses.WHOLE}'))
        WHERE regexp_matches(lower(unit), '{licenses.MENTIONS}')
          AND NOT regexp_matches(lower(unit), '{licenses.DENIALS}')),
    words AS (
        SELECT r, u, is_line, len({TERM_LIST.format('unit')}) AS length,
               unnest({TERM_LIST.format('unit')}) AS term
        FROM units),
    unit_w AS (
        SELECT r, u, is_line, length, term,
               count(*) * coalesce(any_value(idf), any_value(ln(n + 1.0) + 1.0)) AS w
        FROM words LEFT JOIN idf USING (term), total GROUP BY ALL),
    sizes AS (SELECT r, u, sqrt(sum(w * w)) AS size FROM unit_w GROUP BY ALL),
    scored AS (
        SELECT r, u, is_line, length, t, license,
               round(sum(a.w * b.w / b.size) / any_value(s.size), 9) AS score
        FROM unit_w a JOIN template_w b USING (term) JOIN sizes s USING (r, u)
        GROUP BY r, u, is_line, length, t, license
        HAVING sum(b.number) = any_value(b.numbers)),
    each AS (
        SELECT r, u, is_line, length, license, max(score) AS score FROM scored
        GROUP BY r, u, is_line, length, license),
    best AS (
        SELECT *, coalesce(round(score - lead(score) OVER nearest, 9) >= {licenses.MARGIN}, true)
                   AS clear
        FROM each
        WINDOW nearest AS (PARTITION BY r, u ORDER BY score DESC, license DESC)
        QUALIFY row_number() OVER nearest = 1 AND score >= {licenses.MIN_COSINE}),
    lengths AS (SELECT r, len({TERM_LIST.format('text')}) AS words FROM docs),
    own AS (
        SELECT r, arg_max(struct_pack(l := CASE WHEN clear THEN license END, s := score),
                          (clear, score, -u)) AS b,
               sum(CASE WHEN is_line THEN length ELSE 0 END) / any_value(words) AS covered
        FROM best JOIN lengths USING (r) GROUP BY r),
    named AS (
        SELECT r, doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, b.l AS license,
               b.s AS score,
               CASE WHEN regexp_matches(path, '{licenses.FILE_NAME}') THEN 1.0 ELSE covered END
                   AS covered
        FROM docs LEFT JOIN own USING (r)),
    dirs AS (
        SELECT dir AS from_dir,
               arg_max(struct_pack(l := license), (license IS NOT NULL, covered,
                       coalesce(score, 0), coalesce(license, ''))).l AS above
        FROM named WHERE covered >= {licenses.LICENSE_FILE} GROUP BY dir),
    found AS (
        SELECT d.dir, arg_max(struct_pack(a := above, f := from_dir), len(from_dir)) AS x
        FROM (SELECT DISTINCT dir FROM named) d
        JOIN dirs ON d.dir = from_dir OR from_dir = '' OR starts_with(d.dir, from_dir || '/')
        GROUP BY d.dir)
    SELECT doc_id, path, CASE WHEN score IS NULL THEN x.a ELSE license END AS license,
           CASE WHEN license IS NOT NULL THEN 'file' WHEN score IS NOT NULL THEN 'unclear'
                WHEN x.a IS NOT NULL THEN 'directory' END AS basis,
           round(score, 6) AS score, CASE WHEN score IS NULL THEN x.f END AS from_dir
    FROM named LEFT JOIN found USING (dir)"""


def oracle_sql() -> dict[str, str]:
    """Twins of the queries that SQL can express; tests hold the others against plain
    versions."""
    return {
        "op3_source_mix": MIX,
        "op5_quality_rules": QUALITY,
        "op6_warc_packages": WARC,
        "op8_licenses": LICENSES,
        "op11_lexical_search": LEXICAL,
    }
