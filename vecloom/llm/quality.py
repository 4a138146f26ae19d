"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a Spark expression over the whole text, and every rule a bound on a ratio
of measures; no user function runs and no row moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.texts import BLANKS, WORD

SYMBOLS = "#*$%&|<>"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "was", "as", "on", "be",
    "der", "die", "das", "und", "ist", "nicht", "von", "zu", "mit", "ein", "den",
    "le", "la", "les", "de", "des", "et", "est", "que", "pour", "dans", "un", "une", "en",
    "el", "los", "las", "y", "por", "con", "para", "del", "se", "al",
]

# measure / of, least, most. Documents outside any bound are not kept.
RULES = [
    ("n_words", None, 50, 100_000),
    ("word_chars", "n_words", 3.0, 12.0),
    ("n_symbols", "n_words", None, 0.15),
    ("n_stop_words", "n_words", 0.05, None),
    ("n_dup_lines", "n_lines", None, 0.4),
    ("n_repeat_words", "n_words", None, 0.5),
]


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value made once: the elements of a lambda are evaluated once
    a row, while a repeated expression would be evaluated at every mention."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: Column, window: int = 3) -> Column:
    """Words inside windows that are found twice or more in the list.

    Windows are sorted by hash, so equal ones become neighbours; n log n for a text.
    """
    first = F.sequence(F.lit(0), F.size(words) - window)

    def flagged(ordered: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            same = lambda j: (j >= 0) & (F.get(ordered, j)["h"] == x["h"])
            return F.coalesce(same(i - 1), F.lit(False)) | F.coalesce(same(i + 1), F.lit(False))

        return F.filter(ordered, twice)

    windows = F.transform(
        first,
        lambda i: F.struct(
            F.xxhash64(*[F.get(words, i + k) for k in range(window)]).alias("h"), i.alias("i")
        ),
    )
    found = bound(F.sort_array(windows), flagged)
    covered = F.flatten(
        F.transform(found, lambda x: F.array(*[x["i"] + k for k in range(window)]))
    )
    return F.when(F.size(words) >= window, F.size(F.array_distinct(covered))).otherwise(0)


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the measures of RULES to the columns of ``df``; null texts have no words.

    Words and lines are made in a projection of their own, which later ones share.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    split = df.withColumns(
        {
            "__words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
            "__lines": lines,
            "__text": text,
        }
    )
    words, text = F.col("__words"), F.col("__text")
    lower = F.transform(words, lambda w: F.lower(w))
    return split.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
            "n_symbols": (
                F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
            ).cast("long"),
            "n_stop_words": F.size(F.filter(lower, lambda w: w.isin(STOP_WORDS))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (
                F.size("__lines") - F.size(F.array_distinct("__lines"))
            ).cast("long"),
            "n_repeat_words": repeat_words(words).cast("long"),
        }
    ).drop("__words", "__lines", "__text")


def compiled(rules=RULES) -> Column:
    """One condition from the table; ratios compare products, so nothing divides by zero."""
    verdict = F.lit(True)
    for measure, of, least, most in rules:
        base = F.lit(1) if of is None else F.col(of)
        if least is not None:
            verdict = verdict & (F.col(measure) >= base * F.lit(least))
        if most is not None:
            verdict = verdict & (F.col(measure) <= base * F.lit(most))
    return verdict


def apply_rules(df: DataFrame, keep: list[str] = ("doc_id",), rules=RULES) -> DataFrame:
    """(keep..., the measures, base_failed, kept) of every row.

    A null or empty text has no words and fails the base rules. Repeated rows stay; an empty
    table gives none; columns other than ``keep`` and the text are not read, so their names
    cannot clash.
    """
    text = F.col("text").alias("__input")
    rows = measured(df.select(*keep, text), "__input").drop("__input")
    words = F.col("n_words")
    failed = (words < 50) | (100 * F.col("n_repeat_words") > 50 * words)
    return rows.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & compiled(rules)
    )
