"""Quality rules, line first: bad lines go, and documents that lose too much text are rejected.

Every line is held against three families of rules (punctuation, navigation, boilerplate); failing lines
are removed. A document is rejected if the removed lines hold more than ``max_lost`` per cent of its word
characters, if it has fewer than ``min_words`` words, or if more than ``max_repeat`` per cent of its words
stand in five-word windows that occur twice or more. All of it is native columns on one scan, without a shuffle.

Defined results: a null or empty text has no words and is rejected; repeated rows are judged one by one;
an empty table gives an empty table; other columns pass through ``clean`` untouched whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, aside, restored, words

#: Characters counted as symbols.
SYMBOLS = r"[^#*$%&|<>]+"
#: What is neither punctuation nor symbol.
PLAIN = r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+"
#: Four or more short pieces between separators.
NAV_TRAIL = r"^([^|»›•>]{1,30}[|»›•>]){3,}[^|»›•>]{0,30}$"
#: Lines that are nothing but a navigation label.
NAV_LABEL = (
    r"(?i)^[\x20\x09-\x0D]*(home|menu|log ?in|sign (in|up)|register|search|contact us|about us|next|previous|"
    r"back to top|skip to (main )?content|share|tweet|read more|more)[\x20\x09-\x0D]*$"
)
#: Phrases of page furniture.
FURNITURE = (
    r"(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|enable javascript|"
    r"subscribe to our newsletter|click here|this site uses cookies)"
)


@dataclass(frozen=True)
class LineRules:
    min_words: int = 10
    max_repeat: int = 20
    max_lost: int = 50
    #: Per cent of a line's characters that may be punctuation and symbols.
    max_punctuation: int = 50
    #: Furniture phrases condemn lines of at most so many characters; in long lines they are prose.
    furniture_chars: int = 200


def line_fails(line: Column, rules: LineRules) -> Column:
    """Whether a line breaks a rule; a line without a word never does."""
    marks = F.length(F.regexp_replace(line, PLAIN, ""))
    return (
        (marks * 100 > F.length(line) * rules.max_punctuation)
        | line.rlike(NAV_TRAIL)
        | line.rlike(NAV_LABEL)
        | ((F.length(line) <= rules.furniture_chars) & line.rlike(FURNITURE))
    )


def word_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, WHITE, ""))


def judge(docs: DataFrame, text: str = "text", rules: LineRules | None = None) -> DataFrame:
    """Add the measures, ``_lt_clean`` (the text without its failing lines) and ``_lt_kept`` to every row.

    Measures are the columns ``_lt_n_words``, ``_lt_word_chars``, ``_lt_n_symbols``, ``_lt_n_dup_lines``,
    ``_lt_n_repeat_words``, ``_lt_base_failed`` and ``_lt_lost_chars``; given columns that begin with ``_lt_`` are not returned.
    """
    rules = rules or LineRules()
    body = F.coalesce(F.col(text), F.lit(""))
    tokens, grams, pairs, starts = (F.col(f"_lt_{x}") for x in ("tokens", "grams", "pairs", "starts"))

    df = docs.drop(*(c for c in docs.columns if c.startswith("_lt_") and c != text)).withColumn("_lt_tokens", words(F.col(text)))
    df = df.withColumn("_lt_n_words", F.size(tokens).cast("long"))
    # Windows of five words as 64-bit hashes; only texts that repeat one are sorted.
    df = df.withColumn(
        "_lt_grams",
        F.transform(
            F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 4, F.lit(0))),
            lambda w, i: F.xxhash64(w, *(F.get(tokens, i + k) for k in range(1, 5))),
        ),
    )
    df = df.withColumn("_lt_repeats", F.size(F.array_distinct(grams)) < F.size(grams))
    df = df.withColumn(
        "_lt_pairs",
        F.when(F.col("_lt_repeats"), F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    df = df.withColumn(
        "_lt_starts",
        F.sort_array(
            F.filter(
                F.transform(pairs, lambda x, i: F.when((x["h"] == F.get(pairs, i - 1)["h"]) | (x["h"] == F.get(pairs, i + 1)["h"]), x["i"])),
                lambda x: x.isNotNull(),
            )
        ),
    )
    df = df.withColumn(
        "_lt_n_repeat_words",
        F.coalesce(
            F.aggregate(
                F.transform(starts, lambda p, i: F.least(F.lit(5), F.coalesce(F.get(starts, i + 1) - p, F.lit(5)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
            F.lit(0).cast("long"),
        ),
    )
    lines = F.split(body, "\n", -1)
    worded = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lt_lines", lines).withColumn("_lt_worded", worded)
    df = df.withColumn("_lt_good", F.filter(F.col("_lt_lines"), lambda x: ~line_fails(x, rules)))
    df = df.withColumn("_lt_clean", F.array_join(F.col("_lt_good"), "\n"))
    df = (
        df.withColumn("_lt_word_chars", F.length(F.array_join(tokens, "")).cast("long"))
        .withColumn("_lt_n_symbols", F.length(F.regexp_replace(body, SYMBOLS, "")).cast("long"))
        .withColumn("_lt_n_dup_lines", (F.size("_lt_worded") - F.size(F.array_distinct("_lt_worded"))).cast("long"))
    )
    df = df.withColumn("_lt_lost_chars", F.col("_lt_word_chars") - word_length(F.col("_lt_clean")))
    df = df.withColumn(
        "_lt_base_failed",
        (F.col("_lt_n_words") < rules.min_words) | (F.col("_lt_n_repeat_words") * 100 > F.col("_lt_n_words") * rules.max_repeat),
    )
    df = df.withColumn(
        "_lt_kept", ~F.col("_lt_base_failed") & (F.col("_lt_lost_chars") * 100 <= F.col("_lt_word_chars") * rules.max_lost)
    )
    return df.drop("_lt_tokens", "_lt_grams", "_lt_repeats", "_lt_pairs", "_lt_starts", "_lt_lines", "_lt_worded", "_lt_good")


def clean(docs: DataFrame, text: str = "text", rules: LineRules | None = None) -> DataFrame:
    """Kept rows only, in the columns of ``docs``, each text without its failing lines (``n_chars`` follows it)."""
    # The row number keeps the filter above the projections: pushed below, it would repeat their work many times over.
    df = judge(aside(docs, text=F.col(text)), "text", rules).withColumn("_lt_row", F.monotonically_increasing_id())
    df = df.filter(F.col("_lt_kept") & (F.col("_lt_row") >= 0))
    new = {text: F.col("_lt_clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_lt_clean").cast("long")
    return restored(df, docs.columns, **new)
