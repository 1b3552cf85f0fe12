"""Text, JSON and fingerprint expressions, and the vectorised hook for user scores."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.columns import pick, ref

# Words that count as an improvement, and feedback phrases with the stage they mean.
CHANGE_KEYWORDS = ["improve", "add", "clarify", "specific", "example"]
KEYWORD_STAGES = {
    "data loading": "loader",
    "cleaning": "cleaning",
    "analysis": "profile",
    "features": "features",
    "model": "model",
    "api": "serving",
    "docker": "packaging",
    "deploy": "deployment",
    "drift": "drift",
}


def extract_json(value: Column, schema: str, default: Column | None = None) -> Column:
    """The first ``{`` to last ``}`` of a text (code fences removed) parsed by ``schema``.

    ``default`` replaces text without an object or with one that does not parse.
    """
    bare = F.regexp_replace(F.trim(value), r"^```(?:json)?\n?|\n?```$", "")
    found = F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))
    fields = f"{schema}, _bad STRING"
    parsed = F.from_json(found, fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    good = F.when(found.isNotNull() & parsed["_bad"].isNull(), F.from_json(found, schema))
    return good if default is None else F.coalesce(good, default)


# Every character that separates words, Unicode spaces included.
WORD_BREAK = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"


def tokens(value: Column) -> Column:
    """Distinct words of a text."""
    return F.array_distinct(F.filter(F.split(value, WORD_BREAK), lambda w: w != ""))


def text_change(original: Column, new: Column, keywords: list[str] | None = None) -> Column:
    """Estimated gain of a rewrite: keywords it has plus the share of original words lost, at most 0.3."""
    words = keywords if keywords is not None else CHANGE_KEYWORDS
    lowered = F.lower(new)
    present = sum((F.contains(lowered, F.lit(w)).cast("int") for w in words), F.lit(0))
    before = tokens(original)
    kept = F.size(F.array_intersect(before, tokens(new)))
    lost = 1 - kept / F.greatest(F.size(before), F.lit(1))
    return F.round(F.least(F.lit(0.3), present * 0.05 + lost * 0.1), 3)


def tag_keywords(value: Column, mapping: dict[str, str] | None = None) -> Column:
    """Array of the labels whose keyword occurs in the text, ignoring case."""
    lowered = F.lower(value)
    found = [F.when(F.contains(lowered, F.lit(word.lower())), F.lit(label))
             for word, label in (mapping or KEYWORD_STAGES).items()]
    return F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))


def row_fingerprint(df: DataFrame, cols: list[str] | None = None) -> Column:
    """MD5 of the row as JSON with its columns in name order."""
    return F.md5(F.to_json(F.struct(*[ref(c) for c in sorted(pick(df, cols, df.columns))]),
                           {"ignoreNullFields": "false"}))


def score_with(
    df: DataFrame, fn: Callable[..., pd.Series], inputs: list[str], output: str = "score"
) -> DataFrame:
    """Add a column computed by a user function over batches of pandas Series."""

    def batch(rows: pd.DataFrame) -> pd.Series:
        return fn(*[rows[c] for c in rows.columns])

    return df.withColumn(output, F.pandas_udf(batch, "double")(F.struct(*[ref(c) for c in inputs])))
