"""Project names: normal form, words, unity-project numbers."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type prefixes dropped once, punctuation that separates words.
TYPE_PREFIX = r"^(abs/nbs|nbs/abs|abs|nbs|neu-|aus-|um-)\s*"
PUNCTUATION = r"[/\-–—,;:()\[\].]"


def nfc(text: Column) -> Column:
    """Composed form of the text; Spark has no built-in for it. Text below U+0300 is composed
    as it stands and doesn't go to Python."""

    @F.pandas_udf("string")
    def compose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return F.coalesce(compose(F.when(text.rlike(r"[^\x00-\u02FF]"), text)), text)


def normalize_name(name: Column, compose: bool = False) -> Column:
    """Lower case without one leading type prefix, punctuation as blanks, blanks collapsed.

    ``compose`` brings decomposed letters together first; leave it off for input known to be
    composed to stay with built-in expressions.
    """
    text = F.lower(nfc(name) if compose else name)
    text = F.regexp_replace(F.regexp_replace(text, TYPE_PREFIX, ""), PUNCTUATION, " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def name_tokens(normal: Column) -> Column:
    """Distinct words of a normalised name."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda w: w != ""))


def token_share(a: Column, b: Column) -> Column:
    """Shared distinct words over the larger word count; 0 when either has none."""
    ta, tb = name_tokens(a), name_tokens(b)
    most = F.greatest(F.size(ta), F.size(tb))
    return F.when((F.size(ta) > 0) & (F.size(tb) > 0), F.size(F.array_intersect(ta, tb)) / most).otherwise(F.lit(0.0))


def vde_number(text: Column) -> Column:
    """Number after the unity-project mark ("VDE Nr. 8.1b"), null without one."""
    found = F.regexp_extract(text, r"(?iu)(?<![\p{L}\p{N}_])VDE\s*(?:Nr\.?\s*)?(\d+(?:\.\d+[a-z]?)?)(?![\p{L}\p{N}_])", 1)
    return F.when(found != "", found)


def pooled_agreement(name: Column) -> Column:
    """Whether the name says that the agreement is pooled."""
    return F.coalesce(name.rlike(r"(?iu)(?<![\p{L}\p{N}_])SV(?![\p{L}\p{N}_])|Sammelfinanzierungsvereinbarung"), F.lit(False))
