"""Text books as token tables: O-01, O-15..O-17, O-70.

Tokens never leave their row until they are exploded, so cleaning and renumbering need no shuffle and no window.
A null text has no tokens; a token that is all punctuation becomes '' and keeps its position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castgraph.functions.words import PUNCTUATION, STOP_WORDS, WHITE_SPACE


def raw_tokens(text: Column) -> Column:
    """Lower-cased parts between white space."""
    return F.filter(F.split(F.lower(text), WHITE_SPACE), lambda t: t != "")


def clean_tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Raw tokens without punctuation, then without stop words."""
    bare = F.transform(raw_tokens(text), lambda t: F.translate(t, PUNCTUATION, ""))
    stop = STOP_WORDS if stop_words is None else stop_words
    return F.filter(bare, lambda t: ~t.isin(stop)) if stop else bare  # a hash set of literals


def token_table(df: DataFrame, book: str, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """(book, pos, token): cleaned tokens with positions from 0, renumbered after cleaning."""
    return df.select(F.col(book).alias("book"), F.posexplode(clean_tokens(F.col(text), stop_words)).alias("pos", "token"))


def token_counts(df: DataFrame, book: str, text: str) -> DataFrame:
    return df.select(F.col(book).alias("book"), F.coalesce(F.size(raw_tokens(F.col(text))), F.lit(0)).alias("n_raw"), F.coalesce(F.size(clean_tokens(F.col(text))), F.lit(0)).alias("n_clean"))
