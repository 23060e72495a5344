"""Contexts of entities and subsequence search: O-68, O-72."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castgraph.operators.entities import first_match, last_match

MOST_ALIASES = 10_000


def entity_contexts(mentions: DataFrame, lengths: DataFrame, width: int = 10) -> DataFrame:
    """(book, entity, ctx_idx, start, end): the k-th mention's window of ``width`` tokens each side; starts don't reach back over the previous mention."""
    w = Window.partitionBy("book", "entity").orderBy("pos")
    prev = F.coalesce(F.lag("pos").over(w), F.lit(-1))
    out = mentions.join(lengths, "book").select("book", "entity", (F.row_number().over(w) - 1).alias("ctx_idx"), F.greatest(F.col("pos") - width, prev + 1).alias("start"), F.least(F.col("pos") + width + 1, F.col("n_tokens")).alias("end"))
    return out


def context_texts(contexts: DataFrame, books: DataFrame) -> DataFrame:
    """Adds the text; books: (book, tokens array)."""
    return contexts.join(books, "book").select("book", "entity", "ctx_idx", "start", "end", F.array_join(F.slice("tokens", F.col("start") + 1, F.col("end") - F.col("start")), " ").alias("text"))


def mention_contexts(books: DataFrame, aliases: DataFrame, width: int = 10) -> DataFrame:
    """(book, entity, ctx_idx, start, end, text) of every mention, as ``entity_contexts`` and ``context_texts`` give them; books: (book, tokens array).

    The tokens around a mention are cut out of the array before it is exploded, so no row meets a book's tokens again; only mentions are shuffled.
    Names are looked up in the row while there are at most MOST_ALIASES of them, in a join beyond.
    """
    known = [r[0] for r in aliases.select("alias").distinct().limit(MOST_ALIASES + 1).collect()]
    tokens = F.transform("tokens", lambda t, i: F.struct(i.alias("pos"), t.alias("token")))
    if len(known) <= MOST_ALIASES:
        tokens = F.filter(tokens, lambda x: x["token"].isin(known))
    around = F.transform(tokens, lambda x: F.struct(x["pos"].alias("pos"), x["token"].alias("token"), F.slice("tokens", F.greatest(x["pos"] - width, F.lit(0)) + 1, F.least(x["pos"], F.lit(width)) + width + 1).alias("around")))
    rows = books.select("book", F.size("tokens").alias("n_tokens"), F.explode(around).alias("m")).select("book", "n_tokens", "m.*")
    # a token counts by the name it is replaced with, then by the entity that name is found as
    names = first_match(aliases).withColumnsRenamed({"alias": "token", "canonical": "name"}).join(last_match(aliases).withColumnsRenamed({"alias": "name", "canonical": "entity"}), "name").select("token", "entity")
    w = Window.partitionBy("book", "entity").orderBy("pos")
    start = F.greatest(F.col("pos") - width, F.coalesce(F.lag("pos").over(w), F.lit(-1)) + 1)
    cut = rows.join(names, "token").select("book", "entity", (F.row_number().over(w) - 1).alias("ctx_idx"), start.alias("start"), F.least(F.col("pos") + width + 1, F.col("n_tokens")).alias("end"), "around", F.greatest(F.col("pos") - width, F.lit(0)).alias("first"))
    return cut.select("book", "entity", "ctx_idx", "start", "end", F.array_join(F.slice("around", F.col("start") - F.col("first") + 1, F.col("end") - F.col("start")), " ").alias("text"))


def first_subsequence(tokens: Column, wanted: Column) -> Column:
    """0-based place of the first occurrence of a run of tokens; lower case is tried next; else 0.

    Linear: the run is located in the joined tokens, and the marks before it are counted.
    """
    mark = "\x01"

    def at(t: Column, w: Column) -> Column:
        joined = F.concat(F.lit(mark), F.array_join(t, mark), F.lit(mark))
        place = F.call_function("locate", F.concat(F.lit(mark), F.array_join(w, mark), F.lit(mark)), joined)
        before = F.substring(joined, F.lit(1), place - 1)
        return F.when((place > 0) & (F.size(w) > 0), F.char_length(before) - F.char_length(F.replace(before, F.lit(mark), F.lit(""))))

    low = lambda c: F.transform(c, F.lower)
    return F.coalesce(at(tokens, wanted), at(low(tokens), low(wanted)), F.lit(0))
