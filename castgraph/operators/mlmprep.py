"""Preparation of masked-language-model data: O-24..O-26."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = "[MASK]"


def mask_names(text: Column, names: list[str], mask: str = MASK) -> Column:
    """Names replaced as substrings, one after the other; white space is then collapsed."""
    masked = reduce(lambda t, n: F.replace(t, F.lit(n), F.lit(mask)), names, text)
    return F.array_join(F.filter(F.split(masked, r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"), lambda w: w != ""), " ")


def greedy_chunks(words: Column, sizes: Column, most: int) -> Column:
    """Chunks of words of at most ``most`` in size, filled greedily; a longer first word leaves an empty chunk before it."""
    pairs = F.arrays_zip(words.alias("w"), sizes.alias("s"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).cast("bigint").alias("size"))

    def step(acc: Column, p: Column) -> Column:
        size = p["s"].cast("bigint")
        full = acc["size"] + size > most
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.array_join(acc["open"], " ")))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(p["w"])).otherwise(F.concat(acc["open"], F.array(p["w"]))).alias("open"),
            F.when(full, size).otherwise(acc["size"] + size).alias("size"),
        )

    return F.aggregate(pairs, start, step, lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(F.array_join(a["open"], " ")))).otherwise(a["done"]))


def mask_labels(ids: Column, mask_id: int) -> Column:
    """The mask's id where a token is masked, -100 elsewhere."""
    return F.transform(ids, lambda x: F.when(x == mask_id, x).otherwise(F.lit(-100)))


def chunk_table(df: DataFrame, book: str, text: str, names: list[str], most: int = 510) -> DataFrame:
    """(book, chunk_idx, text): masked texts in chunks, a word's size being its length in characters unless sizes are given."""
    masked = df.select(F.col(book).alias("book"), F.split(mask_names(F.col(text), names), " ").alias("words"))
    return masked.select("book", F.posexplode(greedy_chunks(F.col("words"), F.transform("words", F.char_length), most)).alias("chunk_idx", "text"))
