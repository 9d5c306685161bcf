"""Vector column functions: hashed bag-of-words embedding and cosine distance.

Hash embedding (the deterministic test embedding of the original): lower-case,
split on whitespace, each token to ``int(md5(token), 16) % 384``, counts
L2-normalised (an all-zero vector stays zero).

The 128-bit modulus needs no big integers: with the digest as four 32-bit
chunks c0..c3, 2**32, 2**64 and 2**96 are all congruent to 256 modulo 384, so
``idx = (256 * ((c0 + c1 + c2) % 384) + c3) % 384``.  Everything stays in
native expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import EMBED_DIM
from ..sources.tables import spread

TOKEN_SPLIT = r"\s+"


def _chunk(h: Column, i: int) -> Column:
    return F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long")


def token_index(token: Column, dim: int = EMBED_DIM) -> Column:
    if dim != 384:
        raise ValueError("the chunked md5 reduction is derived for dim = 384")
    h = F.md5(token)
    c0, c1, c2, c3 = (_chunk(h, i) for i in range(4))
    return ((F.lit(256) * ((c0 + c1 + c2) % 384) + c3) % 384).cast("int")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda w: w != "")


def hash_embed_sparse(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """V1: (id, idx, cnt, weight) for every non-zero coordinate.

    The per-(id, idx) count is combined map-side, so only distinct cells (at
    most 384 per id) are shuffled; the norm is a window over the cells of an
    id.  When the scan had to be spread, it is spread by id, and then neither
    the count nor the window needs another exchange.
    """
    counted = cells(df, id_col, text_col)
    norm = F.sqrt(F.sum(F.col("cnt") * F.col("cnt")).over(Window.partitionBy("id")))
    return counted.select("id", "idx", "cnt", (F.col("cnt") / norm).alias("weight"))


def cells(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, idx, cnt): token counts per hashed coordinate, combined map-side."""
    src = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), key="id")
    toks = src.select("id", F.explode(tokens(F.col("t"))).alias("w"))
    return toks.groupBy("id", token_index(F.col("w")).alias("idx")).agg(
        F.count(F.lit(1)).alias("cnt"))


def dot(a: Column, b: Column) -> Column:
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos(a, b); a zero vector has distance 1 to everything."""
    den = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(den == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / den)


def token_indexes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, idx array<int>): every token of a row hashed in place, no explode and
    no shuffle; counting is left to the consumer (e.g. ``numpy.bincount``)."""
    src = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")))
    return src.select("id", token_index_array("t").alias("idx"))


def token_index_array(text_col: str) -> Column:
    """Every token of a text hashed to its coordinate, in order."""
    return F.transform(tokens(F.col(text_col)), lambda w: token_index(w))
