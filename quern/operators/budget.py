"""Responses cut to a budget of bytes, as columns: how much goes is computed, not tried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: characters that the answer loses at a time.
ANSWER_STEP = 80


def json_bytes(value: Column) -> Column:
    """Bytes of a value as JSON."""
    return F.octet_length(F.to_json(value))


def text_bytes(text: Column) -> Column:
    """Bytes of a text as JSON, quotes included."""
    return F.octet_length(F.to_json(F.array(text))) - 2


def _prefix(sizes: Column, room: Column) -> Column:
    """struct<n,bytes>: how many elements of a JSON list come first and fit, and the bytes of that list."""
    start = F.struct(F.lit(0).alias("n"), F.lit(2).cast("long").alias("bytes"), F.lit(True).alias("open"))

    def step(state: Column, size: Column) -> Column:
        longer = state["bytes"] + size + F.when(state["n"] > 0, 1).otherwise(0)
        fits = state["open"] & (longer <= room)
        return F.struct((state["n"] + fits.cast("int")).alias("n"), F.when(fits, longer).otherwise(state["bytes"]).alias("bytes"), fits.alias("open"))

    return F.aggregate(sizes, start, step)


def _whole(sizes: Column) -> Column:
    """Bytes of a JSON list of all elements."""
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda a, s: a + s) + F.greatest(F.size(sizes) - 1, F.lit(0)) + 2


def fitted(rows: DataFrame, hits: str, graph: str, answer: str, fixed: Column, limit: int, step: int = ANSWER_STEP) -> DataFrame:
    """[P27, Q18] ``rows`` with lists and answer cut so that the response has at most ``limit`` bytes.

    ``fixed`` is what the rest of the response takes.  The last hits go first, then the last graph rows, then the
    answer loses ``step`` characters at a time.  ``response_bytes`` is what is left, ``problem`` says where nothing
    fits.  Null lists and answers are empty.
    """
    sizes = {c: F.transform(F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)), json_bytes) for c in (hits, graph)}
    text = F.coalesce(F.col(answer), F.lit(""))
    sized = rows.withColumns({"__hits": sizes[hits], "__graph": sizes[graph], "__text": text_bytes(text), "__fixed": fixed.cast("long")})
    sized = sized.withColumn("__hit_end", _prefix(F.col("__hits"), F.lit(limit) - F.col("__fixed") - F.col("__text") - _whole(F.col("__graph"))))
    # Graph rows only go once no hit is left to go.
    kept = F.when(F.col("__fixed") + F.col("__text") + _whole(F.col("__graph")) + 2 <= limit, F.struct(F.size("__graph").alias("n"), _whole(F.col("__graph")).alias("bytes"), F.lit(True).alias("open")))
    sized = sized.withColumn("__graph_end", F.coalesce(kept, _prefix(F.col("__graph"), F.lit(limit) - F.col("__fixed") - F.col("__text") - F.col("__hit_end.bytes"))))
    room = F.lit(limit) - F.col("__fixed") - F.col("__hit_end.bytes") - F.col("__graph_end.bytes")
    lengths = F.transform(F.sequence(F.lit(0), F.ceil(F.char_length(text) / step).cast("int")), lambda k: F.greatest(F.char_length(text) - k * step, F.lit(0)))
    fits = F.filter(lengths, lambda n: text_bytes(F.left(text, n)) <= room)
    cut = F.when(F.col("__text") <= room, F.char_length(text)).otherwise(F.try_element_at(fits, F.lit(1)))
    sized = sized.withColumn("__cut", cut)
    out = {
        hits: F.slice(F.col(hits), F.lit(1), F.col("__hit_end.n")),
        graph: F.slice(F.col(graph), F.lit(1), F.col("__graph_end.n")),
        answer: F.left(text, F.col("__cut")),
        "response_bytes": F.when(F.col("__cut").isNotNull(), F.col("__fixed") + F.col("__hit_end.bytes") + F.col("__graph_end.bytes") + text_bytes(F.left(text, F.col("__cut")))),
        "problem": F.when(F.col("__cut").isNull(), F.lit("the response does not fit its budget")),
    }
    return sized.withColumns(out).drop("__hits", "__graph", "__text", "__fixed", "__hit_end", "__graph_end", "__cut")
