"""Keyset pages with opaque cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, key: str, tiebreak: str, size: int, after: tuple | None = None) -> DataFrame:
    """The next size rows in (key, tiebreak) order after a boundary (a filter that reaches the scan, then a
    top-k), with total and has_more."""
    total = df.agg(F.count("*").alias("total"))
    rest = df
    if after is not None:
        k, t = F.lit(after[0]), F.lit(after[1])
        rest = df.where((F.col(key) > k) | ((F.col(key) == k) & (F.col(tiebreak) > t)))
    rows = rest.orderBy(key, tiebreak).limit(size + 1)  # bounded: one page and a look ahead
    ranked = rows.select("*", F.row_number().over(_order(key, tiebreak)).alias("position"), F.count("*").over(_everything()).alias("_n"))
    ranked = ranked.withColumn("has_more", F.col("_n") > size).where(F.col("position") <= size).drop("_n")
    return ranked.crossJoin(F.broadcast(total))  # one row


def _order(key: str, tiebreak: str):
    from pyspark.sql import Window

    return Window.orderBy(key, tiebreak)


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy()


def _url_safe(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(c), "+/", "-_"), "[=\r\n]", "")


def encode_cursor(key: Column, tiebreak: Column) -> Column:
    """base64url of a JSON body and a checksum of it."""
    body = F.to_json(F.struct(key.alias("k"), tiebreak.alias("t")))
    check = F.substring(F.sha2(F.concat(F.lit("cursor:"), body), 256), 1, 16)
    return _url_safe(F.to_json(F.struct(body.alias("b"), check.alias("c"))).cast("binary"))


def decode_cursor(token: Column, schema: str) -> Column:
    """struct of k and t (schema: DDL of that struct), null where the token was altered."""
    padded = F.rpad(F.translate(token, "-_", "+/"), (F.ceil(F.length(token) / 4) * 4).cast("int"), F.lit("="))
    envelope = F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), "struct<b:string,c:string>")
    check = F.substring(F.sha2(F.concat(F.lit("cursor:"), envelope["b"]), 256), 1, 16)
    return F.when(check == envelope["c"], F.from_json(envelope["b"], schema))
