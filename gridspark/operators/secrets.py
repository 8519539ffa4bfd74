"""Column encryption with a short ring of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encrypt_column(data: Column, key: Column) -> Column:
    """AES-GCM with a fresh nonce per row; the key has 16, 24 or 32 bytes."""
    return F.aes_encrypt(data, key, F.lit("GCM"))


def try_decrypt_column(df: DataFrame, secret: str, keys: list[str]) -> DataFrame:
    """Try the keys in order: ``plain`` from the first that opens the row, and its ``key_rank``.

    Rows no key opens get nulls.
    """
    tries = [F.try_aes_decrypt(F.col(secret), F.lit(k), F.lit("GCM")) for k in keys]
    marks = [F.when(t.isNotNull(), F.struct(t.alias("p"), F.lit(i).alias("k"))) for i, t in enumerate(tries)]
    opened = df.withColumn("__o", F.coalesce(*marks))
    return opened.select(
        *df.columns, F.col("__o.p").cast("string").alias("plain"), F.col("__o.k").alias("key_rank")
    )
