"""What the operators share: the columns they read and the keys of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship as ship

#: The white space that separates words here (space, tab to carriage return); fixed by the contracts.
SPACE = r"[\x20\x09-\x0D]+"

KEYS = ["sp_k1", "sp_k2"]


def read_texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only ``doc_id`` (bigint), ``text`` (null becomes empty) and the named columns.

    All other columns stay behind, so their names can't clash with those an operator adds. Every operator
    starts here or with ``cut``, so that its tasks find this package.
    """
    ship(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[F.col(c) for c in more],
    )


def content_keys(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """128 bits that name a row by id and text, the same in every scan and every retry.

    Rows equal in both share the key; every operator gives such rows equal results.
    """
    known, body = F.col(doc_id), F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [
        F.xxhash64(body, known).alias(KEYS[0]),
        F.xxhash64(F.lit(1), known, F.length(body), body).alias(KEYS[1]),
    ]


def with_keys(docs: DataFrame) -> DataFrame:
    return docs.select("*", *content_keys())


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as its count says, and first, first + 1, ... for it."""
    index = np.repeat(np.arange(len(first)), count)
    return index, first[index] + np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count)
