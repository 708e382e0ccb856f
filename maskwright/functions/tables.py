"""Table functions for SQL: spans as rows under LATERAL. The column expressions are the fast path."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from maskwright.functions.patterns import TOKEN, TOKEN_TYPES


def register(spark: SparkSession) -> None:
    """Register ``find_tokens(text)``: rows (start, end, pii_type, hash)."""
    pattern, types = TOKEN, frozenset(TOKEN_TYPES)

    class FindTokens:
        def eval(self, text: str) -> Iterator[tuple]:
            for m in re.finditer(pattern, text or ""):
                if m[1] in types:
                    yield m.start(), m.end(), m[1], m[2]

    spark.udtf.register("find_tokens", udtf(FindTokens, returnType="start int, end int, pii_type string, hash string"))
