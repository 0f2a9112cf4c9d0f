"""Reproducible pseudo-random numbers from a row's own key.

Unlike ``rand`` or ``randomSplit`` these do not depend on how rows are spread over
partitions, so a retried task or a different cluster size gives the same split.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def row_digest(*key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[part.cast("string") for part in key]))


def hash_bucket(digest: Column, buckets: int) -> Column:
    """0 .. buckets-1 from the first 32 bits of a digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets
