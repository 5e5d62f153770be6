"""Deterministic randomness: md5 order keys and uniforms instead of an RNG.

``order_key(seed, tag, key...)`` is ``md5('seed:tag:key...')``; sorting by it
is a seeded shuffle that does not depend on partitioning and is the same in
Spark and in DuckDB, so sampling operators have exact SQL oracles and task
retries draw the same values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(seed, tag, keys):
    cols = [F.lit(str(seed)), F.lit(str(tag))]
    for k in keys:
        cols.append((F.col(k) if isinstance(k, str) else k).cast("string"))
    return cols


def order_key(seed, tag: str, *keys) -> Column:
    """32-hex md5 string; use as a sort key (ties broken by an id)."""
    return F.md5(F.concat_ws(":", *_parts(seed, tag, keys)))


def uniform(seed, tag: str, *keys) -> Column:
    """u in [0, 1) from the first 8 hex digits of the md5 order key."""
    h = F.substring(order_key(seed, tag, *keys), 1, 8)
    return F.conv(h, 16, 10).cast("bigint") / F.lit(4294967296.0)
