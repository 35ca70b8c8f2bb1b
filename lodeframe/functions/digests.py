"""Digests of sets of any size."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows in a digest's bucket on average.
DIGEST_BUCKET = 4096


def hash_tree(entries: DataFrame) -> str:
    """Digest of entries ``e`` with hashes ``h`` (hex): those of a bucket of leading digits are hashed in order, level by level."""
    digits = max(0, math.ceil(math.log(max(entries.count(), 1) / DIGEST_BUCKET, 16)))
    cur = entries
    while True:
        cur = cur.groupBy(F.substring("h", 1, digits).alias("h")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("e")), "\n"), 256).alias("d"))
        cur = cur.select("h", F.concat_ws(":", "h", "d").alias("e"), "d")
        if not digits:
            out = cur.select("d").first()
            return out[0] if out else hashlib.sha256(b"").hexdigest()
        digits = max(0, digits - 3)
