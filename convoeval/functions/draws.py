"""Random draws as hashes of (seed, ids): stable under retries and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 60


def draw(seed: int, *ids: str | Column) -> Column:
    """A uniform number below 2^60 from an MD5 digest, so that SQL can redo it."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids]))
    return F.conv(F.left(digest, F.lit(DRAW_BITS // 4)), 16, 10).cast("long")
