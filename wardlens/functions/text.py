"""Text comparison as the warehouse's collation does it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_text(c: Column) -> Column:
    """Upper case without outer blanks, for comparisons; NULL stays NULL."""
    return F.upper(F.trim(c))
