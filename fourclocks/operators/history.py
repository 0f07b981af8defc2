"""Election histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalised_results(votes: DataFrame, by: Sequence[str], party: str, cycle: str) -> DataFrame:
    """Vote totals to shares, with the previous cycle's share as fundamentals."""
    share = F.col("votes") / F.sum("votes").over(Window.partitionBy(*by))
    staged = votes.withColumn("share", share)
    return staged.withColumn("fundamentals", F.lag("share").over(Window.partitionBy(party).orderBy(cycle)))
