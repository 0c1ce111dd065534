"""Joins of wide tables with a list of ids, by the measured length of the list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids sent to every executor at most, some 16 bytes each; a longer list is joined by a shuffle.
SENT_IDS = 1 << 21


def send_if_few(ids: DataFrame, limit: int = SENT_IDS) -> DataFrame:
    """Mark a materialised list of ids for broadcast if it is short enough.

    Either way the join gives the same rows; a long list lets Spark choose.
    """
    return F.broadcast(ids) if ids.count() <= limit else ids
