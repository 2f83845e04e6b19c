"""Joins whose hot keys may be split at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def own_exchange(small: DataFrame, *key: str) -> DataFrame:
    """``small`` (one row a key) dealt by a hash of the key, which a join on the key must exchange again.

    An aggregate leaves its result dealt by its key, and a join on that key then runs in
    the aggregate's own stage, where adaptive execution can neither split a hot key of
    the other side nor turn to a broadcast.  With an exchange of its own just below the
    join both are possible; the price is one more exchange of a row a key.
    """
    return small.repartition(F.xxhash64(*key))
