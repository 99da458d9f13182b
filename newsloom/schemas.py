"""The enumerations of the news model and their orders."""

from __future__ import annotations

from pyspark.sql import types as T

PRIORITIES = ["high", "medium", "low", "none"]
#: Rank of a priority, higher first; anything else ranks 0.
PRIORITY_RANK = {"high": 3, "medium": 2, "low": 1, "none": 0}
WORKING_GROUPS = ["AK1", "AK2", "AK3", "AK4", "AK5", "QAG"]



def fields(**kinds: T.DataType) -> T.StructType:
    """A struct type without a session, which DDL strings would need."""
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])
