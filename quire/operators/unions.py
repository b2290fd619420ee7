"""Unions that later steps may group or join."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame


def union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The rows of all, columns by name.

    Spark 4.1 plans a union of equally dealt tables as dealt by their key and leaves out the shuffle of a later grouping or
    join; below sort-merge joins, with adaptive execution or without, such a union then runs as a plain one with other
    partitions than the join rests on ("Can't zip RDDs with unequal numbers of partitions"). The session's setting is read
    when the plan is made, so it is turned off here and stays so."""
    first.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return functools.reduce(DataFrame.unionByName, others, first)
