"""Enough tasks for work that is heavy per row."""

import math

from pyspark.sql import DataFrame

from tidemark.session import cut_lineage

FEW_ROWS, ROWS_OF_TASK = 50_000, 100_000  # a pass over fewer rows costs less than the tasks it would take; most rows a task should have


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when a table has fewer splits than the session has cores.

    A file of few row groups would otherwise leave all text work to a few
    tasks. Large tables have more splits than cores and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    if "Exchange" in execution.executedPlan().toString():
        return df  # a shuffle has dealt the rows out already
    return df.repartition(cores) if execution.toRdd().getNumPartitions() < cores else df


def even(df: DataFrame) -> DataFrame:
    """Deal the rows of a larger table to equal tasks, a multiple of the session's cores, and store them.

    Fits pass over their rows hundreds of times, and a pass lasts as long as
    its longest task. Small tables stay as they are.
    """
    rows = df.count()
    if rows <= FEW_ROWS:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cut_lineage(df.repartition(cores * math.ceil(rows / ROWS_OF_TASK / cores)))
