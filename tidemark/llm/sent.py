"""Sends models of bounded size to the tasks."""

import pickle

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def sent(spark: SparkSession, model):
    """A function that gives ``model`` within a task; its classes travel with it."""
    content = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(content.value)
