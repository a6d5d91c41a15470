"""Rule lists kept as tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_rule_groups(spark: SparkSession, path: str, most: int = 5000) -> list[tuple[str, list[str]]]:
    """Ordered (label, patterns) from a CSV with the columns priority, label, pattern."""
    table = spark.read.option("header", True).schema("priority int, label string, pattern string").csv(
        path, ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False
    )
    return rule_groups(table, most)


def rule_groups(table: DataFrame, most: int = 5000) -> list[tuple[str, list[str]]]:
    """Ordered (label, patterns). Rules become one expression, so their number is checked."""
    rows = table.orderBy("priority", F.monotonically_increasing_id()).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules: join against a rule table instead")
    groups: dict[tuple[int, str], list[str]] = {}
    for row in rows:
        groups.setdefault((row["priority"], row["label"]), []).append(row["pattern"])
    return [(label, patterns) for (_, label), patterns in groups.items()]
