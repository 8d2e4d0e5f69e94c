"""Control over how often an expensive expression is evaluated."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluated_once(df: DataFrame, column: str) -> DataFrame:
    """Keeps later filters on the column from being pushed into its expression.

    Catalyst moves a filter below a projection by copying the projected
    expression into it.  For a column made of dozens of patterns that copy costs
    far more than filtering late, and nothing of it could reach the scan anyway.
    A one-element generator is a border filters do not cross.
    """
    return df.withColumn(column, F.explode(F.array(column)))
