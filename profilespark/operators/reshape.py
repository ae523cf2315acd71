"""Between long and wide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot_profiles(wide: DataFrame, contract: DataFrame, id_col: str, value_name: str) -> DataFrame:
    """Wide profile table to long on a contract; missing cells stay as NULL rows, columns outside the contract are dropped."""
    features = [c for c in wide.columns if c != id_col]
    long = wide.unpivot([id_col], features, "feature_id", value_name)
    return long.join(contract, "feature_id").select(id_col, *contract.columns, value_name)


def pivot_matrix(df: DataFrame, index: str, pivot: str, value: str, pivot_values: list) -> DataFrame:
    """Long to wide with the columns named beforehand; one value per cell."""
    return df.groupBy(index).pivot(pivot, pivot_values).agg(F.first(value, ignorenulls=True))
