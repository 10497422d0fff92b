"""String similarity with no built-in counterpart."""

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


@pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of two texts without case; 0 if one is missing."""
    pairs = zip(a.fillna("").str.lower(), b.fillna("").str.lower(), strict=True)
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in pairs])
