"""Text functions that Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode normal form KC. Only texts with a character beyond ASCII go to Python; all others are in that form already."""
    beyond = text.rlike("[^\\x00-\\x7F]")
    return F.when(beyond, _nfkc(F.when(beyond, text))).otherwise(text)
