"""Unicode functions that Spark SQL lacks, as Arrow-batched functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfc_strip(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v).strip(), na_action="ignore")


def nfc_strip(col: Column) -> Column:
    """NFC form without outer white space; null stays null."""
    return _nfc_strip(col)


@F.pandas_udf(T.StringType())
def _surface(values: pd.Series) -> pd.Series:
    return values.map(lambda v: " ".join(unicodedata.normalize("NFC", v).casefold().split()), na_action="ignore")


def surface(col: Column) -> Column:
    """Surface form: NFC, case-folded, white space collapsed to single spaces and stripped; null stays null."""
    return _surface(col)


def fold(text: str) -> str:
    """NFKC form with single spaces, case-folded, for telling texts apart."""
    return " ".join(unicodedata.normalize("NFKC", text).split()).casefold()


@F.pandas_udf(T.StringType())
def _folded(values: pd.Series) -> pd.Series:
    return values.map(fold, na_action="ignore")


def folded(col: Column) -> Column:
    """fold() of a column; null stays null."""
    return _folded(col)
