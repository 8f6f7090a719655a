"""Unicode composition as an Arrow-batched function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _composed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFC", v))


def nfc(text: Column | str) -> Column:
    """NFC form; plain ASCII needs no work and is not sent to Python, null stays null.

    A worker holds a batch of texts at once; ``session.light_batches`` bounds it.
    """
    text = F.col(text) if isinstance(text, str) else text
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, text).otherwise(_composed(F.when(~plain, text)))
