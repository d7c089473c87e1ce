"""Title normalisation; Unicode folding has no built-in expression."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a copy prepends to a title, and where an url keeps the filing id.
TAG = r"^\s*(?:[\[［][^\]］]{0,10}[\]］]|【[^】]{0,10}】)"
PREFIX = r"^[^:：]{1,15}[:：]"
FILING_ID = r"(?:announcementId=|finalpage/\d{4}-\d{2}-\d{2}/)(\d+)"


@F.pandas_udf(T.StringType())
def normal_title(titles: pd.Series) -> pd.Series:
    """NFKC fold, tag and prefix off, then letters and digits only."""
    tag, prefix, rest = re.compile(TAG), re.compile(PREFIX), re.compile(r"[\W_]+")
    fold = lambda text: rest.sub("", prefix.sub("", tag.sub("", unicodedata.normalize("NFKC", text or ""))))
    return titles.map(fold)
