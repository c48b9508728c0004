"""Display labels for factor keys."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden.config import FACTOR_LABELS


def factor_label(key: Column) -> Column:
    labels = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in FACTOR_LABELS.items()))
    return labels[key]
