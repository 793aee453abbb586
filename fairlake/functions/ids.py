"""Identifiers that come out the same when a job runs again."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def mint_id(*columns) -> Column:
    """UUID-shaped digest of some columns."""
    h = F.sha2(F.concat_ws("/", *columns), 256)
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))
