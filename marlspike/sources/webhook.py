"""Delivered events with signatures (TM-22)."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verified(deliveries: DataFrame, secret: str) -> DataFrame:
    """Deliveries (``kind``, ``signature``, ``body``) whose ``sha256=`` signature fits the body; null parts never fit."""

    @F.pandas_udf("boolean")
    def fits(signature: pd.Series, body: pd.Series) -> pd.Series:
        def one(s, b):
            if s is None or b is None:
                return False
            return hmac.compare_digest(s.encode(), b"sha256=" + hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest().encode())

        return pd.Series([one(s, b) for s, b in zip(signature, body)])

    return deliveries.filter(fits("signature", "body"))


def dispatch(deliveries: DataFrame) -> DataFrame:
    """(api, action, project, issue, json) of issue and comment deliveries; other kinds and unreadable bodies give nothing."""
    j = F.try_parse_json("body")
    get = lambda p, t="string": F.try_variant_get(j, p, t)
    api = F.when(F.col("kind") == "issues", "/issues").when(F.col("kind") == "issue_comment", "/issues/comments")
    rows = deliveries.select(api.alias("api"), get("$.action").alias("action"), get("$.repository.full_name").alias("project"), get("$.issue.number", "bigint").alias("issue"), F.col("body").alias("json"))
    return rows.filter("api IS NOT NULL AND project IS NOT NULL AND issue IS NOT NULL")
