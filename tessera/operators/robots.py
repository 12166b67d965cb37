"""Whether links may be fetched under stored robots.txt files."""

from __future__ import annotations

from functools import lru_cache
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


@lru_cache(maxsize=256)
def _parser(rules: str) -> RobotFileParser:
    out = RobotFileParser()
    out.parse(rules.splitlines())
    out.modified()
    return out


@F.pandas_udf(BooleanType())
def _may_fetch(url: pd.Series, rules: pd.Series, agent: pd.Series) -> pd.Series:
    def one(u, r, a):
        try:
            return _parser(r).can_fetch(a, u)
        except ValueError:  # as the rules have it, errors allow
            return True

    return pd.Series([one(*x) for x in zip(url, rules, agent, strict=True)], dtype="bool")


def with_robots(links: DataFrame, robots: DataFrame, url: str = "url", agent: str = "*") -> DataFrame:
    """``links`` with ``may_fetch``; hosts without a file in ``robots(host, rules)``, and links without a host, allow all.

    ``robots`` has one row a host; of repeated ones the largest text counts.  The join is left to
    the optimizer: the table grows with the web, so nothing is broadcast by hand.
    """
    rules = robots.groupBy(F.lower("host").alias("_host")).agg(F.max("rules").alias("_rules"))
    hosted = links.withColumn("_host", F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))))
    joined = hosted.join(rules, "_host", "left")
    ruled = _may_fetch(F.coalesce(F.col(url), F.lit("")), F.coalesce("_rules", F.lit("")), F.lit(agent))
    return joined.withColumn("may_fetch", F.when(F.col("_rules").isNull(), F.lit(True)).otherwise(ruled)).drop("_host", "_rules")
