"""Anchors: rules that fire on near-certain bots."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .jsontext import user_agent

# The patterns that define the anchors.
CRAWLER_UA = (r"(?i)facebookexternalhit|googlebot|bingbot|bot\b|crawler|spider|slurp|"
              r"bingpreview|headless")
SCRIPT_UA = (r"(?i)python-requests|curl|wget|scrapy|selenium|playwright|puppeteer|"
             r"httpclient|okhttp|go-http-client|java/|libwww|aiohttp")
TEMPLATE = r"\{\{.*?\}\}"


def has_template(request) -> Column:
    return F.coalesce(F.rlike(request, F.lit(TEMPLATE)), F.lit(False))


def has_crawler_ua(agent) -> Column:
    return F.rlike(agent, F.lit(CRAWLER_UA))


def has_script_ua(agent) -> Column:
    return F.rlike(agent, F.lit(SCRIPT_UA))


def with_flags(df: DataFrame, headers: str = "headers", request: str = "request") -> DataFrame:
    """Adds user_agent, the three anchors and heuristic_bot_flag."""
    return (df.withColumn("user_agent", user_agent(headers))
            .withColumns({"has_template": has_template(F.col(request)),
                          "has_crawler_ua": has_crawler_ua(F.col("user_agent")),
                          "has_script_ua": has_script_ua(F.col("user_agent"))})
            .withColumn("heuristic_bot_flag",
                        F.col("has_template") | F.col("has_crawler_ua") | F.col("has_script_ua")))


def weak_label(flag) -> Column:
    """1 where an anchor fires, else -1 (no opinion)."""
    return F.when(flag, F.lit(1)).otherwise(F.lit(-1))
