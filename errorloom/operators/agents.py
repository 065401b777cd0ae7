"""User-agent enrichment.

Events repeat a small set of agent strings, so the rules run once per distinct string and a
broadcast join brings the outcome back. How small that set is gets measured, not assumed: when
the dictionary is too big to broadcast, the rules run on the rows themselves. Either way the
events are never shuffled, so a string that a third of them share does no harm.
"""

import hashlib
import inspect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errorloom.functions import useragent as ua
from errorloom.operators.lookups import BROADCAST_BYTES, cut_lineage, measured_bytes

OUTPUTS = (
    "type",
    "version",
    "platform",
    "is_mobile",
    "is_robot",
    "is_aol",
    "aol_version",
    "is_chromeframe",
)


def rules_version() -> str:
    """Names the rules in force: stored outcomes of other rules no longer count."""
    return hashlib.md5(inspect.getsource(ua).encode()).hexdigest()


def apply_rules(df: DataFrame, ua_col: str = "user_agent") -> DataFrame:
    """Adds the outputs row by row: no shuffle, but every rule's test for every row."""
    agent, low, number = F.col("_agent"), F.col("_low"), F.col("_rule")
    return (
        df.withColumn("_agent", F.coalesce(F.col(ua_col), F.lit("")))
        .withColumn("_low", F.lower(agent))
        .withColumn("_rule", ua.rule_number(agent, low))
        .withColumns(
            {
                "type": ua.browser_type(number),
                "version": ua.browser_version(number, agent),
                "platform": ua.platform(number, low),
                "is_mobile": ua.is_mobile(number),
                "is_robot": ua.is_robot(number),
                "is_aol": ua.is_aol(low),
                "aol_version": ua.aol_version(agent, low),
                "is_chromeframe": ua.is_chromeframe(agent),
            }
        )
        .drop("_agent", "_low", "_rule")
    )


def agent_dictionary(df: DataFrame, ua_col: str = "user_agent") -> DataFrame:
    """One row per distinct agent (missing ones read as empty) with all outputs."""
    agents = df.select(F.coalesce(F.col(ua_col), F.lit("")).alias(ua_col)).distinct()
    return apply_rules(agents, ua_col)


def enrich_user_agents(
    df: DataFrame, ua_col: str = "user_agent", max_dictionary_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Adds the outputs. On a batch input this runs one job, which builds the dictionary."""
    if df.isStreaming or max_dictionary_bytes <= 0:
        return apply_rules(df, ua_col)
    dictionary = cut_lineage(agent_dictionary(df, ua_col))
    if measured_bytes(dictionary) > max_dictionary_bytes:
        return apply_rules(df, ua_col)
    known = dictionary.withColumnRenamed(ua_col, "_agent")
    return (
        df.withColumn("_agent", F.coalesce(F.col(ua_col), F.lit("")))
        .join(F.broadcast(known), "_agent", "left")
        .drop("_agent")
    )
