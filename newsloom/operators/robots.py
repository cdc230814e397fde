"""Robots rules as rows, and what they allow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.scale import lookup_join
from newsloom.functions.urls import host, path, same_escapes


def robots_rules(robots: DataFrame) -> DataFrame:
    """`host, group_no, agent, rule_no, allow, path` from `robots` (host, status, body).

    Agents named on consecutive lines share the rules after them; a blank line ends a
    group. Only files answered with status 200 count. Windows run over one file each.
    Hosts are in lower case, percent-escapes of paths in capitals.
    """
    lines = (
        robots.where("status = 200")
        .select(F.lower("host").alias("host"), F.posexplode(F.split("body", r"\r?\n")).alias("line_no", "line"))
        .withColumn("line", F.trim(F.regexp_replace("line", "#.*", "")))
        .withColumn("key", F.lower(F.trim(F.substring_index("line", ":", 1))))
        .withColumn("value", F.trim(F.regexp_replace("line", "^[^:]*:?", "")))
        .where((F.col("line") == "") | F.col("key").isin("user-agent", "allow", "disallow"))
    )
    in_file = W.partitionBy("host").orderBy("line_no")
    is_agent = F.col("key") == "user-agent"
    begins = is_agent & (F.coalesce(F.lag("key").over(in_file), F.lit("")) != "user-agent")
    grouped = (
        lines.withColumn("begins", begins.cast("int"))
        .withColumn("ends", (F.col("line") == "").cast("int"))
        .withColumn("group_no", F.sum("begins").over(in_file))
        .withColumn("breaks", F.sum("ends").over(in_file))
        # lines after a blank one belong to no group until the next agent
        .withColumn("own_break", F.max(F.when(is_agent, F.col("breaks"))).over(in_file))
        .where((F.col("group_no") > 0) & (F.col("breaks") == F.col("own_break")))
    )
    agents = grouped.where(is_agent).select("host", "group_no", F.lower("value").alias("agent"))
    rules = grouped.where(~is_agent).select(
        "host",
        "group_no",
        F.col("line_no").alias("rule_no"),
        # an empty Disallow forbids nothing
        ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"),
        same_escapes("value").alias("path"),
    )
    return agents.join(rules, ["host", "group_no"]).select(
        "host", "group_no", "agent", "rule_no", "allow", "path"
    )


def rules_for_agent(rules: DataFrame, agent: str) -> DataFrame:
    """The rules of the first group that names the agent, else of the first `*` group."""
    token = agent.split("/")[0].lower()
    named = (F.col("agent") != "*") & F.contains(F.lit(token), F.col("agent"))
    fits = rules.where(named | (F.col("agent") == "*")).withColumn("named", named)
    rank = F.struct(~F.col("named"), "group_no")
    first = fits.groupBy("host").agg(F.min_by("group_no", rank).alias("group_no"))
    return fits.join(first, ["host", "group_no"]).select("host", "rule_no", "allow", "path").distinct()


def robots_allowed(urls: DataFrame, rules: DataFrame, *, agent: str = "Mozilla", **limits) -> DataFrame:
    """`urls` (id, url) with `allowed`: the first rule that fits the path decides, default yes.

    The rules of a host, bounded by its file, are one sorted array: a url meets one row.
    """
    mine = rules_for_agent(rules, agent).groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct("rule_no", "allow", "path"))).alias("rules"))
    tagged = urls.select(
        "id", "url", F.lower(host("url")).alias("host"), same_escapes(path("url")).alias("url_path"))
    joined = lookup_join(tagged, mine, ["host"], "left", spread=["id"], **limits)
    fitting = F.filter(
        "rules", lambda r: (r["path"] == "*") | F.startswith(F.col("url_path"), r["path"]))
    return joined.select("id", "url", F.coalesce(F.get(fitting, F.lit(0))["allow"], F.lit(True)).alias("allowed"))


def robots_refresh_summary(sources: DataFrame, robots: DataFrame, *, agent: str = "Mozilla", **limits) -> DataFrame:
    """One row: sources with an answer, without one, and those their site disallows.

    `robots` has `host, status, body`; a host without a row, or without a status, gave no answer.
    """
    allowed = robots_allowed(sources.select("id", "url"), robots_rules(robots), agent=agent, **limits)
    answers = robots.select(F.lower("host").alias("host"), "status").where("status is not null")
    rows = lookup_join(
        allowed.withColumn("host", F.lower(host("url"))), answers, ["host"], "left", spread=["id"], **limits
    )
    return rows.agg(
        F.count("status").alias("updated"),
        F.count_if(F.col("status").isNull()).alias("failed"),
        F.count_if(~F.col("allowed")).alias("disallowed"),
    )
