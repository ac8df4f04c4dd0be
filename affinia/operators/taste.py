"""Taste of accounts: plays by unit, weighed by how much of it was watched, spread over its attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of which less than this was watched say nothing.
LEAST = 0.5


def upper_median(values: Column) -> Column:
    """The upper of two middle values, not their mean."""
    ordered = F.array_sort(F.collect_list(values))
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def season_lengths(episodes: DataFrame) -> DataFrame:
    """unit, season_length: the upper median of each show's season lengths. episodes: unit, season, episode."""
    seasons = episodes.where("season IS NOT NULL").groupBy("unit", "season").agg(F.count_distinct("episode").alias("n"))
    return seasons.groupBy("unit").agg(upper_median(F.col("n")).alias("season_length"))


def unit_ratios(plays: DataFrame, lengths: DataFrame) -> DataFrame:
    """account, unit, r: plays over season length for shows that have seasons, else plays. plays: account, unit."""
    counted = plays.groupBy("account", "unit").agg(F.count(F.lit(1)).alias("plays"))
    ratio = F.col("plays") / F.coalesce("season_length", F.lit(1))
    return counted.join(lengths, "unit", "left").select("account", "unit", ratio.alias("r"))


def taste(plays: DataFrame, episodes: DataFrame, attributes: DataFrame, least: float = LEAST) -> DataFrame:
    """account, namespace, key, value, weight. attributes: unit, namespace, key, value, each once."""
    ratios = unit_ratios(plays, season_lengths(episodes)).where(F.col("r") >= least)
    sizes = attributes.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    share = ratios.join(sizes, "unit").select("account", "unit", (F.sqrt("r") / F.col("n")).alias("share"))
    return share.join(attributes, "unit").groupBy("account", "namespace", "key", "value").agg(F.sum("share").alias("weight"))


def pooled_taste(plays: DataFrame, episodes: DataFrame, attributes: DataFrame, least: float = LEAST) -> DataFrame:
    """The taste of all accounts together, as of one."""
    return taste(plays.withColumn("account", F.lit(0)), episodes, attributes, least).drop("account")


def shows_without_seasons(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("unit").agg(F.count("season").alias("n")).where("n = 0").select("unit")


def watched_units(plays: DataFrame, lengths: DataFrame, least: float = LEAST) -> DataFrame:
    return unit_ratios(plays, lengths).where(F.col("r") >= least).select("account", "unit")
