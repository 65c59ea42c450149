"""Policy areas by ordered rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actfold.functions import rules
from actfold.functions import text as tx


def chapter_dimension(spark: SparkSession) -> DataFrame:
    """(chapter, area): the ordered ranges spread out, so the range join is an equi-join; about 700 rows, fixed."""
    return spark.createDataFrame(rules.chapter_areas(), "chapter int, area string")


def areas_of_refs(refs: DataFrame) -> DataFrame:
    """refs with chapter and area, where a range holds the chapter."""
    dim = F.broadcast(chapter_dimension(refs.sparkSession))  # its size is that of a fixed list
    return refs.withColumn("chapter", tx.chapter_of(F.col("statute"))).join(dim, "chapter", "left")


def classify(bills: DataFrame, refs: DataFrame) -> DataFrame:
    """(session, num, title, area, area_slug) for every bill.

    A technology title decides at once; then the area of most references, ties
    to the first in the alphabet; then the first title rule; else none.
    """
    votes = areas_of_refs(refs).where("area is not null").groupBy("session", "num", "area").agg(F.count("*").alias("n"))
    most = votes.groupBy("session", "num").agg(F.min_by("area", F.struct(-F.col("n"), F.col("area"))).alias("voted"))
    title = F.coalesce("title", F.lit(""))
    tech = F.when(title.rlike(f"(?i){rules.TITLE_RULES[0][1]}"), rules.TITLE_RULES[0][0])
    out = bills.select("session", "num", "title").join(most, ["session", "num"], "left")
    out = out.withColumn("area", F.coalesce(tech, F.col("voted"), rules.area_of_title(title)))
    return out.select("session", "num", "title", "area", tx.slug(F.col("area")).alias("area_slug"))


def listing(areas: DataFrame) -> DataFrame:
    """Bills by area, the areas' counts along."""
    rows = areas.where("area is not null")
    counts = rows.groupBy("area").agg(F.count("*").alias("n"))  # one row an area of a fixed list
    return rows.join(F.broadcast(counts), "area").select(*rows.columns, "n").orderBy("area", "num")


def split_sponsors(bills: DataFrame, committees: DataFrame) -> DataFrame:
    """(session, num, panels, people): sponsor parts that are committees (by name or by word) and those that are not, each in order."""
    parts = bills.select("session", "num", F.posexplode(F.split(F.coalesce("sponsor", F.lit("")), ";")).alias("pos", "part")).withColumn("part", F.trim("part")).where("part != ''")
    names = committees.select(F.col("name").alias("part"), F.lit(True).alias("known")).distinct()
    rows = parts.join(names.hint("merge"), "part", "left").withColumn("panel", F.coalesce("known", F.lit(False)) | F.col("part").rlike(r"\b(?:Committee|Subcommittee)\b"))
    side = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "part")))), lambda x: x["part"])
    return rows.groupBy("session", "num").agg(side(F.col("panel")).alias("panels"), side(~F.col("panel")).alias("people"))
