"""Review-shaped views of general tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.design import StudyDesign
from tideline.functions.labels import star_to_label, star_to_score, stars_text
from tideline.functions.text import canonical_group
from tideline.session import balanced

OBS_DESIGN = StudyDesign.two_years("europe", "asia", 1998, 1997)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def observations(spark: SparkSession, root: str, design: StudyDesign = OBS_DESIGN) -> DataFrame:
    """Orders as dated, grouped, rated rows.

    The group is the customer's region, the star rating the priority digit, the emotion
    the market segment. Partly shipped orders of no stated priority count as undated.
    """
    orders = table(spark, root, "orders")
    customer = table(spark, root, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, root, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, root, "region").select("r_regionkey", "r_name")
    undated = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "4-NOT SPECIFIED")
    digit = F.substring("o_orderpriority", 1, 1)
    # Large side first: each lookup is then sized on its own and broadcast only if small.
    joined = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
    )
    rows = joined.select(
        F.col("o_orderkey").alias("review_id"),
        canonical_group("r_name").alias("city"),
        F.when(~undated, F.to_date("o_orderdate")).alias("review_date"),
        F.col("o_totalprice").alias("rating"),
        stars_text(digit).alias("stars"),
        digit.cast("int").alias("topic"),
        F.lower("c_mktsegment").alias("emotion_label"),
        F.col("o_orderstatus").alias("stay_type"),
    )
    return rows.withColumns({
        "sentiment_label": star_to_label("stars"),
        "sentiment_score": star_to_score("stars"),
        "temporal_window": design.assign("review_date"),
    })


def texts(spark: SparkSession, root: str) -> DataFrame:
    """Documents as reviews: the negative text is the placeholder for one language, null for another."""
    docs = balanced(table(spark, root, "documents"), "doc_id")
    negative = F.when(F.col("lang") == "de", F.lit("---")).when(F.col("lang") != "es", F.col("text"))
    return docs.select(
        F.col("doc_id").alias("review_id"), "lang", "source", F.col("text").alias("text_positive"),
        negative.alias("text_negative"),
    )
