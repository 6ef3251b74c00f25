"""Venue-shaped inputs derived from the given tables.

The tables hold no venues, so each query first reshapes whole tables into the
rows its operator expects.  Only built-in expressions are used, and only
integers or exact decimals feed the numbers, so sums do not depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from venuemill.functions.text import literal_map
from venuemill.session import spread

AS_OF = "2003-01-01 00:00:00"



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows each become a page or record to read: spread by its key, as some hundred bytes of it are a millisecond of work."""
    df = table(spark, sf_dir, name)
    return spread(df, df.columns[0])


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


CATEGORY_OF_TYPE = {
    "ECONOMY": "restaurant", "LARGE": "restaurant", "MEDIUM": "fika", "PROMO": "hotel",
    "SMALL": "bar", "STANDARD": "exclude",
}
REGION_OF_BRAND = ["stockholm", "gothenburg", "malmo", "sweden"]
DISTINCTIONS = ["1_star", "bib_gourmand", "selected", "2_star", "3_star", "1_key", "no_such_label"]
LABELS = ["God klass", "Mycket god klass", "Rekommenderad", "Not So White Guide"]
LABEL_KEYS = ["recommended", "good_class", "very_good_class", "master_class", "global_master_class"]


def pick(values: list[str], index: Column) -> Column:
    """``values[index]``; NULL outside the list."""
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def brand_number() -> Column:
    return F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")


def part_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with integer facts of their line items (one combining shuffle)."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("l_quantity").cast("bigint").alias("q"),
            F.max("l_quantity").cast("bigint").alias("mx"),
            F.min("l_quantity").cast("bigint").alias("mn"),
            F.count_if(F.col("l_returnflag") == "R").alias("r"),
            F.max("l_shipdate").alias("last"),
        )
    )
    part = table(spark, sf_dir, "part")
    return part.join(lines, part["p_partkey"] == lines["l_partkey"]).select(
        F.col("p_partkey").alias("idx"), F.col("p_name").alias("name"), "p_brand", "p_type", "p_size",
        "n", "q", "mx", "mn", "r", "last",
    )


def rated_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as venues with nested ratings."""
    f = part_facts(spark, sf_dir)
    day = F.date_format("last", "yyyy-MM-dd")

    def rating(when: Column, score: Column, dated: bool = False) -> Column:
        none = F.lit(None)
        return F.when(when, F.struct(
            score.cast("double").alias("score"), F.lit(0.0).alias("scale_min"), F.lit(100.0).alias("scale_max"),
            none.cast("struct<food:double,service:double,ambiance:double,value:double,drinks:double>").alias("sub_scores"),
            (day if dated else none.cast("string")).alias("published_at"),
            F.col("n").cast("int").alias("review_count"),
        ))

    distinction = pick(DISTINCTIONS, F.col("p_size") % 10)
    label = pick(LABELS, F.col("n") % 6)
    ratings = F.struct(
        F.when(distinction.isNotNull(), F.struct(distinction.alias("distinction"), F.lit(0.0).alias("score"))).alias("michelin"),
        F.when(label.isNotNull(), F.struct(
            label.alias("classification"), F.lit("restaurant").alias("venue_type"),
            F.lit(None).cast("struct<food:double,service:double,ambiance:double,value:double,drinks:double>").alias("sub_scores"),
        )).alias("whiteguide"),
        rating(F.col("mx") >= 48, 1 + F.col("q") % 6, True).alias("svd"),
        rating(F.col("mn") <= 2, 1 + F.col("q") % 5, True).alias("dn"),
        rating(F.col("p_size") > 25, F.col("q") % 26, True).alias("di"),
        rating(F.col("n") % 4 == 0, (10 + F.col("q") % 41) / 10).alias("krogguiden"),
        rating(F.col("r") % 3 == 0, 80 + F.col("q") % 21).alias("falstaff"),
        rating(F.col("n") % 7 > 1, (F.col("q") % 51) / 10).alias("thatsup"),
    )
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return f.select(
        "idx", "name", "n", "q",
        F.col("p_brand").alias("city"),
        F.concat("p_type", F.lit(" street "), F.col("p_size").cast("string")).alias("address"),
        ratings.alias("ratings"),
        F.when(F.col("q") % 3 > 0, (30 + F.col("q") % 21) / 10).alias("google_rating"),
        (F.col("q") % 150).cast("int").alias("google_rating_count"),
        F.try_element_at(literal_map(CATEGORY_OF_TYPE), F.col("p_type")).alias("category"),
        pick(REGION_OF_BRAND, number % 4).alias("metro_region"),
        F.concat(F.lit("v"), F.col("idx").cast("string")).alias("id"),
        F.array(
            F.struct(F.lit("whiteguide-news").alias("source_id"), F.concat(F.lit("https://news.example/"), F.col("idx").cast("string")).alias("url")),
            F.struct(F.lit("whiteguide-review").alias("source_id"), F.concat(F.lit("https://guide.example/"), F.col("idx").cast("string")).alias("url")),
            F.struct(F.lit("svd-review").alias("source_id"), F.when(F.col("q") % 2 == 0, F.concat(F.lit("https://svd.example/"), F.col("idx").cast("string"))).otherwise(F.lit("")).alias("url")),
        ).alias("sources"),
        F.when(F.col("q") % 5 == 0, F.concat(F.lit("https://maps.example/"), F.col("idx").cast("string"))).alias("maps_uri"),
        pick(["budget", "mellan", "lyx", ""], F.col("p_size") % 4).alias("price_range"),
        pick(["italian_restaurant", "sushi_restaurant", "bar", "cafe", "museum"], F.col("p_size") % 5).alias("primary_type"),
        F.lit(None).cast("array<struct<days:array<int>,open:string,close:string>>").alias("hours"),
        F.lit("").alias("website"), F.lit(None).cast("string").alias("phone"),
        ((F.col("idx") * 37 % 1500) / 100 + 55).alias("lat"),
        ((F.col("idx") * 53 % 1400) / 100 + 10.0).alias("lng"),
    )


def flat_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same facts as one plain column per source."""
    f = part_facts(spark, sf_dir)

    def rating(when: Column, score: Column) -> Column:
        return F.when(when, score.cast("double"))

    ratings = F.struct(
        rating(F.col("n") % 4 == 0, (10 + F.col("q") % 41) / 10).alias("krogguiden"),
        rating(F.col("q") % 3 > 0, (30 + F.col("q") % 21) / 10).alias("google"),
        F.when(F.col("p_size") % 10 < 6, pick(DISTINCTIONS, F.col("p_size") % 10)).alias("michelin"),
        pick(LABEL_KEYS, F.col("n") % 8).alias("whiteguide"),
        rating(F.col("mx") >= 48, F.col("q") % 7).alias("svd"),
        rating(F.col("mn") <= 2, F.col("q") % 6).alias("dn"),
        rating(F.col("p_size") > 25, F.col("q") % 26).alias("di"),
        rating(F.col("r") % 3 == 0, F.col("q") % 101).alias("falstaff"),
        rating(F.col("n") % 7 > 1, (F.col("q") % 51) / 10).alias("thatsup"),
    )
    return f.select(
        "idx", ratings.alias("ratings"), (F.col("q") % 150).cast("int").alias("google_rating_count"),
        F.when(F.col("n") % 3 == 0, F.create_map(F.lit("krogguiden"), F.lit("https://list.example"))).alias("links"),
    )


def hours_of(user: Column) -> Column:
    """A few entries per user: lunch, evening (also overnight) and weekend."""
    def entry(days: list[int], opened: Column, closed: Column) -> Column:
        return F.struct(
            F.array(*[F.lit(d) for d in days]).alias("days"), opened.alias("open"), closed.alias("close")
        )

    lunch = entry([1, 2, 3, 4, 5], F.format_string("%02d:30", 9 + user % 4), F.format_string("%02d:00", 13 + user % 3))
    evening = entry([3, 4, 5, 6], F.format_string("%02d:15", 16 + user % 3), F.format_string("%02d:00", (22 + user % 6) % 24))
    weekend = entry([0, 6], F.format_string("%02d:00", 8 + user % 5), F.format_string("%02d:45", 14 + user % 8))
    none = F.array().cast("array<struct<days:array<int>,open:string,close:string>>")
    return (
        F.when(user % 5 == 0, none)
        .when(user % 5 == 1, F.array(lunch))
        .when(user % 5 == 2, F.array(evening, lunch))
        .when(user % 5 == 3, F.array(weekend, evening))
        .otherwise(F.array(lunch, evening, weekend))
    )


def serving_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as flat serving rows for the interactive queries."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("idx"),
        F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("name"),
        F.concat("p_brand", F.lit(" street "), size.cast("string")).alias("address"),
        F.when(size % 4 > 0, F.col("p_type")).alias("region"),
        pick(["budget", "mellan", "lyx"], size % 4).alias("price_range"),
        F.when(size % 7 > 0, F.concat(F.initcap("p_type"), F.lit(", "), F.initcap(F.element_at(F.split("p_name", " "), -1)))).alias("cuisine"),
        F.when(size % 3 > 0, size * 2).alias("composite_score"),
        F.when(size % 5 > 0, size).alias("rank"),
        F.when(size % 6 > 0, F.col("p_partkey")).alias("region_rank"),
        pick(REGION_OF_BRAND, brand_number() % 4).alias("metro_region"),
        F.try_element_at(literal_map(CATEGORY_OF_TYPE), F.col("p_type")).alias("category"),
        F.when(size % 9 > 0, (F.col("p_partkey") * 37 % 1500) / 100 + 55).alias("lat"),
        F.when(size % 9 > 0, (F.col("p_partkey") * 53 % 1400) / 100 + 10).alias("lng"),
        hours_of(F.col("p_partkey")).alias("hours"),
        F.struct(
            F.when(size % 2 == 0, (10 + size % 41) / 10).alias("krogguiden"),
            F.when(size % 5 > 0, (30 + size % 21) / 10).alias("google"),
            pick(DISTINCTIONS, size % 10).alias("michelin"),
            pick(LABEL_KEYS, size % 8).alias("whiteguide"),
            F.when(size % 3 == 0, (1 + size % 6).cast("double")).alias("svd"),
            F.when(size % 4 == 0, (1 + size % 5).cast("double")).alias("dn"),
            F.when(size > 25, (size % 26).cast("double")).alias("di"),
            F.when(size % 6 == 0, (80 + size % 21).cast("double")).alias("falstaff"),
            F.when(size % 7 == 0, (size % 51) / 10).alias("thatsup"),
        ).alias("ratings"),
    )
