"""Explicit schemas, so that no read infers types."""

from pyspark.sql import types as T

SUB_SCORES = T.StructType(
    [T.StructField(k, T.DoubleType()) for k in ("food", "service", "ambiance", "value", "drinks")]
)
SUB_ARTICLE = T.StructType([
    T.StructField("venue_name", T.StringType()),
    T.StructField("venue_address", T.StringType()),
    T.StructField("venue_city", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("price_range", T.StringType()),
    T.StructField("body_text", T.StringType()),
])
ARTICLE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("published_at", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("body_text", T.StringType()),
    T.StructField("venue_type", T.StringType()),
    T.StructField("venue_name", T.StringType()),
    T.StructField("venue_address", T.StringType()),
    T.StructField("venue_city", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("explicit_sub_scores", SUB_SCORES),
    T.StructField("sub_articles", T.ArrayType(SUB_ARTICLE)),
    T.StructField("cuisine", T.ArrayType(T.StringType())),
    T.StructField("price_range", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lng", T.DoubleType()),
    T.StructField("review_count", T.IntegerType()),
    T.StructField("collected_at", T.StringType()),
    T.StructField("enriched_at", T.StringType()),
])

HOURS = T.ArrayType(T.StructType([
    T.StructField("days", T.ArrayType(T.IntegerType())),
    T.StructField("open", T.StringType()),
    T.StructField("close", T.StringType()),
]))

NUMERIC_RATING = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("scale_min", T.DoubleType()),
    T.StructField("scale_max", T.DoubleType()),
    T.StructField("sub_scores", SUB_SCORES),
    T.StructField("published_at", T.StringType()),
    T.StructField("review_count", T.IntegerType()),
])
RATINGS = T.StructType([
    T.StructField("michelin", T.StructType([
        T.StructField("distinction", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ])),
    T.StructField("whiteguide", T.StructType([
        T.StructField("classification", T.StringType()),
        T.StructField("venue_type", T.StringType()),
        T.StructField("sub_scores", SUB_SCORES),
    ])),
    *[T.StructField(k, NUMERIC_RATING) for k in ("svd", "dn", "di", "krogguiden", "falstaff", "thatsup")],
])

MOMENT = T.StructType([T.StructField(k, T.IntegerType()) for k in ("day", "hour", "minute")])
PERIODS = T.ArrayType(T.StructType([
    T.StructField("open", MOMENT),
    T.StructField("close", MOMENT),
]))
PLACE = T.StructType([
    T.StructField("place_id", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("formatted_address", T.StringType()),
    T.StructField("primary_type", T.StringType()),
    T.StructField("maps_uri", T.StringType()),
    T.StructField("business_status", T.StringType()),
    T.StructField("website", T.StringType()),
    T.StructField("phone", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("rating_count", T.IntegerType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lng", T.DoubleType()),
    T.StructField("periods", PERIODS),
])

FLAT_RATINGS = T.StructType([
    T.StructField("krogguiden", T.DoubleType()),
    T.StructField("google", T.DoubleType()),
    T.StructField("michelin", T.StringType()),
    T.StructField("whiteguide", T.StringType()),
    T.StructField("svd", T.DoubleType()),
    T.StructField("dn", T.DoubleType()),
    T.StructField("di", T.DoubleType()),
    T.StructField("falstaff", T.DoubleType()),
    T.StructField("thatsup", T.DoubleType()),
])
SERVING = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("price_range", T.StringType()),
    T.StructField("cuisine", T.StringType()),
    T.StructField("hours", HOURS),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lng", T.DoubleType()),
    T.StructField("ratings", FLAT_RATINGS),
    T.StructField("links", T.MapType(T.StringType(), T.StringType())),
    T.StructField("google_rating_count", T.IntegerType()),
    T.StructField("composite_score", T.IntegerType()),
])
