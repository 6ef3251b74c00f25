"""Distances, regions and place categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from venuemill import fixed_values as V
from venuemill.functions.text import lookup, strip

EARTH_KM = 6371.0
EARTH_M = 6371000.0


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = EARTH_M) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(radius) * 2 * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def format_distance(meters: Column) -> Column:
    return F.when(
        meters < 1000, F.format_string("%d m", F.floor(meters + F.lit(0.5)))
    ).when(meters >= 1000, F.format_string("%.1f km", meters / 1000))


def metro_region(lat: Column, lng: Column) -> Column:
    """First metro centre within its radius, else the rest of the country."""
    chain = F.when(lat.isNull() | lng.isNull(), F.lit(V.DEFAULT_METRO))
    for region, clat, clng, km in V.METRO_CENTRES:
        near = haversine(lat, lng, F.lit(clat), F.lit(clng), EARTH_KM) <= F.lit(km)
        chain = chain.when(near, F.lit(region))
    return chain.otherwise(F.lit(V.DEFAULT_METRO))


def city_centroid(city: Column) -> Column:
    """``struct(lat, lng)`` of a known city, else of the country."""
    key = strip(F.lower(city))
    lat = lookup({c: p[0] for c, p in V.CITY_CENTROIDS.items()}, key)
    lng = lookup({c: p[1] for c, p in V.CITY_CENTROIDS.items()}, key)
    return F.struct(
        F.coalesce(lat, F.lit(V.COUNTRY_CENTROID[0])).alias("lat"),
        F.coalesce(lng, F.lit(V.COUNTRY_CENTROID[1])).alias("lng"),
    )


def in_country(lat: Column, lng: Column, address: Column) -> Column:
    text = F.lower(address)
    foreign = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in V.FOREIGN_KEYWORDS])
    south, north, west, east = V.COUNTRY_BOX
    return ~foreign & lat.between(south, north) & lng.between(west, east)


def is_food_type(place_type: Column) -> Column:
    return F.coalesce(place_type.isin(V.FOOD_TYPES), F.lit(False))


def venue_category(venue_type: Column, place_type: Column) -> Column:
    kind = F.coalesce(place_type, F.lit(""))
    venue = F.coalesce(venue_type, F.lit(""))
    return (
        F.when(kind.isin(V.HOTEL_TYPES), F.lit("hotel"))
        .when((venue == "hotel") & (kind == ""), F.lit("hotel"))
        .when((kind != "") & ~kind.isin(V.FOOD_TYPES), F.lit("exclude"))
        .when(kind.isin(V.BAR_TYPES), F.lit("bar"))
        .when(kind.isin(V.FIKA_TYPES), F.lit("fika"))
        .when(venue == "bar", F.lit("bar"))
        .when(venue == "cafe", F.lit("fika"))
        .otherwise(F.lit("restaurant"))
    )
