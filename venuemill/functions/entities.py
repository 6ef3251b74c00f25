"""Character references of HTML, inside column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from venuemill import fixed_values as V
from venuemill.functions.text import literal_map


def _code_point(number: Column) -> Column:
    """The character with this number; the replacement character where there is none."""
    valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    safe = F.when(valid, number).otherwise(F.lit(0xFFFD))
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def decode_entities(text: Column) -> Column:
    """Named and numeric character references replaced once, from left to right; unknown ones stay.

    The text is cut at ``&``; each later part may begin with the rest of a reference.
    """
    names = literal_map(V.ENTITY_NAMES)

    def part(p: Column, i: Column) -> Column:
        ref = F.regexp_extract(p, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});", 1)
        number = F.when(ref.rlike("^#[0-9]"), F.conv(F.substring(ref, 2, 8), 10, 10).cast("long")).when(
            ref.rlike("^#[xX]"), F.conv(F.substring(ref, 3, 8), 16, 10).cast("long")
        )
        char = F.coalesce(F.when(number.isNotNull(), _code_point(number)), F.try_element_at(names, ref))
        known = F.concat(char, F.substr(p, F.length(ref) + 2))
        return F.when(i == 0, p).otherwise(F.coalesce(known, F.concat(F.lit("&"), p)))

    # most texts have no reference and skip the work
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "&"), part), "")).otherwise(text)
