"""Text normalisation.

White space follows the wide definition (no-break and Unicode spaces count),
which is broader than Java's ``\\s``; ``WS`` spells it out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from venuemill import fixed_values as V

_WIDE = "".join(
    map(chr, [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)
_SPACES = r"\s" + _WIDE
WS = f"[{_SPACES}]"
_ASCII_EDGE = (
    r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
)


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def lookup(values: dict, key: Column) -> Column:
    """Value of a fixed map, NULL when the key is absent."""
    return F.try_element_at(literal_map(values), key)


def present(c: Column) -> Column:
    """Not NULL and not the empty string."""
    return F.coalesce(c != F.lit(""), F.lit(False))


def present_number(c: Column) -> Column:
    """Not NULL and not zero."""
    return F.coalesce(c != F.lit(0), F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.when(present(c), c)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression that is used several times inside conditions is otherwise
    evaluated each time, which hurts for chains of patterns."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


#: What ``strip`` may begin or end with, and what a pattern takes for the end of a line.
_EDGES = [*" \t\n\x0b\f\r\x85", *_WIDE]


def strip_plain(c: Column) -> Column:
    """``strip`` of a plain column: the pattern, which tries every place of a text, only runs where an end may be stripped."""
    ends = F.substring(c, 1, 1).isin(_EDGES) | F.substring(c, -1, 1).isin(_EDGES)
    return F.when(ends, strip(c)).otherwise(c)


def collapse_spaces(c: Column, at_least: int = 2) -> Column:
    return F.regexp_replace(c, f"{WS}{{{at_least},}}", " ")


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Ties go up, also for negative numbers, unlike ``round``."""
    if digits == 0:
        return F.floor(c + F.lit(0.5))
    scale = F.lit(float(10**digits))
    return F.floor(c * scale + F.lit(0.5)) / scale


# --- addresses, cities, names, prices ------------------------------------


def normalize_address(raw: Column) -> Column:
    a = strip(raw)
    a = F.regexp_replace(a, r"\n.*", "")
    a = F.regexp_replace(a, rf"(?i)^Adress:{WS}*", "")
    a = F.regexp_replace(a, rf"(?i)[.,]?{WS}*tel:?{WS}*[\d{_SPACES}()+\-–—]+\.?{WS}*\z", "")
    # ", Area / City" at the end; the letter classes hold no digits, so a
    # corner address ("Street 6 / Other 19") never matches
    letter = "A-ZÀ-Öa-zà-ö"
    a = F.regexp_replace(
        a,
        rf",{WS}+[{letter}][{letter}{_SPACES}:-]+{WS}*/{WS}*[{letter}][{letter}{_SPACES}:,-]+\z",
        "",
    )
    a = F.regexp_replace(a, rf"(?i),{WS}+(?:www|[a-z]{{3,12}})\z", "")
    a = strip(F.regexp_replace(a, rf"\.{WS}*\z", ""))
    return collapse_spaces(a)


def normalize_city(raw: Column) -> Column:
    def known(city: Column) -> Column:
        key = F.lower(city)
        return F.when(key.isin(V.REGION_NAMES), F.lit("")).otherwise(
            F.coalesce(lookup(V.CITY_ALIASES, key), city)
        )

    return let(strip(raw), known)


def normalize_venue_name(raw: Column) -> Column:
    name = F.translate(strip(raw), "‘’“”", "''\"\"")
    name = F.regexp_replace(name, rf"\.{WS}*\z", "")
    return collapse_spaces(name)


def normalize_price(raw: Column) -> Column:
    def tier(price: Column) -> Column:
        key = F.lower(price)
        return (
            F.when(key.isin(V.PRICE_WORDS["budget"]) | (price == "$"), F.lit("budget"))
            .when(key.isin(V.PRICE_WORDS["mellan"]) | (price == "$$"), F.lit("mellan"))
            .when(key.isin(V.PRICE_WORDS["lyx"]) | price.rlike(r"^\${3,}\z"), F.lit("lyx"))
            .otherwise(price)
        )

    return let(strip(raw), tier)


def is_city_header(name: Column) -> Column:
    return strip(F.lower(name)).isin(V.CITY_HEADER_NAMES)


def name_key(name: Column) -> Column:
    """Match key: lower case, one prefix and one suffix word off, no marks."""
    k = F.lower(name)
    k = F.regexp_replace(k, rf"^(?:{'|'.join(V.NAME_PREFIXES)}){WS}+", "")
    k = F.regexp_replace(k, rf"{WS}+(?:{'|'.join(V.NAME_SUFFIXES)})\z", "")
    k = F.regexp_replace(k, r"['´`]", "")
    k = F.regexp_replace(k, r"[^\p{L}\p{N}]", " ")
    return F.trim(F.regexp_replace(k, " +", " "))


def address_key(address: Column) -> Column:
    k = collapse_spaces(F.lower(address), 1)
    k = F.regexp_replace(k, r"\.\z", "")
    k = F.regexp_replace(k, rf",{WS}*", " ")
    words = "|".join(V.ADDRESS_CITY_WORDS)
    k = F.regexp_replace(k, f"{_ASCII_EDGE}(?:{words}){_ASCII_EDGE}", "")
    return strip(k)


_STREET_NUMBER = r"^(.+?)\s+(\d+\s*[a-z]?)\z"


def street_number(address: Column) -> Column:
    """``struct(street, number)`` of a raw address; NULL address gives NULL."""

    def parts(key: Column) -> Column:
        found = F.regexp_extract(key, _STREET_NUMBER, 1)
        return F.when(
            key.isNotNull(),
            F.struct(
                F.when(found != "", F.trim(found)).otherwise(key).alias("street"),
                F.trim(F.regexp_extract(key, _STREET_NUMBER, 2)).alias("number"),
            ),
        )

    return let(strip(collapse_spaces(address_key(address), 1)), parts)


def fold_letters(c: Column) -> Column:
    """Accented Latin letters to plain ones; other letters stay."""
    c = F.translate(c, V.FOLD_FROM, V.FOLD_TO)
    for wide, pair in V.FOLD_WIDE.items():
        c = F.replace(c, F.lit(wide), F.lit(pair))
    return c


def slugify(c: Column) -> Column:
    s = F.regexp_replace(F.lower(fold_letters(c)), "[^a-z0-9]+", "-")
    return F.regexp_replace(s, r"^-|-\z", "")


# --- addresses of the guides ---------------------------------------------


def _last_comma_part(c: Column) -> Column:
    return strip(F.element_at(F.split(c, ","), -1))


def _comma_parts(c: Column) -> Column:
    return F.size(F.split(c, ","))


def city_before_postcode(address: Column) -> Column:
    """``Street, City, 111 22, Sweden``: the part before the post code."""
    def city(parts: Column) -> Column:
        n = F.size(parts)
        return F.when(n < 2, F.lit("")).otherwise(let(
            strip(F.element_at(parts, -1)),
            lambda last: F.when(
                last.rlike(rf"^\d{{3}}{WS}*\d{{2}}\z") & (n >= 3), strip(F.try_element_at(parts, n - F.lit(1)))
            ).otherwise(last),
        ))

    return let(F.split(strip(F.regexp_replace(address, rf"(?i),{WS}*Sweden{WS}*\z", "")), ","), city)


def city_after_postcode(address: Column) -> Column:
    """``Street, 123 45 City`` or ``Street, Area / City``."""
    after = F.regexp_extract(address, rf"\d{{3}}{WS}?\d{{2}}{WS}+(.+?)\z", 1)
    return F.when(after != "", strip(after)).otherwise(
        strip(F.element_at(F.split(address, "[,/]"), -1))
    )


def city_from_last_part(address: Column) -> Column:
    """``Street, 11122, City`` or ``Street, 111 22 City, Sweden``."""
    a = F.regexp_replace(address, rf"(?i),{WS}*(?:Sweden|Schweden){WS}*\z", "")
    return strip(F.regexp_replace(_last_comma_part(a), r"^\d[\d\s]*", ""))


def street_from_first_part(address: Column) -> Column:
    a = F.regexp_replace(address, rf"(?i),{WS}*(?:Sweden|Schweden){WS}*\z", "")
    return strip(F.element_at(F.split(a, ","), 1))


def strip_country(address: Column) -> Column:
    a = F.regexp_replace(address, rf"(?i),{WS}*Sverige\z", "")
    return strip(F.regexp_replace(a, rf"(?i),{WS}*Sweden\z", ""))


def city_from_place_address(address: Column) -> Column:
    """``Street, 111 22 City, Sverige``."""
    a = strip_country(address)
    return F.when(_comma_parts(a) < 2, F.lit("")).otherwise(
        strip(F.regexp_replace(_last_comma_part(a), rf"^\d{{3}}{WS}*\d{{2}}{WS}*", ""))
    )


def clean_guide_address(address: Column, city: Column) -> Column:
    """Drop country, post code and the given city from the end."""

    def without_city(a: Column) -> Column:
        head = F.rtrim(F.substring(a, F.lit(1), F.length(a) - F.length(city)))
        ends_with_city = (
            present(city) & F.endswith(F.lower(a), F.lower(city)) & F.endswith(head, F.lit(","))
        )
        street = strip(F.substring(head, F.lit(1), F.length(head) - 1))
        return F.when(ends_with_city, street).otherwise(a)

    a = strip(F.regexp_replace(address, rf"(?i),{WS}*Sweden{WS}*\z", ""))
    return let(strip(F.regexp_replace(a, rf",{WS}*\d{{3}}{WS}*\d{{2}}{WS}*\z", "")), without_city)


def euro_price_tier(symbols: Column) -> Column:
    n = F.regexp_count(symbols, F.lit("€"))
    return F.when(n <= 1, F.lit("budget")).when(n == 2, F.lit("mellan")).otherwise(F.lit("lyx"))


def price_label(tier: Column) -> Column:
    return lookup(V.PRICE_LABELS, tier)


# --- markup, titles, tags -------------------------------------------------


def strip_html(html: Column, entities: list[tuple[str, str]] = V.ENTITIES_GUIDE) -> Column:
    t = F.regexp_replace(html, "<[^>]*>", "")
    for name, char in entities:
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.replace(t, F.lit("\r\n"), F.lit("\n"))
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def name_from_title(title: Column) -> Column:
    """``Name: headline`` gives the name; NULL for editorial titles."""
    rejected = f"(?i)^(?:{'|'.join(V.NON_VENUE_TITLE_PREFIXES)})"

    def usable(name: Column) -> Column:
        fits = (F.length(name) > 2) & (F.length(name) < 50)
        return F.when(fits & ~name.rlike(rejected), name)

    # a title without a colon gives the empty name, which is too short
    return let(strip(F.regexp_extract(title, "^([^:]+):", 1)), usable)


def split_list(c: Column, sep: str = ",") -> Column:
    """Comma list to trimmed, non-empty items."""
    return F.filter(F.transform(F.split(c, sep), strip), lambda x: x != "")


def clean_tags(tags: Column) -> Column:
    return F.array_distinct(F.filter(tags, lambda t: strip(t) != ""))


# --- numbers in text ------------------------------------------------------


def leading_int(c: Column) -> Column:
    """Integer at the start of the text, NULL when there is none."""
    return blank_to_null(F.regexp_extract(c, rf"^{WS}*([+-]?\d+)", 1)).try_cast("int")


def leading_double(c: Column) -> Column:
    digits = F.regexp_extract(c, rf"^{WS}*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return blank_to_null(digits).try_cast("double")


def sub_score(score: Column, maximum: Column | float) -> Column:
    """Native sub-score on the 0-10 scale with one decimal."""
    maximum = maximum if isinstance(maximum, Column) else F.lit(maximum)
    return round_half_up(F.try_divide(score, maximum) * F.lit(10.0), 1)


def record_id(source: Column, key: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat(source, F.lit(":"), key), 256), 1, length)
