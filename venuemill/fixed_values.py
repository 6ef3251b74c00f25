"""Fixed values.

Every table below is a constant that results depend on: word lists, label
maps, weights and thresholds.  They are data, kept together and in natural
order; the logic that uses them lives in ``functions`` and ``operators``.
"""

# --- Fixed values: cities, districts and regions -------------------------

CITY_ALIASES = {
    "gothenburg": "Göteborg",
    "göteborg": "Göteborg",
    "goteborg": "Göteborg",
    "malmö": "Malmö",
    "malmo": "Malmö",
    "stockholm": "Stockholm",
    "köpenhamn": "Köpenhamn",
    "københavn": "Köpenhamn",
    "copenhagen": "Köpenhamn",
    "s:t ibb": "S:t Ibb",
    "jarfalla": "Järfälla",
    "östermalm": "Stockholm",
    "södermalm": "Stockholm",
    "norrmalm": "Stockholm",
    "vasastan": "Stockholm",
    "kungsholmen": "Stockholm",
    "gamla stan": "Stockholm",
    "djurgården": "Stockholm",
    "hägersten": "Stockholm",
    "bromma": "Stockholm",
}

REGION_NAMES = [
    "dalarna", "gotland", "västergötland", "öland", "skåne", "lappland",
    "norrland", "småland", "värmland", "halland", "blekinge", "bohuslän",
    "uppland", "södermanland", "östergötland", "jämtland", "hälsingland",
    "ångermanland", "medelpad", "gästrikland", "härjedalen", "norrbotten",
    "västerbotten",
]

CITY_HEADER_NAMES = [
    "stockholm", "göteborg", "gothenburg", "malmö", "uppsala", "södermalm",
    "norrmalm", "vasastan", "östermalm", "kungsholmen", "gamla stan",
    "djurgården", "hägersten", "bromma", "solna", "sundbyberg", "nacka",
    "lidingö", "majorna", "linnéstaden", "haga", "lund", "helsingborg",
    "västerås", "örebro", "linköping", "norrköping", "jönköping", "umeå",
    "gävle", "borås", "eskilstuna", "karlstad", "täby", "halmstad", "växjö",
    "sundsvall", "luleå", "trollhättan", "östersund", "kalmar", "falun",
    "kristianstad", "skövde", "uddevalla", "visby", "kiruna",
]

CITY_CENTROIDS = {
    "stockholm": (59.33, 18.07),
    "göteborg": (57.71, 11.97),
    "malmö": (55.6, 13.0),
    "uppsala": (59.86, 17.64),
    "linköping": (58.41, 15.62),
    "örebro": (59.27, 15.21),
    "västerås": (59.61, 16.55),
    "helsingborg": (56.05, 12.69),
    "norrköping": (58.59, 16.18),
    "jönköping": (57.78, 14.16),
    "lund": (55.7, 13.19),
    "umeå": (63.83, 20.26),
    "gävle": (60.67, 17.14),
    "borås": (57.72, 12.94),
    "halmstad": (56.67, 12.86),
    "växjö": (56.88, 14.81),
    "karlstad": (59.4, 13.5),
    "sundsvall": (62.39, 17.31),
    "visby": (57.64, 18.3),
    "åre": (63.4, 13.08),
    "kalmar": (56.66, 16.36),
    "luleå": (65.58, 22.15),
    "kiruna": (67.86, 20.23),
    "falkenberg": (56.9, 12.49),
    "borgholm": (56.88, 16.66),
}
COUNTRY_CENTROID = (62.0, 15.0)

# (id, latitude, longitude, radius in km), tried in this order
METRO_CENTRES = [
    ("stockholm", 59.33, 18.07, 50.0),
    ("gothenburg", 57.71, 11.97, 40.0),
    ("malmo", 55.6, 13.0, 50.0),
]
DEFAULT_METRO = "sweden"

FOREIGN_KEYWORDS = [
    "københavn", "copenhagen", "danmark", "denmark", "oslo", "norge", "norway",
]
# latitude min, max, longitude min, max
COUNTRY_BOX = (55.3, 69.1, 10.9, 24.2)

# --- Fixed values: names, prices, text -----------------------------------

NAME_PREFIXES = [
    "restaurang", "restaurant", "ristorante", "trattoria", "brasserie",
    "bistro", "café", "cafe", "hotell?", "hotel",
]
NAME_SUFFIXES = [
    "restaurang", "restaurant", "bar", "grill", "kitchen", "kök", "& bar",
    "& grill", "& restaurang",
]
ADDRESS_CITY_WORDS = ["stockholm", "göteborg", "malmö", "sweden", "sverige"]

PRICE_WORDS = {
    "budget": ["budget", "billig", "enkel", "lågt"],
    "mellan": ["mellan", "mellanklass", "medel", "medium"],
    "lyx": ["lyx", "lyxig", "luxury", "exklusiv", "högt", "hög", "mycket högt"],
}
PRICE_LABELS = {"budget": "€", "mellan": "€€", "lyx": "€€€"}

# one-to-one letters, then letters that become two
FOLD_FROM = "åäöÅÄÖéèêëÉÈÊËáàâãÁÀÂÃíìîïÍÌÎÏóòôõÓÒÔÕúùûüÚÙÛÜýÿÝñÑçÇøØ"
FOLD_TO = "aaoAAOeeeeEEEEaaaaAAAAiiiiIIIIooooOOOOuuuuUUUUyyYnNcCoO"
FOLD_WIDE = {"æ": "ae", "Æ": "AE", "ß": "ss"}

ENTITIES_NEWSPAPER = [
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&auml;", "ä"),
    ("&ouml;", "ö"), ("&aring;", "å"), ("&Auml;", "Ä"), ("&Ouml;", "Ö"),
    ("&Aring;", "Å"), ("&ndash;", "–"), ("&nbsp;", " "),
]
ENTITIES_GUIDE = [
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
    ("&#39;", "'"), ("&auml;", "ä"), ("&ouml;", "ö"), ("&aring;", "å"),
    ("&Auml;", "Ä"), ("&Ouml;", "Ö"), ("&Aring;", "Å"), ("&ndash;", "–"),
    ("&mdash;", "—"), ("&nbsp;", " "),
]
# names of character references that pages of these guides use, by the HTML standard
ENTITY_NAMES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0",
    "auml": "ä", "ouml": "ö", "aring": "å", "Auml": "Ä", "Ouml": "Ö", "Aring": "Å",
    "eacute": "é", "Eacute": "É", "egrave": "è", "Egrave": "È", "ecirc": "ê", "euml": "ë",
    "agrave": "à", "Agrave": "À", "aacute": "á", "acirc": "â", "aelig": "æ", "AElig": "Æ",
    "oslash": "ø", "Oslash": "Ø", "oacute": "ó", "ocirc": "ô", "uuml": "ü", "Uuml": "Ü",
    "uacute": "ú", "ugrave": "ù", "iacute": "í", "icirc": "î", "iuml": "ï", "ccedil": "ç",
    "Ccedil": "Ç", "ntilde": "ñ", "szlig": "ß", "ndash": "–", "mdash": "—", "hellip": "…",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»",
    "bull": "•", "middot": "·", "copy": "©", "reg": "®", "deg": "°", "frac12": "½", "euro": "€",
}
PAYWALL_PHRASES = ["Redan prenumerant", "Logga in för"]
NON_VENUE_TITLE_PREFIXES = [
    r"krogkommissionen", r"elin\s+peters", r"studio\s+dn", r"kk\s+tipsar",
    r"veckans",
]
EXCLUDED_SLUGS = ["annonsera-pa-krogguiden"]
CUTOFF_DATE = "2025-01-01T00:00:00.000Z"

# --- Fixed values: place types -------------------------------------------

HOTEL_TYPES = ["hotel", "resort_hotel", "inn", "lodging", "hostel"]
BAR_TYPES = ["bar", "wine_bar", "cocktail_bar"]
FIKA_TYPES = [
    "cafe", "cafeteria", "coffee_shop", "coffee_roastery", "bakery",
    "pastry_shop", "ice_cream_shop", "chocolate_shop", "dessert_shop",
]
FOOD_TYPES = [
    "restaurant", "cafe", "cafeteria", "coffee_shop", "coffee_roastery",
    "bakery", "pastry_shop", "bar", "wine_bar", "cocktail_bar", "pub",
    "brewpub", "bar_and_grill", "bistro", "gastropub",
    "fine_dining_restaurant", "hotel", "resort_hotel", "inn", "lodging",
    "hostel", "ice_cream_shop", "chocolate_shop", "dessert_shop",
    "sandwich_shop", "bagel_shop", "italian_restaurant", "french_restaurant",
    "japanese_restaurant", "sushi_restaurant", "chinese_restaurant",
    "thai_restaurant", "indian_restaurant", "mexican_restaurant",
    "korean_restaurant", "vietnamese_restaurant", "lebanese_restaurant",
    "persian_restaurant", "spanish_restaurant", "greek_restaurant",
    "turkish_restaurant", "mediterranean_restaurant",
    "scandinavian_restaurant", "european_restaurant", "asian_restaurant",
    "asian_fusion_restaurant", "seafood_restaurant", "steak_house",
    "hamburger_restaurant", "pizza_restaurant", "ramen_restaurant",
    "tapas_restaurant", "falafel_restaurant", "brunch_restaurant",
    "vegan_restaurant", "vegetarian_restaurant", "brazilian_restaurant",
    "dim_sum_restaurant", "barbecue_restaurant", "bangladeshi_restaurant",
    "czech_restaurant", "austrian_restaurant", "german_restaurant",
    "peruvian_restaurant", "caribbean_restaurant", "hawaiian_restaurant",
    "danish_restaurant", "ukrainian_restaurant", "south_american_restaurant",
    "cajun_restaurant", "fusion_restaurant", "american_restaurant",
    "family_restaurant", "fast_food_restaurant", "hot_dog_restaurant",
    "chicken_restaurant", "chinese_noodle_restaurant",
    "japanese_izakaya_restaurant", "basque_restaurant",
    "southwestern_us_restaurant", "indonesian_restaurant",
    "afghan_restaurant", "ethiopian_restaurant",
]
CUISINE_LABELS = {
    "italian_restaurant": "Italienskt",
    "french_restaurant": "Franskt",
    "japanese_restaurant": "Japanskt",
    "sushi_restaurant": "Sushi",
    "chinese_restaurant": "Kinesiskt",
    "thai_restaurant": "Thaimat",
    "indian_restaurant": "Indiskt",
    "mexican_restaurant": "Mexikanskt",
    "korean_restaurant": "Koreanskt",
    "vietnamese_restaurant": "Vietnamesiskt",
    "lebanese_restaurant": "Libanesiskt",
    "persian_restaurant": "Persiskt",
    "spanish_restaurant": "Spanskt",
    "greek_restaurant": "Grekiskt",
    "turkish_restaurant": "Turkiskt",
    "mediterranean_restaurant": "Medelhav",
    "scandinavian_restaurant": "Skandinaviskt",
    "european_restaurant": "Europeiskt",
    "asian_restaurant": "Asiatiskt",
    "asian_fusion_restaurant": "Asiatisk fusion",
    "seafood_restaurant": "Fisk & skaldjur",
    "steak_house": "Steakhouse",
    "hamburger_restaurant": "Hamburgare",
    "pizza_restaurant": "Pizza",
    "ramen_restaurant": "Ramen",
    "tapas_restaurant": "Tapas",
    "falafel_restaurant": "Falafel",
    "fine_dining_restaurant": "Fine dining",
    "bistro": "Bistro",
    "gastropub": "Gastropub",
    "brunch_restaurant": "Brunch",
    "vegan_restaurant": "Veganskt",
    "vegetarian_restaurant": "Vegetariskt",
    "brazilian_restaurant": "Brasilianskt",
    "dim_sum_restaurant": "Dim sum",
    "barbecue_restaurant": "BBQ",
    "bangladeshi_restaurant": "Bangladeshiskt",
    "czech_restaurant": "Tjeckiskt",
    "austrian_restaurant": "Österrikiskt",
    "german_restaurant": "Tyskt",
    "peruvian_restaurant": "Peruanskt",
    "caribbean_restaurant": "Karibiskt",
    "hawaiian_restaurant": "Hawaiianskt",
    "danish_restaurant": "Danskt",
    "ukrainian_restaurant": "Ukrainskt",
    "south_american_restaurant": "Sydamerikanskt",
    "cajun_restaurant": "Cajun",
    "fusion_restaurant": "Fusion",
    "bakery": "Bageri",
    "pastry_shop": "Konditori",
    "cafe": "Café",
    "cafeteria": "Café",
    "coffee_shop": "Café",
    "coffee_roastery": "Café",
    "bar": "Bar",
    "wine_bar": "Vinbar",
    "cocktail_bar": "Cocktailbar",
    "pub": "Pub",
    "brewpub": "Bryggpub",
    "bar_and_grill": "Bar & grill",
    "ice_cream_shop": "Glass",
    "chocolate_shop": "Choklad",
    "dessert_shop": "Dessert",
    "sandwich_shop": "Smörgåsar",
    "bagel_shop": "Bagels",
    "restaurant": "Restaurang",
}
CLASSIFICATION_KEYS = {
    "GOD NIVÅ": "recommended",
    "REKOMMENDERAD": "recommended",
    "REKOMMENDERAT": "recommended",
    "GOD KLASS": "good_class",
    "MYCKET GOD KLASS": "very_good_class",
    "MYCKET GOD NIVÅ": "very_good_class",
    "MÄSTARKLASS": "master_class",
    "EXCEPTIONELL NIVÅ": "master_class",
    "GLOBAL MÄSTARKLASS": "global_master_class",
    "GLOBAL EXCEPTIONELL NIVÅ": "global_master_class",
}
GENERIC_CUISINES = ["Restaurang", "Café", "Bar", "Hotell"]

# --- Fixed values: scoring ------------------------------------------------

PIPELINE_WEIGHTS = {
    "michelin": 0.30,
    "whiteguide": 0.22,
    "falstaff": 0.22,
    "di": 0.14,
    "svd": 0.12,
    "dn": 0.12,
    "krogguiden": 0.10,
    "thatsup": 0.08,
    "google": 0.08,
}
LEGACY_WEIGHTS = {
    "michelin": 0.28,
    "whiteguide": 0.2,
    "svd": 0.16,
    "krogguiden": 0.16,
    "di": 0.16,
    "falstaff": 0.14,
    "dn": 0.14,
    "google": 0.1,
}
DISTINCTION_SCORES = {
    "selected": 7.5,
    "bib_gourmand": 8.0,
    "1_star": 9.0,
    "2_star": 9.5,
    "3_star": 10.0,
    "1_key": 9.0,
    "2_key": 9.5,
    "3_key": 10.0,
}
# native 0-3 scale of the same labels
DISTINCTION_LEVELS = {
    "selected": 0.0,
    "bib_gourmand": 0.5,
    "1_star": 1.0,
    "1_key": 1.0,
    "2_star": 2.0,
    "2_key": 2.0,
    "3_star": 3.0,
    "3_key": 3.0,
}
STARS = ["1_star", "2_star", "3_star"]
KEYS = ["1_key", "2_key", "3_key"]
# Labels are looked up in upper case, so a mixed-case label never maps.
CLASSIFICATION_SCORES = {
    "GOD NIVÅ": 7.0,
    "REKOMMENDERAD": 7.5,
    "REKOMMENDERAT": 7.5,
    "GOD KLASS": 8.0,
    "MYCKET GOD KLASS": 8.5,
    "MYCKET GOD NIVÅ": 9.0,
    "MÄSTARKLASS": 9.5,
    "EXCEPTIONELL NIVÅ": 10.0,
    "GLOBAL MÄSTARKLASS": 10.0,
    "GLOBAL EXCEPTIONELL NIVÅ": 10.0,
}
LEGACY_CLASSIFICATION_SCORES = {
    "recommended": 7.0,
    "good_class": 7.5,
    "very_good_class": 8.5,
    "master_class": 9.0,
    "global_master_class": 10.0,
}
SCALE_MAX = {
    "krogguiden": 5.0,
    "svd": 6.0,
    "di": 25.0,
    "dn": 5.0,
    "falstaff": 100.0,
    "thatsup": 5.0,
    "google": 5.0,
}
CROWD_PRIOR = 7.0
CROWD_FULL_CONFIDENCE = 100.0
PERFECTION_THRESHOLD = 9.5
DECAY_START_YEARS = 3.0
DECAY_PER_YEAR = 0.15
DECAY_FLOOR = 0.4
MILLIS_PER_YEAR = 365.25 * 24 * 60 * 60 * 1000
RANKED_CATEGORIES = ["restaurant", "bar", "fika", "hotel"]

# score, hue, saturation %, lightness %
SCORE_GRADIENT = [
    (0, 0, 70, 45),
    (25, 15, 80, 48),
    (50, 45, 90, 50),
    (75, 90, 60, 42),
    (100, 140, 50, 32),
]
GOLD = "hsl(43, 80%, 50%)"

# --- Fixed values: matching and consolidation ----------------------------

NAME_THRESHOLD = 0.85
NAME_THRESHOLD_NO_ADDRESS = 0.90
NAME_WEIGHT = 0.8
ADDRESS_WEIGHT = 0.2
STREET_WEIGHT = 0.7
NUMBER_WEIGHT = 0.3

# (pass, source id, rating key, scale min, scale max); the sub-article pass
# of the fifth source comes right after its review pass
SOURCE_PASSES = [
    (1, "whiteguide-review", "whiteguide", None, None),
    (2, "krogguiden", "krogguiden", 1.0, 5.0),
    (3, "michelin", "michelin", None, None),
    (4, "di", "di", 0.0, 25.0),
    (5, "dn-review", "dn", 1.0, 5.0),
    (7, "svd-review", "svd", 1.0, 6.0),
    (8, "falstaff", "falstaff", 0.0, 100.0),
    (9, "thatsup", "thatsup", 0.0, 5.0),
]
SUB_ARTICLE_PASS = 6
NAME_PRIORITY = [
    "michelin", "whiteguide-review", "dn-review", "svd-review", "di",
    "krogguiden",
]
QUOTE_SOURCES = [
    "michelin", "whiteguide-review", "falstaff", "dn-review", "svd-review", "di",
]
QUOTE_MIN_CHARS = 20

# --- Fixed values: hours, sub-scores, sources -----------------------------

BREAKFAST_END = 10 * 60
LUNCH_START = 11 * 60
LUNCH_END = 14 * 60
DINNER_START = 17 * 60

DI_SUB_SCORE_MAX = {"food": 15.0, "ambiance": 5.0, "service": 5.0}
GUIDE_SUB_SCORE_MAX = {"food": 39.0, "service": 20.0, "ambiance": 20.0, "drinks": 20.0}

DI_COLUMNS = {
    "name": "Restaurang",
    "total": "Totalpoäng",
    "food": "Mat",
    "ambiance": "Miljö",
    "service": "Service",
    "coordinates": "Kordinater",
    "retest_url": "Länk test-artikel omtest",
    "url": "Länk test-artikel",
    "retest_date": "Datum omtest",
    "date": "Datum",
    "address": "Adress",
    "city": "Ort",
    "price": "Prisklass",
}

LD_VENUE_TYPES = ["Restaurant", "FoodEstablishment", "LocalBusiness", "BarOrPub"]
LD_LISTED_TYPES = [
    "Restaurant", "BarOrPub", "CafeOrCoffeeShop", "Hotel",
    "FoodEstablishment", "LocalBusiness",
]
LD_TYPE_TO_VENUE_TYPE = {
    "Restaurant": "restaurant",
    "BarOrPub": "bar",
    "CafeOrCoffeeShop": "cafe",
    "Hotel": "hotel",
}

# (id, name, url, prestige, collection method, scale min, scale max,
#  sub-scores, content types, coverage, country, enabled)
SOURCE_DEFINITIONS = [
    ("whiteguide-review", "White Guide", "https://whiteguide.com", "prestige",
     "api", None, None, ["food", "service", "ambiance", "drinks"], ["review"],
     ["national"], "se", True),
    ("whiteguide-news", "White Guide Nyheter",
     "https://whiteguide.com/se/sv/news", "prestige", "scrape_html", None,
     None, [], ["news"], ["national"], "se", True),
    ("dn-review", "DN Krogkommissionen",
     "https://www.dn.se/kultur/krogkommissionen/", "professional", "browser",
     0.0, 5.0, [], ["review", "mentioned", "listing"], ["stockholm"], "se",
     True),
    ("dn-news", "DN Restaurangnyheter", "https://www.dn.se", "professional",
     "browser", None, None, None, ["news"], ["national"], "se", False),
    ("svd-review", "SvD Krogguiden", "https://www.svd.se/krogguiden",
     "professional", "scrape_json_ld", 1.0, 6.0, None, ["review"],
     ["stockholm"], "se", True),
    ("michelin", "Guide Michelin", "https://guide.michelin.com/se/en",
     "prestige", "scrape_html", 0.0, 3.0, None, ["review"], ["national"],
     "se", True),
    ("di", "DI Weekend", "https://www.di.se/di-weekend/krogguiden/",
     "professional", "api", 0.0, 25.0, ["food", "ambiance", "service"],
     ["review"], ["national"], "se", True),
    ("krogguiden", "Krogguiden.se", "https://www.krogguiden.se",
     "professional", "scrape_html", 1.0, 5.0, None, ["review"],
     ["Stockholm"], "se", True),
    ("falstaff", "Falstaff", "https://www.falstaff.com", "professional",
     "scrape_json_ld", 0.0, 100.0, None, ["review"], ["national"], "se", True),
    ("thatsup", "Thatsup", "https://thatsup.se", "enthusiast",
     "scrape_json_ld", 0.0, 5.0, None, ["listing"], ["national"], "se", True),
]

CATEGORY_PREFIX = {"restaurant": "r", "bar": "b", "fika": "f", "hotel": "h"}
SITEMAP_TOP_N = {"restaurant": 50, "bar": 20, "fika": 20, "hotel": 20}
