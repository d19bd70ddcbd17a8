"""Closed vocabularies of the news model.

Everything here is a fixed value that results depend on: word lists, scores, limits and thresholds.  All of it can be
overridden by arguments of the operators.
"""

# --- rights: mode -> excerpt limit, excerpt may be shown, text may be used for briefs, image may be reused, may be taken in
RIGHTS = {
    "PUBLIC_DOMAIN": (2000, True, True, True, True),
    "OPEN_LICENSE": (2000, True, True, True, True),
    "RSS_EXCERPT_ALLOWED": (300, True, True, False, True),
    "METADATA_ONLY": (0, False, True, False, True),
    "LINK_ONLY": (0, False, False, False, True),
    "BLOCKED": (0, False, False, False, False),
}

# --- URL parameters that only track readers
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "igshid")

# --- words dropped from headlines before they are compared
HEADLINE_STOP_WORDS = tuple("a an the and or but of at on in to for with by from up out as is are was were be been after before over under into says say new".split())

# --- categories by keyword; the first category with a keyword in the text wins, keywords are substrings
CATEGORY_KEYWORDS = (
    ("weather", ("tornado", "hurricane", "blizzard", "snowstorm", "flood warning", "severe weather", "heat advisory", "winter storm", "nws", "forecast")),
    ("public-safety", ("fire", "firefighters", "police", "shooting", "stabbing", "crash", "evacuation", "emergency", "alert", "road closure", "closure", "hazmat", "rescue", "ambulance")),
    ("politics", ("council", "vote", "election", "mayor", "governor", "senate", "assembly", "bill", "budget", "referendum", "ballot")),
    ("sports", ("game", "team", "season", "playoff", "score", "coach", "league")),
    ("business", ("business", "jobs", "economy", "market", "company", "factory", "downtown", "development")),
    ("health", ("health", "hospital", "clinic", "disease", "vaccine", "outbreak")),
    ("environment", ("climate", "river", "park", "wildlife", "pollution", "solar")),
    ("technology", ("tech", "software", "ai ", "startup", "cyber", "app ")),
    ("science", ("earthquake", "study", "research", "nasa", "scientists", "magnitude")),
    ("entertainment", ("concert", "festival", "film", "music", "theater", "art ")),
    ("travel", ("travel", "flight", "airport", "amtrak", "highway", "thruway")),
)
DEFAULT_CATEGORY = "local"

# --- sections from most to least specific, and their locality scores
SECTIONS = ("local", "regional", "state", "national", "world")
LOCALITY = {"local": 1.0, "regional": 0.8, "state": 0.6, "national": 0.4, "world": 0.2}

# --- rank
RANK_WEIGHTS = {"freshness": 0.25, "locality": 0.25, "corroboration": 0.20, "source_priority": 0.15, "breaking": 0.10, "category_boost": 0.05}
FRESH_HOURS = 72
BREAKING_SOURCES, BREAKING_MINUTES = 3, 60
STALE_PER_DAY, STALE_GRACE_HOURS, STALE_MOST = 0.05, 24, 0.3
DUPLICATE_PENALTY = 0.10
URGENT_CATEGORIES = ("public-safety", "weather")
OFFICIAL_TYPES = ("nws-alerts", "json-api")
OFFICIAL_NAMES = ("national weather service", "usgs", "city of", "county of")

# --- duplicates
NEAR_DUP_RATIO, NEAR_DUP_HOURS = 85, 48

# --- clusters
CLUSTER_WEIGHTS = {"tfidf": 0.55, "location": 0.20, "entity": 0.15, "time": 0.10}
CLUSTER_THRESHOLD, MERGE_THRESHOLD, CLUSTER_HOURS = 0.45, 0.65, 72
TEXT_ALONE, TEXT_WITH_ENTITY = 0.20, 0.08
MAX_FEATURES = 5000
ENTITY_STOP_WORDS = ("The", "This", "That", "These", "Those", "With", "From", "After", "Before", "Crews", "Fire", "Police")
PLACE_SUFFIXES = r"\s+(county|city|town|township|village|borough|parish|state|commonwealth|district|region|metro(?:politan area)?)$"
PLACE_PREFIXES = (("st. ", "st ", "saint "), ("mt. ", "mt ", "mount "), ("ft. ", "ft ", "fort "))

# --- editions
SECTION_CAPS = {"local": 20, "regional": 10, "state": 10, "national": 10, "world": 10}
EDITION_MAX = 30

# --- licences of images
LICENSE_REFUSED = ("nc", "nd", "sampling")

# --- checks of briefs: words that carry no content, and words that the prompt itself asks for
BRIEF_STOP_WORDS = tuple(
    """a an the and or but of at on in to for with by from up out as is are was were be been after before over under into
    says say said new this that these those it its they them their his her our your will would could should has have had
    than then when where which who whom about also just more most some such only very can according including reported
    officials official while during""".split()
)
COVERAGE_SKIP = BRIEF_STOP_WORDS + tuple(
    """sources source disagree disagrees disagreed disagreement differ differs differed difference different details
    developing information unknown unclear ongoing number numbers""".split()
)
#: Phrases that never come from a source; compared in normal form.
BANNED_PHRASES = (
    "casualties", "casualty", "still under investigation", "no casualties", "depth under investigation", "as reported in the headline", "as reported in the excerpt",
    "as noted in the source material", "as per the cluster locations", "as per the places", "as per places", "according to the same source", "according to the places", "us ny",
)
STITCHING_PHRASES = ("another story", "another report from", "a separate story", "in other news")
AFFECTED_WORDS = tuple("affected homes customers residents displaced service people households without evacuated injured missing cases deaths hospitalized".split())
WEEKDAYS = tuple("monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun".split())
MONTHS = {
    1: ("january", "jan"), 2: ("february", "feb"), 3: ("march", "mar"), 4: ("april", "apr"), 5: ("may",), 6: ("june", "jun"),
    7: ("july", "jul"), 8: ("august", "aug"), 9: ("september", "sep", "sept"), 10: ("october", "oct"), 11: ("november", "nov"), 12: ("december", "dec"),
}
#: Outcomes that a brief may state only if its sources do; patterns ignore case.
OUTCOMES = {
    "death": r"\b(?:dying|die[sd]?|dead(?:ly)?|deaths?|kill(?:s|ed|ing)?|fatal(?:ly|ity|ities)?)\b",
    "arrest": r"\barrest(?:s|ed|ing)?\b",
    "charge": r"\bcharg(?:e|es|ed|ing)\b",
    "conviction": r"\b(?:convict(?:s|ed|ion|ions)?|guilty)\b",
    "sentencing": r"\bsentenc(?:e|es|ed|ing)\b",
    "custody": r"\b(?:custody|custodial)\b",
    "indictment": r"\bindict(?:s|ed|ment|ments)?\b",
    "arraignment": r"\barraign(?:s|ed|ment|ments)?\b",
    "imprisonment": r"\b(?:jail(?:s|ed)?|imprison(?:ed)?|prison)\b",
    "injury": r"\binjur(?:y|ies|ed)?\b|\bwound(?:s|ed)?\b",
}
_MONTH_NAMES = "|".join(sorted((n for names in MONTHS.values() for n in names), key=len, reverse=True))
#: A lookahead goes before the boundary, which is slower to test at each character.
ISO_DATE = r"(?=\d{4}-)\b(\d{4})-(\d{2})-(\d{2})(?!\d)"
MONTH_DAY = rf"(?i)(?=[adfjmnos])\b(?:{_MONTH_NAMES})\s+\d{{1,2}}(?:\s*,?\s*\d{{4}})?\b"
SLASH_DATE = r"(?=\d{1,2}/)\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b"
REPORTED_ON = rf"(?i)(?=was)\bwas\s+reported\s+on\s+(?:{_MONTH_NAMES}|\d)"
TITLES = "Dr|Mr|Mrs|Ms|St|Jr|Sr|vs|etc|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
MULTI_WORD_NAME = r"(?=[A-Z])\b([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})+)\b"
NUMBER = r"(?=[$\d])\$?\d[\d,]*(?:\.\d+)?%?"
EVENT_IN = r"(?=[oht])\b(?:occurred|happened|took place|takes? place|taking place)\s+in\s+(?:the\s+)?([A-Z][A-Za-z.'-]*(?:\s+[A-Z][A-Za-z.'-]*)*)"
CONTAINED = (r"(?i)\b(?:is|are|was|were)\s+(?:located|situated)\s+in\b", r"(?i)\b(?:which|that)\s+(?:is|are)\s+(?:located|situated\s+)?in\b", r"\b(?:is|are|was|were)\s+in\s+[A-Z][A-Za-z.'\s]*?County\b")
COUNTY = r"([A-Z][A-Za-z.'-]*(?:\s+[A-Z][A-Za-z.'-]*)*\s+County)"
TAXONOMY = ("local", "politics", "public-safety", "weather", "sports", "business", "health", "environment", "technology", "science", "entertainment", "travel")

# --- weather: provider icon codes, text keywords in order, symbol prefixes in order
ICON_CONDITIONS = {
    "CLEAR": ("skc", "hot", "cold"), "PARTLY_CLOUDY": ("few", "sct"), "CLOUDY": ("bkn", "ovc"), "FOG": ("fog", "nfg", "haze", "smoke", "dust", "ndu", "fu"),
    "RAIN": ("rain", "nrain", "hi_rain", "fzra", "hi_fzra", "ra_sn"), "SHOWERS": ("shra", "hi_shra", "nshra", "hi_nshra"), "THUNDERSTORM": ("tsra", "hi_tsra", "ntsra", "scttsra", "hi_tsra_sct"),
    "SNOW": ("snow", "nsnow", "hi_snow", "blizzard", "nblizzard"), "SLEET": ("snip", "ip", "mix", "rasn", "fzra_sn", "sn"), "WINDY": ("wind", "nwind", "hi_nwind"),
}
TEXT_CONDITIONS = (
    ("THUNDERSTORM", ("thunder",)), ("SNOW", ("snow", "flurr", "blizzard")), ("SLEET", ("sleet", "freezing rain", "ice")), ("SHOWERS", ("shower",)), ("RAIN", ("rain",)), ("DRIZZLE", ("drizzle",)),
    ("FOG", ("fog", "haze", "smoke")), ("WINDY", ("windy", "breezy", "gust")), ("PARTLY_CLOUDY", ("partly", "mostly")), ("CLOUDY", ("cloudy", "overcast")), ("CLEAR", ("sunny", "clear", "fair")),
)
SYMBOL_CONDITIONS = (
    ("clearsky", "CLEAR"), ("fair", "PARTLY_CLOUDY"), ("partlycloudy", "PARTLY_CLOUDY"), ("cloudy", "CLOUDY"), ("fog", "FOG"), ("sleet", "SLEET"), ("snow", "SNOW"), ("drizzle", "DRIZZLE"), ("rainshowers", "SHOWERS"), ("rain", "RAIN"),
)
SEVERITIES = ("extreme", "severe", "moderate", "minor")
#: Heat index in degrees Fahrenheit by temperature and humidity: constant, t, r, tr, tt, rr, ttr, trr, ttrr.
HEAT_INDEX = (-42.379, 2.04901523, 10.14333127, -0.22475541, -0.00683783, -0.05481717, 0.00122874, 0.00085282, -0.00000199)

#: Fixed patterns and kinds of the published tables.
SOURCE_ID = "^[a-z0-9]+(-[a-z0-9]+)*$"
COUNTRY = "^[A-Z]{2}$"
ADMIN1 = "^[A-Z]{2}-[A-Z0-9]{1,3}$"
LANGUAGE = "^[a-z]{2}(-[A-Z]{2})?$"
FEED_PATH = r"^feeds/.*\.json$"
URI = r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"
SOURCE_TYPES = ("rss", "atom", "gdelt", "nws-alerts", "json-api")
EDITION_KINDS = ("latest", "morning", "afternoon", "evening")
