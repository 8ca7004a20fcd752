"""Fixed values that results depend on: phrases, vocabularies and thresholds. They must be exactly these."""

from __future__ import annotations

# Least severity stored, least characters and words of a message, words of a short comment.
MIN_SEVERITY = 3
MIN_CHARS = 30
MIN_WORDS = 8
SHORT_WORDS = 25
MIN_ARTICLE_CHARS = 20

# Phrases that mark a message as noise, anywhere in it, lower case.
NOISE_PHRASES = (
    "so how's everyone", "well hello there", "better test this", "not forgotten about", "just sitting back", "balancing real life", "bsky.social", "bluesky social media", "there is some beautiful irony", "follow us on", "subscribe to our", "join our channel",
    "turn on notifications", "share this post", "repost if you", "like and subscribe", "don't forget to", "link in bio", "check out our", "support us on", "patreon", "wait i thought", "i thought the war", "you had won", "the war was over", "is he fucking",
    "is he serious?", "is she serious?", "are they serious?", "what a surprise", "can you believe", "hot take:", "unpopular opinion:", "genuine question:", "genuine question,", "anyone else notice", "anyone else feel", "thoughts on this",
    "what do you think", "comment below", "your thoughts?", "let me know", "does anyone know", "asking for a friend", "just asking", "no way this is real", "this is insane", "this is crazy", "oh wow", "lol ", " lmao", " lmfao", " smh", "😂😂", "🤣🤣",
    "https://t.me/joinchat", "https://t.me/+", "t.me/joinchat", "this is a test", "testing 1 2 3", "hello world",
)

# White space of Unicode, what \s means to patterns with (?U).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Beginnings of short comments.
COMMENTARY_STARTERS = ("wait", "is he", "is she", "is this", "are they", "can you", "do you", "does anyone", "lol", "omg", "wow,", "wtf", "smh")

# An article is relevant if it contains one of these, lower case.
CONFLICT_KEYWORDS = (
    "iran", "israel", "irgc", "idf", "mossad", "hezbollah", "hamas", "houthi", "houthis", "ansar allah", "islamic revolutionary",
    "missile", "strike", "attack", "bomb", "explosion", "airstrike", "air strike", "drone", "ballistic", "cruise missile", "rocket", "intercept", "iron dome",
    "kill", "killed", "dead", "casualties", "wounded", "destroyed", "tehran", "tel aviv", "haifa", "beirut", "damascus", "baghdad", "sanaa", "hormuz", "red sea",
    "persian gulf", "natanz", "bushehr", "dimona", "gaza", "west bank", "golan", "rafah", "nuclear", "enrichment", "uranium", "centrifuge", "warhead",
    "carrier", "warship", "navy", "troops", "military", "escalation", "retaliation", "ceasefire", "war", "combat", "pentagon", "centcom", "camp david",
)

# Location names that name no place, and that name too wide a place.
NOT_A_PLACE = ("unknown", "n/a", "", "various", "multiple", "none", "unspecified", "idf", "irgc", "iaf", "centcom", "isis", "nato", "un", "hamas", "hezbollah", "houthi", "houthis", "cia", "mossad", "pmf", "sdf")
VAGUE_LOCATIONS = (
    "iran", "israel", "lebanon", "syria", "iraq", "yemen", "saudi arabia", "jordan", "kuwait", "qatar", "uae", "bahrain", "oman", "egypt", "turkey", "united states", "russia", "china", "unknown", "n/a", "", "middle east", "region", "area", "various",
)

# Event types of a classification; all others count as the first.
EVENT_TYPES = ("military", "diplomatic", "economic", "humanitarian", "cyber")
MAX_KILLED = 1_000_000

# Near-duplicate link: window in seconds, radius in km, caps on candidates, similarity in fifths.
DUP_WINDOW_S = 900
DUP_RADIUS_KM = 50.0
DUP_CAP_LOCATED, DUP_CAP_UNLOCATED = 20, 200

# Navigation integrity: cell in degrees, thresholds, least aircraft and ratio of a zone, altitude floor.
CELL_DEG = 0.8
NIC_LEAST, NAC_P_LEAST = 7, 8
CELL_AIRCRAFT, CELL_RATIO = 10, 0.25
ALTITUDE_FT = 20_000

# Outage detector.
DAY_S = 86_400
CURRENT_S, SEASONAL_S = 5_400, 5_400
CURRENT_POINTS, BASELINE_POINTS = 2, 4
SPARK_POINTS = 48
Z_DEPRESSED, FLAT_ABSOLUTE = -4.0, -0.02
TYPICAL_FLOOR = 0.005
VARIANCE_POINTS = 4
RULER_STRIDE_S, RULER_PROBES, RULER_LEAST = 3_600, 22, 8
LONG_DAYS, LONG_DAY_POINTS, LONG_BASELINE_POINTS, LONG_LEAST_DAYS = 7, 3, 10, 4
STALE_STEPS, STALE_FLOOR_S = 6, 3_600
MIN_BASELINE = {"bgp": 10.0, "ping-slash24": 10.0, "merit-nt": 15.0, "gtr": 1e6}
MIN_BASELINE_OTHER = 1.0

# Tracks.
VESSEL_TTL_S = 600
TRACK_TTL_S, TRACK_POINTS_AIR, TRACK_POINTS_SEA = 600, 120, 200
EARTH_KM, EARTH_NM = 6371.0, 3440.065

# The retired sentinel position.
SENTINEL_LAT, SENTINEL_LON = -25.0, 80.0

# How a death toll is put in words. Counts that can be copied, not "dozens" or "many"; the killed alone.
TOLL_WORDS = ("kill", "dead", "death", "died", "martyr", "fatalit", "slain", "toll", "casualt", "murder", "execut", "lives of")
NUMERALS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
_COUNT = rf"(?:(?:\d{{1,3}}(?:,\d{{3}})+|\d{{1,6}})|{'|'.join(NUMERALS)})"
_APPROX = r"(?:at least|more than|over|nearly|around|about|some|up to|no fewer than|a total of)\s+"
_KILL = "(?:killed|dead|deaths|died|martyred|martyrs|fatalities|slain)"
_VICTIM = (
    "(?:people|persons?|civilians?|children|kids|women|men|palestinians?|israelis?|iranians?|lebanese|syrians?|yemenis?|iraqis?|americans?|"
    "soldiers?|troops?|officers?|police(?:men)?|militants?|fighters?|members?|medics?|journalists?|workers?|students?|hostages?|victims?|"
    "bodies|others?|more|additional)"
)
_FILLER = rf"(?:\s+(?:{_VICTIM}|were|was|are|is|have|has|had|been|reportedly|reported|said|confirmed|feared|also|now)){{0,3}}"
_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
TOLL_COUNTS = {
    "count_then_kill": rf"(?iU)(?<!\bno\s)\b({_COUNT})\b{_FILLER}\s+{_KILL}\b",
    "kill_then_count": rf"(?iU)\b(?:killed|killing|kills|kill|martyred|murdered|executed|claim(?:ed|ing)? the lives of)\s+(?:{_APPROX})?({_COUNT})\b(?!\s*(?:%|percent|years?|yrs?|months?|weeks?|days?|hours?|minutes?|{_MONTHS}))",
    "death_toll_phrase": rf"(?iU)\b(?:death toll|toll of (?:the )?dead|number of (?:the )?(?:dead|deaths|killed|martyrs)|fatalities)\b[^.\n]{{0,40}}?\b({_COUNT})\b",
}
TOLL_SINGULAR = (
    r"(?iU)\b(?:a|an|one)\s+(?:[\w-]+\s+){0,2}?(?:man|woman|child|boy|girl|person|soldier|officer|civilian|policeman|teenager|worker|journalist|medic|paramedic|driver|"
    r"guard|farmer|student|doctor|nurse)\s+(?:was\s+|has\s+been\s+|were\s+|had\s+been\s+)?(?:killed|shot\s+dead|martyred)\b"
)
_ZERO = (
    r"no\s+(?:one|body|\w+\s+)?(?:was\s+|were\s+|been\s+)?(?:killed|martyred)\b|nobody\s+(?:was\s+)?killed|no\s+(?:deaths|fatalities|casualties)\b|"
    r"without\s+(?:any\s+)?(?:deaths|fatalities|casualties)|zero\s+(?:deaths|fatalities|casualties)"
)
_UNPUBLISHED = r"(?:\w+\s+){0,3}?(?:announced|reported|confirmed|released|published|yet)\b"
TOLL_ZERO = rf"(?iU)\b(?:{_ZERO})(?!\s+{_UNPUBLISHED})"
TOLL_UNPUBLISHED = rf"(?iU)\b(?:{_ZERO})\s+{_UNPUBLISHED}|\bno\s+(?:one|body)\s+(?:was\s+|were\s+|has\s+been\s+)?reported\s+(?:killed|dead|martyred)\b"
TOLL_WOUNDED = r"(?iU)\b(?:wounded|injur\w+|hospitali[sz]\w+|casualt\w+|missing)\b"
# What a text of the wounded cannot do without: a stem in lower case, or a letter that patterns take for s or i.
TOLL_WOUNDED_STEMS = ("wounded", "injur", "hospitali", "casualt", "missing", "ſ", "ı", "\u0307")
TOLL_ARABIC_STEMS = ("قتل", "قتيل", "شهيد", "شهداء", "استشه", "وفاة", "وفيات")
_AR_KILL = "(?:قتل|قتلى|قتيل|شهيد|شهداء|استشه|مقتل|وفاة|وفيات)"
_AR_NUM = "(?:[0-9٠-٩][0-9٠-٩,]{0,6})"
TOLL_ARABIC = rf"{_AR_KILL}[^.\n]{{0,30}}?{_AR_NUM}|{_AR_NUM}[^.\n]{{0,30}}?{_AR_KILL}"

# Words of a place's name that tell its scale, in the order in which they decide.
CHOKEPOINT = r"\b(strait|straits|bab|mandeb|mandab|hormuz|channel|canal|bay)\b"
OPEN_WATER = r"\b(sea|gulf|ocean|waters)\b|mediterranean"
FACILITY = r"\b(airbase|air base|afb|base|facility|enrichment|port|refinery|terminal|plant|reactor|airport|field|complex|hq|mosque)\b"
# Places whose extent was measured, in metres; it outranks that of their tier.
KEY_UNCERTAINTY_M = {"anbar": 352_000, "al-anbar": 352_000, "ben gurion airport": 3_265, "ben gurion international airport": 3_265}
# Flags and the places they stand for, in order.
FLAGS = {
    "🇮🇷": "Iran", "🇮🇱": "Israel", "🇺🇸": "United States", "🇱🇧": "Lebanon", "🇾🇪": "Yemen", "🇸🇾": "Syria", "🇮🇶": "Iraq", "🇸🇦": "Saudi Arabia",
    "🇯🇴": "Jordan", "🇪🇬": "Egypt", "🇹🇷": "Turkey", "🇷🇺": "Russia", "🇬🇧": "United Kingdom", "🇫🇷": "France", "🇩🇪": "Germany", "🇨🇳": "China",
    "🇵🇸": "Gaza", "🇰🇼": "Kuwait", "🇶🇦": "Qatar", "🇦🇪": "UAE", "🇴🇲": "Oman", "🇧🇭": "Bahrain", "🇵🇰": "Pakistan",
}

# Generated events by type and by least severity (each with the upper end of its band), their mean and greatest age, and how far
# from its place one lies; how near movers come to a target, and by how much their reported positions differ (degrees).
DEMO_KINDS = (("military", 0.60), ("diplomatic", 0.80), ("economic", 0.92), ("cyber", 1.0))
DEMO_SEVERITIES = ((3, 0.35), (5, 0.65), (7, 0.88), (9, 1.0))
DEMO_MEAN_AGE_S, DEMO_OLDEST_S = 180_000.0, 604_800.0
DEMO_JITTER = 0.3
FLIGHT_NEAR, FLIGHT_NOISE = 0.5, 0.01
VOYAGE_NEAR, VOYAGE_NOISE = 0.1, 0.003
#: Kilometres of a knot's hour and of a degree.
KNOT_KM, DEGREE_KM = 1.852, 111.0

# Seconds after which a feed without a new payload is stale.
FEED_STALE_S = {"adsb": 90, "ais": 60, "tle": 25_200, "gnss": 90, "stream": 900}
