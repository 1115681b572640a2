"""Fixed values shared by the column functions and operators.

Everything in this module is a fixed value: word lists, name patterns, lookup
tables and numeric limits that decide results.  They are written out plainly so
they can be reviewed and overridden; no logic lives here.
"""

# --- fixed values: limits -------------------------------------------------------
PAGE_ROWS = 32_000
MAX_CATEGORIES = 25
MAX_CHART_POINTS = 1_000
MAX_LABEL_CHARS = 120
MAX_SERIES_LABEL_CHARS = 64
DECIMAL_DIGITS = 32
SENTINEL_RATIO = 0.20
CODE_MAX_LEN = 8
CODE_REPEAT_RATIO = 0.10
CODE_UPPER_SHARE = 0.9
STALE_DAYS = (30, 365, 1095)
TOP_K = 10
RERANK_POOL = 20
RETRIEVAL_POOL = 50
RRF_K = 60
SCORE_FLOOR = 0.15
LIMIT_MAX = 32_000
MIN_QUESTION_CHARS = 3
DISAMBIGUATE_POOL = 5
NEAR_MISSES = 5
BANNER_ROWS = 2
CACHE_TTL_S = 30 * 86_400
CACHE_MAX_BYTES = 2_000_000_000
METRICS_TTL_S = 90 * 86_400
METRICS_MAX_ROWS = 100_000
MAX_NARRATION_CHARS = 1_200
TOTAL_TOLERANCE = "0.01"
BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6
RECALL_AT = (1, 3, 5, 10)

# --- fixed values: Latin capitals that look like Greek ones ----------------------
HOMOGLYPH_LATIN = "ABEZHIKMNOPTXY"
HOMOGLYPH_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΧΥ"

# --- fixed values: row markers ---------------------------------------------------
TOTAL_ROW_LABELS = (
    "ΣΥΝΟΛΟ", "ΣΥΝΟΛΑ", "ΓΕΝΙΚΟ ΣΥΝΟΛΟ", "ΣΥΝΟΛΙΚΑ", "ΑΘΡΟΙΣΜΑ", "ΟΛΕΣ", "ΟΛΑ",
    "ΣΥΝΟΛΟ ΧΩΡΑΣ", "TOTAL", "GRAND TOTAL", "ALL", "SUM",
)
RESIDUAL_ROW_LABELS = (
    "ΑΓΝΩΣΤΟ", "ΑΓΝΩΣΤΗ", "ΜΗ ΔΗΛΩΘΕΝ", "ΛΟΙΠΑ", "ΛΟΙΠΕΣ", "ΛΟΙΠΟΙ", "ΑΛΛΕΣ ΧΩΡΕΣ",
    "ΑΛΛΟ", "UNKNOWN", "OTHER", "NOT STATED",
)
SENTINELS = (
    "-", "–", "—", ":", "..", ".", "n/a", "#n/a", "na", "#διαιρ/0!", "#div/0!",
    "δ/υ", "μη διαθεσιμο", "δεν υπαρχουν στοιχεια", "x", "c", "w", "z", "null", "none",
)
OBSERVATION_FLAGS = "pebefcdinrsu"
TRUE_WORDS = ("true", "yes", "y", "ναι", "t", "1")
FALSE_WORDS = ("false", "no", "n", "όχι", "οχι", "f", "0")

# --- fixed values: column-name signals (matched after folding) -------------------
IDENTIFIER_NAMES = ("id", "_id", "a/a", "α/α", "αα", "κωδικός", "κωδ", "code", "index_id")
IDENTIFIER_SUFFIXES = ("id", "κωδ", "_code")
CUMULATIVE_NAME = "(συνολο|synolo|total|cum|αθροιστ)"
INDEX_NAME = "(index|δεικτησ|deiktis|obs_value|_idx)"
YEAR_NAME = "(year|ετοσ|etos|period|per|χρονια|τριμηνο|εξαμηνο)"
SCALE_HINTS = (
    ("σε χιλιαδεσ", "χιλιάδες"),
    ("σε εκατ", "εκατομμύρια"),
    ("σε δισ", "δισεκατομμύρια"),
    ("χιλ.", "χιλιάδες"),
    ("εκατ.", "εκατομμύρια"),
    ("thousands", "thousands"),
    ("millions", "millions"),
)

# --- fixed values: claim vocabulary ----------------------------------------------
NUMBER_WORDS = (
    "εκατομμύρι", "χιλιάδ", "χιλιάδες", "δισεκατομμύρι", "δεκάδ", "εκατοντάδ",
    "μισ", "μισό", "διπλάσι", "τριπλάσι", "τρίτο", "τέταρτο", "ένα τρίτο",
    "million", "billion", "thousand", "hundred", "half", "double", "twice", "triple",
    "third", "quarter", "dozens",
)
TREND_WORDS = (
    "αυξήθηκ", "αύξηση", "μειώθηκ", "μείωση", "άνοδο", "ανοδικ", "πτώση", "πτωτικ", "τάση",
    "σταθερ", "εξέλιξη", "διπλασιάστηκ", "κορυφ", "ρεκόρ",
    "rose", "increase", "fell", "decrease", "decline", "growth", "trend", "stable", "surge",
)
SUPERLATIVE_WORDS = (
    "υψηλότερ", "χαμηλότερ", "μεγαλύτερ", "μικρότερ", "περισσότερ", "λιγότερ", "πρώτ",
    "τελευταί", "κορυφαί", "μέγιστ", "ελάχιστ",
    "highest", "lowest", "largest", "smallest", "most", "least", "top", "maximum", "minimum",
    "first", "leading",
)
MARKUP_PATTERNS = (
    r"(?i)https?://",
    r"(?i)www\.",
    r"(?U)[\w.+-]+@[\w-]+\.[\w.]+",
    r"</?[a-zA-Z][^>]*>",
    r"\]\([^)]*\)",
    r"```",
    r"<\|",
)
FIGURE_TOKEN = r"(?U)[A-Za-zΑ-Ωα-ω_]*\d[\w.,]*"
PURE_FIGURE = r"^[+-]?\d[\d.,]*$"
CLAUSE_BREAK = r"(?<!\d)[.;:·!?\n](?!\d)|(?<!\d),(?!\d)"

# --- fixed values: question language ----------------------------------------------
GREEKLISH_MARKERS = (
    "posa", "poso", "posoi", "poses", "posous", "posi", "poia", "poies", "poioi",
    "poio", "pou", "poy", "pws", "pos", "giati", "pote", "einai", "ine", "yparxoun",
    "iparxoun", "yparxei", "iparxei", "stin", "sthn", "ston", "sto", "sti", "stis",
    "stous", "tou", "ton", "twn", "tvn", "tis", "kai", "ana", "gia", "apo", "tha",
    "vro", "vrw", "ftiaxnete", "kapou", "dimou", "dimos", "dimo", "xora", "xoras",
    "ellada", "ellados", "simeia", "kentra", "neoi", "mesa",
)
ENGLISH_MARKERS = (
    "the", "is", "are", "was", "were", "what", "where", "when", "which", "who", "how",
    "why", "find", "there", "published", "of", "for", "and", "with", "does", "do",
    "can", "am", "looking", "show", "about", "this", "that", "these", "those", "by",
    "on", "at", "an", "from", "main",
)
GREEKLISH_DIGRAPHS = {
    "th": "θ", "ch": "χ", "ps": "ψ", "ks": "ξ",
    "ou": "ου", "ai": "αι", "ei": "ει",
    "oi": "οι", "gg": "γγ", "gk": "γκ",
    "mp": "μπ", "nt": "ντ", "tz": "τζ",
    "ts": "τσ",
}
GREEKLISH_LETTERS = {
    "a": "α", "b": "β", "c": "κ", "d": "δ", "e": "ε",
    "f": "φ", "g": "γ", "h": "η", "i": "ι", "j": "τζ",
    "k": "κ", "l": "λ", "m": "μ", "n": "ν", "o": "ο",
    "p": "π", "q": "κ", "r": "ρ", "s": "σ", "t": "τ",
    "u": "υ", "v": "β", "w": "ω", "x": "ξ", "y": "υ",
    "z": "ζ",
}

# --- fixed values: catalogue -------------------------------------------------------
TABULAR_FORMATS = ("CSV", "JSON", "XLS", "XLSX")
READABLE_FORMATS = ("CSV", "JSON")
SECRET_PARAMS = "sig|se|sp|sv|st|skoid|sktid|fdl|token|key|api_key"
THEME_LABELS = {
    "AGRI": "Agriculture, fisheries and food",
    "ECON": "Economy and finance",
    "EDUC": "Education, culture and sport",
    "ENER": "Energy",
    "ENVI": "Environment",
    "GOVE": "Government and public sector",
    "HEAL": "Health",
    "INTR": "International issues",
    "JUST": "Justice and legal system",
    "REGI": "Regions and cities",
    "SOCI": "Population and society",
    "TECH": "Science and technology",
    "TRAN": "Transport",
}
PUBLISHER_PATTERNS = (
    ("municipality", r"(?U)^\s*Δήμ(ος|ου)\b"),
    ("region", r"(?U)^\s*Περιφερει|^\s*Περιφέρεια\b"),
    ("ministry", r"Υπουργεί"),
)
PUBLISHER_DEFAULT = "national"
STORE_TYPES = {
    "int": "integer", "int2": "integer", "int4": "integer", "int8": "integer",
    "bigint": "integer", "smallint": "integer", "serial": "integer",
    "numeric": "number", "float4": "number", "float8": "number", "real": "number",
    "double precision": "number", "money": "number",
    "bool": "boolean", "boolean": "boolean",
    "date": "date",
    "timestamp": "timestamp", "timestamptz": "timestamp",
    "timestamp without time zone": "timestamp", "timestamp with time zone": "timestamp",
}

# --- fixed values: payload kinds ----------------------------------------------------
MAGIC_HEX = (
    ("504B0304", "zip"), ("25504446", "pdf"), ("D0CF11E0", "ole"), ("1F8B", "gzip"),
    ("425A68", "bzip2"), ("89504E47", "png"), ("47494638", "gif"), ("FFD8FF", "jpeg"),
    ("53514C69746520666F726D61742033", "sqlite"),
)
HTML_MARKERS = ("<!doctype html", "<html", "<head", "<body")
XML_MARKERS = ("<?xml", "<featurecollection", "<wfs:", "<serviceexceptionreport")
DELIMITERS = ",;\t|"
CODECS = ("utf-8", "cp1253", "iso-8859-7")

# --- fixed values: closed vocabularies ----------------------------------------------
PLAN_STATUSES = ("matched", "unsupported", "no_match")
ANSWER_STATUSES = ("answered", "partial", "refused")
COLUMN_ROLES = (
    "identifier", "temporal", "dimension", "code", "unknown", "index", "row_total",
    "running_cumulative", "measure",
)
AGGREGATIONS = ("sum", "count", "avg", "min", "max", "none")
