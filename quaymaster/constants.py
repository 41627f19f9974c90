"""Fixed values that results depend on: word lists, patterns, weights, limits."""

# --- fixed values: white space stripped by trim (Unicode spaces and the BOM) ---
SPACE_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE_CLASS = r"[\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
# The same spaces for use inside a character class (plain \s is ASCII only).
SPACES_IN_CLASS = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"

# --- fixed values: words that mean "no value" ---
PROFILE_NULLS = ("", "null", "none", "n/a", "na", "nil", "-", "undefined", "nan")
TRANSFORM_NULLS = ("", "null", "none", "n/a", "na", "nil", "-", "undefined")
CLEAN_NULLS = ("", "null", "none", "n/a", "-")
CLEAN_BOOLEAN_NULLS = ("", "null", "none", "n/a")

# --- fixed values: boolean words ---
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n")
CLEAN_TRUE_WORDS = ("true", "1", "yes", "y", "active")

# --- fixed values: currency prefixes ---
CURRENCY_CODES = "INR|USD|EUR|GBP|JPY|CNY|AUD|CAD|CHF|SGD|HKD|AED|SAR|ZAR|BRL|MXN|RUB|KRW|TRY|NZD"
CURRENCY_SYMBOLS = "$€£¥₹"

# --- fixed values: number and identifier grammar ---
INTEGER_PREFIX = r"^[+-]?\d+"
NUMBER_PREFIX = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
NUMBER_WHOLE = NUMBER_PREFIX + r"\z"
INTEGER_WHOLE = INTEGER_PREFIX + r"\z"
UUID_ANY = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
UUID_STRICT = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
BOOLEAN_WORD = r"(?i)^(true|false|yes|no|y|n|1|0|active|inactive)\z"
HEX_COLOR = r"^#[0-9a-fA-F]{6}(?:\s*,\s*#[0-9a-fA-F]{6})*\z"
URL_START = r"(?i)^https?://.+"

# --- fixed values: inferred type tests, in the order they are tried ---
TYPE_TESTS = (
    ("uuid", UUID_ANY),
    ("email", rf"^[^{SPACES_IN_CLASS}@]+@[^{SPACES_IN_CLASS}@]+\.[^{SPACES_IN_CLASS}@]+\z"),
    ("url", URL_START),
    ("timestamp", r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}[T ]\d{1,2}:\d{1,2}"),
    ("date", r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}\z"),
    ("boolean", BOOLEAN_WORD),
    ("phone", rf"^[+\d][\d{SPACES_IN_CLASS}().-]{{6,}}\z"),
    ("currency", rf"(?i)^(?:[{CURRENCY_SYMBOLS}]\s?|(?:{CURRENCY_CODES})\s+)[\d,]+\.?\d*\z"),
    ("integer", r"^-?\d{1,18}\z"),
    ("number", r"^-?\d{0,18}\.\d+\z"),
)
TYPE_SHARE = 0.8

# --- fixed values: pattern labels, in reporting order ---
REGEX_PATTERNS = (
    ("MM/DD/YYYY", r"^\d{2}/\d{2}/\d{4}\z"),
    ("DD-MM-YYYY", r"^\d{2}-\d{2}-\d{4}\z"),
    ("ISO-8601-date", r"^\d{4}-\d{2}-\d{2}\z"),
    ("unix-epoch", r"^\d{10,13}\z"),
    ("comma-separated-number", r"^\d{1,3}(,\d{3})+(\.\d+)?\z"),
    ("currency-prefixed", rf"^[{CURRENCY_SYMBOLS}]"),
    ("iso-currency-prefixed", rf"(?i)^(?:{CURRENCY_CODES})\s+[\d,]"),
    ("leading-zeros", r"^0\d+\z"),
)
LONG_TEXT_PATTERN = "long-text"
LONG_TEXT_LENGTH = 200
MULTILINE_PATTERN = "multiline"
JSON_PATTERN = "json-content"
ALL_NULL_PATTERN = "all_null"
SPECIAL_CHAR = rf"[^\w{SPACES_IN_CLASS}.,@_\-/]"

# --- fixed values: profile limits ---
NUMERIC_SHARE = 0.6
TOP_VALUES = 10
TOP_MAX_DISTINCT = 50
TOP_MIN_SHARE = 0.1
OUTLIERS_KEPT = 5
OUTLIER_ABOVE = 1.5
OUTLIER_BELOW = 0.5
SAMPLES_KEPT = 5
SIMPLE_SAMPLES_KEPT = 3
P95 = 0.95

# --- fixed values: mapping score ---
CAST_SAMPLE = 20
CAST_STEPS = ((0.95, 1.0), (0.80, 0.7), (0.50, 0.3))
CAST_ISSUE_BELOW = 0.7
CAST_EXAMPLES = 3
WEIGHTS = {"type": 0.30, "null": 0.20, "unique": 0.15, "required": 0.25, "confidence": 0.10}
PASS_SCORE = 0.8
NULL_RATE_WARN = 0.2
NULL_RATE_CRITICAL = 0.5
NULL_PENALTY = 0.3
UNIQUE_PENALTY = 0.4
LOW_CONFIDENCE = 0.7
SEVERITY_RANK = {"critical": 0, "warning": 1, "info": 2}

# --- fixed values: validation, sampling, batches, repair, verdict ---
FAILURE_RATE_LIMIT = 0.05
FAILURE_EXAMPLES = 5
SUMMARY_MIN_RATE = 0.02
SUMMARY_EXAMPLES = 3
DRY_RUN_SAMPLE = 50
SAMPLE_EDGE = 10
BATCH_ROWS = 500
MAX_RETRIES = 3
VERDICT_SAFE_SCORE = 0.8
VERDICT_LOW_SCORE = 0.5
VERDICT_DRY_RUN_SHARE = 0.5
VERDICT_ISSUES_SHOWN = 3
CONFIDENT = 0.85
UNSURE = 0.5

# --- fixed values: gender words of the products rule ---
GENDER_WORDS = {
    "male": "Men", "m": "Men", "boy": "Men", "men": "Men",
    "female": "Women", "f": "Women", "girl": "Women", "women": "Women",
    "unisex": "Unisex", "all": "Unisex", "both": "Unisex",
}

# Error codes used in every ``errors`` array.
BAD_CAST = "bad_cast"
NOT_NULL = "not_null"
TOO_LONG = "too_long"
OUT_OF_RANGE = "out_of_range"
BAD_FORMAT = "bad_format"
DUPLICATE_KEY = "duplicate_key"
FK_MISSING = "fk_missing"
