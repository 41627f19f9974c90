"""What the SQL side expects: written out here, not taken from the library that it checks."""

# --- fixed values: white space, null words, boolean words, currencies ---
SPACE_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
PROFILE_NULLS = ("", "null", "none", "n/a", "na", "nil", "-", "undefined", "nan")
TRANSFORM_NULLS = ("", "null", "none", "n/a", "na", "nil", "-", "undefined")
CLEAN_NULLS = ("", "null", "none", "n/a", "-")
CLEAN_BOOLEAN_NULLS = ("", "null", "none", "n/a")
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n")
CLEAN_TRUE_WORDS = ("true", "1", "yes", "y", "active")
CURRENCY_CODES = "INR|USD|EUR|GBP|JPY|CNY|AUD|CAD|CHF|SGD|HKD|AED|SAR|ZAR|BRL|MXN|RUB|KRW|TRY|NZD"
CURRENCY_SYMBOLS = "$€£¥₹"

# --- fixed values: grammar of numbers and identifiers ---
INTEGER_PREFIX = r"^[+-]?\d+"
NUMBER_PREFIX = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
NUMBER_WHOLE = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"
UUID_ANY = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
UUID_STRICT = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
BOOLEAN_WORD = r"(?i)^(true|false|yes|no|y|n|1|0|active|inactive)\z"
URL_START = r"(?i)^https?://.+"
_SPACES = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPECIAL_CHAR = rf"[^\w{_SPACES}.,@_\-/]"

# --- fixed values: type tests and pattern labels, in order ---
TYPE_TESTS = (
    ("uuid", UUID_ANY),
    ("email", rf"^[^{_SPACES}@]+@[^{_SPACES}@]+\.[^{_SPACES}@]+\z"),
    ("url", URL_START),
    ("timestamp", r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}[T ]\d{1,2}:\d{1,2}"),
    ("date", r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}\z"),
    ("boolean", BOOLEAN_WORD),
    ("phone", rf"^[+\d][\d{_SPACES}().-]{{6,}}\z"),
    ("currency", rf"(?i)^(?:[{CURRENCY_SYMBOLS}]\s?|(?:{CURRENCY_CODES})\s+)[\d,]+\.?\d*\z"),
    ("integer", r"^-?\d{1,18}\z"),
    ("number", r"^-?\d{0,18}\.\d+\z"),
)
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

# --- fixed values: gender words ---
GENDER_WORDS = {
    "male": "Men", "m": "Men", "boy": "Men", "men": "Men",
    "female": "Women", "f": "Women", "girl": "Women", "women": "Women",
    "unisex": "Unisex", "all": "Unisex", "both": "Unisex",
}
