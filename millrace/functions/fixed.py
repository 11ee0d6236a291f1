"""Fixed values.

Word lists, patterns, formats and thresholds in this file define the results of
the cleaning rules; changing one changes what a rule finds.
"""

# --- fixed values: placeholders that stand for "no value" -------------------
NULL_TOKENS = (
    "not_available", "not available", "n/a", "na", "n.a", "n.a.",
    "none", "unknown", "undefined", "null", "nil", "missing",
    "nan", "#n/a", "#na", "-", "--", "---", "not applicable",
    "not specified", "unspecified", "blank", "empty",
)
REPORT_NULL_TOKENS = NULL_TOKENS + ("tbd", "tbh")

# Tokens a CSV scan reads as null (the pandas.read_csv defaults).
SCAN_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# --- fixed values: characters and shapes -------------------------------------
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　"
CURRENCY_SYMBOLS = "£$€¥₹"
CURRENCY_SHAPE = "[£$€¥₹]"
NUMBER_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER_SHAPE = r"^[+-]?\d+$"
EMAIL_LOOSE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
EMAIL_STRICT = r"^[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}$"
ID_NAME_SHAPE = r"\bid\b|_id$|^id_"
ISO_DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}$"

# --- fixed values: English number words ---------------------------------------
WORD_VALUES = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5,
    "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14,
    "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40,
    "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
    "hundred": 100, "thousand": 1000,
}

MONTHS = (
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
)

# --- fixed values: date formats, in the order they are tried ------------------
CLEANER_DATE_FORMATS = (
    "%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%m-%d-%Y",
    "%d-%m-%y", "%m-%d-%y", "%d %b %Y", "%b %d, %Y", "%B %d, %Y", "%d %B %Y",
)
REPORT_DATE_FORMATS = (
    "%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%m-%d-%Y",
    "%d-%m-%y", "%m-%d-%y", "%d %b %Y", "%b %d, %Y", "%d %B %Y", "%B %d, %Y",
    "%B %d %Y", "%d %B, %Y",
)
LAYER_DATE_FORMATS = (
    "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%Y/%m/%d", "%d.%m.%Y",
    "%Y%m%d",
)
UNAMBIGUOUS_DATE_FORMATS = ("%d-%m-%Y", "%d.%m.%Y", "%Y/%m/%d", "%Y%m%d")
# Shapes outside the lists above that a date cleaner still accepts last.
EXTRA_DATE_FORMATS = ("%d-%b-%Y", "%d.%m.%Y", "%Y%m%d")

# --- fixed values: column-name keywords of the report and the smart cleaner ---
AGE_WORDS = ("age", "years", "yr", "yrs", "years_old")
SCORE_WORDS = ("score", "rating", "grade", "mark", "rank", "points", "gpa")
REPORT_SCORE_WORDS = SCORE_WORDS + ("percent",)
SALARY_WORDS = ("salary", "wage", "income", "pay", "compensation", "earnings")
REPORT_SALARY_WORDS = SALARY_WORDS + ("revenue",)
CURRENCY_WORDS = (
    "salary", "wage", "income", "pay", "price", "cost", "revenue", "profit",
    "amount", "fee", "rate", "budget",
)
REPORT_CURRENCY_WORDS = CURRENCY_WORDS + ("worth",)
DATE_WORDS = (
    "date", "time", "created", "updated", "login", "signup", "registered",
    "modified", "timestamp", "at", "on", "when", "dob", "birth",
)
ID_WORDS = ("id", "_id", "uid", "uuid", "key", "pk", "ref", "code")

# --- fixed values: column-name keywords of the automatic cleaner --------------
POSITIVE_WORDS = (
    "age", "salary", "price", "cost", "count", "quantity", "amount", "score",
    "rate", "revenue", "profit", "weight", "height", "distance", "size",
)
IMPORTANT_WORDS = (
    "id", "_id", "key", "pk", "uid", "uuid", "ref", "code", "number",
    "name", "firstname", "first_name", "lastname", "last_name", "fullname",
    "full_name", "title", "email", "phone", "mobile", "tel", "contact",
    "date", "time", "dob", "birth", "created", "updated", "timestamp", "year",
    "address", "city", "state", "country", "zip", "postal", "region",
    "age", "gender", "sex",
    "order", "invoice", "account", "customer", "employee", "user",
)
EMAIL_WORDS = ("email", "mail", "e_mail")

# --- fixed values: semantic name patterns, first match wins -------------------
SEMANTIC_NAME_PATTERNS = (
    ("id", (r"\bid\b", r"_id$", r"^id_", r"identifier", r"uuid", r"guid")),
    ("date", (r"date", r"_at$", r"^at_", r"timestamp", r"created", r"updated",
              r"dob", r"birth")),
    ("email", (r"email", r"e.?mail")),
    ("age", (r"\bage\b", r"_age$", r"^age_", r"years.?old")),
    ("money", (r"salary", r"wage", r"pay", r"income", r"revenue", r"amount",
               r"price", r"cost", r"fee", r"budget", r"compensation")),
    ("country", (r"country", r"nation", r"nationality")),
    ("name", (r"^name$", r"_name$", r"^name_", r"firstname", r"lastname",
              r"first.?name", r"last.?name", r"full.?name", r"surname")),
    ("phone", (r"phone", r"mobile", r"tel\b", r"telephone", r"cell")),
    ("gender", (r"gender", r"sex\b")),
    ("boolean", (r"^is_", r"^has_", r"^was_", r"^did_", r"^can_")),
)
SEMANTIC_BUCKETS = {
    "id": "id_columns", "date": "date_columns", "email": "email_columns",
    "age": "age_columns", "money": "money_columns", "name": "name_columns",
    "boolean": "boolean_columns",
}

# --- fixed values: bounds and cut-offs ----------------------------------------
AGE_RANGE = (0.0, 120.0)
SCORE_RANGE = (0.0, 100.0)
SALARY_MIN = 0.0
SPARSE_ROW_SHARE = 0.5
NULL_COLUMN_SHARE = 0.5
AUTO_DROP_SHARE = 0.4
SYMMETRIC_SKEW = 0.5
LOW_CARDINALITY = 20
