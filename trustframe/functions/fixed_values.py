"""Word lists, patterns and limits that decide results. Kept together so they can be read at a glance."""

# fixed values: texts that stand for "no value"
NULL_TOKENS = ["n/a", "na", "null", "none", "-", "--", "nil", "(blank)", "blank"]

# fixed values: labels of total rows, alone or at either end of a short label
TOTALS_LABELS = ["total", "totals", "grand total", "subtotal", "sub-total", "sum", "net total",
                 "إجمالي", "الإجمالي", "المجموع", "مجموع", "الاجمالي", "اجمالي"]
TOTALS_AFFIXES = ["total", "subtotal", "sub-total", "grand total", "إجمالي", "الإجمالي", "اجمالي", "الاجمالي",
                  "مجموع", "المجموع"]
TOTALS_MAX_LENGTH = 40
REPORT_TOTAL_WORDS = ["total", "totals", "grand total", "الإجمالي", "إجمالي", "اجمالي", "الاجمالي",
                      "المجموع", "مجموع", "sum"]

# fixed values: column-name words per role
IDENTIFIER_WORDS = ["id", "code", "no", "number", "ref", "reference", "key", "رقم", "كود"]
MONEY_WORDS = ["price", "amount", "cost", "salary", "revenue", "fee", "charge", "balance", "total", "value",
               "سعر", "مبلغ", "تكلفة", "راتب", "إيراد", "قيمة", "رصيد"]
PERCENT_WORDS = ["percent", "pct", "rate", "ratio", "نسبة", "معدل"]
QUANTITY_WORDS = ["quantity", "count", "units", "stock", "عدد", "كمية"]
GEO_WORDS = ["nation", "city", "region", "governorate", "address", "location", "محافظة", "مدينة", "عنوان", "دولة"]
CONTACT_WORDS = ["email", "phone", "mobile", "fax", "تليفون", "بريد", "هاتف", "جوال"]
BOOLEAN_TOKENS = ["true", "false", "yes", "no", "y", "n", "0", "1"]
NON_ADDITIVE_WORDS = ["price", "unit", "rate", "avg", "average", "mean", "per", "سعر", "متوسط", "معدل"]

# fixed values: currency marks in column names, first match wins
NAME_CURRENCIES = [("egp", "EGP"), ("e.g.p", "EGP"), ("جنيه", "EGP"), ("ج.م", "EGP"), ("ج.م.", "EGP"),
                   ("usd", "USD"), ("$", "USD"), ("دولار", "USD"), ("eur", "EUR"), ("€", "EUR"), ("يورو", "EUR"),
                   ("sar", "SAR"), ("ريال", "SAR")]

# fixed values: currency words in text
TEXT_CURRENCIES = {"egp": "EGP", "le": "EGP", "جنيه": "EGP", "جنيها": "EGP", "جنيهات": "EGP", "ج.م": "EGP",
                   "usd": "USD", "$": "USD", "دولار": "USD", "eur": "EUR", "€": "EUR", "يورو": "EUR",
                   "sar": "SAR", "ريال": "SAR", "aed": "AED", "درهم": "AED"}

# fixed values: month names
ENGLISH_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ARABIC_MONTHS = {"يناير": 1, "فبراير": 2, "مارس": 3, "أبريل": 4, "ابريل": 4, "مايو": 5, "يونيو": 6, "يوليو": 7,
                 "أغسطس": 8, "اغسطس": 8, "سبتمبر": 9, "أكتوبر": 10, "اكتوبر": 10, "نوفمبر": 11, "ديسمبر": 12}

# fixed values: digits and Arabic letter forms
ARABIC_DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
LETTER_FORMS = ("أإآٱةىؤئ_-ـ", "ااااهيوي  ")          # the last source letter has no target: it is removed
DIACRITICS = "[\u064B-\u0652\u0670]"

# fixed values: text encodings tried in order
TEXT_ENCODINGS = ["utf-8-sig", "cp1256", "latin-1"]

# fixed values: entity patterns; earlier kinds win where matches overlap
NUMBER_PATTERN = r"\d{1,3}(?:[,٬]\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
EMAIL_PATTERN = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
NUMERIC_DATE_PATTERN = r"\b(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\b|\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})\b"
CURRENCY_PATTERN = r"جنيهات|دولار|جنيها|جنيه|يورو|ريال|درهم|ج\.م|egp|usd|eur|sar|aed|le|\$|€"
MONEY_PATTERN = rf"(?i)(?:(?:{CURRENCY_PATTERN})\s?(?:{NUMBER_PATTERN})|(?:{NUMBER_PATTERN})\s?(?:{CURRENCY_PATTERN}))(?![\w])"
NAMED_DATE_PATTERN = (r"(?i)\b(\d{1,2})\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?,?\s+(\d{4})\b"
                      r"|\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})\b"
                      r"|(\d{1,2})\s+(يناير|فبراير|مارس|أبريل|ابريل|مايو|يونيو|يوليو|أغسطس|اغسطس|سبتمبر|أكتوبر|اكتوبر|نوفمبر|ديسمبر)\s+(\d{4})")
PERCENT_PATTERN = rf"(?:{NUMBER_PATTERN})\s?%"
PHONE_PATTERN = (r"(?<![\w.])(?:\+20\s?|0)1[0125]\d{8}(?!\d)"
                 r"|(?<![\w.])\+\d{1,3}[\s-]?\d{2,4}[\s-]?\d{3,4}[\s-]?\d{3,4}")
CODE_PATTERN = r"\b[A-Z]{1,6}[-_/]?\d{2,}(?:[-/]\d+)?\b"
TABLE_NUMBER_PATTERN = r"^[-+(]?\s*[$€£]?\s*\d[\d,٬]*(?:\.\d+)?\s*%?\)?$"
REPAIR_NUMBER_PATTERN = r"^-?[\d,]+\.?\d*$"

# fixed values: thresholds
KEY_UNIQUENESS = 0.98
KEY_NULL_RATE = 0.02
COMPOSITE_UNIQUENESS = 0.10
COMPOSITE_NULL_RATE = 0.10
COMPOSITE_COLUMNS = 6
GRAIN_UNIQUENESS = 0.9
NAME_SIMILARITY = 0.82
CONTAINMENT = 0.90
HEADER_SCAN_ROWS = 30
MAX_EXACT_INTEGER = 2 ** 53
MIN_GAP_ROWS = 2
BAND_OVERLAP = 0.9
GROUP_LEVELS = 3
MAX_MEASURES = 4
MAX_DIMENSIONS = 3
TOP_GROUPS = 10
MAX_MONTHS = 60
MIN_OUTLIER_ROWS = 20
OUTLIER_FENCE = 3.0
NEGATIVE_SHARE = 0.02
TREND_Z = 3.5
EXAMPLES = 5
MIN_REPORT_ROWS = 2
MIN_REPORT_DIM_DISTINCT = 2
LABEL_OVERLAP = 0.6
MATCH_SHARE = 0.5
VOLUME_WARNING = 0.2
SNIPPET_WORDS = 30
BM25_K1 = 1.2
BM25_B = 0.75
ATTACHMENT_DEPTH = 3
FAILURE_CONTEXT = 12
