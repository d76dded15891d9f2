"""Every threshold and fixed value of the engine, in one place."""

from __future__ import annotations

# Geometry, in points unless a factor of the text size.
WORD_GAP_MIN, WORD_GAP_FACTOR, WORD_OVERLAP = -2.0, 0.22, 0.5
LINE_OVERLAP = 0.4
SEGMENT_GAP_FACTOR = 0.9
COLUMN_BUCKET, COLUMN_GUTTER, COLUMN_WIDTH, COLUMN_BANDS, COLUMN_SHARED = 4, 28, 40, 20, 6
COLUMN_MIN_WORDS, COLUMN_MARGIN = 12, 20
OCR_MIN_CHARS, OCR_AREA = 12, 40_000
DEFAULT_PAGE = (595.0, 842.0)

# Tables and fields.
TABLE_TOLERANCE, TABLE_MIN_ROWS, TABLE_LONG, TABLE_WIDE, TABLE_RECURRING = 6.0, 3, 5, 3, 0.6
TABLE_SLACK = 2.0
LABEL_MAX_WORDS, HEADING_FACTOR, VALUE_LARGER, VALUE_WORDS = 5, 1.3, 1.04, 3
BELOW_X, BELOW_GAP, BELOW_LINES = 4.0, 1.8, 2
REACH_RIGHT, REACH_BELOW = 220.0, 40.0
CONFIDENCE_MAX, CONFIDENCE_BASE, CONFIDENCE_NEAR, CONFIDENCE_TYPE = 0.97, 0.45, 0.3, 0.25
NARRATIVE_WORDS = 4
DEFAULT_SIZE = 10.0
RECURRING_DOCS = 3
TITLE_HEIGHT, TITLE_WORDS = 0.25, 4

# Clustering: weights of shape, table columns, row scale, field count, type profile, narrative.
CLUSTER_WEIGHTS = (2.0, 2.0, 1.5, 1.0, 3.0, 1.0)
CLUSTER_PARTIAL, CLUSTER_SCALE, CLUSTER_THRESHOLD = 0.4, 3.0, 0.82

# Reconciliation.
NAME_GATE, NAME_WEIGHT, NAME_CLEAR, NAME_CONTAINED = 0.15, 0.45, 0.6, 0.25
SHAPE_WEIGHT, KIND_WEIGHT, SAME_TYPE_WEIGHT = 0.18, 0.12, 0.12
RANK_CLOSE, RANK_CLOSE_WEIGHT, RANK_NEAR, RANK_NEAR_WEIGHT = 0.25, 0.3, 0.75, 0.18
POSITION_X, POSITION_SPAN, POSITION_GATE, POSITION_WEIGHT = 1.6, 0.5, 0.3, 0.15
MIN_SIGNALS, MERGE_THRESHOLD, SAMPLES, SHAPES = 2, 0.55, 6, 1000

# Resolving, review, rows.
COVERAGE_FLOOR, NAME_QUORUM, IDENTIFYING = 0.15, 0.6, 0.9
BLEND_OLD, BLEND_TYPE, REVIEW_BELOW = 0.6, 0.4, 0.75
CONFIRMED, GENERALISED = 1.0, 0.95
TONE_SURE, TONE_LIKELY = 0.75, 0.5
ROWS_DEFAULT, ROWS_CAP = 200, 500
COLUMN_NAME_LENGTH = 55

VALUE_TYPES = ("date", "money", "number", "integer", "identifier", "email", "phone", "boolean", "text")

# Patterns, lists and confidences that typed values are checked against, each a whole text's.
SPACES = "\t\n\x0b\f\r \xa0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"
BOOLEAN = "yes|no|true|false|y|n"
ISO_DATE = r"(\d{4})-(\d{2})-(\d{2})"
DAY_FIRST_NAME = r"(\d{1,2})\s+([A-Za-z]{3,9})\.?,?\s+(\d{4})"
MONTH_FIRST_NAME = r"([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})"
SLASH_DATE = r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})"
PHONE, PHONE_DIGITS = rf"\+?[\d(][\d{SPACES}().-]{{8,}}", 9
NO_PHONE = r"\d{1,4}[/.-]\d{1,2}[/.-]\d{2,4}"
AMOUNT = r"-?\d+(\.\d{1,4})?"
INTEGER, NUMBER = r"-?\d+", r"-?\d*\.\d+"
IDENTIFIER, IDENTIFIER_LENGTH, IDENTIFIER_WORDS = r"[A-Za-z0-9][A-Za-z0-9/*_. #-]*", 40, 3
TYPE_CONFIDENCE = {"email": 0.98, "boolean": 0.9, "phone": 0.85, "integer": 0.9, "number": 0.9, "identifier": 0.75, "text": 0.6}
DATE_CONFIDENCE = {"iso": 0.98, "named": 0.96, "proved": 0.95, "settled": 0.85, "open": 0.45}
MONEY_CONFIDENCE = {"named": 0.95, "bare": 0.7}
CURRENCY_SYMBOLS = (("$", "USD"), ("£", "GBP"), ("€", "EUR"), ("₹", "INR"), ("¥", "JPY"))
CURRENCY_WORDS = ("INR", "USD", "GBP", "EUR", "AUD", "SGD", "AED", "CAD", "JPY")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ABBREVIATIONS = {
    "no": "number", "num": "number", "nbr": "number", "#": "number",
    "inv": "invoice", "ref": "reference", "qty": "quantity", "amt": "amount",
    "desc": "description", "dt": "date", "acct": "account", "ac": "account",
}
STOPWORDS = ("the", "of", "a", "to", "for", "and", "on", "by", "in", "at")
KIND_WORDS = (
    ("invoice", "Invoices"), ("receipt", "Receipts"), ("statement", "Statements"),
    ("purchase order", "Purchase orders"), ("policy", "Policies"), ("report", "Reports"),
)
#: Why two labels are one field or aren't, in the order in which reasons are told.
REASONS = {
    "apart": '"{a}" and "{b}" stand side by side in one document, so each is a field by itself',
    "unlike": "what they hold is not of one type",
    "weak": "too little speaks for them being one",
    "same_name": "with abbreviations written out, they are one name",
    "shared_word": "their names have a word in common",
    "shape": "their values look alike ({shape})",
    "type": "both hold {type}, in different writing",
    "rank": "each comes {ordinal} among the {type} fields of its document",
    "near_rank": "they come at about the same turn among the {type} fields",
    "place": "they stand at about the same place of the page",
}
COLUMN_TYPES = {
    "date": "date", "money": "decimal(16,2)", "number": "double", "integer": "bigint", "identifier": "string",
    "email": "string", "phone": "string", "boolean": "boolean", "text": "string",
}
