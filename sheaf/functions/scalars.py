"""Value typing in plain Python, for page kernels that look at a few strings at a time."""

from __future__ import annotations

import re
from functools import lru_cache

from sheaf import constants as C

SPACES = C.SPACES
EMAIL, PHONE, DATE_GROUPS, ISO, DAY_NAME, NAME_DAY, SLASH, IDENTIFIER, AMOUNT, INTEGER, NUMBER = (
    re.compile(p, re.A)
    for p in (
        C.EMAIL, C.PHONE, C.NO_PHONE, C.ISO_DATE, C.DAY_FIRST_NAME, C.MONTH_FIRST_NAME, C.SLASH_DATE, C.IDENTIFIER, C.AMOUNT, C.INTEGER, C.NUMBER,
    )
)
BOOLEAN = re.compile(C.BOOLEAN, re.I)
MONEY_WORD = re.compile(r"(?<![A-Za-z0-9_])(" + "|".join(C.CURRENCY_WORDS) + r"|Rs\.?)\b", re.I | re.A)
MONTHS = {m: i + 1 for i, m in enumerate(C.MONTHS)} | {"sept": 9}


def trim(s: str) -> str:
    return s.strip(SPACES)


def parse_date(s: str, style: str = "unknown") -> tuple[str, float, str, bool] | None:
    """(iso, confidence, style, ambiguous) or None."""
    t = trim(s)
    if ISO.fullmatch(t):
        return t, C.DATE_CONFIDENCE["iso"], "iso", False
    m = DAY_NAME.fullmatch(t)
    day_month_year = m.groups() if m else None
    if not m and (m := NAME_DAY.fullmatch(t)):
        day_month_year = (m[2], m[1], m[3])
    if day_month_year:
        day, name, year = int(day_month_year[0]), day_month_year[1].lower(), int(day_month_year[2])
        month = MONTHS.get(name[:4]) or MONTHS.get(name[:3])
        return (f"{year}-{month:02d}-{day:02d}", C.DATE_CONFIDENCE["named"], "named", False) if month and 1 <= day <= 31 else None
    if m := SLASH.fullmatch(t):
        a, b, year = map(int, m.groups())
        if a > 12 and b > 12:
            return None
        if a > 12 or b > 12:
            shown, month, day = ("dmy", b, a) if a > 12 else ("mdy", a, b)
            return f"{year}-{month:02d}-{day:02d}", C.DATE_CONFIDENCE["proved"], shown, False
        month, day = (a, b) if style == "mdy" else (b, a)
        unknown = style == "unknown"
        return f"{year}-{month:02d}-{day:02d}", C.DATE_CONFIDENCE["open" if unknown else "settled"], style, unknown
    return None


def parse_money(s: str) -> tuple[float, str | None, float] | None:
    """(amount, currency, confidence) or None."""
    t = trim(s)
    negated = len(t) >= 2 and t[0] == "(" and t[-1] == ")" and "\n" not in t
    rest, currency = (trim(t[1:-1]) if negated else t), None
    for symbol, code in C.CURRENCY_SYMBOLS:
        if rest.startswith(symbol) or rest.endswith(symbol):
            currency, rest = code, trim(rest.replace(symbol, ""))
            break
    else:
        if m := MONEY_WORD.search(rest):
            code = m[1].upper().removesuffix(".")
            currency, rest = "INR" if code == "RS" else code, trim(rest[: m.start()] + rest[m.end() :])
    cleaned = rest.replace(",", "").removeprefix("+")
    if not AMOUNT.fullmatch(cleaned) or not (currency or negated or re.search(r"\.[0-9]{2}\Z", cleaned)):
        return None
    return float(cleaned) * (-1 if negated else 1), currency, C.MONEY_CONFIDENCE["named" if currency else "bare"]


@lru_cache(maxsize=100_000)
def type_of(raw: str) -> tuple[str, float]:
    """(type, confidence) of a text."""
    s = trim(raw)
    if not s:
        return "text", 0.0
    if EMAIL.fullmatch(s):
        return "email", C.TYPE_CONFIDENCE["email"]
    if BOOLEAN.fullmatch(s):
        return "boolean", C.TYPE_CONFIDENCE["boolean"]
    if date := parse_date(s):
        return "date", date[1]
    if PHONE.fullmatch(s) and sum(c in "0123456789" for c in s) >= C.PHONE_DIGITS and not DATE_GROUPS.fullmatch(s):
        return "phone", C.TYPE_CONFIDENCE["phone"]
    if money := parse_money(s):
        return "money", money[2]
    bare = s.replace(",", "")
    if INTEGER.fullmatch(bare):
        return "integer", C.TYPE_CONFIDENCE["integer"]
    if NUMBER.fullmatch(bare):
        return "number", C.TYPE_CONFIDENCE["number"]
    words = re.split(rf"[{SPACES}]+", s)
    doubled = re.search(rf"[{SPACES}]{{2,}}", s)
    if len(s) <= C.IDENTIFIER_LENGTH and not doubled and re.search("[0-9]", s) and IDENTIFIER.fullmatch(s) and len(words) <= C.IDENTIFIER_WORDS:
        return "identifier", C.TYPE_CONFIDENCE["identifier"]
    return "text", C.TYPE_CONFIDENCE["text"]
