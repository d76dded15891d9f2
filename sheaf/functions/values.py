"""Typing of single values, as Column expressions that stay inside code generation.

``type_value`` runs an ordered cascade, in which the order is meaning: dates come before phone numbers,
phone numbers before amounts. Patterns are anchored with ``\\A`` and ``\\z`` (a Java ``$`` would match before a
last line feed) and every conversion is a ``try_cast``, for ANSI mode would raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf import constants as C

SPACE = C.SPACES
SLASH_DATE, ISO_DATE, DAY_FIRST_NAME, MONTH_FIRST_NAME = (
    rf"\A{p}\z" for p in (C.SLASH_DATE, C.ISO_DATE, C.DAY_FIRST_NAME, C.MONTH_FIRST_NAME)
)
MONEY_WORD = r"(?i)\b(" + "|".join(C.CURRENCY_WORDS) + r"|Rs\.?)\b"


def pinned(df: DataFrame, name: str, c: Column) -> DataFrame:
    """Adds a column that no later filter can pull apart.

    A filter on a computed column is pushed below it with the whole computation written in again, and a
    cascade of parsers grows beyond what one generated method may hold. A one-element explode stops that.
    """
    kept = [x for x in df.columns if x != name]
    return df.select(*[F.col(f"`{x}`") for x in kept], F.explode_outer(F.array(c)).alias(name))


def parted(df: DataFrame, name: str) -> DataFrame:
    """``df``, whose generated code ends and begins anew at a column.

    The JVM leaves a method of more than 8,000 bytes to its interpreter, several times slower. A step with a
    function that has no generated code, here one that changes nothing, stands between two methods.
    """
    return df.withColumn(name, F.element_at(F.transform(F.array(name), lambda x: x), 1))


def js_trim(c: Column) -> Column:
    """Trim of all Unicode white space; Spark's own trim without a list knows the space alone."""
    return F.btrim(c, F.lit(C.SPACES))


def shape_of(c: Column) -> Column:
    """Letters become A, digits 9, runs of either A+ and 9+; everything else stays."""
    shape = F.regexp_replace(F.regexp_replace(js_trim(c), "[A-Za-z]", "A"), "[0-9]", "9")
    return F.regexp_replace(F.regexp_replace(shape, "A{2,}", "A+"), "9{2,}", "9+")


def iso_of(y: Column, m: Column, d: Column) -> Column:
    pad = lambda n: F.lpad(n.cast("string"), F.greatest(F.lit(2), F.length(n.cast("string"))), "0")
    return F.concat_ws("-", y.cast("string"), pad(m), pad(d))


def month_number(name: Column) -> Column:
    """By the first four letters, or else the first three; null for no month."""
    lower = F.lower(name)
    table = F.create_map(*[F.lit(x) for i, m in enumerate(C.MONTHS) for x in (m, i + 1)], F.lit("sept"), F.lit(9))
    return F.coalesce(table[F.substring(lower, 1, 4)], table[F.substring(lower, 1, 3)])


def _date(iso: Column, confidence, style, ambiguous) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        iso.alias("iso"), as_column(confidence).cast("double").alias("confidence"), as_column(style).alias("style"), as_column(ambiguous).alias("ambiguous")
    )


def parse_date(c: Column, style: Column | str = "unknown") -> Column:
    """Struct(iso, confidence, style, ambiguous), or null. A style settles what the text leaves open."""
    return parse_trimmed_date(js_trim(c), style)


def parse_trimmed_date(t: Column, style: Column | str = "unknown") -> Column:
    style = style if isinstance(style, Column) else F.lit(style)
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    number = lambda pattern, k: part(pattern, k).try_cast("int")

    def named(pattern: str, day: int, month: int) -> Column:
        m, d = month_number(part(pattern, month)), number(pattern, day)
        # a year keeps no leading zeros once it has been a number
        made = _date(iso_of(number(pattern, 3), m, d), C.DATE_CONFIDENCE["named"], "named", False)
        return F.when(m.isNotNull() & d.between(1, 31), made)

    a, b, year = (number(SLASH_DATE, k) for k in (1, 2, 3))
    unknown = style == "unknown"
    open_ = _date(
        F.when(style == "mdy", iso_of(year, a, b)).otherwise(iso_of(year, b, a)), F.when(unknown, C.DATE_CONFIDENCE["open"]).otherwise(C.DATE_CONFIDENCE["settled"]), style, unknown
    )
    slash = (
        F.when((a > 12) & (b <= 12), _date(iso_of(year, b, a), C.DATE_CONFIDENCE["proved"], "dmy", False))
        .when((b > 12) & (a <= 12), _date(iso_of(year, a, b), C.DATE_CONFIDENCE["proved"], "mdy", False))
        .when((a <= 12) & (b <= 12), open_)
    )
    return (
        F.when(t.rlike(ISO_DATE), _date(t, C.DATE_CONFIDENCE["iso"], "iso", False))
        .when(t.rlike(DAY_FIRST_NAME), named(DAY_FIRST_NAME, 1, 2))
        .when(t.rlike(MONTH_FIRST_NAME), named(MONTH_FIRST_NAME, 2, 1))
        .when(t.rlike(SLASH_DATE), slash)
    )


def date_form(t: Column) -> Column:
    """Which of the written forms a trimmed text has: 1 to 4, or 0. Every form ends in a digit and has 8 signs at least."""
    may = (F.length(t) >= 8) & F.right(t, F.lit(1)).between("0", "9")
    form = F.when(t.rlike(ISO_DATE), 1).when(t.rlike(DAY_FIRST_NAME), 2).when(t.rlike(MONTH_FIRST_NAME), 3).when(t.rlike(SLASH_DATE), 4)
    return F.when(may, form.otherwise(0)).otherwise(0)


def with_date(df: DataFrame, t: str, name: str, style: Column, proof: str | None = None) -> DataFrame:
    """Adds ``parse_trimmed_date`` of a column in steps, so that each text is taken apart once.

    proof: name of a column that says which order, dmy or mdy, the text proves, if it proves one.
    """
    form, parts = F.col("__form"), F.col("__parts")
    staged = df.withColumn("__form", date_form(F.col(t)))
    staged = staged.withColumn("__parts", F.when(form >= 2, F.split(t, r"[\s.,/-]+")))
    staged = staged.withColumns({
        "__a": F.when(form == 3, parts[1]).otherwise(parts[0]).try_cast("int"),
        "__b": F.when(form == 2, month_number(parts[1])).when(form == 3, month_number(parts[0])).otherwise(parts[1].try_cast("int")),
        "__y": parts[2].try_cast("int"),
    })
    a, b, year = F.col("__a"), F.col("__b"), F.col("__y")
    unknown = style == "unknown"
    day, month = (form == 4) & (a > 12) & (b <= 12), (form == 4) & (b > 12) & (a <= 12)
    reading = F.when(month | ((form == 4) & ~day & (style == "mdy")), iso_of(year, a, b)).otherwise(iso_of(year, b, a))
    told = lambda *v: F.struct(
        *[(x if isinstance(x, Column) else F.lit(x)).cast(k).alias(n) for x, (n, k) in zip(v, (("confidence", "double"), ("style", "string"), ("ambiguous", "boolean")))]
    )
    open_ = told(F.when(unknown, C.DATE_CONFIDENCE["open"]).otherwise(C.DATE_CONFIDENCE["settled"]), style, unknown)
    facts = (
        F.when(form == 1, told(C.DATE_CONFIDENCE["iso"], "iso", False))
        .when(form.isin(2, 3) & b.isNotNull() & a.between(1, 31), told(C.DATE_CONFIDENCE["named"], "named", False))
        .when(day, told(C.DATE_CONFIDENCE["proved"], "dmy", False)).when(month, told(C.DATE_CONFIDENCE["proved"], "mdy", False)).when((form == 4) & (a <= 12) & (b <= 12), open_)
    )
    staged = staged.withColumn("__facts", facts)
    made = F.struct(F.when(form == 1, F.col(t)).otherwise(reading).alias("iso"), "__facts.confidence", "__facts.style", "__facts.ambiguous")
    staged = staged.withColumn(name, F.when(F.col("__facts").isNotNull(), made))
    if proof is not None:
        staged = staged.withColumn(proof, F.when(day, "dmy").when(month, "mdy"))
    return staged.drop("__form", "__parts", "__a", "__b", "__y", "__facts")


def _negated(t: Column) -> Column:
    return t.rlike(r"\A\(.*\)\z")


def _inner(t: Column, negated: Column) -> Column:
    return F.when(negated, js_trim(t.substr(F.lit(2), F.length(t) - 2))).otherwise(t)


def _symbol(inner: Column) -> Column:
    return F.coalesce(*[F.when(inner.startswith(s) | inner.endswith(s), s) for s, _ in C.CURRENCY_SYMBOLS])


def _code(inner: Column) -> Column:
    return F.regexp_replace(F.upper(F.regexp_extract(inner, MONEY_WORD, 1)), r"\.\z", "")


def _cleaned(inner: Column, symbol: Column, code: Column) -> Column:
    without_word = js_trim(F.regexp_replace(inner, r"(?is)\A(.*?)\b(?:" + "|".join(C.CURRENCY_WORDS) + r"|Rs\.?)\b(.*)\z", "$1$2"))
    rest = F.when(symbol.isNotNull(), js_trim(F.replace(inner, symbol, F.lit("")))).when(code != "", without_word).otherwise(inner)
    return F.regexp_replace(F.replace(rest, F.lit(","), F.lit("")), r"\A\+", "")


def _money(cleaned: Column, negated: Column, symbol: Column, code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in C.CURRENCY_SYMBOLS for x in pair])
    currency = F.when(symbol.isNotNull(), names[symbol]).when(code == "RS", "INR").when(code != "", code)
    signal = currency.isNotNull() | negated | cleaned.rlike(r"\.\d{2}\z")
    amount = cleaned.try_cast("double") * F.when(negated, -1.0).otherwise(1.0)
    made = F.struct(amount.alias("amount"), currency.alias("currency"), F.when(currency.isNotNull(), C.MONEY_CONFIDENCE["named"]).otherwise(C.MONEY_CONFIDENCE["bare"]).alias("confidence"))
    return F.when(cleaned.rlike(rf"\A{C.AMOUNT}\z") & signal, made)


def parse_money(c: Column) -> Column:
    """Struct(amount, currency, confidence), or null where nothing says that a number is money."""
    t = js_trim(c)
    negated = _negated(t)
    inner = _inner(t, negated)
    symbol, code = _symbol(inner), _code(inner)
    return _money(_cleaned(inner, symbol, code), negated, symbol, code)


def with_money(df: DataFrame, t: Column, name: str) -> DataFrame:
    """Adds ``parse_money`` of an already trimmed text, in steps that are columns of their own."""
    digit = F.col("__digit")  # without a digit nothing is an amount
    staged = df.withColumn("__digit", t.rlike("[0-9]"))
    staged = staged.withColumn("__negated", digit & _negated(t)).withColumn("__inner", F.when(digit, _inner(t, F.col("__negated"))))
    staged = staged.withColumn("__symbol", _symbol(F.col("__inner")))
    code = F.when(F.col("__symbol").isNull() & F.col("__inner").rlike("[A-Za-z]"), _code(F.col("__inner")))
    staged = staged.withColumn("__code", F.when(digit, F.coalesce(code, F.lit(""))))
    staged = staged.withColumn("__cleaned", F.when(digit, _cleaned(F.col("__inner"), F.col("__symbol"), F.col("__code"))))
    made = _money(F.col("__cleaned"), F.col("__negated"), F.col("__symbol"), F.col("__code"))
    return staged.withColumn(name, made).drop("__digit", "__negated", "__inner", "__symbol", "__code", "__cleaned")


def is_email(t: Column) -> Column:
    return t.contains("@") & t.rlike(rf"\A{C.EMAIL}\z")


def is_boolean(t: Column) -> Column:
    return (F.length(t) <= 5) & t.rlike(rf"(?i)\A({C.BOOLEAN})\z")


def is_phone(t: Column) -> Column:
    digits = F.length(F.regexp_replace(t, r"\D", ""))
    return t.rlike(rf"\A{C.PHONE}\z") & (digits >= C.PHONE_DIGITS) & ~t.rlike(rf"\A{C.NO_PHONE}\z")


def is_identifier(t: Column) -> Column:
    return (
        (F.length(t) <= C.IDENTIFIER_LENGTH)
        & ~t.rlike(rf"[{SPACE}]{{2,}}")
        & t.rlike(r"\d")
        & t.rlike(rf"\A{C.IDENTIFIER}\z")
        & (F.size(F.split(t, rf"[{SPACE}]+")) <= C.IDENTIFIER_WORDS)
    )


def typed(kind: str, text, number=None, boolean=None, currency=None, confidence=0.0) -> Column:
    put = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(
        F.lit(kind).alias("type"), put(text, "string").alias("text"), put(number, "double").alias("number"),
        put(boolean, "boolean").alias("boolean"), put(currency, "string").alias("currency"), put(confidence, "double").alias("confidence"),
    )


def _cascade(t: Column, date: Column, money: Column) -> Column:
    bare = F.replace(t, F.lit(","), F.lit(""))
    yes = t.rlike(r"(?i)\A(yes|true|y)\z")
    return (
        F.when(t == "", typed("text", None))
        .when(is_email(t), typed("email", F.lower(t), confidence=C.TYPE_CONFIDENCE["email"]))
        .when(is_boolean(t), typed("boolean", yes.cast("string"), boolean=yes, confidence=C.TYPE_CONFIDENCE["boolean"]))
        .when(date.isNotNull(), typed("date", date["iso"], confidence=date["confidence"]))
        .when(is_phone(t), typed("phone", F.regexp_replace(t, r"[^\d+]", ""), confidence=C.TYPE_CONFIDENCE["phone"]))
        .when(money.isNotNull(), typed("money", money["amount"], money["amount"], currency=money["currency"], confidence=money["confidence"]))
        .when(bare.rlike(rf"\A{C.INTEGER}\z"), typed("integer", bare, bare.try_cast("double"), confidence=C.TYPE_CONFIDENCE["integer"]))
        .when(bare.rlike(rf"\A{C.NUMBER}\z"), typed("number", bare, bare.try_cast("double"), confidence=C.TYPE_CONFIDENCE["number"]))
        .when(is_identifier(t), typed("identifier", t, confidence=C.TYPE_CONFIDENCE["identifier"]))
        .otherwise(typed("text", t, confidence=C.TYPE_CONFIDENCE["text"]))
    )


def type_value(c: Column, style: Column | str = "unknown") -> Column:
    """Struct(type, text, number, boolean, currency, confidence); ``text`` is the canonical rendering.

    Integers keep every digit in ``text``; ``number`` is a double. A null is like an empty text. Over a
    whole column use ``with_value``: its steps are columns of their own, so none is worked out twice.
    """
    t = js_trim(F.coalesce(c, F.lit("")))
    return _cascade(t, parse_trimmed_date(t, style), parse_money(t))


def with_value(df: DataFrame, raw: Column, name: str = "value", style: Column | str = "unknown", proof: str | None = None) -> DataFrame:
    """Adds ``type_value(raw, style)``, staged so that no text is matched twice and generated code stays small.

    proof: see ``with_date``.
    """
    staged = df.withColumns({"__raw": F.coalesce(raw, F.lit("")), "__style": style if isinstance(style, Column) else F.lit(style)})
    staged = staged.withColumn("__t", js_trim(F.col("__raw")))
    staged = parted(with_date(parted(staged, "__t"), "__t", "__date", F.col("__style"), proof), "__date")
    staged = with_money(staged, F.col("__t"), "__money")
    return pinned(staged, name, _cascade(F.col("__t"), F.col("__date"), F.col("__money"))).drop("__raw", "__style", "__t", "__date", "__money")


def date_proofs(c: Column) -> tuple[Column, Column]:
    """Whether a value proves day-first or month-first order."""
    t = js_trim(c)
    a, b = (F.regexp_extract(t, SLASH_DATE, k).try_cast("int") for k in (1, 2))
    return F.coalesce((a > 12) & (b <= 12), F.lit(False)), F.coalesce((b > 12) & (a <= 12), F.lit(False))


def resolve_date_style(dmy: Column, mdy: Column) -> Column:
    """The convention that the counts of proofs show; both or neither leave it unknown."""
    return F.when((dmy > 0) & (mdy == 0), "dmy").when((mdy > 0) & (dmy == 0), "mdy").otherwise("unknown")


def tone(status: Column, confidence: Column) -> Column:
    return (
        F.when(status == "empty", "empty").when(confidence >= C.TONE_SURE, "sure").when(confidence >= C.TONE_LIKELY, "likely").otherwise("unsure")
    )


def accuracy_text(c: Column) -> Column:
    """Numbers to two decimals, other texts trimmed: how extracted and true values are compared."""
    t = js_trim(c)
    return F.coalesce(F.format_string("%.2f", F.when(t.rlike(r"\A-?\d+(\.\d+)?\z"), t.try_cast("double"))).try_cast("decimal(38,2)").cast("string"), t)


def display_number(c: Column) -> Column:
    """Thousands separators for what has two decimals; anything else as it is."""
    return F.when(c.rlike(r"\A-?\d+\.\d{2}\z"), F.format_number(c.try_cast("decimal(38,2)"), 2)).otherwise(c)
