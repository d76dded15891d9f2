"""DuckDB SQL of the queries: the same rules stated a second time, without the operators."""

from __future__ import annotations

from sheaf import constants as C

VENDOR_CASES = """
pile AS (
  SELECT o_orderkey::VARCHAR AS document, o_orderkey, o_custkey, 0 AS ord, 'date' AS field, 0.5 AS confidence,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Invoice Date' WHEN '2-HIGH' THEN 'DATE' WHEN '3-MEDIUM' THEN 'Issued'
      WHEN '4-NOT SPECIFIED' THEN 'Date of Issue' WHEN '5-LOW' THEN 'Raised on' END AS source_label,
    CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%d/%m/%Y') WHEN '2-HIGH' THEN strftime(o_orderdate, '%m/%d/%Y')
      WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%d %b %Y')
      WHEN '5-LOW' THEN strftime(o_orderdate, '%b %d, %Y') END AS raw
  FROM orders
  UNION ALL
  SELECT o_orderkey::VARCHAR, o_orderkey, o_custkey, 1, 'total', 0.75,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Total Due' WHEN '2-HIGH' THEN 'TOTAL' WHEN '3-MEDIUM' THEN 'Amount Payable'
      WHEN '4-NOT SPECIFIED' THEN 'Grand Total' WHEN '5-LOW' THEN 'Balance Due' END,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Rs ' WHEN '2-HIGH' THEN '$' WHEN '3-MEDIUM' THEN 'INR '
      WHEN '4-NOT SPECIFIED' THEN '(' WHEN '5-LOW' THEN '£' END || o_totalprice::DECIMAL(16,2)::VARCHAR
      || CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN ')' ELSE '' END
  FROM orders)"""

MONTH_LIST = str(list(C.MONTHS))
SLASH, DAY_NAME, NAME_DAY = C.SLASH_DATE, C.DAY_FIRST_NAME, C.MONTH_FIRST_NAME
WORDS = r"\b(" + "|".join(C.CURRENCY_WORDS) + r"|Rs\.?)\b"


def typed(source: str, style: str = "'unknown'") -> str:
    """CTEs that end in ``typed``: the columns of ``source`` (with ``raw``) and the typed value."""
    return rf"""
trimmed AS (SELECT *, trim(coalesce(raw, ''), ' ' || chr(9) || chr(10) || chr(13)) AS t, {style} AS given_style FROM {source}),
dated AS (SELECT *,
    CASE WHEN regexp_full_match(t, '{SLASH}') THEN regexp_extract(t, '^{SLASH}$', 1)::INT END AS a,
    CASE WHEN regexp_full_match(t, '{SLASH}') THEN regexp_extract(t, '^{SLASH}$', 2)::INT END AS b,
    regexp_extract(t, '^{SLASH}$', 3) AS y,
    CASE WHEN regexp_full_match(t, '{DAY_NAME}') THEN regexp_extract(t, '^{DAY_NAME}$', 1)::INT
         WHEN regexp_full_match(t, '{NAME_DAY}') THEN regexp_extract(t, '^{NAME_DAY}$', 2)::INT END AS nd,
    list_position({MONTH_LIST}, lower(left(CASE WHEN regexp_full_match(t, '{DAY_NAME}') THEN regexp_extract(t, '^{DAY_NAME}$', 2)
         WHEN regexp_full_match(t, '{NAME_DAY}') THEN regexp_extract(t, '^{NAME_DAY}$', 1) END, 3))) AS nm,
    coalesce(nullif(regexp_extract(t, '^{DAY_NAME}$', 3), ''), regexp_extract(t, '^{NAME_DAY}$', 3)) AS ny
  FROM trimmed),
isoed AS (SELECT *,
    CASE WHEN regexp_full_match(t, '{C.ISO_DATE}') THEN t
         WHEN nm > 0 AND nd BETWEEN 1 AND 31 THEN printf('%d-%02d-%02d', ny::INT, nm, nd)
         WHEN a > 12 AND b <= 12 THEN printf('%d-%02d-%02d', y::INT, b, a)
         WHEN b > 12 AND a <= 12 THEN printf('%d-%02d-%02d', y::INT, a, b)
         WHEN a <= 12 AND b <= 12 AND given_style = 'mdy' THEN printf('%d-%02d-%02d', y::INT, a, b)
         WHEN a <= 12 AND b <= 12 THEN printf('%d-%02d-%02d', y::INT, b, a) END AS iso,
    CASE WHEN regexp_full_match(t, '{C.ISO_DATE}') THEN 0.98
         WHEN nm > 0 AND nd BETWEEN 1 AND 31 THEN 0.96
         WHEN (a > 12 AND b <= 12) OR (b > 12 AND a <= 12) THEN 0.95
         WHEN a <= 12 AND b <= 12 AND given_style = 'unknown' THEN 0.45
         WHEN a <= 12 AND b <= 12 THEN 0.85 END::DOUBLE AS date_confidence,
    regexp_full_match(t, '\(.*\)') AS negated
  FROM dated),
inner_ AS (SELECT *, CASE WHEN negated THEN trim(substr(t, 2, length(t) - 2)) ELSE t END AS i FROM isoed),
marked AS (SELECT *,
    CASE WHEN starts_with(i, '$') OR ends_with(i, '$') THEN '$' WHEN starts_with(i, '£') OR ends_with(i, '£') THEN '£'
         WHEN starts_with(i, '€') OR ends_with(i, '€') THEN '€' WHEN starts_with(i, '₹') OR ends_with(i, '₹') THEN '₹'
         WHEN starts_with(i, '¥') OR ends_with(i, '¥') THEN '¥' END AS symbol,
    rtrim(upper(regexp_extract(i, '(?i){WORDS}', 1)), '.') AS code
  FROM inner_),
cleaned_ AS (SELECT *,
    CASE WHEN symbol = '$' THEN 'USD' WHEN symbol = '£' THEN 'GBP' WHEN symbol = '€' THEN 'EUR' WHEN symbol = '₹' THEN 'INR'
         WHEN symbol = '¥' THEN 'JPY' WHEN code = 'RS' THEN 'INR' WHEN code <> '' THEN code END AS currency,
    regexp_replace(replace(CASE WHEN symbol IS NOT NULL THEN trim(replace(i, symbol, ''))
         WHEN code <> '' THEN trim(regexp_replace(i, '(?i){WORDS}', '')) ELSE i END, ',', ''), '^\+', '') AS cleaned
  FROM marked),
paid AS (SELECT *,
    regexp_full_match(cleaned, '{C.AMOUNT}') AND (currency IS NOT NULL OR negated OR regexp_matches(cleaned, '\.\d{{2}}$')) AS is_money,
    replace(t, ',', '') AS bare
  FROM cleaned_),
typed AS (SELECT *,
    CASE WHEN t = '' THEN 'text'
         WHEN regexp_full_match(t, '{C.EMAIL}') THEN 'email'
         WHEN regexp_full_match(t, '(?i)({C.BOOLEAN})') THEN 'boolean'
         WHEN iso IS NOT NULL THEN 'date'
         WHEN regexp_full_match(t, '\+?[\d(][\d\s().-]{{8,}}') AND length(regexp_replace(t, '\D', '', 'g')) >= 9
              AND NOT regexp_full_match(t, '{C.NO_PHONE}') THEN 'phone'
         WHEN is_money THEN 'money'
         WHEN regexp_full_match(bare, '{C.INTEGER}') THEN 'integer'
         WHEN regexp_full_match(bare, '{C.NUMBER}') THEN 'number'
         WHEN length(t) <= 40 AND NOT regexp_matches(t, '\s{{2,}}') AND regexp_matches(t, '\d')
              AND regexp_full_match(t, '{C.IDENTIFIER}') AND len(regexp_split_to_array(t, '\s+')) <= 3 THEN 'identifier'
         ELSE 'text' END AS type,
    CASE WHEN is_money THEN cleaned::DOUBLE * CASE WHEN negated THEN -1 ELSE 1 END END AS amount
  FROM paid),
valued AS (SELECT *,
    CASE type WHEN 'email' THEN 0.98 WHEN 'boolean' THEN 0.9 WHEN 'date' THEN date_confidence WHEN 'phone' THEN 0.85
         WHEN 'money' THEN CASE WHEN currency IS NOT NULL THEN 0.95 ELSE 0.7 END WHEN 'integer' THEN 0.9 WHEN 'number' THEN 0.9
         WHEN 'identifier' THEN 0.75 ELSE CASE WHEN t = '' THEN 0 ELSE 0.6 END END::DOUBLE AS value_confidence
  FROM typed)"""


def proofs(by: str, source: str = "pile") -> str:
    """Select of day-first and month-first proofs by a grouping column."""
    return rf"""
SELECT {by},
  count(*) FILTER (regexp_full_match(raw, '{SLASH}') AND try_cast(regexp_extract(raw, '^{SLASH}$', 1) AS INT) > 12
    AND try_cast(regexp_extract(raw, '^{SLASH}$', 2) AS INT) <= 12) AS dmy,
  count(*) FILTER (regexp_full_match(raw, '{SLASH}') AND try_cast(regexp_extract(raw, '^{SLASH}$', 2) AS INT) > 12
    AND try_cast(regexp_extract(raw, '^{SLASH}$', 1) AS INT) <= 12) AS mdy
FROM {source} GROUP BY {by}"""


STYLE = "CASE WHEN dmy > 0 AND mdy = 0 THEN 'dmy' WHEN mdy > 0 AND dmy = 0 THEN 'mdy' ELSE 'unknown' END"


def canonical(cases: str) -> str:
    """Canonical cells of the pile that ``cases`` ends with."""
    return (
        cases
        + ", proved AS ("
        + proofs("source_label")
        + f"), styled AS (SELECT p.*, {STYLE} AS style FROM pile p JOIN proved USING (source_label)), "
        # totals are no dates: their style is unknown, as it is for every label without proofs
        + typed("styled", "style")
        + """, cells AS (SELECT document, o_custkey, field, source_label, raw, style, type, t, amount,
      CASE WHEN type = 'date' THEN iso END AS iso, greatest(confidence * 0.6 + value_confidence * 0.4, 0) AS confidence FROM valued)"""
    )


CANONICAL = canonical(VENDOR_CASES)
#: Every customer a source of its own, so that some sources hold ambiguous dates alone.
BY_CUSTOMER = canonical(
    VENDOR_CASES.replace("pile AS", "whole_pile AS", 1)
    + ", pile AS (SELECT * REPLACE (source_label || '/' || o_custkey AS source_label) FROM whole_pile)"
)
