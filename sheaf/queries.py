"""The registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf import oracle_text as sql
from sheaf.functions import labels, values
from sheaf.operators import cells, cluster, extract, geometry, reconcile, review, rows
from sheaf.plans.piles import line_candidates, order_pile, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def canonical_pile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.canonical(order_pile(spark, sf_dir), order=["o_orderkey"])


def committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.commit_table(canonical_pile(spark, sf_dir), [("date", "invoice_date", "date"), ("total", "total", "money")])


COMMITTED = f"""WITH {sql.CANONICAL},
committed AS (SELECT document, max(try_cast(iso AS DATE)) FILTER (field = 'date') AS invoice_date,
  max(amount) FILTER (field = 'total')::DECIMAL(16,2) AS total, count(*) FILTER (confidence < 0.75)::INT AS _needs_review
  FROM cells GROUP BY document)"""


@query(f"""WITH {sql.CANONICAL},
wide AS (SELECT document, o_custkey, max(try_cast(iso AS DATE)) FILTER (field = 'date') AS d,
  max(amount) FILTER (field = 'total')::DECIMAL(16,2) AS total FROM cells GROUP BY document, o_custkey)
SELECT o_custkey AS customer, sum(total)::DOUBLE AS revenue FROM wide WHERE d >= DATE '1995-01-01' GROUP BY o_custkey""")
def analyst_sales(spark, sf_dir):
    """Revenue by customer since a date, from dates and totals recovered out of each vendor's renderings."""
    pile = canonical_pile(spark, sf_dir)
    wide = cells.commit_table(pile.withColumn("document", F.concat_ws("|", "document", "o_custkey")), [("date", "d", "date"), ("total", "total", "money")])
    late = wide.filter("d >= DATE '1995-01-01'").withColumn("customer", F.element_at(F.split("document", r"\|"), 2).cast("long"))
    return late.groupBy("customer").agg(F.sum("total").cast("double").alias("revenue")).orderBy(F.col("revenue").desc(), "customer")


@query(f"""WITH {sql.VENDOR_CASES}
SELECT shape, count(*) AS n FROM (
  SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(raw), '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g'), 'A{{2,}}', 'A+', 'g'), '9{{2,}}', '9+', 'g') AS shape
  FROM pile) GROUP BY shape""")
def shape_of(spark, sf_dir):
    pile = order_pile(spark, sf_dir)
    return pile.groupBy(values.shape_of(F.col("raw")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {sql.VENDOR_CASES}, {sql.typed('pile')} SELECT source_label, type, count(*) AS n FROM typed GROUP BY source_label, type")
def type_value_hist(spark, sf_dir):
    typed = values.with_value(order_pile(spark, sf_dir), F.col("raw"))
    return typed.groupBy("source_label", F.col("value.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


TEXTS = """texts AS (SELECT c_name AS raw FROM customer UNION ALL SELECT p_name FROM part UNION ALL SELECT p_brand FROM part
  UNION ALL SELECT c_custkey::VARCHAR FROM customer UNION ALL SELECT printf('%.3f', p_retailprice) FROM part
  UNION ALL SELECT '+' || (900000000 + p_partkey)::VARCHAR FROM part UNION ALL SELECT c_name || '@example.com' FROM customer
  UNION ALL SELECT CASE WHEN p_size % 2 = 0 THEN ' Yes ' ELSE 'n' END FROM part)"""


@query(f"WITH {TEXTS}, {sql.typed('texts')} SELECT type, count(*) AS n, count(DISTINCT t) AS distinct_texts, sum(value_confidence) AS confidence FROM valued GROUP BY type")
def type_value_texts(spark, sf_dir):
    """The whole cascade over names, codes, numbers, phones, addresses and booleans."""
    c, p = (table(spark, sf_dir, t) for t in ("customer", "part"))
    parts = (
        c.select("c_name"), p.select("p_name"), p.select("p_brand"), c.select(F.col("c_custkey").cast("string")),
        p.select(F.format_string("%.3f", "p_retailprice")), p.select(F.concat(F.lit("+"), (F.col("p_partkey") + 900000000).cast("string"))),
        c.select(F.concat("c_name", F.lit("@example.com"))), p.select(F.when(F.col("p_size") % 2 == 0, " Yes ").otherwise("n")),
    )
    texts = parts[0].toDF("raw")
    for x in parts[1:]:
        texts = texts.union(x)
    typed = values.with_value(texts, F.col("raw")).withColumn("t", values.js_trim(F.col("raw")))
    return typed.groupBy(F.col("value.type").alias("type")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("distinct_texts"), F.sum("value.confidence").alias("confidence")
    )


@query(f"""WITH {sql.VENDOR_CASES}, {sql.typed('pile')}
SELECT document, amount, currency, CASE WHEN currency IS NOT NULL THEN 0.95 ELSE 0.7 END::DOUBLE AS confidence FROM typed WHERE field = 'total'""")
def parse_money(spark, sf_dir):
    totals = order_pile(spark, sf_dir).filter("field = 'total'")
    parsed = values.with_money(totals.withColumn("t", values.js_trim(F.col("raw"))), F.col("t"), "m")
    return parsed.select("document", "m.*")


@query(f"""WITH {sql.VENDOR_CASES}, {sql.typed('pile')}
SELECT document, iso, date_confidence AS confidence,
  CASE WHEN date_confidence = 0.98 THEN 'iso' WHEN date_confidence = 0.96 THEN 'named' WHEN date_confidence = 0.45 THEN 'unknown' WHEN a > 12 THEN 'dmy' ELSE 'mdy' END AS style,
  date_confidence = 0.45 AS ambiguous FROM typed WHERE field = 'date'""")
def parse_date_loose(spark, sf_dir):
    dates = order_pile(spark, sf_dir).filter("field = 'date'").withColumn("d", values.parse_date(F.col("raw")))
    return dates.select("document", "d.*")


@query(f"""WITH {sql.VENDOR_CASES}, p AS (
{sql.proofs("CASE WHEN source_label IN ('Invoice Date', 'DATE') THEN 'merged' ELSE source_label END AS col").replace("GROUP BY CASE WHEN source_label IN ('Invoice Date', 'DATE') THEN 'merged' ELSE source_label END AS col", "GROUP BY col")})
SELECT col AS column_name, {sql.STYLE} AS style, CASE {sql.STYLE} WHEN 'dmy' THEN dmy WHEN 'mdy' THEN mdy ELSE 0 END AS evidence FROM p""")
def date_style_by_column(spark, sf_dir):
    """Two vendors merged into one column: proofs of both orders leave it open."""
    merged = F.when(F.col("source_label").isin("Invoice Date", "DATE"), "merged").otherwise(F.col("source_label"))
    found = cells.date_styles(order_pile(spark, sf_dir).withColumn("column_name", merged), ["column_name"])
    return found.select("column_name", "style", "evidence")


@query(f"""WITH {sql.VENDOR_CASES}, p AS ({sql.proofs("source_label")})
SELECT source_label, {sql.STYLE} AS style, CASE {sql.STYLE} WHEN 'dmy' THEN dmy WHEN 'mdy' THEN mdy ELSE 0 END AS evidence FROM p""")
def date_style_by_label(spark, sf_dir):
    return cells.date_styles(order_pile(spark, sf_dir), ["source_label"]).select("source_label", "style", "evidence")


@query(f"""WITH {sql.VENDOR_CASES}, {sql.typed('pile')},
counts AS (SELECT source_label, type, count(*) AS n, min(o_orderkey) AS seen FROM typed GROUP BY source_label, type)
SELECT source_label, type FROM (SELECT *, row_number() OVER (PARTITION BY source_label ORDER BY n DESC, seen) AS k FROM counts) WHERE k = 1""")
def type_column_majority(spark, sf_dir):
    return cells.majority_types(order_pile(spark, sf_dir), ["source_label"], ["o_orderkey"])


@query(f"WITH {sql.CANONICAL} SELECT document, field, source_label, style, type, iso, amount, confidence FROM cells")
def canonical_cells(spark, sf_dir):
    v = F.col("value")
    return canonical_pile(spark, sf_dir).select(
        "document", "field", "source_label", "style", v["type"].alias("type"),
        F.when(v["type"] == "date", v["text"]).alias("iso"), F.when(v["type"] == "money", v["number"]).alias("amount"), "confidence",
    )


@query(f"WITH {sql.CANONICAL} SELECT field, count(*) AS n, avg(confidence) AS confidence, min(confidence) AS least FROM cells GROUP BY field")
def confidence_blend(spark, sf_dir):
    found = canonical_pile(spark, sf_dir).groupBy("field")
    return found.agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.min("confidence").alias("least"))


@query(f"WITH {sql.CANONICAL} SELECT document, count(*) FILTER (confidence < 0.75) AS needs_review FROM cells GROUP BY document")
def needs_review_counts(spark, sf_dir):
    return canonical_pile(spark, sf_dir).groupBy("document").agg(F.count_if(cells.needs_review()).alias("needs_review"))


@query(f"WITH {sql.BY_CUSTOMER} SELECT field, count(*) AS ambiguous FROM cells WHERE type = 'date' AND style = 'unknown' AND confidence < 0.5 * 0.6 + 0.5 * 0.4 GROUP BY field")
def unresolved_dates(spark, sf_dir):
    """Every customer writes dates in a way of its own; those without a provable one stay open."""
    pile = order_pile(spark, sf_dir).withColumn("source_label", F.concat_ws("/", "source_label", "o_custkey"))
    return cells.unresolved_dates(cells.canonical(pile, order=["o_orderkey"]))


@query(COMMITTED + " SELECT document, invoice_date::VARCHAR AS invoice_date, total::DOUBLE AS total, _needs_review FROM committed")
def commit_pivot(spark, sf_dir):
    made = committed(spark, sf_dir)
    return made.select("document", F.col("invoice_date").cast("string").alias("invoice_date"), F.col("total").cast("double").alias("total"), "_needs_review")


@query("""WITH t AS (SELECT c_custkey::VARCHAR AS document, c_name, c_acctbal, c_mktsegment FROM customer)
SELECT document, c_name, c_acctbal, c_mktsegment FROM t WHERE document ILIKE '%12%' OR c_name ILIKE '%12%' OR c_mktsegment ILIKE '%12%'
  OR (CASE WHEN c_acctbal = floor(c_acctbal) THEN c_acctbal::BIGINT::VARCHAR ELSE c_acctbal::VARCHAR END) ILIKE '%12%'""")
def rows_search(spark, sf_dir):
    """Any column's text holds the query."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("document"), "c_name", "c_acctbal", "c_mktsegment")
    return rows.search(c, "12")


@query("""WITH t AS (SELECT c_custkey::VARCHAR AS document, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS balance FROM customer)
SELECT document, balance, row_number() OVER (ORDER BY balance DESC NULLS LAST, document) AS place FROM t""")
def rows_sort_nulls_last(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("document"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("balance")
    )
    return rows.placed(c, [rows.order_of(c, "balance", "desc"), F.col("document").asc()])


@query("SELECT o_orderkey::VARCHAR AS document, o_totalprice FROM orders ORDER BY document LIMIT 500")
def rows_topk(spark, sf_dir):
    """A sort column that the table lacks falls back to the document; the limit is capped at 500."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("document"), "o_totalprice")
    return rows.rows(o, sort="no_such_column", limit=9999)


@query(f"WITH {sql.CANONICAL} SELECT document, field, raw, confidence FROM cells WHERE confidence < 0.75 AND field = 'date'")
def review_queue(spark, sf_dir):
    fields = spark.createDataFrame([("date", 0, True), ("total", 1, False)], "field string, position int, included boolean")
    return review.queue(canonical_pile(spark, sf_dir), fields).select("document", "field", "raw", "confidence")


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'P' THEN 'corrected' ELSE 'unreviewed' END"


@query(f"""WITH c AS (SELECT o_orderpriority, {STATUS} AS status, o_totalprice / 200000 AS confidence FROM orders)
SELECT o_orderpriority, count(*) AS total, count(*) FILTER (status = 'unreviewed' AND confidence < 0.75) AS needs_review,
  count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'corrected') AS corrected, 0::BIGINT AS empty FROM c GROUP BY o_orderpriority""")
def review_summary(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "P", "corrected").otherwise("unreviewed")
    o = table(spark, sf_dir, "orders").select("o_orderpriority", status.alias("status"), (F.col("o_totalprice") / 200000).alias("confidence"))
    return review.summary(o, ("o_orderpriority",))


@query("""SELECT n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS documents,
  (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS fields FROM nation""")
def project_overview(spark, sf_dir):
    """Correlated counts as aggregates before the join; kinds without members keep a zero."""
    counts = lambda t, key, name: table(spark, sf_dir, t).groupBy(F.col(key).alias("n_nationkey")).agg(F.count(F.lit(1)).alias(name))
    n = table(spark, sf_dir, "nation").join(counts("customer", "c_nationkey", "documents"), "n_nationkey", "left")
    n = n.join(counts("supplier", "s_nationkey", "fields"), "n_nationkey", "left").na.fill(0, ["documents", "fields"])
    return n.select(F.col("n_name").alias("name"), "documents", "fields").orderBy(F.col("documents").desc(), "name")


FLAGS = "(VALUES ('A'), ('N'), ('R')) f(field)"


@query(f"""SELECT DISTINCT o_orderkey::VARCHAR AS doc_id, field FROM orders, {FLAGS}
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = field)""")
def empty_cells(spark, sf_dir):
    """Fields that a document's kind expects and the document doesn't supply."""
    docs = table(spark, sf_dir, "orders").select(F.lit(0).alias("kind"), F.col("o_orderkey").cast("string").alias("doc_id"))
    fields = spark.createDataFrame([(0, x) for x in "ANR"], "kind int, field string")
    filled = line_candidates(spark, sf_dir).select("doc_id", F.col("type").alias("field")).distinct()
    return cells.empty_cells(docs, F.broadcast(fields), filled).select("doc_id", "field")


@query("""SELECT doc_id, field, value, ord FROM (SELECT l_orderkey::VARCHAR AS doc_id, l_returnflag AS field, l_quantity::INT::VARCHAR AS value, l_linenumber AS ord,
  row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS k FROM lineitem) WHERE k = 1""")
def first_candidate(spark, sf_dir):
    known = spark.createDataFrame([(0, f"{f} {s}", f) for f in "ANR" for s in "FO"], "kind int, label string, field string")
    return cells.first_candidates(line_candidates(spark, sf_dir), F.broadcast(known)).select("doc_id", "field", "value", "ord")


LINES = """lines AS (SELECT l_orderkey::VARCHAR AS doc_id, l_linenumber AS ord, l_returnflag || ' ' || l_linestatus AS label, l_returnflag AS type,
  l_quantity AS x, l_extendedprice / 100 AS y FROM lineitem)"""


@query(f"WITH {LINES} SELECT label, count(DISTINCT doc_id) AS documents FROM lines GROUP BY label")
def label_df(spark, sf_dir):
    return extract.label_frequency(line_candidates(spark, sf_dir))


@query(f"""WITH {LINES}, n AS (SELECT count(DISTINCT doc_id) AS docs FROM lines)
SELECT label FROM lines GROUP BY label HAVING count(DISTINCT doc_id) >= (SELECT least(3, greatest(1, docs)) FROM n)""")
def recurring_labels(spark, sf_dir):
    c = line_candidates(spark, sf_dir)
    return extract.recurring_labels(c, c.select("doc_id").distinct().count())


@query(f"WITH {LINES} SELECT doc_id, ord, label, row_number() OVER (PARTITION BY doc_id, type ORDER BY y, x, ord) - 1 AS rank FROM lines")
def label_rank(spark, sf_dir):
    return reconcile.ranked(line_candidates(spark, sf_dir)).select("doc_id", "ord", "label", "rank")


@query(f"""WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY y, x, ord) - 1 AS rank FROM lines)
SELECT label, count(*) AS occurrences, max(type) AS type, round(avg(rank), 6) AS rank, round(avg(x / 595), 6) AS px, round(avg(y / 842), 6) AS py FROM r GROUP BY label""")
def label_stats(spark, sf_dir):
    s = reconcile.label_stats(line_candidates(spark, sf_dir))
    return s.select("label", "occurrences", "type", *[F.round(c, 6).alias(c) for c in ("rank", "px", "py")])


@query(f"WITH {LINES} SELECT DISTINCT p.label AS a, q.label AS b FROM lines p JOIN lines q USING (doc_id) WHERE p.label < q.label")
def label_cooccurrence(spark, sf_dir):
    return reconcile.cooccurrence(line_candidates(spark, sf_dir)).select("a", "b")


ABBREVIATE = "CASE w WHEN 'no' THEN 'number' WHEN 'num' THEN 'number' WHEN 'nbr' THEN 'number' WHEN '#' THEN 'number' WHEN 'inv' THEN 'invoice' WHEN 'ref' THEN 'reference' WHEN 'qty' THEN 'quantity' WHEN 'amt' THEN 'amount' WHEN 'desc' THEN 'description' WHEN 'dt' THEN 'date' WHEN 'acct' THEN 'account' WHEN 'ac' THEN 'account' ELSE w END"
STOP = "('the','of','a','to','for','and','on','by','in','at')"
TOKENS_SQL = (
    r"list_filter(list_transform(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\([^)]*\)', ' ', 'g'),"
    r" '@?\s*\d+(\.\d+)?\s*%', ' ', 'g'), '[^a-z0-9#]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: " + ABBREVIATE + "), lambda w: w NOT IN " + STOP + ")"
)


@query(f"""WITH p AS (SELECT DISTINCT p_type AS label FROM part UNION SELECT DISTINCT p_brand || ' No. (' || p_size || '%)' FROM part),
t AS (SELECT label, list_distinct({TOKENS_SQL.format('label')}) AS w FROM p),
j AS (SELECT x.label AS a, y.label AS b, len(x.w) AS n, len(y.w) AS m, len(list_intersect(x.w, y.w)) AS s FROM t x JOIN t y ON x.label < y.label)
SELECT a, b, least(1, s / (n + m - s) + CASE WHEN s = least(n, m) THEN 0.25 ELSE 0 END)::DOUBLE AS similarity FROM j WHERE s > 0""")
def label_similarity(spark, sf_dir):
    """All pairs with a word in common among the part types' and brands' names; any other pair's similarity is 0."""
    p = table(spark, sf_dir, "part")
    second = p.select(F.concat("p_brand", F.lit(" No. ("), F.col("p_size").cast("string"), F.lit("%)")).alias("label"))
    names = p.select(F.col("p_type").alias("label")).union(second).distinct()
    return labels.similar_pairs(names)


@query(f"""WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY y, x, ord) - 1 AS rank FROM lines),
met AS (SELECT DISTINCT p.label AS a, q.label AS b FROM lines p JOIN lines q USING (doc_id) WHERE p.label < q.label),
s AS (SELECT DISTINCT label, type FROM lines)
SELECT least(p.label, q.label) AS p, greatest(p.label, q.label) AS q, EXISTS (SELECT 1 FROM met WHERE a = p.label AND b = q.label) AS blocked
FROM s p JOIN s q ON p.label < q.label""")
def label_pairs_blocked(spark, sf_dir):
    c = line_candidates(spark, sf_dir)
    pairs = reconcile.pair_scores(reconcile.label_stats(c), reconcile.cooccurrence(c))
    return pairs.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), "blocked")


@query("""WITH n AS (SELECT c_nationkey AS k, (round(count(*) / 100.0) + 1)::INT AS fields, count(*) FILTER (c_mktsegment = 'BUILDING') AS t1,
  count(*) FILTER (c_mktsegment = 'MACHINERY') AS t2, (c_nationkey % 3)::INT AS cols, (c_nationkey % 4)::INT AS scale FROM customer GROUP BY c_nationkey)
SELECT a.k AS a, b.k AS b, round((2 * (a.k % 2 = b.k % 2)::INT
  + 2 * CASE WHEN a.cols = b.cols THEN 1 WHEN a.cols = 0 OR b.cols = 0 THEN 0 ELSE 0.4 END
  + 1.5 * greatest(0, 1 - abs(a.scale - b.scale) / 3)
  + CASE WHEN a.fields = b.fields THEN 1 ELSE 1 - abs(a.fields - b.fields) / greatest(1, a.fields + b.fields) END
  + 3 * CASE WHEN a.t1 + a.t2 = 0 AND b.t1 + b.t2 = 0 THEN 1 WHEN a.t1 + a.t2 = 0 OR b.t1 + b.t2 = 0 THEN 0
        ELSE (a.t1 * b.t1 + a.t2 * b.t2) / sqrt((a.t1 * a.t1 + a.t2 * a.t2)::DOUBLE * (b.t1 * b.t1 + b.t2 * b.t2)) END
  + 1) / 10.5, 9) AS similarity FROM n a JOIN n b ON a.k < 5 AND a.k <> b.k""")
def signature_similarity(spark, sf_dir):
    """Nation profiles read as document signatures, each against five that lead."""
    segment = lambda s: F.count_if(F.col("c_mktsegment") == s)
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(
        (F.round(F.count(F.lit(1)) / 100.0) + 1).cast("int").alias("fields"), F.array(segment("BUILDING"), segment("MACHINERY")).alias("types")
    )
    signed = n.select("k", F.struct(
        (F.col("k") % 2).cast("string").alias("shape"), (F.col("k") % 3).alias("table_columns"), (F.col("k") % 4).alias("row_scale"),
        F.col("fields").alias("field_count"), "types", F.lit(0).alias("narrative_lines"),
    ).alias("s"))
    first = [(r["k"], r["k"], cluster.plain(r["s"])) for r in signed.filter("k < 5").orderBy("k").collect()]
    met = cluster.with_leaders(signed, first, "s", "int").filter("since <> k")
    return met.select(F.col("since").alias("a"), F.col("k").alias("b"), F.round(cluster.similarity(F.col("leading"), F.col("s")), 9).alias("similarity"))


@query("""SELECT c_custkey::VARCHAR AS cell_id, c_name AS document, c_mktsegment || ' (pending)' AS before, c_mktsegment AS after
FROM customer WHERE c_custkey <> 7 AND c_custkey % 2 = 1""")
def strip_suffix_preview(spark, sf_dir):
    """The rule learned from one edit, shown over its siblings."""
    raw = F.when(F.col("c_custkey") % 2 == 1, F.concat("c_mktsegment", F.lit(" (pending)"))).otherwise(F.col("c_mktsegment"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("cell_id"), F.col("c_name").alias("document"), raw.alias("raw"))
    return review.preview(review.classify("BUILDING (pending)", "BUILDING"), c, "7")


@query(rf"""WITH {sql.VENDOR_CASES}, d AS (SELECT document, raw, regexp_extract(raw, '^{sql.SLASH}$', 1)::INT AS a, regexp_extract(raw, '^{sql.SLASH}$', 2)::INT AS b, regexp_extract(raw, '^{sql.SLASH}$', 3)::INT AS y
  FROM pile WHERE field = 'date' AND regexp_full_match(raw, '{sql.SLASH}'))
SELECT document AS cell_id, document, raw AS before, printf('%d-%02d-%02d', y, a, b) AS after FROM d WHERE a <= 12 AND b <= 12""")
def date_convention_preview(spark, sf_dir):
    """Only dates that were ambiguous are read anew."""
    dates = order_pile(spark, sf_dir).filter("field = 'date'").withColumn("cell_id", F.col("document"))
    return review.preview(review.classify("04/05/2026", "2026-04-05"), dates)


@query(f"""WITH base AS (SELECT o_orderkey::VARCHAR AS cell_id, {STATUS} AS status, o_totalprice / 1000000 AS confidence FROM orders)
SELECT cell_id, CASE WHEN status = 'unreviewed' THEN 'corrected' ELSE status END AS status,
  CASE WHEN status = 'unreviewed' THEN 0.95 ELSE confidence END AS confidence, CASE WHEN status = 'unreviewed' THEN 'X' || cell_id END AS corrected_to FROM base""")
def correction_apply_guard(spark, sf_dir):
    """An approved batch changes only what nobody has reviewed; then the log is laid over the base."""
    status = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "P", "corrected").otherwise("unreviewed")
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("cell_id"), status.alias("status"), (F.col("o_totalprice") / 1000000).alias("confidence"))
    approved = base.select("cell_id", F.concat(F.lit("X"), "cell_id").alias("after"))
    events = review.apply_batch(base, approved, 1)
    return review.current_cells(base, events)


@query("""SELECT o_orderkey::VARCHAR AS field, CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS name, 'text' AS type, o_custkey % 3 <> 0 AS included FROM orders""")
def field_patch(spark, sf_dir):
    """The last non-null change of each attribute wins."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string").alias("field")
    fields = o.select(key, F.col("o_orderstatus").alias("name"), F.lit("text").alias("type"), F.lit(True).alias("included"))
    first = o.select(key, F.lit(1).alias("seq"), F.lit("older").alias("name"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("boolean").alias("included")).filter("false")
    even = o.filter("o_custkey % 2 = 0")
    older = even.select(key, F.lit(1).alias("seq"), F.lit("older").alias("name"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("boolean").alias("included"))
    newer = even.select(key, F.lit(2).alias("seq"), F.col("o_orderpriority").alias("name"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("boolean").alias("included"))
    out = o.filter("o_custkey % 3 = 0").select(key, F.lit(3).alias("seq"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("type"), F.lit(False).alias("included"))
    return review.patch_fields(fields, first.union(older).union(newer).union(out))


@query("""SELECT l_orderkey::VARCHAR AS doc_id, 0 AS page, list_sort(list(l_quantity))[(floor(count(*) / 2) + 1)::INT] AS median FROM lineitem GROUP BY l_orderkey""")
def median_size(spark, sf_dir):
    words = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(0).alias("page"), F.col("l_quantity").alias("size"))
    return extract.median_size(words)


@query("""WITH w AS (SELECT user_id, event_id, epoch(ts) AS x, value AS w FROM events),
g AS (SELECT *, x - lag(x + w) OVER (PARTITION BY user_id ORDER BY x, event_id) AS gap FROM w)
SELECT user_id, event_id, sum(CASE WHEN gap <= 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY x, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM g""")
def words_gaps_islands(spark, sf_dir):
    """Runs of neighbours with small gaps, over events per user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), F.col("value").alias("w"))
    e = e.withColumn("x", F.col("us") / 1e6)
    order = [F.col("x"), F.col("event_id")]
    starts = F.col("x") - geometry.previous_right(["user_id"], order) > 3600
    return geometry.gap_islands(e, ["user_id"], order, starts).select("user_id", "event_id", F.col("island").cast("long").alias("island"))


@query("""WITH t AS (SELECT p_size AS kind, p_brand AS said, p_partkey AS id FROM part),
v AS (SELECT kind, lower(said) AS k, count(*) AS n, arg_min(said, id) AS title, min(id) AS first FROM t GROUP BY kind, lower(said))
SELECT kind, title, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, first) AS r FROM v) WHERE r = 1""")
def kind_name_vote(spark, sf_dir):
    said = table(spark, sf_dir, "part").select(F.col("p_size").alias("kind"), F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("said"))
    return reconcile.kind_said(said)


@query(r"""SELECT DISTINCT name, CASE WHEN s = '' THEN 'field' ELSE s END AS column_name, 'extract_' || regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS table_name FROM (
  SELECT name, left(regexp_replace(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '^(\d)', 'f_\1'), 55) AS s
  FROM (SELECT p_name || ' (' || p_size || ')' AS name FROM part UNION SELECT p_size || '. ' || p_type FROM part UNION SELECT '**')) """)
def column_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    names = p.select(F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")")).alias("name"))
    names = names.union(p.select(F.concat(F.col("p_size").cast("string"), F.lit(". "), "p_type"))).union(spark.createDataFrame([("**",)], "name string"))
    return names.distinct().select("name", labels.column_name(F.col("name")).alias("column_name"), labels.table_name(F.col("name")).alias("table_name"))


@query(r"""WITH w AS (SELECT DISTINCT p_type AS said FROM part UNION SELECT DISTINCT c_mktsegment FROM customer UNION SELECT r_name FROM region UNION SELECT n_name FROM nation),
t AS (SELECT said, array_to_string(list_transform(regexp_split_to_array(said, '\s+'), lambda x: CASE WHEN x = upper(x) THEN left(x, 1) || lower(substr(x, 2)) ELSE x END), ' ') AS c FROM w)
SELECT said, CASE WHEN regexp_matches(c, '(?i)s$') THEN c WHEN regexp_matches(c, '(?i)(ch|sh|x|z)$') THEN c || 'es'
  WHEN regexp_matches(c, '(?i)[^aeiou]y$') THEN left(c, length(c) - 1) || 'ies' ELSE c || 's' END AS kind FROM t""")
def kind_titles(spark, sf_dir):
    one = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("said"))
    said = one("part", "p_type").union(one("customer", "c_mktsegment")).union(one("region", "r_name")).union(one("nation", "n_name")).distinct()
    return said.select("said", labels.pluralise(labels.title_case(F.col("said"))).alias("kind"))


@query("""SELECT 'Receipt' AS label, printf('R%07d', o_orderkey) AS value, count(*) AS n FROM orders GROUP BY 2""")
def split_fused(spark, sf_dir):
    """Label and value set in one run of text."""
    o = table(spark, sf_dir, "orders").select(F.format_string("Receipt R%07d", "o_orderkey").alias("text"))
    cut = o.join(extract.split_fused_texts(o, "text"), "text")
    return cut.groupBy("label", "value").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT doc_id, coalesce(length(trim(text)), 0) AS chars FROM documents)
SELECT doc_id::VARCHAR AS doc_id, 0 AS page, chars, chars < greatest(12, 595.0 * 842 / 40000) AS needs_ocr FROM d""")
def needs_ocr(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("page"), "text")
    pages = d.select("doc_id", "page", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))
    return geometry.needs_ocr(d, pages)


@query("""WITH v AS (SELECT l_orderkey AS k, (l_linenumber % 4 * 90)::INT AS quadrant, sum(length(l_shipdate::DATE::VARCHAR)) AS weight, min(l_linenumber) AS seen FROM lineitem GROUP BY 1, 2)
SELECT k::VARCHAR AS doc_id, 0 AS page, CASE WHEN quadrant IN (90, 270) THEN quadrant ELSE 0 END AS correction
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY weight DESC, seen) AS r FROM v) WHERE r = 1""")
def text_rotation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(0).alias("page"), F.col("l_linenumber").alias("ord"),
        F.col("l_shipdate").cast("date").cast("string").alias("text"), (F.col("l_linenumber") % 4 * 90 + 3.0).alias("angle"),
    )
    return geometry.text_rotation(li)


@query(rf"""WITH {sql.VENDOR_CASES}, s AS (SELECT DISTINCT source_label AS raw FROM pile UNION SELECT DISTINCT raw FROM pile UNION SELECT p_name || ':' FROM part UNION SELECT p_name FROM part),
{sql.typed('s')}
SELECT raw AS text, t <> '' AND (regexp_matches(t, '[:：]$') OR (len(regexp_split_to_array(t, '\s+')) <= 5 AND type = 'text' AND regexp_matches(t, '[A-Za-z]'))) AS is_label FROM typed""")
def looks_like_label(spark, sf_dir):
    pile, p = order_pile(spark, sf_dir), table(spark, sf_dir, "part")
    texts = pile.select("source_label").union(pile.select("raw")).union(p.select(F.concat("p_name", F.lit(":")))).union(p.select("p_name")).distinct().toDF("text")
    return extract.with_is_label(texts, "text").select("text", "is_label")


@query(f"""WITH {sql.CANONICAL}, found AS (SELECT document, amount FROM cells WHERE field = 'total' AND document::BIGINT % 5 <> 0)
SELECT 'total' AS field, count(*) AS checked, count(*) FILTER (round(amount, 2) = round(o_totalprice, 2)) AS correct, count(*) FILTER (amount IS NULL) AS missing
FROM orders LEFT JOIN found ON document = o_orderkey::VARCHAR""")
def accuracy(spark, sf_dir):
    """Recovered totals against the recorded ones, a fifth of them not recovered; amounts in parentheses read as negative and are wrong."""
    truth = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("document"), F.lit("total").alias("field"), F.col("o_totalprice").cast("decimal(16,2)").cast("string").alias("text"))
    return cells.accuracy(canonical_pile(spark, sf_dir).filter("field = 'total' and o_orderkey % 5 <> 0"), truth)


MADE = """made AS (SELECT o_orderkey::VARCHAR AS doc_id, v.* FROM orders, LATERAL (
  SELECT 0 AS ord, CASE o_orderpriority WHEN '1-URGENT' THEN 'Order Date' WHEN '2-HIGH' THEN 'DATE' ELSE 'Dt. of order' END AS label, 'date' AS type, 50 + o_orderkey % 40 AS x, 100.0 AS y
  UNION ALL SELECT 1, CASE o_orderpriority WHEN '1-URGENT' THEN 'Total Amt' WHEN '2-HIGH' THEN 'Amount' ELSE 'Balance' END, 'money', 400.0, 700.0 + o_orderkey % 9
  UNION ALL SELECT 2, CASE o_orderpriority WHEN '1-URGENT' THEN 'Customer No.' WHEN '2-HIGH' THEN 'Acct' ELSE 'Client' END, 'identifier', 60.0, 140.0
  UNION ALL SELECT 3, 'Ref', 'identifier', 60.0, CASE WHEN o_orderkey % 2 = 0 THEN 120.0 ELSE 160.0 END) v)"""


def made_candidates(spark, sf_dir):
    """Four candidates for each order, whose labels depend on its priority."""
    by = lambda *names: F.when(F.col("o_orderpriority") == "1-URGENT", names[0]).when(F.col("o_orderpriority") == "2-HIGH", names[1]).otherwise(names[2])
    put = lambda n, label, kind, value, x, y: F.struct(
        F.lit(n).alias("ord"), label.alias("label"), F.lit(kind).alias("type"), value.alias("value"), x.cast("double").alias("x"), y.cast("double").alias("y")
    )
    key, code = F.col("o_orderkey"), F.format_string("C-%06d", "o_custkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    rows = F.array(
        put(0, by("Order Date", "DATE", "Dt. of order"), "date", F.lit("1995-01-01"), 50 + key % 40, F.lit(100)),
        put(1, by("Total Amt", "Amount", "Balance"), "money", F.lit("$1.00"), F.lit(400), 700 + key % 9),
        put(2, by("Customer No.", "Acct", "Client"), "identifier", code, F.lit(60), F.lit(140)),
        put(3, F.lit("Ref"), "identifier", F.format_string("R%07d", "o_orderkey"), F.lit(60), F.when(key % 2 == 0, 120).otherwise(160)),
    )
    exploded = o.select(F.lit(0).alias("kind"), key.cast("string").alias("doc_id"), F.explode(rows).alias("c"))
    return exploded.select("kind", "doc_id", "c.*", F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"))


@query(f"""WITH {MADE}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY y, x, ord) - 1 AS rank FROM made),
s AS (SELECT label, max(type) AS type, avg(rank) AS rank, avg(x / 595) AS px, avg(y / 842) AS py, list_distinct({TOKENS_SQL.format('label')}) AS w,
  CASE WHEN label = 'Ref' THEN 'A9+' ELSE 'A-9+' END AS shape FROM r GROUP BY label),
met AS (SELECT DISTINCT p.label AS a, q.label AS b FROM made p JOIN made q USING (doc_id) WHERE p.label < q.label),
j AS (SELECT p.label AS p, q.label AS q, EXISTS (SELECT 1 FROM met WHERE a = p.label AND b = q.label) AS blocked, p.type = q.type AS same,
  least(p.type, q.type) || greatest(p.type, q.type) IN ('identifiertext', 'moneynumber') OR p.type = q.type AS compatible,
  len(list_intersect(p.w, q.w)) AS n, len(p.w) AS np, len(q.w) AS nq,
  p.type = q.type AND p.type IN ('identifier', 'text') AND p.shape = q.shape AS shaped, p.type = q.type AND p.type NOT IN ('identifier', 'text') AS alike,
  abs(p.rank - q.rank) AS gap, greatest(0, 1 - (abs(p.px - q.px) * 1.6 + abs(p.py - q.py)) / 0.5) AS place FROM s p JOIN s q ON p.label < q.label),
k AS (SELECT *, CASE WHEN np = 0 OR nq = 0 THEN 0 ELSE least(1, n / (np + nq - n) + CASE WHEN n = least(np, nq) THEN 0.25 ELSE 0 END) END AS name FROM j),
m AS (SELECT *, (name > 0.15)::INT + (shaped OR alike)::INT + (gap < 0.75)::INT + (place > 0.3)::INT AS signals FROM k)
SELECT p, q, blocked, round(CASE WHEN blocked OR NOT compatible OR signals < 2 THEN 0 ELSE least(1, CASE WHEN name > 0.15 THEN name * 0.45 ELSE 0 END
  + CASE WHEN shaped THEN 0.18 WHEN alike THEN 0.12 ELSE 0 END + CASE WHEN same THEN 0.12 ELSE 0 END
  + CASE WHEN gap < 0.25 THEN 0.3 WHEN gap < 0.75 THEN 0.18 ELSE 0 END + CASE WHEN place > 0.3 THEN place * 0.15 ELSE 0 END) END::DOUBLE, 6) AS score,
  CASE WHEN blocked OR NOT compatible OR signals < 2 THEN 1 ELSE (name > 0.15)::INT + (shaped OR alike)::INT + (gap < 0.75)::INT + (place > 0.3)::INT END::INT AS reasons FROM m""")
def label_pairs_scored(spark, sf_dir):
    """Merge score, veto and number of reasons of every two labels."""
    c = made_candidates(spark, sf_dir)
    pairs = reconcile.pair_scores(reconcile.label_stats(c), reconcile.cooccurrence(c))
    return pairs.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), "blocked", F.round("score", 6).alias("score"), F.size("reasons").alias("reasons"))


@query(f"""WITH {MADE}, n AS (SELECT label, count(*) AS occurrences FROM made GROUP BY label), d AS (SELECT count(*) AS docs FROM orders)
SELECT label, least(1, occurrences / greatest(1, docs))::DOUBLE AS coverage FROM n, d""")
def label_coverage(spark, sf_dir):
    """Coverage of every label as a field of its own."""
    c = made_candidates(spark, sf_dir)
    stats = reconcile.label_stats(c)
    alone = stats.select("kind", "label", F.col("label").alias("root"))
    none = reconcile.pair_scores(stats, reconcile.cooccurrence(c)).filter("false")
    documents = c.groupBy("kind").agg(F.countDistinct("doc_id").alias("documents"))
    return reconcile.fields_of(stats, alone, none, documents).select(F.col("name").alias("label"), "coverage")


def _ends(spark, sf_dir, raw):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("cell_id"), F.col("c_name").alias("document"), raw.alias("raw"))


@query("""SELECT c_custkey::VARCHAR AS cell_id, c_name AS document, 'Segment: ' || c_mktsegment AS before, c_mktsegment AS after FROM customer WHERE c_custkey % 2 = 1""")
def strip_prefix_preview(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit("Segment: "), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return review.preview(review.classify("Segment: BUILDING", "BUILDING"), _ends(spark, sf_dir, raw))


@query("""SELECT c_custkey::VARCHAR AS cell_id, c_name AS document, '[[' || c_mktsegment || ']]' AS before, c_mktsegment AS after FROM customer WHERE c_custkey % 3 = 0""")
def strip_both_preview(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("[["), "c_mktsegment", F.lit("]]"))).otherwise(F.concat(F.lit("[["), "c_mktsegment"))
    return review.preview(review.classify("[[BUILDING]]", "BUILDING"), _ends(spark, sf_dir, raw))


@query("""SELECT o_orderkey::VARCHAR AS cell_id, CASE WHEN o_orderkey % 2 = 0 THEN 'confirmed' ELSE 'corrected' END AS status,
  CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus || '!' END AS corrected_to, 1.0::DOUBLE AS confidence FROM orders""")
def review_events(spark, sf_dir):
    """Confirmations and corrections as they are appended to the log."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("cell"), "o_orderkey", F.concat(F.lit(" "), "o_orderstatus", F.lit("! ")).alias("said"))
    seq = F.col("o_orderkey")
    confirmed = o.filter("o_orderkey % 2 = 0").select(*review.confirm("cell", seq))
    corrected = o.filter("o_orderkey % 2 = 1").select(*review.correct("cell", F.col("said"), seq))
    return confirmed.unionByName(corrected).select("cell_id", "status", "corrected_to", "confidence")


@query(COMMITTED + " SELECT document, total::DOUBLE AS total FROM committed WHERE _needs_review = 0")
def rows_reviewed(spark, sf_dir):
    return rows.reviewed(committed(spark, sf_dir)).select("document", F.col("total").cast("double").alias("total"))


@query("""WITH d AS (SELECT doc_id, coalesce(length(trim(text)), 0) AS chars FROM documents)
SELECT doc_id::VARCHAR AS doc_id, 2::BIGINT AS page_count, sum(chars)::BIGINT AS char_count, bool_or(chars < 12.524475) OR true AS needs_ocr FROM d GROUP BY doc_id""")
def document_totals(spark, sf_dir):
    """Every document as two pages, the second blank."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("page"), "text")
    page = lambda n: d.select("doc_id", F.lit(n).alias("page"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))
    return geometry.document_totals(d, page(0).union(page(1)))


@query("""SELECT c_nationkey AS kind, count(*) AS total, count(*) FILTER (c_acctbal < 0) AS needs_review FROM customer
WHERE c_mktsegment <> 'MACHINERY' GROUP BY c_nationkey""")
def review_summary_of_fields(spark, sf_dir):
    """The summary over the cells of included fields alone."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("kind"), F.col("c_mktsegment").alias("field"), F.lit("unreviewed").alias("status"), F.when(F.col("c_acctbal") < 0, 0.5).otherwise(0.9).alias("confidence")
    )
    fields = c.select("field").distinct().withColumn("included", F.col("field") != "MACHINERY")
    return review.summary_of_fields(c, fields, ("kind",)).select("kind", "total", "needs_review")


def truth_sql(rows: list[tuple]) -> str:
    quoted = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


def pile_truth_sql() -> str:
    """The recorded truth of the generated invoices as a VALUES list: what the found values must be."""
    from sheaf.sources import corpus

    rows = [(s.name, f, t) for s in corpus.generate() if s.kind == "invoice" for f, t in s.truth.items()]
    return f"SELECT document, field, text FROM (VALUES {truth_sql(rows)}) t(document, field, text)"


#: The name that a discovered field of the invoices goes by, and what the truth calls it.
PILE_FIELDS = (
    ("Invoice No.", "invoice_number"), ("Invoice Date", "invoice_date"), ("Bill To", "customer"), (None, "tax"),
    ("Subtotal", "subtotal"), ("Total Due", "total"),
)


def _pile(spark):
    from sheaf.plans.ingest import discover
    from sheaf.sources import corpus

    tokens, pages, _ = corpus.pile(spark)
    return discover(tokens, pages)


@query("""SELECT * FROM (VALUES ('Account Statements', 2, 2), ('Invoices', 31, 7), ('Receipts', 5, 2), ('Unstructured documents', 2, 0)) t(kind, documents, fields)""")
def pile_kinds(spark, sf_dir):
    """The kinds that are found in the generated pile, with their documents and fields."""
    found = _pile(spark)
    documents = found.documents.groupBy("kind").agg(F.countDistinct("doc_id").cast("int").alias("documents"))
    fields = found.fields.groupBy("kind").agg(F.count(F.lit(1)).cast("int").alias("fields"))
    named = found.kinds.join(documents, "kind").join(fields, "kind", "left").na.fill(0, ["fields"])
    return named.select(F.col("name").alias("kind"), "documents", "fields")


@query("""SELECT * FROM (VALUES
  ('DATE|Date of Issue|Invoice Date|Issued|Raised on', 1.0), ('INVOICE NUMBER|Inv. Number|Invoice|Invoice No.|Reference', 1.0),
  ('Account|Bill To|CLIENT|Customer|Sold To', 1.0), ('Subtotal', 1.0), ('GST (18%)|SALES TAX|Tax|VAT|VAT @ 20%', 1.0),
  ('Amount Payable|Balance Due|Grand Total|TOTAL|Total Due', 1.0), ('Due Date|Payment Due|Settle by', 0.612903)) t(labels, coverage)""".replace("SELECT * FROM", "SELECT labels, coverage::DOUBLE AS coverage FROM"))
def pile_fields(spark, sf_dir):
    """The fields of the generated invoices: which labels are one field, and in how many documents it stands."""
    found = _pile(spark)
    invoices = found.kinds.filter("name = 'Invoices'").select("kind")
    named = found.fields.join(invoices, "kind")
    labels = F.array_join(F.array_sort(F.concat(F.array("name"), "aliases")), "|")
    return named.select(labels.alias("labels"), F.round("coverage", 6).alias("coverage"))


@query(pile_truth_sql())
def pile_cells(spark, sf_dir):
    """The values found in the generated invoices, as texts that compare with the recorded truth."""
    found = _pile(spark)
    known = spark.createDataFrame([p for p in PILE_FIELDS if p[0]], "name string, truth string")
    fields = found.fields.join(known, "name", "left").withColumn("truth", F.coalesce("truth", F.when(F.array_contains(F.concat(F.array("name"), "aliases"), "VAT"), "tax")))
    cells = found.cells.join(fields.filter("truth is not null").select("field", "truth", "kind"), ["field", "kind"])
    cells = cells.join(found.kinds.filter("name = 'Invoices'").select("kind"), "kind")
    return cells.select(F.col("doc_id").alias("document"), F.col("truth").alias("field"), values.accuracy_text(F.col("value.text")).alias("text"))
