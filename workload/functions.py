"""Column functions over the dirty table and the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import dates, numbers, text
from millrace.operators import steps

from .base import bare, day_text, dirty, null_like, num, query, table, with_dirty


@query("norm_trim", with_dirty("SELECT row_id AS _row_id, trim(price) AS price, trim(status) AS status FROM dirty"))
def norm_trim(spark, sf):
    return dirty(spark, sf).select("_row_id", text.trimmed(F.col("price")).alias("price"), text.trimmed(F.col("status")).alias("status"))


@query(
    "norm_trim_texts",
    r"SELECT doc_id, regexp_replace(text, '^[\s]+|[\s]+$', '', 'g') AS text FROM documents",
)
def norm_trim_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.trimmed(F.col("text")).alias("text"))


_TITLE = (
    "array_to_string(list_transform(regexp_extract_all({x}, '([A-Za-z]+|[^A-Za-z]+)'),"
    " lambda t: upper(t[1:1]) || lower(t[2:])), '')"
)


@query(
    "norm_case",
    f"SELECT p_partkey, lower(p_type) AS low, {_TITLE.replace('{x}', 'p_label')} AS title FROM"
    " (SELECT *, replace(p_name, ' ', '-') || ' o''clock ' || p_brand AS p_label FROM part)",
)
def norm_case(spark, sf):
    label = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(" o'clock "), "p_brand")
    return table(spark, sf, "part").select("p_partkey", F.lower("p_type").alias("low"), text.title_case(label).alias("title"))


@query(
    "norm_currency",
    with_dirty(f"SELECT row_id AS _row_id, CASE WHEN regexp_matches(price, '[£$€¥₹]') THEN {num(bare('price'))} END AS amount FROM dirty"),
)
def norm_currency(spark, sf):
    return dirty(spark, sf).select("_row_id", numbers.parse_currency(F.col("price")).alias("amount"))


@query(
    "norm_numeric_strip",
    with_dirty(f"SELECT row_id AS _row_id, {num(bare('price || chr(37)'))} AS amount FROM dirty"),
)
def norm_numeric_strip(spark, sf):
    return dirty(spark, sf).select("_row_id", numbers.parse_formatted_number(F.concat("price", F.lit("%"))).alias("amount"))


# Numbers below a million, spelled by the same SQL on both engines and read back.
_ONES = "CASE {n} WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' WHEN 4 THEN 'four' WHEN 5 THEN 'five' WHEN 6 THEN 'six' WHEN 7 THEN 'seven' WHEN 8 THEN 'eight' WHEN 9 THEN 'nine' END"
_SPELLED = (
    "concat({t}, ' thousand ', {h}, ' hundred ', CASE (k // 10) % 10 WHEN 2 THEN 'Twenty' WHEN 3 THEN 'thirty' WHEN 4 THEN 'forty'"
    " WHEN 5 THEN 'fifty' WHEN 6 THEN 'sixty' WHEN 7 THEN 'seventy' WHEN 8 THEN 'eighty' ELSE 'ninety' END, '-', {o})"
).replace("{t}", _ONES.replace("{n}", "1 + k % 9")).replace("{h}", _ONES.replace("{n}", "1 + (k // 7) % 9")).replace(
    "{o}", _ONES.replace("{n}", "1 + (k // 3) % 9")
)
_TENS = "CASE WHEN (k // 10) % 10 BETWEEN 2 AND 8 THEN (k // 10) % 10 * 10 ELSE 90 END"


@query(
    "norm_word_numbers",
    f"SELECT k, {_SPELLED} AS spelled, CAST((1 + k % 9) * 1000 + (1 + (k // 7) % 9) * 100 + {_TENS} + 1 + (k // 3) % 9"
    " AS DOUBLE) AS value FROM (SELECT o_orderkey AS k FROM orders)",
)
def norm_word_numbers(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    spelled = spark.sql(f"SELECT k, {_SPELLED.replace('//', 'DIV')} AS spelled FROM {{t}}", t=orders)
    return spelled.withColumn("value", numbers.parse_number_words(F.col("spelled")))


@query(
    "norm_word_numbers_plain",
    with_dirty("SELECT row_id AS _row_id, CASE WHEN age = 'thirty' THEN CAST(30 AS DOUBLE) END AS value FROM dirty"),
)
def norm_word_numbers_plain(spark, sf):
    """The layered cleaner's form: no hyphens, no zero."""
    value = numbers.parse_number_words(F.col("age"), hyphens=False, allow_zero=False)
    return dirty(spark, sf).select("_row_id", value.alias("value"))


@query("norm_null_tokens", with_dirty(f"SELECT row_id AS _row_id, CASE WHEN NOT {null_like('price')} THEN price END AS price FROM dirty"))
def norm_null_tokens(spark, sf):
    return dirty(spark, sf).select("_row_id", text.null_tokens_to_null(F.col("price")).alias("price"))


_SHAPES = (
    ("%Y-%m-%d", "yyyy-MM-dd"), ("%Y/%m/%d", "yyyy/MM/dd"), ("%d/%m/%Y", "dd/MM/yyyy"), ("%m/%d/%Y", "MM/dd/yyyy"),
    ("%d-%m-%Y", "dd-MM-yyyy"), ("%d-%m-%y", "dd-MM-yy"), ("%d %b %Y", "dd MMM yyyy"), ("%b %d, %Y", "MMM dd, yyyy"),
    ("%d %B %Y", "dd MMMM yyyy"), ("%B %d, %Y", "MMMM dd, yyyy"),
)
_WRITTEN = "CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{p}')" for i, (p, _) in enumerate(_SHAPES)) + " END"
_READ = (
    "coalesce(" + ", ".join(
        f"CASE WHEN regexp_full_match(d, '{shape}') THEN try_strptime(d, '{fmt}') END"
        for shape, fmt in (
            (r"\d{4}-\d+-\d+", "%Y-%m-%d"), (r"\d{4}/\d+/\d+", "%Y/%m/%d"), (r"\d+/\d+/\d{4}", "%d/%m/%Y"),
            (r"\d+/\d+/\d{4}", "%m/%d/%Y"), (r"\d+-\d+-\d{4}", "%d-%m-%Y"), (r"\d+-\d+-\d{2}", "%d-%m-%y"),
            (r"\d+ [A-Za-z]{3} \d{4}", "%d %b %Y"), (r"[A-Za-z]{3} \d+, \d{4}", "%b %d, %Y"),
            (r"[A-Za-z]+ \d+, \d{4}", "%B %d, %Y"), (r"\d+ [A-Za-z]+ \d{4}", "%d %B %Y"),
        )
    ) + ")"
)


@query(
    "norm_dates_multi",
    f"SELECT o_orderkey, d AS written, strftime({_READ}, '%Y-%m-%d') AS iso FROM"
    f" (SELECT o_orderkey, {_WRITTEN} AS d FROM orders)",
)
def norm_dates_multi(spark, sf):
    """Order dates written in ten formats in turn, read back without knowing which."""
    written = F.coalesce(
        *[F.when(F.col("o_orderkey") % 10 == i, F.date_format("o_orderdate", p)) for i, (_, p) in enumerate(_SHAPES)]
    )
    df = table(spark, sf, "orders").select("o_orderkey", written.alias("written"))
    return df.withColumn("iso", dates.iso_text(dates.first_date(F.col("written"))))


_A, _B = "TRY_CAST(substr(order_date, 1, 2) AS INT)", "TRY_CAST(substr(order_date, 4, 2) AS INT)"


@query(
    "norm_dates_careful",
    with_dirty(
        "SELECT row_id AS _row_id, order_date AS before, CASE WHEN order_date LIKE '____/%' THEN replace(order_date, '/', '-')"
        f" WHEN order_date LIKE '__/%' AND {_A} > 12 THEN {day_text('order_date')} ELSE order_date END AS after,"
        f" CASE WHEN order_date LIKE '____/%' THEN '%Y/%m/%d' WHEN order_date LIKE '__/%' AND {_A} > 12 THEN '%d/%m/%Y' END AS format,"
        f" order_date LIKE '__/%' AND {_A} <= 12 AND {_B} <= 12 AS ambiguous FROM dirty"
    ),
)
def norm_dates_careful(spark, sf):
    c = F.col("order_date")
    return dirty(spark, sf).select(
        "_row_id", c.alias("before"), dates.careful_date(c).alias("after"), dates.careful_date_format(c).alias("format"),
        dates.is_ambiguous_date(c).alias("ambiguous"),
    )


@query(
    "valid_dates",
    with_dirty(
        "SELECT row_id AS _row_id, CASE WHEN regexp_full_match(order_date, '\\d{4}-\\d+-\\d+') AND"
        " try_strptime(order_date, '%Y-%m-%d') IS NOT NULL THEN order_date END AS order_date FROM dirty"
    ),
)
def valid_dates(spark, sf):
    return dirty(spark, sf).select("_row_id", F.when(dates.is_real_iso_date(F.col("order_date")), F.col("order_date")).alias("order_date"))


@query(
    "email_shape",
    r"SELECT conv_id, turn, word, regexp_full_match(word, '[^@\s]+@[^@\s]+\.[^@\s]+') AS loose,"
    r" regexp_full_match(word, '[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}') AS strict FROM"
    " (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations"
    " UNION ALL SELECT c_custkey, 0, c_name || '@' || lower(c_mktsegment) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '.com' END FROM customer)"
    " WHERE position('@' IN word) > 0",
)
def email_shape(spark, sf):
    talk = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("word"))
    tail = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(".com")
    made = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"),
        F.concat("c_name", F.lit("@"), F.lower("c_mktsegment"), tail).alias("word"),
    )
    words = talk.unionByName(made).filter(F.col("word").contains("@"))
    w = F.col("word")
    return words.select("conv_id", "turn", "word", text.email_shaped(w).alias("loose"), text.email_shaped(w, strict=True).alias("strict"))


@query(
    "zscore",
    "SELECT o_orderkey, round(abs(o_totalprice - m) / s, 6) AS z FROM orders,"
    " (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)",
)
def zscore(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    figures = orders.agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"))
    mean, std = figures.select("m").scalar(), figures.select("s").scalar()
    return orders.select("o_orderkey", F.round(numbers.z_score(F.col("o_totalprice"), mean, std), 6).alias("z"))


@query(
    "percent_share",
    "SELECT l_orderkey, l_linenumber, round(l_discount / nullif(l_tax, 0) * 100, 2) AS pct FROM lineitem",
)
def percent_share(spark, sf):
    pct = numbers.percent(F.col("l_discount"), F.col("l_tax"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", pct.alias("pct"))


@query(
    "sanitise_values",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS ratio,"
    " strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM lineitem",
)
def sanitise_values(spark, sf):
    """Infinity and NaN come from a division whose divisor can be zero."""
    ratio = F.when(F.col("l_discount") == 0, F.col("l_tax") * float("inf")).otherwise(F.try_divide("l_tax", "l_discount"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.finite(ratio).alias("ratio"), dates.iso_text(F.col("l_shipdate")).alias("l_shipdate")
    )


@query(
    "coerce_audit",
    with_dirty(
        "SELECT row_id AS _row_id, 'price' AS column, 'coerce_numeric_failed' AS action, price AS \"from\" FROM dirty"
        f" WHERE price IS NOT NULL AND {num('price')} IS NULL"
    ),
)
def coerce_audit(spark, sf):
    return steps.coercion_losses(dirty(spark, sf), "price")


@query(
    "fill_confidence_band",
    with_dirty(
        "SELECT status, CASE WHEN p < 5 THEN 'high' WHEN p <= 20 THEN 'medium' ELSE 'low' END AS band FROM"
        " (SELECT status, 100.0 * count(*) FILTER (age IS NULL) / count(*) AS p FROM dirty GROUP BY status)"
    ),
)
def fill_confidence_band(spark, sf):
    g = dirty(spark, sf).groupBy("status").agg((F.count_if(F.col("age").isNull()) * 100.0 / F.count("*")).alias("p"))
    return g.select("status", numbers.fill_confidence(F.col("p")).alias("band"))


@query(
    "hint_flags",
    "SELECT doc_id, regexp_matches(text, '[£$€¥₹]') AS currency,"
    r" regexp_matches(text, '(?i)\b(zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|"
    r"fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand)\b')"
    " AS number_word FROM documents",
)
def hint_flags(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", text.has_currency(t).alias("currency"), numbers.has_number_word(t).alias("number_word")
    )
