"""Columns of mixed cells, and what a step did to which rows."""

from pyspark.sql import functions as F

from millrace.operators import audit, cells, facts, steps
from millrace.operators.causes import step_causes
from millrace.plans import clean_layers as layers
from millrace.plans.clean_smart import smart_clean
from millrace.plans.runner import Step, run_steps

from .base import dirty, num, query, table, with_dirty

# Cells as JSON text: numbers, the same as strings, booleans, the same as strings, gaps.
_MIXED = """
SELECT o_orderkey AS row_id, o_custkey % 20 AS grp,
  CASE o_orderkey % 9
    WHEN 0 THEN CAST(o_custkey % 7 AS STRING) WHEN 1 THEN concat('"', CAST(o_custkey % 7 AS STRING), '"')
    WHEN 2 THEN 'true' WHEN 3 THEN '"true"' WHEN 4 THEN concat(CAST(o_custkey % 7 AS STRING), '.5')
    WHEN 5 THEN concat('" ', o_orderstatus, '"') WHEN 6 THEN concat('"', lower(o_orderstatus), '"')
    WHEN 7 THEN concat('[', CAST(o_custkey % 3 AS STRING), ']') ELSE {gap} END AS cell
FROM {orders}"""


def _sql(gap: str = "NULL") -> str:
    return _MIXED.replace("{orders}", "orders").replace("{gap}", gap)


def _mixed(spark, sf, gap: str = "NULL"):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    text = spark.sql(_MIXED.replace("{gap}", gap), orders=orders)
    return text.select(F.col("row_id").alias("_row_id"), "grp", F.parse_json("cell").alias("reading"))


def _shown(df, *columns):
    return df.select(*columns, F.to_json("reading").alias("cell"), cells.cell_kind(F.col("reading")).alias("kind"))


_KIND = (
    "CASE WHEN cell IN ('true', 'false') THEN 'boolean' WHEN cell LIKE '\"%' THEN 'string' WHEN cell LIKE '[%' THEN 'nested'"
    " WHEN cell LIKE '%.%' THEN 'decimal' WHEN cell IS NOT NULL THEN 'int' END"
)
# Trimmed, lower case, inside the quotes of a string.
_NEAT = "CASE WHEN cell LIKE '\"%' THEN concat('\"', lower(trim(trim(cell, '\"'))), '\"') ELSE cell END"


@query(
    "cell_type_histogram_mixed",
    f"""WITH m AS (SELECT *, {_KIND} AS kind FROM ({_sql("'null'")}) WHERE cell <> 'null')
    SELECT 'grp' AS "column", (SELECT count(o_custkey) FROM orders) AS int_cells, 0 AS float_cells, 0 AS bool_cells, 0 AS str_cells, 0 AS other_cells
    UNION ALL SELECT 'reading', count(*) FILTER (kind = 'int'), count(*) FILTER (kind = 'decimal'), count(*) FILTER (kind = 'boolean'),
      count(*) FILTER (kind = 'string'), count(*) FILTER (kind = 'nested') FROM m""",
)
def cell_type_histogram_mixed(spark, sf):
    return facts.cell_types(_mixed(spark, sf, "'null'"))


@query(
    "clean_layers_mixed",
    f"""WITH m AS (SELECT row_id, grp, {_NEAT} AS cell FROM ({_sql("'8'")}))
    SELECT min(row_id) AS _row_id, grp, cell, any_value({_KIND}) AS kind FROM m GROUP BY grp, cell""",
)
def clean_layers_mixed(spark, sf):
    chosen = ["profiling", "schema_inference", "normalization", "duplicate_handling"]
    result = layers.run_layers(_mixed(spark, sf, "'8'"), layers=chosen, strict=True)
    return _shown(result.df, "_row_id", "grp")


@query(
    "clean_smart_mixed",
    f"""WITH m AS (SELECT row_id, grp, cell FROM ({_sql("'8'")}))
    SELECT min(row_id) AS _row_id, grp, cell, any_value({_KIND}) AS kind FROM m GROUP BY grp, cell""",
)
def clean_smart_mixed(spark, sf):
    none = {k: [] for k in ("age_columns", "score_columns", "currency_columns", "salary_columns", "date_columns")}
    return _shown(smart_clean(_mixed(spark, sf, "'8'"), none).df, "_row_id", "grp")


@query(
    "run_mixed_cells",
    f"""WITH once AS (SELECT min(row_id) AS row_id, grp, cell FROM ({_sql()}) GROUP BY grp, cell),
    filled AS (SELECT row_id, grp, coalesce(cell, '"none"') AS cell FROM once)
    SELECT row_id AS _row_id, grp, cell, {_KIND} AS kind FROM filled""",
)
def run_mixed_cells(spark, sf):
    """Copies go, gaps are filled; equal texts of other types are no copies."""
    plan = [Step("remove_duplicates"), Step("fill_missing", {"column": "reading", "method": "value", "value": "none"})]
    run = run_steps(_mixed(spark, sf), plan, report="diff")
    if run.cause:
        raise run.cause
    return _shown(run.result, "_row_id", "grp")


@query(
    "audit_mixed_types",
    f"""WITH m AS (SELECT *, {_KIND} AS kind FROM ({_sql()}))
    SELECT kind AS was, 'string' AS became, count(*) AS cells FROM m WHERE kind <> 'string' GROUP BY kind""",
)
def audit_mixed_types(spark, sf):
    """Cells whose text stayed while their type changed."""
    before = _mixed(spark, sf)
    after = before.select("_row_id", "grp", cells.cell_text(F.col("reading")).cast("variant").alias("reading"))
    changed = audit.audit_cells(before, after).filter("action = 'type_changed'")
    return changed.groupBy(F.col("from").alias("was"), F.col("to").alias("became")).agg(F.count("*").alias("cells"))


# --- causes -----------------------------------------------------------------------------------
def _listed(df):
    return df.select("code", F.col("column").alias("col"), "rows", F.array_join("examples", "|").alias("examples"))


def _top(source: str, value: str, n: str = "n") -> str:
    return f"(SELECT string_agg(v, '|' ORDER BY c DESC, v) FROM (SELECT {value} AS v, {n} AS c FROM {source} ORDER BY c DESC, v LIMIT 3))"


@query(
    "causes_filter",
    with_dirty(
        "SELECT 'filter_missing' AS code, 'cust_id' AS col, count(*) AS rows, '' AS examples FROM dirty WHERE cust_id IS NULL"
        " UNION ALL SELECT 'filter_value', 'cust_id', count(*), '' FROM dirty WHERE cust_id <= 500"
    ),
)
def causes_filter(spark, sf):
    return _listed(step_causes(dirty(spark, sf), "filter_rows", {"column": "cust_id", "operator": ">", "value": 500}))


@query(
    "causes_join",
    with_dirty(
        """, l AS (SELECT status AS k, count(*) AS nl FROM dirty GROUP BY status),
        r AS (SELECT o_orderstatus AS k, count(*) AS nr FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1),
        alone AS (SELECT l.k, nl AS n FROM l LEFT JOIN r ON l.k = r.k WHERE r.k IS NULL),
        near AS (SELECT k, n FROM alone WHERE lower(trim(k)) IN (SELECT lower(trim(k)) FROM r)),
        made AS (SELECT nl * nr AS n FROM l JOIN r ON l.k = r.k WHERE nl > 1 AND nr > 1)"""
        f" SELECT 'left_alone' AS code, 'status' AS col, sum(n)::BIGINT AS rows, {_top('alone', 'k')} AS examples FROM alone"
        f" UNION ALL SELECT 'left_alone_folded', 'status', sum(n)::BIGINT, {_top('near', 'k')} FROM near"
        " UNION ALL SELECT 'repeated_both', 'status', sum(n)::BIGINT, '' FROM made UNION ALL SELECT 'largest_key', 'status', max(n)::BIGINT, '' FROM made"
    ),
)
def causes_join(spark, sf):
    right = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderstatus").alias("status"), "o_orderpriority").distinct()
    return _listed(step_causes(dirty(spark, sf), "join", {"on": "status"}, right))


@query(
    "causes_cast",
    with_dirty(
        f", lost AS (SELECT price AS k, count(*) AS n FROM dirty WHERE price IS NOT NULL AND {num('price')} IS NULL GROUP BY price)"
        f" SELECT 'cast_lost' AS code, 'price' AS col, sum(n)::BIGINT AS rows, {_top('lost', 'k')} AS examples FROM lost"
    ),
)
def causes_cast(spark, sf):
    return _listed(step_causes(dirty(spark, sf), "change_dtype", {"column": "price", "dtype": "float"}))


@query(
    "causes_copies_groups",
    with_dirty(
        """, same AS (SELECT count(*) AS n FROM dirty GROUP BY order_id, cust_id, price, age, status, order_date, mostly_null HAVING count(*) > 1)
        SELECT 'remove_duplicates' AS step, 'copies' AS code, sum(n - 1)::BIGINT AS rows FROM same
        UNION ALL SELECT 'remove_duplicates', 'largest_group', max(n) FROM same
        UNION ALL SELECT 'group_aggregate', 'missing_key', count(*) FROM dirty WHERE cust_id IS NULL
        UNION ALL SELECT 'group_aggregate', 'groups', count(DISTINCT (cust_id, status)) FROM dirty WHERE cust_id IS NOT NULL
        UNION ALL SELECT 'drop_missing', 'gap', count(*) FROM dirty WHERE age IS NULL"""
    ),
)
def causes_copies_groups(spark, sf):
    df = dirty(spark, sf)
    parts = (("remove_duplicates", {}), ("group_aggregate", {"group_by": ["cust_id", "status"]}), ("drop_missing", {"columns": ["age"]}))
    out = None
    for name, config in parts:
        one = step_causes(df, name, config).select(F.lit(name).alias("step"), "code", "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "run_causes",
    with_dirty(
        """, f AS (SELECT count(*) FILTER (cust_id IS NULL) AS gone, count(*) FILTER (cust_id <= 900) AS low FROM dirty)
        SELECT 'large_row_drop' AS anomaly_type, concat('step filter_rows with column=cust_id, operator=>, value=900; cust_id: ', gone,
          ' rows, the cell is missing; cust_id: ', low, ' rows, the value does not pass') AS likely_cause FROM f"""
    ),
)
def run_causes(spark, sf):
    """What a run says about the filter that lost most rows."""
    df = steps.select_columns(dirty(spark, sf), ["order_id", "cust_id"])
    run = run_steps(df, [Step("filter_rows", {"column": "cust_id", "operator": ">", "value": 900})], report="counts")
    if run.cause:
        raise run.cause
    return run.reports[1].explanations.filter("anomaly_type = 'large_row_drop'").select("anomaly_type", "likely_cause")
