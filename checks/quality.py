from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import over
from checks.ingest import CUSTOMER, DATES
from checks.registry import each, query
from tabulight.operators import quality

TYPES = {"c_custkey": "NUM", "segment": "TEXT", "acctbal": "NUM", "mixed_code": "MIXED", "active_flag": "BOOL",
         "mostly_zero": "NUM", "const_col": "TEXT", "empty_col": "TEXT", "c_nationkey": "NUM"}
ORDER_TYPES = {"o_orderkey": "NUM", "order_day": "DATE", "price_text": "NUM", "o_orderstatus": "TEXT", "o_orderpriority": "TEXT"}
TYPE_SQL = " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in TYPES.items())
M3 = """(v IS NULL OR regexp_replace(lower(v), '^\\s+|\\s+$', '', 'g') IN ('', 'null', 'none', 'nan', 'n/a', 'na', 'undefined',
        '-', '--', '?', 'n/a.', 'n.d.', 'nd', '#n/a', '#na'))"""

# every cell of dirty_customer as (column, position, v)
CELLS = each(CUSTOMER, """SELECT '{c}' AS "column", {i} AS position, CAST({c} AS VARCHAR) AS v FROM dirty_customer""")
PER_COLUMN = f"""
    SELECT "column", position, count(*) AS rows, count(*) - count(v) AS nulls,
           count(*) FILTER (WHERE {M3}) AS missing, count(*) FILTER (WHERE trim(v) = '') AS blanks,
           count(*) FILTER (WHERE v IS NULL OR trim(v) = '' OR v IN ('nan', 'undefined')) AS fillable,
           count(DISTINCT v) AS d
    FROM ({CELLS}) GROUP BY 1, 2"""
ALL_COLUMNS = ", ".join(CUSTOMER)
GROUPS = f"SELECT count(*) AS n FROM dirty_customer GROUP BY {ALL_COLUMNS}"
COPIES = f"SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM ({GROUPS})"


def c(sql: str) -> str:
    return over("dirty_customer", sql)


@query("e01_null_counts", c(f'SELECT "column", nulls FROM ({PER_COLUMN})'))
def _(t):
    return quality.null_counts(t.dirty_customer)


@query("e02_missing_profile", c(f"""
    SELECT "column", nulls, missing AS blanks, missing AS total_missing, round(100.0 * missing / rows, 2) AS missing_pct,
           CASE WHEN round(100.0 * missing / rows, 2) > 20 THEN 'HIGH' WHEN round(100.0 * missing / rows, 2) > 5 THEN 'MEDIUM'
                ELSE 'LOW' END AS severity
    FROM ({PER_COLUMN}) WHERE missing > 0"""))
def _(t):
    return quality.missing_profile(t.dirty_customer)


@query("e03_missing_totals", c(f"""
    SELECT CAST(sum(missing) AS BIGINT) AS missing_cells, round(100.0 * sum(missing) / sum(rows), 2) AS missing_pct,
           CAST(sum(nulls) AS BIGINT) AS null_cells, round(100.0 * sum(nulls) / sum(rows), 2) AS null_pct,
           count(*) FILTER (WHERE missing > 0) AS columns_with_missing FROM ({PER_COLUMN})"""))
def _(t):
    return quality.missing_totals(t.dirty_customer)


@query("e04_null_blank_report", c(f"""
    SELECT "column", nulls, blanks, nulls + blanks AS total_missing, round(100.0 * (nulls + blanks) / rows, 2) AS missing_pct
    FROM ({PER_COLUMN})"""))
def _(t):
    return quality.null_blank_report(t.dirty_customer)


@query("e05_missing_panel", c(f"""
    SELECT "column", CASE CASE "column" {TYPE_SQL} END WHEN 'NUM' THEN 'Numeric' WHEN 'DATE' THEN 'Date' ELSE 'Categorical' END AS data_type,
           fillable AS missing_count, rows AS total_rows, CAST(sum(fillable) OVER () AS BIGINT) AS total_missing
    FROM ({PER_COLUMN}) WHERE fillable > 0 ORDER BY fillable DESC, position"""))
def _(t):
    return quality.missing_panel(t.dirty_customer, TYPES)


@query("e06_duplicate_count", c(f"""
    SELECT rows, duplicates, round(100.0 * duplicates / rows, 2) AS duplicate_pct,
           CASE WHEN round(100.0 * duplicates / rows, 2) > 10 THEN 'HIGH' WHEN round(100.0 * duplicates / rows, 2) > 3 THEN 'MEDIUM'
                ELSE 'LOW' END AS severity FROM ({COPIES})"""))
def _(t):
    return quality.duplicate_count(t.dirty_customer)


@query("e07_duplicate_groups", c(f"SELECT count(*) FILTER (WHERE n > 1) AS duplicate_groups FROM ({GROUPS})"))
def _(t):
    return quality.duplicate_groups(t.dirty_customer)


@query("e08_distinct_counts", each(
    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
     "l_returnflag", "l_linestatus", "l_shipdate"],
    "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM lineitem"))
def _(t):
    return quality.distinct_counts(t.lineitem)


@query("e09_empty_and_constant", c(f"""
    SELECT "column", CASE WHEN d = 0 THEN 'empty' ELSE 'constant' END AS kind FROM ({PER_COLUMN}) WHERE d <= 1"""))
def _(t):
    return quality.empty_and_constant(t.dirty_customer)


@query("e10_consistency_pct", c("""
    SELECT n AS checked, n - good AS bad, round(100.0 * (1 - (n - good) * 1.0 / n), 2) AS consistency_pct
    FROM (SELECT count(mixed_code) + count(c_custkey) + count(acctbal) + count(mostly_zero) + count(c_nationkey) AS n,
                 count(TRY_CAST(mixed_code AS DOUBLE)) + count(c_custkey) + count(acctbal) + count(mostly_zero) + count(c_nationkey) AS good
          FROM dirty_customer)"""))
def _(t):
    return quality.consistency_pct(t.dirty_customer, TYPES)


@query("e10_consistency_pct_dates", over("dirty_orders", f"""
    SELECT n AS checked, n - good AS bad, round(100.0 * (1 - (n - good) * 1.0 / n), 2) AS consistency_pct
    FROM (SELECT count(o_orderkey) + count(order_day) + count(price_text) AS n,
                 count(o_orderkey) + count(try_strptime(order_day, [{DATES}])) + count(TRY_CAST(price_text AS DOUBLE)) AS good
          FROM dirty_orders)"""))
def _(t):
    return quality.consistency_pct(t.dirty_orders, ORDER_TYPES)


@query("e11_encoding_issues", over("noisy_documents", """
    SELECT 'text' AS "column", n AS issues FROM (
        SELECT count(*) FILTER (WHERE contains(text, chr(65533)))
             + count(*) FILTER (WHERE regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]')) AS n FROM noisy_documents)
    WHERE n > 0"""))
def _(t):
    return quality.encoding_issues(t.noisy_documents)


@query("e12_mixed_and_whitespace", over("noisy_documents", each(["text", "lang", "source"], """
    SELECT '{c}' AS "column", 'mixed types' AS issue FROM noisy_documents
    HAVING count(*) FILTER (WHERE regexp_full_match(replace(regexp_replace(regexp_replace({c}, '-', ''), '[.]', ''), ' ', 'x'), '[0-9]+')) BETWEEN 1 AND count({c}) - 1
    UNION ALL SELECT '{c}', 'outer whitespace' FROM noisy_documents
    HAVING count(DISTINCT {c}) BETWEEN 2 AND 20 AND bool_or(regexp_matches({c}, '^\\s|\\s$'))""")))
def _(t):
    return quality.mixed_and_whitespace(t.noisy_documents)


OUTLIERS = each(["c_custkey", "acctbal", "mostly_zero", "c_nationkey"], """
    SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers
    FROM dirty_customer, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM dirty_customer)
    WHERE q1 <> q3""")


@query("e13_column_quality", c(f"""
    SELECT p."column", position, CASE p."column" {TYPE_SQL} END AS type, missing, round(100.0 * missing / rows, 1) AS missing_pct,
           d AS "unique", coalesce(outliers, 0) AS outliers,
           array_to_string(list_filter([
             CASE WHEN missing > 0 THEN 'missing values' END, CASE WHEN outliers > 0 THEN 'outliers' END,
             CASE WHEN p."column" = 'mixed_code' THEN 'mixed types' END,
             CASE WHEN d = 1 AND missing < rows THEN 'constant' END,
             CASE WHEN d = rows AND p."column" IN ('segment', 'mixed_code', 'const_col', 'empty_col') THEN 'all unique' END],
             lambda x: x IS NOT NULL), ', ') AS issues
    FROM ({PER_COLUMN}) p LEFT JOIN ({OUTLIERS}) o ON p."column" = o."column" """))
def _(t):
    return quality.column_quality(t.dirty_customer, TYPES).withColumn("issues", F.concat_ws(", ", "issues"))


@query("e14_key_fields", """
    SELECT 'measure' AS role, CAST(row_number() OVER (ORDER BY v DESC) AS INTEGER) AS rank, "column" FROM (
        SELECT 'l_partkey' AS "column", var_samp(l_partkey) AS v FROM lineitem UNION ALL
        SELECT 'l_suppkey', var_samp(l_suppkey) FROM lineitem UNION ALL
        SELECT 'l_orderkey', var_samp(l_orderkey) FROM lineitem UNION ALL
        SELECT 'l_linenumber', var_samp(l_linenumber) FROM lineitem UNION ALL
        SELECT 'l_quantity', var_samp(l_quantity) FROM lineitem UNION ALL
        SELECT 'l_extendedprice', var_samp(l_extendedprice) FROM lineitem UNION ALL
        SELECT 'l_discount', var_samp(l_discount) FROM lineitem UNION ALL
        SELECT 'l_tax', var_samp(l_tax) FROM lineitem)
    UNION ALL SELECT 'date', 1, 'l_shipdate'
    UNION ALL SELECT 'id', 1, "column" FROM (SELECT * FROM (
        SELECT 'l_orderkey' AS "column", count(DISTINCT l_orderkey) / count(*) AS share FROM lineitem UNION ALL
        SELECT 'l_partkey', count(DISTINCT l_partkey) / count(*) FROM lineitem UNION ALL
        SELECT 'l_extendedprice', count(DISTINCT l_extendedprice) / count(*) FROM lineitem UNION ALL
        SELECT 'l_shipdate', count(DISTINCT l_shipdate) / count(*) FROM lineitem)
        WHERE share >= 0.95 ORDER BY share DESC, "column" DESC LIMIT 1)""")
def _(t):
    types = dict.fromkeys(t.lineitem.columns, "NUM") | {"l_returnflag": "TEXT", "l_linestatus": "TEXT", "l_shipdate": "DATE"}
    return quality.key_fields(t.lineitem, types)


@query("e15_type_distribution", c("""
    SELECT * FROM (VALUES ('NUM', 4), ('TEXT', 3), ('DATE', 0), ('MIXED', 1)) v(type, columns)
    UNION ALL SELECT 'BOOL', count(DISTINCT active_flag) // 2 FROM dirty_customer"""))
def _(t):
    types = TYPES | {"active_flag": "TEXT"}     # as an older type list would have it: found again by its values
    return quality.type_distribution(t.dirty_customer, types)


@query("e16_dataset_size", """
    SELECT bytes, CASE WHEN round(bytes / 1048576.0, 2) < 1 THEN concat(CAST(round(CAST(bytes AS DOUBLE) / 1024, 1) AS VARCHAR), ' KB')
                       ELSE concat(CAST(round(CAST(bytes AS DOUBLE) / 1048576, 2) AS VARCHAR), ' MB') END AS label
    FROM (SELECT CAST(sum(strlen(text) + strlen(lang) + strlen(source)) + 16 * count(*) AS BIGINT) AS bytes FROM documents)""")
def _(t):
    return quality.dataset_size(t.documents)


@query("e17_schema_details", each(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], """
    SELECT '{c}' AS "column", {i} AS position,
           CASE '{c}' WHEN 'o_orderdate' THEN 'DATE' WHEN 'o_orderkey' THEN 'INTEGER' WHEN 'o_custkey' THEN 'INTEGER' WHEN 'o_totalprice' THEN 'REAL' ELSE 'TEXT' END AS storage_type,
           count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count,
           (SELECT string_agg(CAST(v AS VARCHAR), ', ' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM orders ORDER BY 1 LIMIT 3)) AS sample_values
    FROM orders"""))
def _(t):
    types = {"o_orderkey": "NUM", "o_custkey": "NUM", "o_totalprice": "NUM", "o_orderdate": "DATE"}
    return quality.schema_details(t.orders, types).withColumn("sample_values", F.array_join("sample_values", ", "))


NUMBER_PROFILE = """
    SELECT '{c}' AS "column", %s AS position, 'number' AS kind, '%s' AS meaning, count(*) - count({c}) AS nulls,
           CAST(min({c}) AS DOUBLE) AS min_number, CAST(max({c}) AS DOUBLE) AS max_number, round(avg({c}), 2) AS average,
           count(DISTINCT {c}) AS distinct_count, NULL AS min_text, NULL AS max_text, '' AS "values" FROM orders"""
TEXT_PROFILE = """
    SELECT '{c}', %s, 'other', %s, count(*) FILTER (WHERE {c} IS NULL OR trim({c}) = ''), NULL, NULL, NULL, count(DISTINCT {c}), NULL, NULL,
           (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM orders ORDER BY 1 LIMIT 15)) FROM orders"""


@query("e18_catalog_profile", " UNION ALL ".join([
    (NUMBER_PROFILE % (0, "id")).replace("{c}", "o_orderkey"), (NUMBER_PROFILE % (1, "id")).replace("{c}", "o_custkey"),
    (TEXT_PROFILE % (2, "'status'")).replace("{c}", "o_orderstatus"),
    (NUMBER_PROFILE % (3, "money")).replace("{c}", "o_totalprice"),
    """SELECT 'o_orderdate', 4, 'date', 'date', count(*) - count(o_orderdate), NULL, NULL, NULL, NULL,
              CAST(min(o_orderdate) AS VARCHAR), CAST(max(o_orderdate) AS VARCHAR), '' FROM orders""",
    (TEXT_PROFILE % (5, "NULL")).replace("{c}", "o_orderpriority")]))
def _(t):
    return quality.catalog_profile(t.orders).withColumn("values", F.concat_ws(", ", "values"))


@query("e19_quality_label", c(f"""
    SELECT nulls AS null_cells, duplicates, CASE WHEN nulls = 0 AND duplicates = 0 THEN 'EXCELLENT'
        WHEN np < 5 AND dp < 3 THEN 'GOOD' WHEN np < 15 AND dp < 10 THEN 'FAIR' ELSE 'POOR' END AS label
    FROM (SELECT CAST(sum(nulls) AS BIGINT) AS nulls, 100.0 * sum(nulls) / sum(rows) AS np FROM ({PER_COLUMN})),
         (SELECT duplicates, 100.0 * duplicates / rows AS dp FROM ({COPIES}))"""))
def _(t):
    return quality.quality_label(t.dirty_customer)


@query("e20_trust_score", c(f"""
    SELECT score, CASE WHEN score >= 85 THEN 'good' WHEN score >= 60 THEN 'warning' ELSE 'poor' END AS band, flags FROM (
      SELECT greatest(0, CAST(floor(100 - (least(20, nulls * 200.0 / (rows * 9)) + least(10, duplicates * 200.0 / rows)
               + CASE WHEN rows < 30 THEN 20 ELSE 0 END)) AS INTEGER)) AS score,
             concat(flags, CASE WHEN duplicates > 0 THEN ', duplicate rows' ELSE '' END) AS flags
      FROM (SELECT sum(nulls) AS nulls, string_agg('nulls: ' || "column", ', ' ORDER BY "column") FILTER (WHERE nulls > 0) AS flags
            FROM ({PER_COLUMN})), ({COPIES}))"""))
def _(t):
    return quality.trust_score(t.dirty_customer, TYPES).withColumn("flags", F.concat_ws(", ", "flags"))


@query("e20_trust_score_dates", over("dirty_orders", """
    SELECT CAST(floor(100 - 10) AS INTEGER) AS score, 'good' AS band, 'unparseable dates: order_day' AS flags FROM dirty_orders
    HAVING count(*) FILTER (WHERE order_day IS NOT NULL AND try_strptime(order_day, '%Y-%m-%d') IS NULL) > 0 AND count(*) >= 30"""))
def _(t):
    return quality.trust_score(t.dirty_orders, ORDER_TYPES).withColumn("flags", F.concat_ws(", ", "flags"))


@query("e21_forecast_safety", """
    SELECT n >= 10 AND d >= 4 AS safe, CASE WHEN n < 10 THEN 'too few rows' WHEN d < 4 THEN 'too few periods' ELSE 'ok' END AS reason
    FROM (SELECT count(*) AS n, count(DISTINCT o_orderdate) AS d FROM orders)""")
def _(t):
    return quality.forecast_safety(t.orders, {"o_orderdate": "DATE"})


@query("e22_date_range", over("dirty_orders", """
    SELECT strftime(min(d), '%Y-%m-%d') AS first_date, strftime(max(d), '%Y-%m-%d') AS last_date
    FROM (SELECT try_strptime(order_day, '%Y-%m-%d') AS d FROM dirty_orders)"""))
def _(t):
    return quality.date_range(t.dirty_orders, "order_day")


ISSUES = f"""
    SELECT (SELECT CAST(sum(missing) AS DOUBLE) FROM ({PER_COLUMN})) AS missing, (SELECT duplicates FROM ({COPIES})) AS copies,
           (SELECT count(*) FROM ({PER_COLUMN}) WHERE d = 0) AS empty, (SELECT count(*) FROM ({PER_COLUMN}) WHERE d = 1) AS const,
           (SELECT sum(outliers) FROM ({OUTLIERS})) AS outliers,
           (SELECT round(100.0 * count(*) FILTER (WHERE v IS NOT NULL AND (num OR TRY_CAST(v AS DOUBLE) IS NOT NULL)) / count(v), 2)
            FROM (SELECT v, "column" <> 'mixed_code' AS num FROM ({CELLS})
                  WHERE "column" IN ('c_custkey', 'acctbal', 'mostly_zero', 'c_nationkey', 'mixed_code'))) AS consistent"""


@query("e25_issue_list", c(f"""
    SELECT CAST(seq AS INTEGER) AS seq, issue, CAST(value AS DOUBLE) AS value FROM (
      SELECT unnest([1, 2, 3, 4, 5, 6, 8]) AS seq,
             unnest(['missing values', 'duplicate rows', 'empty columns', 'constant columns', 'outliers', 'mixed type columns', 'low consistency']) AS issue,
             unnest([missing, copies, empty, const, outliers, 1, consistent]) AS value FROM ({ISSUES}))
    WHERE CASE WHEN seq = 8 THEN value < 95 ELSE value > 0 END"""))
def _(t):
    return quality.issue_list(t.dirty_customer, TYPES)


BYTES = " + ".join(f"coalesce(sum(strlen({x})), 0)" for x in ("segment", "mixed_code", "active_flag", "const_col", "empty_col"))
FACTS = f"""
    SELECT p.rows, p.duplicates, round(100.0 * duplicates / p.rows, 2) AS duplicate_pct, m.* EXCLUDE (cells),
           round(100.0 * missing_cells / cells, 2) AS missing_pct, round(100.0 * null_cells / cells, 2) AS null_pct,
           CAST(empty AS BIGINT) AS empty_columns, CAST(const AS BIGINT) AS constant_columns, CAST(i.outliers AS BIGINT) AS outlier_count,
           (SELECT count(*) FROM ({OUTLIERS}) WHERE outliers > 0) AS outlier_columns, CAST(0 AS BIGINT) AS encoding_issues,
           CAST(0 AS BIGINT) AS encoding_issue_columns, consistent AS consistency_pct, bytes,
           CASE WHEN bytes < 1048576 * 0.995 THEN concat(CAST(round(CAST(bytes AS DOUBLE) / 1024, 1) AS VARCHAR), ' KB')
                ELSE concat(CAST(round(CAST(bytes AS DOUBLE) / 1048576, 2) AS VARCHAR), ' MB') END AS label,
           CAST(9 AS BIGINT) AS total_columns, CAST(1 AS BIGINT) AS mixed_type_columns
    FROM ({COPIES}) p, ({ISSUES}) i, (SELECT CAST(28 * count(*) + {BYTES} AS BIGINT) AS bytes FROM dirty_customer),
         (SELECT CAST(sum(missing) AS BIGINT) AS missing_cells, CAST(sum(nulls) AS BIGINT) AS null_cells, sum(rows) AS cells,
                 count(*) FILTER (WHERE missing > 0) AS columns_with_missing FROM ({PER_COLUMN})) m"""


@query("e23_overview", c(FACTS))
def _(t):
    return quality.overview(t.dirty_customer, TYPES)["facts"]


def samples(name: str, kind: str) -> str:
    return f"""SELECT 'columns' AS section, '{name}' AS metric, '{kind}: ' || coalesce((SELECT string_agg(CAST(v AS VARCHAR), ', ' ORDER BY v)
        FROM (SELECT DISTINCT {name} AS v FROM dirty_customer WHERE {name} IS NOT NULL ORDER BY 1 LIMIT 3)), 'None') AS value"""


@query("e24_overview_report", c(f""", f AS ({FACTS})
    SELECT 'table' AS section, 'rows' AS metric, CAST(rows AS VARCHAR) AS value FROM f UNION ALL
    SELECT 'table', 'columns', '9' UNION ALL SELECT 'table', 'size', label FROM f UNION ALL
    SELECT 'quality', 'missing_cells', CAST(missing_cells AS VARCHAR) FROM f UNION ALL
    SELECT 'quality', 'missing_pct', CAST(missing_pct AS VARCHAR) FROM f UNION ALL
    SELECT 'quality', 'duplicates', CAST(duplicates AS VARCHAR) FROM f UNION ALL
    SELECT 'quality', 'empty_columns', CAST(empty_columns AS VARCHAR) FROM f UNION ALL
    SELECT 'quality', 'consistency_pct', CAST(consistency_pct AS VARCHAR) FROM f UNION ALL
    SELECT 'types', 'numeric', '4' UNION ALL SELECT 'types', 'text', '3' UNION ALL
    SELECT 'types', 'date', '0' UNION ALL SELECT 'types', 'boolean', '1' UNION ALL
    SELECT 'keys', 'id', CASE WHEN count(DISTINCT mixed_code) >= 0.7 * count(mixed_code) THEN 'mixed_code' ELSE
      CASE WHEN 0.95 * count(*) <= count(DISTINCT c_custkey) THEN 'c_custkey' ELSE 'none' END END FROM dirty_customer UNION ALL
    SELECT 'keys', 'date', 'none' UNION ALL
    SELECT 'keys', 'measures', 'c_custkey, acctbal, mostly_zero, c_nationkey' UNION ALL
    {" UNION ALL ".join(samples(n, k) for n, k in (("c_custkey", "INTEGER"), ("segment", "TEXT"), ("acctbal", "REAL"), ("mixed_code", "MIXED"),
                        ("active_flag", "BOOLEAN"), ("mostly_zero", "REAL"), ("const_col", "TEXT"), ("empty_col", "TEXT"), ("c_nationkey", "INTEGER")))}"""))
def _(t):
    return quality.overview_report(t.dirty_customer, TYPES)
