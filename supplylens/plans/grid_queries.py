"""Registered queries for the sheet-grid operators.

A workbook cell table is derived from the driver tables: yearly order
totals per customer nation, laid out per region in three sheet shapes
(a wide sheet with a title and a numeric note row above its header, a
period sheet whose header row holds years, and a fixed-layout sheet with
series names in row 0), plus an index sheet and a notes sheet.  The DuckDB
oracle builds the same cells with SQL and applies each rule in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from supplylens.operators import grid as G
from supplylens.operators import relational as R
from supplylens.plans.registry import register, table
from supplylens.session import scratch_path

BASE_YEAR = 1995


def _totals(spark, d):
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name",
                                         "n_regionkey")
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    # pre-aggregate per (customer, year) so a hot customer is one row per year
    per_cust = o.groupBy("o_custkey", F.year("o_orderdate").alias("yr")).agg(
        F.sum("o_totalprice").alias("total"))
    t = (per_cust.join(c, "o_custkey")
         .groupBy("c_nationkey", "yr")
         .agg(F.sum("total").alias("total")))
    return (R.lookup(R.lookup(t, n, "c_nationkey"), r, "n_regionkey")
            .withColumnRenamed("c_nationkey", "n_nationkey"))


def workbook_cells(spark, d):
    """The cell table ``(sheet, row_idx, col_idx, value)``.

    Built in five passes (per region, per nation, per year, per nation-year
    total, plus two constant cells), each emitting its cells with one
    ``explode`` of an array of structs.
    """
    tot = _totals(spark, d)
    reg = table(spark, d, "region")
    nr = (table(spark, d, "nation")
          .join(reg.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey"))
    years = tot.select("r_name", "yr").distinct()
    lit = F.lit
    col = F.expr("n_nationkey div 5") + 1
    yr_row = F.col("yr") - BASE_YEAR + 3
    yr_col = F.col("yr") - BASE_YEAR + 1
    val = F.round("total", 2).cast("decimal(20,2)").cast("string")
    yr_txt = F.col("yr").cast("string")
    rk = F.col("r_regionkey")
    sales = F.concat(lit("Sales "), F.col("r_name"))
    yearly = F.concat(lit("Yearly "), F.col("r_name"))
    totals = F.concat(lit("Totals "), F.col("r_name"))

    def cell(sheet, row, column, value):
        return F.struct(sheet.alias("sheet"), lit(row).cast("int").alias("row_idx"),
                        lit(column).cast("int").alias("col_idx"), value.cast("string").alias("value"))

    def emit(df, *cells):
        return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")

    parts = [
        emit(reg,
             cell(sales, 0, 0, F.concat(lit("Order totals for "), F.col("r_name"))),
             *[cell(sales, 1, i, lit(str(i + 1))) for i in range(3)],
             cell(sales, 2, 0, lit("Year")),
             *[cell(sales, 100, i, lit("")) for i in range(3)],
             cell(sales, 101, 0, lit("Source: order book")),
             cell(yearly, 0, 0, lit("Table F")), cell(yearly, 1, 0, lit("Nation")),
             cell(totals, 0, 0, F.concat(lit("TOTALS "), F.col("r_name"))),
             cell(totals, 1, 0, lit("Note: order totals by customer nation")),
             cell(totals, 2, 0, lit("Calendar Year")), cell(totals, 50, 0, lit("2050")),
             cell(lit("Index"), rk + 1, 0, F.col("r_name")), cell(lit("Index"), rk + 1, 1, sales),
             cell(lit("Index"), rk + 1, 2, lit("wide layout")),
             cell(lit("Totals NOTES"), rk + 3, 0, rk), cell(lit("Totals NOTES"), rk + 3, 1, lit("1.5"))),
        emit(nr, cell(sales, 2, col, F.col("n_name")), cell(yearly, col + 1, 0, F.col("n_name")),
             cell(totals, 0, col, F.col("n_name")), cell(totals, 50, col, lit("n/a"))),
        emit(years, cell(sales, yr_row, 0, yr_txt), cell(yearly, 1, yr_col, yr_txt),
             cell(totals, yr_row, 0, yr_txt)),
        emit(tot, cell(sales, yr_row, col, val), cell(yearly, col + 1, yr_col, val),
             cell(totals, yr_row, col, val)),
        spark.createDataFrame([("Index", 0, 0, "Contents"), ("Totals NOTES", 0, 1, "Sydney")],
                              "sheet STRING, row_idx INT, col_idx INT, value STRING"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def landed_cells(spark, d):
    """The workbook as a landed table: written once under the shared scratch
    folder and read back, so the grid operators (which read the cells
    several times) scan a stored table instead of re-deriving it."""
    path = scratch_path(spark, "workbook")
    workbook_cells(spark, d).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_CELLS_SQL = f"""
tot AS (
  SELECT n.n_nationkey, n.n_name, r.r_name, CAST(year(o.o_orderdate) AS INTEGER) AS yr,
         sum(o.o_totalprice) AS total
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
       JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY 1, 2, 3, 4),
nr AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
yrs AS (SELECT DISTINCT r_name, yr FROM tot),
three AS (SELECT CAST(range AS INTEGER) AS c FROM range(0, 3)),
raw AS (
  SELECT 'Sales ' || r_name AS sheet, 0 AS row_idx, 0 AS col_idx, 'Order totals for ' || r_name AS value FROM region
  UNION ALL SELECT 'Sales ' || r_name, 1, c, CAST(c + 1 AS VARCHAR) FROM region, three
  UNION ALL SELECT 'Sales ' || r_name, 2, 0, 'Year' FROM region
  UNION ALL SELECT 'Sales ' || r_name, 2, n_nationkey // 5 + 1, n_name FROM nr
  UNION ALL SELECT 'Sales ' || r_name, yr - {BASE_YEAR} + 3, 0, CAST(yr AS VARCHAR) FROM yrs
  UNION ALL SELECT 'Sales ' || r_name, yr - {BASE_YEAR} + 3, n_nationkey // 5 + 1,
                   CAST(CAST(round(total, 2) AS DECIMAL(20, 2)) AS VARCHAR) FROM tot
  UNION ALL SELECT 'Sales ' || r_name, 100, c, '' FROM region, three
  UNION ALL SELECT 'Sales ' || r_name, 101, 0, 'Source: order book' FROM region
  UNION ALL SELECT 'Yearly ' || r_name, 0, 0, 'Table F' FROM region
  UNION ALL SELECT 'Yearly ' || r_name, 1, 0, 'Nation' FROM region
  UNION ALL SELECT 'Yearly ' || r_name, 1, yr - {BASE_YEAR} + 1, CAST(yr AS VARCHAR) FROM yrs
  UNION ALL SELECT 'Yearly ' || r_name, n_nationkey // 5 + 2, 0, n_name FROM nr
  UNION ALL SELECT 'Yearly ' || r_name, n_nationkey // 5 + 2, yr - {BASE_YEAR} + 1,
                   CAST(CAST(round(total, 2) AS DECIMAL(20, 2)) AS VARCHAR) FROM tot
  UNION ALL SELECT 'Totals ' || r_name, 0, 0, 'TOTALS ' || r_name FROM region
  UNION ALL SELECT 'Totals ' || r_name, 0, n_nationkey // 5 + 1, n_name FROM nr
  UNION ALL SELECT 'Totals ' || r_name, 1, 0, 'Note: order totals by customer nation' FROM region
  UNION ALL SELECT 'Totals ' || r_name, 2, 0, 'Calendar Year' FROM region
  UNION ALL SELECT 'Totals ' || r_name, yr - {BASE_YEAR} + 3, 0, CAST(yr AS VARCHAR) FROM yrs
  UNION ALL SELECT 'Totals ' || r_name, yr - {BASE_YEAR} + 3, n_nationkey // 5 + 1,
                   CAST(CAST(round(total, 2) AS DECIMAL(20, 2)) AS VARCHAR) FROM tot
  UNION ALL SELECT 'Totals ' || r_name, 50, 0, '2050' FROM region
  UNION ALL SELECT 'Totals ' || r_name, 50, n_nationkey // 5 + 1, 'n/a' FROM nr
  UNION ALL SELECT 'Index', 0, 0, 'Contents'
  UNION ALL SELECT 'Index', r_regionkey + 1, 0, r_name FROM region
  UNION ALL SELECT 'Index', r_regionkey + 1, 1, 'Sales ' || r_name FROM region
  UNION ALL SELECT 'Index', r_regionkey + 1, 2, 'wide layout' FROM region
  UNION ALL SELECT 'Totals NOTES', r_regionkey + 3, 0, CAST(r_regionkey AS VARCHAR) FROM region
  UNION ALL SELECT 'Totals NOTES', r_regionkey + 3, 1, '1.5' FROM region
  UNION ALL SELECT 'Totals NOTES', 0, 1, 'Sydney'),
cells AS (SELECT sheet, CAST(row_idx AS INTEGER) AS row_idx, CAST(col_idx AS INTEGER) AS col_idx, value
          FROM raw)"""

_NUMERIC = "regexp_full_match(trim(value), '[0-9.\\-]+') AND regexp_matches(trim(value), '[0-9]')"
_NONEMPTY = "value IS NOT NULL AND trim(value) <> ''"


def _header_sql(k: int) -> str:
    return f"""
hdr AS (SELECT sheet, min(row_idx) AS header_row FROM (
          SELECT sheet, row_idx, count(*) AS n FROM cells
          WHERE row_idx < 20 AND {_NONEMPTY} AND NOT ({_NUMERIC})
          GROUP BY 1, 2) t WHERE n >= {k} GROUP BY 1)"""


@register("grid_header", f"WITH {_CELLS_SQL}, {_header_sql(3)} SELECT * FROM hdr")
def grid_header(spark, d):
    return G.detect_header(landed_cells(spark, d), k=3)


@register("grid_header_k2", f"WITH {_CELLS_SQL}, {_header_sql(2)} SELECT * FROM hdr")
def grid_header_k2(spark, d):
    return G.detect_header(landed_cells(spark, d), k=2)


@register("grid_period_header", f"""
WITH {_CELLS_SQL}
SELECT sheet, min(row_idx) AS header_row FROM cells
WHERE row_idx < 15 AND value IS NOT NULL
  AND (regexp_matches(trim(value), '^[0-9]{{4}}') OR (contains(trim(value), '-') AND length(trim(value)) <= 7))
GROUP BY sheet
""")
def grid_period_header(spark, d):
    return G.detect_period_header(landed_cells(spark, d))


def _apply_sql(ignore_first: bool) -> str:
    extra = "AND b.col_idx > f.c0" if ignore_first else ""
    return f"""
WITH {_CELLS_SQL}, {_header_sql(3)},
sales AS (SELECT * FROM cells WHERE sheet LIKE 'Sales %'),
names AS (SELECT c.sheet, c.col_idx, trim(c.value) AS "column"
          FROM sales c JOIN hdr h ON c.sheet = h.sheet AND c.row_idx = h.header_row),
body AS (SELECT c.sheet, c.row_idx, c.col_idx,
                CASE WHEN c.value IS NOT NULL AND trim(c.value) <> '' THEN c.value END AS value
         FROM sales c JOIN hdr h ON c.sheet = h.sheet AND c.row_idx > h.header_row),
f AS (SELECT sheet, min(col_idx) AS c0 FROM body GROUP BY sheet),
keep AS (SELECT DISTINCT b.sheet, b.row_idx FROM body b JOIN f ON b.sheet = f.sheet
         WHERE b.value IS NOT NULL {extra})
SELECT b.sheet, b.row_idx, b.col_idx,
       CASE WHEN n."column" IS NOT NULL AND trim(n."column") <> '' THEN n."column" ELSE 'col' END AS "column",
       b.value
FROM body b JOIN keep k ON b.sheet = k.sheet AND b.row_idx = k.row_idx
LEFT JOIN names n ON b.sheet = n.sheet AND b.col_idx = n.col_idx
"""


def _sales_cells(spark, d):
    return landed_cells(spark, d).filter(F.col("sheet").startswith("Sales "))


@register("grid_apply", _apply_sql(False))
def grid_apply(spark, d):
    cells = _sales_cells(spark, d)
    return G.apply_header(cells, G.detect_header(cells, k=3))


@register("grid_apply_ignore_first", _apply_sql(True))
def grid_apply_ignore_first(spark, d):
    cells = _sales_cells(spark, d)
    return G.apply_header(cells, G.detect_header(cells, k=3), ignore_first=True)


@register("grid_melt", f"""
WITH {_CELLS_SQL},
c AS (SELECT * FROM cells WHERE sheet LIKE 'Totals%' AND NOT contains(upper(sheet), 'NOTES')),
heads AS (SELECT sheet, col_idx, trim(value) AS city FROM c
          WHERE row_idx = 0 AND col_idx >= 1 AND {_NONEMPTY}),
periods AS (SELECT sheet, row_idx, trim(value) AS year_period FROM c
            WHERE row_idx >= 3 AND col_idx = 0 AND {_NONEMPTY}),
vals AS (SELECT sheet, row_idx, col_idx, TRY_CAST(trim(value) AS DOUBLE) AS v FROM c
         WHERE row_idx >= 3 AND col_idx >= 1)
SELECT p.year_period, h.city, round_even(v.v, 2) AS price_cpl,
       CASE WHEN contains(lower(v.sheet), 'america') THEN 'AMER' ELSE 'REST' END AS fuel_type
FROM vals v JOIN periods p ON v.sheet = p.sheet AND v.row_idx = p.row_idx
JOIN heads h ON v.sheet = h.sheet AND v.col_idx = h.col_idx
WHERE v.v IS NOT NULL AND NOT isnan(v.v)
""")
def grid_melt(spark, d):
    cells = landed_cells(spark, d).filter(F.col("sheet").startswith("Totals"))
    return G.melt_grid(cells, header_row=0, first_row=3, skip="NOTES",
                       label_rules=[("america", "AMER")], default_label="REST")


@register("unpivot", """
SELECT l_linenumber, l_returnflag AS flag, round(sum(l_quantity), 2) AS qty
FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1, 2
""")
def unpivot_q(spark, d):
    li = table(spark, d, "lineitem")
    wide = (li.groupBy("l_linenumber").pivot("l_returnflag", ["A", "N", "R"])
            .agg(F.round(F.sum("l_quantity"), 2)))
    return G.unpivot(wide, ["l_linenumber"], ["A", "N", "R"], "flag", "qty")


_ROUTE_RULES = {"stocks": ["Sales ASIA", "Sales EUROPE"], "supply": ["Sales AMERICA"]}


def _routed(spark, d):
    return G.route_sheets(landed_cells(spark, d), _ROUTE_RULES, "sales", exclude=["Index"])


_ROUTE_SQL = """
routed AS (SELECT *, sheet AS source_sheet,
                  CASE WHEN sheet IN ('Sales ASIA', 'Sales EUROPE') THEN 'stocks'
                       WHEN sheet IN ('Sales AMERICA') THEN 'supply' ELSE 'sales' END AS data_category
           FROM cells WHERE sheet NOT IN ('Index'))"""


@register("grid_route", f"""
WITH {_CELLS_SQL}, {_ROUTE_SQL}
SELECT source_sheet, data_category, count(*) AS n_cells FROM routed GROUP BY 1, 2
""")
def grid_route(spark, d):
    return _routed(spark, d).groupBy("source_sheet", "data_category").agg(
        F.count(F.lit(1)).alias("n_cells"))


@register("grid_split", f"""
WITH {_CELLS_SQL}, {_ROUTE_SQL}
SELECT 'sales_table' AS table_name, count(*) FILTER (WHERE data_category = 'sales') AS n_cells FROM routed
UNION ALL SELECT 'stocks_table', count(*) FILTER (WHERE data_category = 'stocks') FROM routed
UNION ALL SELECT 'supply_table', count(*) FILTER (WHERE data_category = 'supply') FROM routed
UNION ALL SELECT 'other_table', count(*) FILTER (WHERE data_category = 'other') FROM routed
""")
def grid_split(spark, d):
    parts = G.split_by(_routed(spark, d), "data_category",
                       {"sales": "sales_table", "stocks": "stocks_table", "supply": "supply_table",
                        "other": "other_table"})
    counts = [df.agg(F.count(F.lit(1)).alias("n_cells")).select(F.lit(name).alias("table_name"),
                                                                "n_cells")
              for name, df in parts.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@register("sanitize", """
SELECT o_orderkey AS Order_Key_id, o_totalprice AS "Total_price_AUD", o_orderstatus AS statuscode,
       o_orderpriority AS col, o_orderdate AS Order_Keyid, o_custkey AS "order_key_id_1"
FROM orders
""")
def sanitize(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("Order Key (id)"), F.col("o_totalprice").alias("Total price, AUD"),
        F.col("o_orderstatus").alias("status=code"), F.col("o_orderpriority").alias("  ()  "),
        F.col("o_orderdate").alias("Order   Key\t(id)"), F.col("o_custkey").alias("order key id"))
    return G.sanitize_columns(o)


@register("normalize_nulls", """
SELECT p_partkey, CASE WHEN p_size <= 8 THEN NULL ELSE p_name END AS p_name,
       CASE WHEN p_size > 45 THEN NULL ELSE p_type END AS p_type
FROM part
""")
def normalize_nulls_q(spark, d):
    p = table(spark, d, "part")
    name = (F.when(F.col("p_size") <= 2, F.lit("")).when(F.col("p_size") <= 4, F.lit("nan"))
            .when(F.col("p_size") <= 6, F.lit("None")).when(F.col("p_size") <= 8, F.lit(" . "))
            .otherwise(F.col("p_name")))
    ptype = F.when(F.col("p_size") > 45, F.lit("  ")).otherwise(F.col("p_type"))
    return G.normalize_nulls(p.select("p_partkey", name.alias("p_name"), ptype.alias("p_type")))


@register("grid_write_split", f"""
WITH {_CELLS_SQL}, {_ROUTE_SQL}
SELECT CASE data_category WHEN 'sales' THEN 'sales_table' WHEN 'stocks' THEN 'stocks_table'
            ELSE 'supply_table' END AS "table",
       count(*) AS n_cells, count(DISTINCT source_sheet) AS n_sheets
FROM routed GROUP BY 1
""")
def grid_write_split(spark, d):
    path = scratch_path(spark, "split")
    G.write_split(_routed(spark, d), "data_category",
                  {"sales": "sales_table", "stocks": "stocks_table", "supply": "supply_table",
                   "other": "other_table"}, path)
    back = spark.read.parquet(path)
    return back.groupBy("table").agg(F.count(F.lit(1)).alias("n_cells"),
                                     F.count_distinct("source_sheet").alias("n_sheets"))


# -- whole sheets as wide tables: one sheet per order month, one row per order, so cells grow with orders


def month_sheets(spark, d):
    """Sheets "Month YYYY-MM": a title, a row of numbers, the header in row 2, then a row per order.

    Headers hold a blank, a repeated name and characters that no column may
    have; odd and even months differ in their last column; orders of status P have no cell
    beyond the first and are left out.
    """
    o = table(spark, d, "orders")
    month = F.date_format("o_orderdate", "yyyy-MM")
    sheet = F.concat(F.lit("Month "), month)
    even = F.month("o_orderdate") % 2 == 0
    row = (F.col("o_orderkey") + 3).cast("long")
    full = F.col("o_orderstatus") != "P"

    def cell(row_idx, col, value):
        return F.struct(row_idx.cast("long").alias("row_idx"), F.lit(col).alias("col_idx"), value.cast("string").alias("value"))

    body = o.select(sheet.alias("sheet"), F.explode(F.array(
        cell(row, 0, F.col("o_orderkey")),
        cell(row, 1, F.when(full, F.col("o_orderstatus"))),
        cell(row, 2, F.when(full, F.col("o_totalprice").cast("decimal(20,2)"))),
        cell(row, 3, F.when(full, F.substring("o_orderpriority", 1, 1))),
        cell(row, 4, F.when(full, F.when(F.col("o_orderkey") % 3 == 0, F.lit("nan")).otherwise(F.col("o_custkey").cast("string")))),
        cell(row, 5, F.when(full, F.to_date("o_orderdate"))))).alias("c")).select("sheet", "c.*")
    lit = lambda x: F.lit(x)
    zero = F.lit(0)
    heads = o.select(sheet.alias("sheet"), even.alias("even")).distinct().select("sheet", F.explode(F.array(
        cell(zero, 0, F.concat(lit("Orders of "), F.col("sheet"))), *[cell(zero + 1, i, lit(str(i))) for i in range(4)],
        *[cell(zero + 2, i, lit(n)) for i, n in enumerate(["Order Key", "Status", "Total (AUD)", " ", "total {AUD}"])],
        cell(zero + 2, 5, F.when(F.col("even"), "Ordered; on").otherwise("Day")))).alias("c")).select("sheet", "c.*")
    index = spark.createDataFrame([("Index", r, c, v) for r in range(3) for c, v in enumerate(["Sheet", "Title", "Rows"])],
                                  "sheet string, row_idx long, col_idx int, value string")
    return body.unionByName(heads).unionByName(index)


_MONTHS_SQL = """
SELECT 'Month ' || strftime(o_orderdate, '%Y-%m') AS source_sheet, o_orderkey + 3 AS row_idx,
       CAST(o_orderkey AS VARCHAR) AS "Order_Key", o_orderstatus AS "Status",
       CAST(CAST(o_totalprice AS DECIMAL(20, 2)) AS VARCHAR) AS "Total_AUD", substring(o_orderpriority, 1, 1) AS "col",
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS "total_AUD_1",
       CASE WHEN month(o_orderdate) % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS "Ordered_on",
       CASE WHEN month(o_orderdate) % 2 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS "Day",
       CASE strftime(o_orderdate, '%Y-%m') WHEN '1995-03' THEN 'stocks' WHEN '1996-05' THEN 'supply' WHEN '1996-07' THEN 'supply'
            ELSE 'sales' END AS data_category
FROM orders WHERE o_orderstatus <> 'P'
"""
MONTH_RULES = {"stocks": ["Month 1995-03"], "supply": ["Month 1996-05", "Month 1996-07"]}


@register("grid_table", f"SELECT * EXCLUDE (data_category) FROM ({_MONTHS_SQL}) q")
def grid_table(spark, d):
    """GRD1 + GRD3 + GRD8 + GRD9: all month sheets as one wide table, columns from the header cells."""
    cells = month_sheets(spark, d).filter(F.col("sheet") != "Index")
    path = scratch_path(spark, "month-cells")
    G.sheet_table(cells).write.parquet(path)
    return G.to_wide(spark.read.parquet(path)).withColumnRenamed("sheet", "source_sheet")


@register("grid_pipeline", f"""
SELECT data_category, name, count(*) AS n_rows, count(value) AS n_values, count(DISTINCT source_sheet) AS n_sheets,
       min(value) AS least, max(value) AS greatest
FROM (SELECT * EXCLUDE (row_idx) FROM ({_MONTHS_SQL}) q) w
     UNPIVOT INCLUDE NULLS (value FOR name IN ("Order_Key", "Status", "Total_AUD", "col", "total_AUD_1", "Ordered_on", "Day"))
GROUP BY data_category, name
HAVING data_category = 'sales' OR name <> CASE data_category WHEN 'stocks' THEN 'Ordered_on' WHEN 'supply' THEN 'Ordered_on' END
""")
def grid_pipeline(spark, d):
    """Parse, route and save the workbook; the saved tables described column by column."""
    saved = G.save_sheets(month_sheets(spark, d), scratch_path(spark, "sheets"), MONTH_RULES, "sales", exclude=["Index"])
    parts = []
    for path in saved.values():
        wide = spark.read.parquet(path)
        names = [c for c in wide.columns if c not in ("source_sheet", "row_idx", "data_category")]
        parts.append(wide.select("data_category", "source_sheet", *names).unpivot(["data_category", "source_sheet"], names, "name", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("data_category", "name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"), F.count_distinct("source_sheet").alias("n_sheets"),
        F.min("value").alias("least"), F.max("value").alias("greatest"))
