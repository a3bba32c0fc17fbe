"""The SQL every registered query must agree with, for DuckDB on the same tables.

Written apart from the library: plain SQL over one mapping of the tables to sales lines. Ranks have a full tie-break,
money is summed as DECIMAL and rounded by the same rule as in Spark.
"""

from __future__ import annotations

LINES = """
SELECT CAST(l_orderkey AS VARCHAR) AS InvoiceNo,
       CASE WHEN l_partkey % 50 = 0 THEN 'FEE' || CAST(l_partkey AS VARCHAR)
            WHEN l_partkey < 100000 THEN lpad(CAST(l_partkey AS VARCHAR), 5, '0')
            ELSE CAST(l_partkey AS VARCHAR) END AS StockCode,
       p_name AS Description,
       p_brand AS Brand,
       CAST(l_quantity AS BIGINT) AS Quantity,
       CAST(ROUND(CAST(l_extendedprice / NULLIF(l_quantity, 0) AS DECIMAL(38,6)), 2) AS DECIMAL(18,2)) AS UnitPrice,
       o_custkey AS CustomerID,
       cn.n_name AS Country,
       sn.n_name AS SupplierCountry,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS Revenue,
       {date} AS InvoiceDateTime,
       CAST({date} AS DATE) AS InvoiceDay,
       strftime({date}, '%Y-%m') AS YearMonth,
       CAST(year({date}) AS INTEGER) AS Year,
       CAST(quarter({date}) AS INTEGER) AS Quarter,
       CAST(month({date}) AS INTEGER) AS MonthNum,
       monthname({date}) AS MonthName,
       dayname({date}) AS WeekdayName,
       CAST(hour({date}) AS INTEGER) AS HourOfDay,
       CAST(o_orderdate AS DATE) AS OrderDay,
       l_orderkey, l_linenumber
FROM lineitem
LEFT JOIN orders ON o_orderkey = l_orderkey
LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN nation cn ON cn.n_nationkey = c_nationkey
LEFT JOIN part ON p_partkey = l_partkey
LEFT JOIN supplier ON s_suppkey = l_suppkey
LEFT JOIN nation sn ON sn.n_nationkey = s_nationkey
"""

EVENTS = """
SELECT CAST(event_id AS VARCHAR) AS InvoiceNo, user_id AS CustomerID, CAST(value AS DECIMAL(18,2)) AS Revenue,
       CAST(hour(ts) AS INTEGER) AS HourOfDay
FROM events
"""

PRODUCT = "regexp_matches(StockCode, '^[0-9]{5}')"
HOME = "NATION_0"


def sales(body: str, date: str = "o_orderdate", revenue: str = "") -> str:
    """body may start with further CTEs: 'name AS (…), … SELECT …'. ``revenue`` replaces the column by an expression."""
    lead = f"WITH s AS ({LINES.format(date=date)})"
    if revenue:
        lead = f"WITH given AS ({LINES.format(date=date)}), s AS (SELECT * REPLACE ({revenue} AS Revenue) FROM given)"
    return f"{lead}, {body.strip()}" if " AS (" in body.strip().split("SELECT")[0] else f"{lead} {body.strip()}"


def events(body: str) -> str:
    lead = f"WITH s AS ({EVENTS})"
    return f"{lead}, {body.strip()}" if " AS (" in body.strip().split("SELECT")[0] else f"{lead} {body.strip()}"


def r(x: str, digits: int = 2) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,6)), {digits}) AS DOUBLE)"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def pct(a: str, b: str) -> str:
    return f"(100.0 * CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def n(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def iso(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def amount_case(column: str, edges: tuple[int, ...]) -> str:
    arms = [f"WHEN {column} < {edges[0]} THEN '1 Under {edges[0]:,}'"]
    for i, (low, high) in enumerate(zip(edges, edges[1:]), start=2):
        arms.append(f"WHEN {column} < {high} THEN '{i} {low:,} - {high - 1:,}'")
    return f"CASE {' '.join(arms)} ELSE '{len(edges) + 1} {edges[-1]:,} and above' END"


ORDERS = "COUNT(DISTINCT InvoiceNo)"
BUYERS = "COUNT(DISTINCT CustomerID)"
QTY = n("SUM(Quantity)")
REV = r("SUM(Revenue)")
SHARE = r(pct("SUM(Revenue)", "(SELECT SUM(Revenue) FROM s)"))
AOV = r(div("SUM(Revenue)", ORDERS))
ASP = r(div("SUM(Revenue)", "SUM(Quantity)"))

CUST = f"cust AS (SELECT CustomerID, {ORDERS} AS orders, SUM(Revenue) AS revenue FROM s GROUP BY CustomerID)"
BY_ORDER = """o AS (SELECT InvoiceNo, SUM(Revenue) AS order_value, SUM(Quantity) AS units, COUNT(*) AS lines
                 FROM s GROUP BY InvoiceNo)"""
BIG = """big AS (SELECT InvoiceNo FROM s GROUP BY InvoiceNo ORDER BY SUM(Revenue) DESC, InvoiceNo LIMIT 1)"""

def tile(place: str, n_tiles: int) -> str:
    """The tile of a 0-based place among n: the first n % n_tiles tiles hold one more than the others."""
    small, longer = f"(n // {n_tiles})", f"(n % {n_tiles})"
    long_ones = f"({longer} * ({small} + 1))"
    return (
        f"CAST(1 + CASE WHEN {place} < {long_ones} THEN {place} // ({small} + 1)"
        f" ELSE {longer} + ({place} - {long_ones}) // greatest({small}, 1) END AS INTEGER)"
    )


# Scores from places and counts, segments from a table of rules of which the first that fits names the customer.
LAST_DAY = "(SELECT MAX(InvoiceDay) FROM s)"
RFM = f"""
orders_of AS (SELECT CustomerID, InvoiceNo, MAX(InvoiceDay) AS day, SUM(Revenue) AS paid FROM s GROUP BY CustomerID, InvoiceNo),
buyers AS (
  SELECT CustomerID, MAX(day) AS last_day, COUNT(InvoiceNo) AS frequency, {r('SUM(paid)')} AS monetary
  FROM orders_of GROUP BY CustomerID
), placed AS (
  SELECT *, CAST(date_diff('day', last_day, {LAST_DAY}) + 1 AS INTEGER) AS recency_days, COUNT(*) OVER () AS n,
         row_number() OVER (ORDER BY last_day DESC, CustomerID) - 1 AS by_day,
         row_number() OVER (ORDER BY frequency, monetary, CustomerID) - 1 AS by_orders,
         row_number() OVER (ORDER BY monetary, CustomerID) - 1 AS by_money
  FROM buyers
), rules AS (
  SELECT * FROM (VALUES
    (1, 'Champions', [4, 5], [4, 5]), (2, 'Loyal Customers', [3, 4, 5], [3, 4, 5]), (3, 'New / Promising', [4, 5], [1, 2]),
    (4, 'Need Attention', [3], [1, 2]), (5, 'Cannot Lose Them', [1, 2], [4, 5]), (6, 'At Risk', [1, 2], [2, 3, 4, 5]),
    (7, 'Lost / Hibernating', [1, 2, 3, 4, 5], [1, 2, 3, 4, 5])) AS t(place, name, r_fits, f_fits)
), rfm AS (
  SELECT p.CustomerID, p.recency_days, p.frequency, p.monetary, 6 - {tile('by_day', 5)} AS r_score,
         {tile('by_orders', 5)} AS f_score, {tile('by_money', 5)} AS m_score,
         (SELECT arg_min(name, place) FROM rules WHERE list_contains(r_fits, 6 - {tile('by_day', 5)})
            AND list_contains(f_fits, {tile('by_orders', 5)})) AS segment
  FROM placed p
)"""

FIRST = """
bought AS (SELECT DISTINCT CustomerID, date_trunc('month', InvoiceDay) AS month FROM s),
activity AS (
  SELECT CustomerID, strftime(month, '%Y-%m') AS YearMonth,
         strftime(min(month) OVER (PARTITION BY CustomerID), '%Y-%m') AS first_month,
         date_diff('month', min(month) OVER (PARTITION BY CustomerID), month) AS later
  FROM bought
)"""


def described(label: str, table: str, column: str, variance: bool, digits: int | None = None) -> str:
    def shown(x: str) -> str:
        return f"CAST({x} AS DOUBLE)" if digits is None else r(x, digits)

    middle = f"(SELECT {column} AS v, row_number() OVER (ORDER BY {column}) AS rn, COUNT(*) OVER () AS n FROM {table})"
    median = f"(SELECT SUM(v) FROM (SELECT v FROM {middle} WHERE rn = (n+1)//2 UNION ALL SELECT v FROM {middle} WHERE rn = (n+2)//2))"
    last = f", {r(f'var_pop(CAST({column} AS DOUBLE))')} AS variance" if variance else ""
    return f"""SELECT '{label}' AS metric, {shown(f'MIN({column})')} AS min_val,
      {r(div(f'SUM({column})', f'COUNT({column})'))} AS mean_val, {r(f'CAST({median} AS DOUBLE) / 2', 6 if digits is None else digits)} AS median_val,
      {shown(f'MAX({column})')} AS max_val{last} FROM {table}"""


def pareto(key: str, noun: str, cuts: list[tuple[str, str]], target_label: str, count_first: bool = False, revenue: str = "") -> str:
    shown = f"band, {noun}, cumulative_revenue_pct" if count_first else f"band, cumulative_revenue_pct, {noun}"
    rows = [
        f"SELECT 'Top {label}% of {noun}' AS band, {r(f'100.0 * MAX(CASE WHEN rnk <= n * CAST({cut} AS DOUBLE) THEN share END)')}"
        f" AS cumulative_revenue_pct, CAST(floor(MAX(n) * CAST({cut} AS DOUBLE)) AS BIGINT) AS {noun} FROM cum"
        for label, cut in cuts
    ]
    rows.append(
        f"SELECT '{target_label}', {r('100.0 * MIN(CASE WHEN share >= 0.8 THEN share END)')},"
        " MIN(CASE WHEN share >= 0.8 THEN rnk END) FROM cum"
    )
    return sales(
        f"""e AS (SELECT {key}, SUM(Revenue) AS revenue FROM s GROUP BY {key}),
        cum AS (SELECT {div('SUM(revenue) OVER (ORDER BY revenue DESC)', 'SUM(revenue) OVER ()')} AS share,
                       row_number() OVER (ORDER BY revenue DESC, {key}) AS rnk, COUNT(*) OVER () AS n FROM e)
        SELECT {shown} FROM ({" UNION ALL ".join(rows)})""",
        revenue=revenue,
    )


def top_products(columns: str, order: str, where: str = PRODUCT, having: str = "", outer: str = "*") -> str:
    return sales(f"""
      p AS (SELECT StockCode, MIN(Description) AS description, {columns} FROM s WHERE {where}
            GROUP BY StockCode {having})
      SELECT {outer} FROM p ORDER BY {order}, StockCode LIMIT 10""")


def usual_names(body: str) -> str:
    """Names by the most lines, ties by text; ``body`` selects from p (codes with their measures) and u (their names)."""
    return sales(f"""
      g AS (SELECT * REPLACE (CASE WHEN Quantity < 15 THEN 'A sample' ELSE Description END AS Description) FROM s),
      c AS (SELECT StockCode, Description, COUNT(*) AS n FROM g WHERE Description IS NOT NULL GROUP BY ALL),
      u AS (SELECT StockCode, Description FROM c QUALIFY row_number() OVER (PARTITION BY StockCode ORDER BY n DESC, Description) = 1),
      {body}""")


def pairs(code: str, description: str, where: str) -> str:
    return sales(f"""
      l AS (SELECT InvoiceNo, {code} AS code, {description} AS description FROM s),
      popular AS (SELECT code, MIN(description) AS description FROM l WHERE {where} GROUP BY code
                  ORDER BY COUNT(DISTINCT InvoiceNo) DESC, code LIMIT 30),
      baskets AS (SELECT list_sort(list(DISTINCT code)) AS held FROM l SEMI JOIN popular USING (code)
                  WHERE InvoiceNo IS NOT NULL GROUP BY InvoiceNo),
      firsts AS (SELECT held, unnest(range(1, len(held))) AS i FROM baskets),
      p AS (SELECT item_a, item_b, COUNT(*) AS orders_together
            FROM (SELECT held[i] AS item_a, unnest(held[i + 1:]) AS item_b FROM firsts) GROUP BY 1, 2)
      SELECT item_a, na.description AS description_a, item_b, nb.description AS description_b, orders_together,
             {r(pct('orders_together', '(SELECT COUNT(DISTINCT InvoiceNo) FROM l)'))} AS support_pct
      FROM p JOIN popular na ON na.code = item_a JOIN popular nb ON nb.code = item_b
      ORDER BY orders_together DESC, item_a, item_b LIMIT 10""")


def tukey() -> str:
    fence = "(q3 + {f} * (q3 - q1))"
    mild, extreme = fence.format(f="1.5"), fence.format(f="3.0")
    return f"""
      ranked AS (SELECT Revenue, row_number() OVER (ORDER BY Revenue) AS rn, COUNT(*) OVER () AS n FROM s),
      q AS (SELECT MAX(CASE WHEN rn = floor(n * 0.25) + 1 THEN Revenue END) AS q1,
                   MAX(CASE WHEN rn = floor(n * 0.75) + 1 THEN Revenue END) AS q3 FROM ranked)
      SELECT {r('MAX(q1)')} AS q1, {r('MAX(q3)')} AS q3, {r(f'MAX({mild})')} AS upper_fence,
             {r(f'MAX({extreme})')} AS extreme_fence,
             COUNT(CASE WHEN Revenue > {mild} THEN 1 END) AS mild_outlier_lines,
             COUNT(CASE WHEN Revenue > {extreme} THEN 1 END) AS extreme_outlier_lines,
             {r(pct(f'SUM(CASE WHEN Revenue > {extreme} THEN Revenue END)', 'SUM(Revenue)'))} AS extreme_outlier_revenue_pct
      FROM s, q"""


def flagged(rules: list[tuple[str, str]]) -> str:
    return sales(
        " UNION ALL ".join(
            f"SELECT '{label}' AS check_name, COUNT(*) AS rows_flagged, {REV} AS revenue FROM s WHERE {rule}"
            for label, rule in rules
        )
    )


def grouped(keys: str, columns: str, by_events: bool = False) -> str:
    names = ", ".join(str(i + 1) for i in range(len(keys.split(", "))))
    return (events if by_events else sales)(f"SELECT {keys}, {columns} FROM s GROUP BY {names}")


def order_statistics(revenue: str = "") -> str:
    columns = (("Order value", "order_value"), ("Units per order", "units"), ("Lines per order", "lines"))
    rows = " UNION ALL ".join(described(label, "o", c, False, 2) for label, c in columns)
    return sales(f"{BY_ORDER} {rows}", revenue=revenue)


def tiles(n_tiles: int, labels: list[str], revenue: str = "") -> str:
    return sales(
        f"""
          {CUST}, q AS (SELECT *, NTILE({n_tiles}) OVER (ORDER BY revenue DESC NULLS LAST, CustomerID) AS tile FROM cust)
          SELECT {labels}[tile] AS value_segment,
                 COUNT(*) AS customers, {r('MIN(revenue)')} AS min_revenue, {r('MAX(revenue)')} AS max_revenue,
                 {r(div('SUM(revenue)', 'COUNT(*)'))} AS avg_revenue, {r('SUM(revenue)')} AS revenue,
                 {r(pct('SUM(revenue)', '(SELECT SUM(revenue) FROM cust)'))} AS revenue_share_pct
          FROM q GROUP BY tile""",
        revenue=revenue,
    )


QUARTILES = [
    "Q1 - Top 25% (High value)",
    "Q2 - Upper-mid 25%",
    "Q3 - Lower-mid 25%",
    "Q4 - Bottom 25% (Low value)",
]
# every seventh customer, and the codes that end in 7, have no revenue at all
CUSTOMER_GAPS = "CASE WHEN CustomerID % 7 <> 0 THEN Revenue END"
CODE_GAPS = "CASE WHEN NOT suffix(StockCode, '7') THEN Revenue END"


def control() -> str:
    """Every measure from the lines; sums per order keep all of them, sums per order and product some."""
    per_order = "InvoiceNo CustomerID Country InvoiceDateTime InvoiceDay YearMonth Year Quarter MonthNum MonthName WeekdayName HourOfDay"
    per_item = "InvoiceNo CustomerID Country YearMonth StockCode Description".split()
    sums = {"Lines": "COUNT(*)", "Quantity": "SUM(Quantity)", "Revenue": "SUM(Revenue)"}
    rows = []
    for name in [*sums, *per_order.split()]:
        value = f"CAST({sums.get(name, f'COUNT(DISTINCT {name})')} AS DECIMAL(38,4))"
        items = value if name in sums or name in per_item else "CAST(NULL AS DECIMAL(38,4))"
        rows.append(f"SELECT '{name}' AS measure, {value} AS lines, {value} AS orders, {items} AS items, TRUE AS agrees FROM s")
    for name in ("StockCode", "Description"):
        value = f"CAST(COUNT(DISTINCT {name}) AS DECIMAL(38,4))"
        rows.append(f"SELECT '{name}', {value}, CAST(NULL AS DECIMAL(38,4)), {value}, TRUE FROM s")
    return sales(" UNION ALL ".join(rows))


def statements() -> dict[str, str]:
    found = _statements()
    # from shared sums, each report must be what it is from the lines
    again = {
        "s7_monthly_sales_from_sums": "q4_01_monthly_sales",
        "s7_headline_kpis_from_sums": "q3_01_headline_kpis",
        "s7_rfm_summary_from_sums": "q5_09_rfm_summary",
        "s7_top_products_by_orders_from_sums": "q6_03_top_products_by_orders",
        "s7_premium_products_from_sums": "q6_09_premium_products",
        "s7_country_league_from_sums": "q7_01_country_league",
        "s7_mart_product_from_sums": "q9_03_mart_product",
    }
    return {"s7_grain_control": control(), **{name: found[other] for name, other in again.items()}, **found}


def frequent(code: str, where: str, share: str) -> str:
    """Pairs and triples by self joins of the orders' distinct codes; support as a share of all orders."""
    return sales(f"""
      l AS (SELECT DISTINCT InvoiceNo AS o, {code} AS code FROM s WHERE {where}),
      n AS (SELECT COUNT(DISTINCT InvoiceNo) AS n FROM s),
      two AS (SELECT a.o, a.code AS a, b.code AS b FROM l a JOIN l b ON a.o = b.o AND a.code < b.code),
      sets AS (
        SELECT a || ' + ' || b AS items, 2 AS size, COUNT(*) AS orders FROM two GROUP BY a, b
        UNION ALL
        SELECT a || ' + ' || b || ' + ' || code, 3, COUNT(*) FROM two JOIN l ON l.o = two.o AND code > b GROUP BY a, b, code)
      SELECT items, size, orders, {r(pct('orders', 'n'))} AS support_pct FROM sets, n WHERE orders >= n * {share}""")


def rolled(keys: str, counted: str) -> str:
    """Exact counts; the estimates beside them must keep within their error."""
    columns = {"orders": "InvoiceNo", "customers": "CustomerID", "products": "StockCode", "countries": "Country"}
    counts = ", ".join(f"COUNT(DISTINCT {columns[m]}) AS {m}" for m in counted.split())
    within = ", ".join(f"TRUE AS {m}_within" for m in counted.split())
    lead = f"{keys}, " if keys else ""
    group = " GROUP BY " + ", ".join(str(i + 1) for i in range(len(keys.split(", ")))) if keys else ""
    return sales(f"SELECT {lead}COUNT(*) AS line_items, {QTY} AS quantity, {REV} AS revenue, {counts}, {within} FROM s{group}")


def _statements() -> dict[str, str]:
    key = "InvoiceNo, StockCode, Description, Quantity, InvoiceDateTime, UnitPrice, CustomerID, Country"

    def duplicates(keys: str) -> str:
        return sales(f"""
          SELECT COUNT(*) AS duplicate_groups, {n('SUM(cnt - 1)')} AS surplus_rows,
                 {r(pct('SUM(cnt - 1)', '(SELECT COUNT(*) FROM s)'))} AS pct_of_rows,
                 {r('SUM((cnt - 1) * line_revenue)')} AS revenue_in_surplus_rows
          FROM (SELECT MAX(Revenue) AS line_revenue, COUNT(*) AS cnt FROM s GROUP BY {keys} HAVING COUNT(*) > 1)""")

    return {
        "s2_prepare_sales": sales(f"""
          SELECT InvoiceNo, StockCode, trim(Description) AS Description, Quantity,
                 CAST(UnitPrice AS DECIMAL(18,4)) AS UnitPrice, CustomerID, Country,
                 CAST(Revenue AS DECIMAL(18,4)) AS Revenue, Year, Quarter, MonthName, WeekdayName,
                 {iso('InvoiceDateTime')} AS InvoiceDateTime, {iso('InvoiceDay')} AS InvoiceDay, YearMonth, MonthNum,
                 HourOfDay FROM s"""),
        "s2_rejected_lines": sales("""
          SELECT InvoiceNo, StockCode, CAST(Quantity AS VARCHAR) AS Quantity,
                 CASE WHEN Quantity = 13 THEN 'unknown' ELSE strftime(InvoiceDateTime, '%d-%m-%Y %H:%M') END AS InvoiceDate,
                 CASE WHEN Quantity = 17 THEN 'n/a' ELSE CAST(UnitPrice AS VARCHAR) END AS UnitPrice
          FROM s WHERE Quantity IN (13, 17)"""),
        "q2_01_table_shape": sales(f"""
          SELECT COUNT(*) AS total_rows, {ORDERS} AS distinct_invoices, {iso('MIN(InvoiceDateTime)')} AS first_transaction,
                 {iso('MAX(InvoiceDateTime)')} AS last_transaction,
                 CAST(date_diff('day', MIN(InvoiceDay), MAX(InvoiceDay)) + 1 AS INTEGER) AS days_covered FROM s"""),
        "q2_02_null_blank_counts": sales(
            f"""g AS (SELECT * REPLACE (CASE WHEN Description LIKE 'hot%' THEN '  ' ELSE Description END AS Description,
                   CASE WHEN Country = '{HOME}' THEN NULL ELSE Country END AS Country,
                   CASE WHEN Quantity <> 13 THEN Quantity END AS Quantity) FROM s) """
            + " UNION ALL ".join(
                f"SELECT '{label}' AS column_name, {n(f'SUM(CASE WHEN {test} THEN 1 ELSE 0 END)')} AS null_or_blank FROM g"
                for label, test in [
                    ("InvoiceNo", "InvoiceNo IS NULL"),
                    ("StockCode", "StockCode IS NULL OR trim(StockCode) = ''"),
                    ("Description", "Description IS NULL OR trim(Description) = ''"),
                    ("Quantity", "Quantity IS NULL"),
                    ("InvoiceDate", "InvoiceDateTime IS NULL"),
                    ("UnitPrice", "UnitPrice IS NULL"),
                    ("CustomerID", "CustomerID IS NULL"),
                    ("Country", "Country IS NULL OR trim(Country) = ''"),
                    ("Revenue", "Revenue IS NULL"),
                ]
            )
        ),
        "q2_03_duplicate_summary": duplicates(key),
        "q2_03_duplicate_line_numbers": duplicates("l_orderkey, l_linenumber"),
        "q2_04_rule_violations": sales(f"""
          SELECT {n('SUM(CAST(Quantity <= 0 AS INTEGER))')} AS non_positive_quantity,
                 {n('SUM(CAST(UnitPrice <= 0 AS INTEGER))')} AS non_positive_price,
                 {n('SUM(CAST(Revenue <= 0 AS INTEGER))')} AS non_positive_revenue,
                 {n("SUM(CAST(InvoiceNo ILIKE 'C%' AS INTEGER))")} AS cancelled_invoices,
                 {n('SUM(CAST(ABS(Revenue - Quantity * UnitPrice) > 0.01 AS INTEGER))')} AS revenue_formula_mismatch
          FROM s"""),
        "q2_05_calendar_consistency": sales(
            f"""
          SELECT {n('SUM(CAST(Year <> year(OrderDay) AS INTEGER))')} AS year_mismatch,
                 {n('SUM(CAST(Quarter <> quarter(OrderDay) AS INTEGER))')} AS quarter_mismatch_calendar,
                 {n('SUM(CASE WHEN MonthName <> monthname(OrderDay) THEN 1 ELSE 0 END)')} AS month_name_mismatch,
                 {n('SUM(CAST(WeekdayName <> dayname(OrderDay) AS INTEGER))')} AS weekday_mismatch
          FROM s""",
            "l_shipdate",
        ),
        "q2_06_cardinality": sales(f"""
          SELECT {BUYERS} AS customers, COUNT(DISTINCT StockCode) AS stock_codes, COUNT(DISTINCT Description) AS descriptions,
                 COUNT(DISTINCT Country) AS countries, COUNT(DISTINCT YearMonth) AS months_covered FROM s"""),
        "q2_07_nonconforming_codes": sales(f"""
          SELECT StockCode, MIN(Description) AS description, COUNT(*) AS line_items, {QTY} AS qty, {REV} AS revenue
          FROM s WHERE NOT {PRODUCT} GROUP BY StockCode"""),
        "q2_08_code_descriptions": sales("""
          SELECT Description AS StockCode, COUNT(DISTINCT Brand) AS description_variants FROM s GROUP BY Description
          HAVING COUNT(DISTINCT Brand) > 1 ORDER BY description_variants DESC, Description LIMIT 15"""),
        "q2_09_customer_countries": sales("""
          SELECT CustomerID, COUNT(DISTINCT SupplierCountry) AS countries FROM s GROUP BY CustomerID
          HAVING COUNT(DISTINCT SupplierCountry) > 1"""),
        "q2_10_invoice_dependencies": sales(
            f"""
          SELECT {n('SUM(CASE WHEN ts > 1 THEN 1 ELSE 0 END)')} AS invoices_with_multiple_timestamps,
                 {n('SUM(CASE WHEN cu > 1 THEN 1 ELSE 0 END)')} AS invoices_with_multiple_customers
          FROM (SELECT COUNT(DISTINCT InvoiceDateTime) AS ts, {BUYERS} AS cu FROM s GROUP BY InvoiceNo)""",
            "l_shipdate",
        ),
        "q2_11_flag_extremes": flagged(
            [
                ("Quantity > 45", "Quantity > 45"),
                ("UnitPrice > 10000", "UnitPrice > 10000"),
                ("Line revenue > 100000", "Revenue > 100000"),
                ("UnitPrice < 100", "UnitPrice < 100"),
                ("UnitPrice < 0", "UnitPrice < 0"),
            ]
        ),
        "q2_12_period_coverage": sales(f"""
          SELECT YearMonth, COUNT(*) AS rows_in_month, {iso('MIN(InvoiceDay)')} AS first_day,
                 {iso('MAX(InvoiceDay)')} AS last_day, COUNT(DISTINCT InvoiceDay) AS active_days FROM s GROUP BY YearMonth"""),
        "q2_13_day_of_month_coverage": sales("""
          SELECT CAST(day(InvoiceDay) AS INTEGER) AS day_of_month, COUNT(*) AS rows_on_that_day,
                 COUNT(DISTINCT YearMonth) AS months_with_data FROM s GROUP BY 1"""),
        "q3_01_headline_kpis": sales(f"""
          SELECT COUNT(*) AS line_items, {ORDERS} AS total_orders, {BUYERS} AS total_customers,
                 COUNT(DISTINCT StockCode) AS total_products, COUNT(DISTINCT Country) AS total_countries,
                 {QTY} AS quantity_sold, {REV} AS total_revenue, {AOV} AS avg_order_value, {ASP} AS avg_selling_price,
                 {r(div('SUM(Revenue)', BUYERS))} AS revenue_per_customer,
                 {r(div(ORDERS, BUYERS))} AS orders_per_customer, {r(div('COUNT(*)', ORDERS))} AS lines_per_order,
                 {r(div('SUM(Quantity)', ORDERS))} AS units_per_order FROM s"""),
        "q3_02_repeat_kpis": sales(f"""
          {CUST}
          SELECT COUNT(*) AS customers, {n('SUM(CAST(orders > 1 AS INTEGER))')} AS repeat_customers,
                 {n('SUM(CAST(orders = 1 AS INTEGER))')} AS one_time_customers,
                 {r(pct('SUM(CAST(orders > 1 AS INTEGER))', 'COUNT(*)'))} AS repeat_rate_pct,
                 {r(pct('SUM(CASE WHEN orders > 1 THEN revenue END)', 'SUM(revenue)'))} AS revenue_share_from_repeat_pct
          FROM cust"""),
        "q3_03_yearly_sales": grouped(
            "Year",
            f"{ORDERS} AS orders, {BUYERS} AS customers, {QTY} AS quantity, {REV} AS revenue, {SHARE} AS revenue_share_pct",
        ),
        "q3_04_describe_measures": sales(
            " UNION ALL ".join(described(c, "s", c, True) for c in ("Quantity", "UnitPrice", "Revenue"))
        ),
        "q3_05_describe_orders": order_statistics(),
        "q3_05_describe_orders_fine_money": order_statistics("CAST(Revenue + l_linenumber * 0.0007 AS DECIMAL(18,4))"),
        "q4_01_monthly_sales": sales(f"""
          m AS (SELECT YearMonth, {ORDERS} AS orders, {BUYERS} AS customers, {QTY} AS quantity, SUM(Revenue) AS rev
                FROM s GROUP BY YearMonth)
          SELECT YearMonth, orders, customers, quantity, {r('rev')} AS revenue, {r(div('rev', 'orders'))} AS aov,
                 {r(pct('(rev - LAG(rev) OVER (ORDER BY YearMonth))', 'LAG(rev) OVER (ORDER BY YearMonth)'))} AS mom_growth_pct
          FROM m"""),
        "q4_02_running_and_moving": sales(f"""
          m AS (SELECT YearMonth, SUM(Revenue) AS rev FROM s GROUP BY YearMonth)
          SELECT YearMonth, {r('rev')} AS revenue, {r('SUM(rev) OVER (ORDER BY YearMonth)')} AS cumulative_revenue,
                 {r(div('SUM(rev) OVER w', 'COUNT(rev) OVER w'))} AS moving_avg_3m
          FROM m WINDOW w AS (ORDER BY YearMonth ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""),
        "q4_03_quarterly_sales": grouped(
            "Year, Quarter", f"{ORDERS} AS orders, {QTY} AS quantity, {REV} AS revenue, {SHARE} AS revenue_share_pct"
        ),
        "q4_04_seasonality": grouped(
            "MonthNum, MonthName",
            f"COUNT(DISTINCT YearMonth) AS months_in_data, {REV} AS revenue,"
            f" {r(div('SUM(Revenue)', 'COUNT(DISTINCT YearMonth)'))} AS avg_revenue_per_month, {ORDERS} AS orders",
        ),
        "q4_05_weekday_sales": grouped(
            "WeekdayName",
            f"{ORDERS} AS orders, {QTY} AS quantity, {REV} AS revenue, {SHARE} AS revenue_share_pct, {AOV} AS aov",
        ),
        "q4_06_hourly_sales": grouped(
            "HourOfDay", f"{ORDERS} AS orders, {REV} AS revenue, {SHARE} AS revenue_share_pct", by_events=True
        ),
        "q4_07_day_part_sales": events(f"""
          SELECT CASE WHEN HourOfDay < 12 THEN '1 Morning (before 12)' WHEN HourOfDay < 15 THEN '2 Midday (12-14)'
                      WHEN HourOfDay < 18 THEN '3 Afternoon (15-17)' ELSE '4 Evening (18+)' END AS day_part,
                 {ORDERS} AS orders, {REV} AS revenue, {SHARE} AS revenue_share_pct FROM s GROUP BY 1"""),
        "q4_08_best_days": sales(f"""
          d AS (SELECT InvoiceDay, WeekdayName, {ORDERS} AS orders, {REV} AS revenue FROM s GROUP BY 1, 2)
          SELECT {iso('InvoiceDay')} AS InvoiceDay, WeekdayName, orders, revenue FROM d
          ORDER BY revenue DESC, d.InvoiceDay LIMIT 10"""),
        "q4_09_revenue_per_active_day": grouped(
            "YearMonth",
            f"COUNT(DISTINCT InvoiceDay) AS active_days, {REV} AS revenue,"
            f" {r(div('SUM(Revenue)', 'COUNT(DISTINCT InvoiceDay)'))} AS revenue_per_active_day",
        ),
        "q4_10_monthly_excluding_top_order": sales(f"""
          {BIG}
          SELECT YearMonth, {REV} AS revenue_as_provided,
                 {r('SUM(CASE WHEN InvoiceNo NOT IN (SELECT InvoiceNo FROM big) THEN Revenue ELSE 0 END)')}
                   AS revenue_excl_largest_order FROM s GROUP BY YearMonth"""),
        "q5_01_top_customers_by_revenue": sales(f"""
          SELECT CustomerID, MIN(Country) AS country, {ORDERS} AS orders, {QTY} AS quantity, {REV} AS revenue,
                 {SHARE} AS revenue_share_pct FROM s GROUP BY CustomerID ORDER BY 5 DESC, CustomerID LIMIT 10"""),
        "q5_02_top_customers_by_orders": sales(f"""
          SELECT CustomerID, MIN(Country) AS country, {ORDERS} AS orders, {REV} AS revenue, {AOV} AS aov
          FROM s GROUP BY CustomerID ORDER BY 3 DESC, 4 DESC, CustomerID LIMIT 10"""),
        "q5_03_order_frequency_bands": sales(f"""
          {CUST}
          SELECT CASE WHEN orders = 1 THEN '1 order' WHEN orders = 2 THEN '2 orders' WHEN orders <= 5 THEN '3-5 orders'
                      WHEN orders <= 10 THEN '6-10 orders' ELSE '11+ orders' END AS order_frequency_band,
                 COUNT(*) AS customers, {r(pct('COUNT(*)', '(SELECT COUNT(*) FROM cust)'))} AS customer_share_pct,
                 {r('SUM(revenue)')} AS revenue,
                 {r(pct('SUM(revenue)', '(SELECT SUM(revenue) FROM cust)'))} AS revenue_share_pct
          FROM cust GROUP BY 1"""),
        "q5_04_value_quartiles": tiles(4, QUARTILES),
        "q5_04_value_quartiles_gaps": tiles(4, QUARTILES, CUSTOMER_GAPS),
        "q5_04_value_deciles": tiles(10, [f"Q{i} of 10" for i in range(1, 11)]),
        "q5_05_repeat_vs_onetime": sales(f"""
          {CUST}
          SELECT CASE WHEN orders > 1 THEN 'Repeat' ELSE 'One-time' END AS customer_type, COUNT(*) AS customers,
                 {r('SUM(revenue)')} AS revenue, {r(div('SUM(revenue)', 'COUNT(*)'))} AS avg_revenue_per_customer,
                 {r(div('SUM(orders)', 'COUNT(*)'))} AS avg_orders, {r(div('SUM(revenue)', 'SUM(orders)'))} AS aov
          FROM cust GROUP BY 1"""),
        "q5_06_new_vs_returning": sales(f"""
          {FIRST}
          SELECT YearMonth, {n('SUM(CAST(YearMonth = first_month AS INTEGER))')} AS new_customers,
                 {n('SUM(CAST(YearMonth > first_month AS INTEGER))')} AS returning_customers, COUNT(*) AS active_customers,
                 {r(pct('SUM(CAST(YearMonth > first_month AS INTEGER))', 'COUNT(*)'))} AS returning_pct
          FROM activity GROUP BY YearMonth"""),
        "q5_07_purchase_span": sales(f"""
          sp AS (SELECT date_diff('day', MIN(InvoiceDay), MAX(InvoiceDay)) AS days, {ORDERS} AS orders
                 FROM s GROUP BY CustomerID HAVING {ORDERS} > 1)
          SELECT COUNT(*) AS repeat_customers, {r(div('SUM(days)', 'COUNT(*)'), 1)} AS avg_days_between_first_last,
                 {r(div(f"SUM(CAST({div('days', 'orders - 1')} AS DECIMAL(18,9)))", 'COUNT(*)'), 1)} AS avg_days_between_orders,
                 CAST(MAX(days) AS DOUBLE) AS max_days_active FROM sp"""),
        "q5_08_rfm": sales(f"""
          {RFM} SELECT CustomerID, recency_days, frequency, monetary, r_score, f_score, m_score, segment FROM rfm"""),
        "q5_08_rfm_snapshot": sales(f"""
          {RFM.replace(LAST_DAY, "DATE '2001-01-01'")}
          SELECT CustomerID, recency_days, frequency, monetary, r_score, f_score, m_score, segment FROM rfm"""),
        "q5_09_rfm_summary": sales(f"""
          {RFM}
          SELECT segment, COUNT(*) AS customers, {r(pct('COUNT(*)', '(SELECT COUNT(*) FROM rfm)'))} AS customer_share_pct,
                 {r(div('SUM(recency_days)', 'COUNT(*)'), 1)} AS avg_recency_days,
                 {r(div('SUM(frequency)', 'COUNT(*)'))} AS avg_orders,
                 {r(div('SUM(CAST(monetary AS DECIMAL(18,2)))', 'COUNT(*)'))} AS avg_revenue,
                 {r('SUM(CAST(monetary AS DECIMAL(18,2)))')} AS revenue,
                 {r(pct('SUM(CAST(monetary AS DECIMAL(18,2)))', '(SELECT SUM(CAST(monetary AS DECIMAL(18,2))) FROM rfm)'))}
                   AS revenue_share_pct
          FROM rfm GROUP BY segment"""),
        "q5_10_cohort_retention": sales(
            f"{FIRST} SELECT first_month AS cohort, {n('SUM(CAST(later = 0 AS INTEGER))')} AS cohort_size, "
            + ", ".join(
                f"{r(pct(f'SUM(CAST(later = {m} AS INTEGER))', 'SUM(CAST(later = 0 AS INTEGER))'), 1)} AS m{m}_pct"
                for m in (1, 2, 3, 6, 12)
            )
            + " FROM activity GROUP BY first_month"
        ),
        "q5_10_cohort_retention_censored": sales(
            f"{FIRST} SELECT first_month AS cohort, {n('SUM(CAST(later = 0 AS INTEGER))')} AS cohort_size, "
            + ", ".join(
                f"CASE WHEN date_diff('month', CAST(first_month || '-01' AS DATE), (SELECT MAX(month) FROM bought)) >= {m}"
                f" THEN {r(pct(f'SUM(CAST(later = {m} AS INTEGER))', 'SUM(CAST(later = 0 AS INTEGER))'), 1)} END AS m{m}_pct"
                for m in (1, 2, 3, 6, 12)
            )
            + " FROM activity GROUP BY first_month"
        ),
        "q9_01_year_from_months": rolled("Year", "orders customers products countries"),
        "q9_01_quarter_from_months": rolled("Year, Quarter", "orders customers products countries"),
        "q3_01_totals_from_months": rolled("", "orders customers products countries"),
        "q9_04_market_from_countries": rolled(
            f"CASE WHEN Country = '{HOME}' THEN '{HOME}' ELSE 'International' END AS market", "orders customers products"
        ),
        "q5_10_purchase_gaps": sales("""
          bought AS (SELECT DISTINCT CustomerID, date_trunc('month', InvoiceDay) AS month FROM s WHERE CustomerID IS NOT NULL),
          gaps AS (SELECT CustomerID, CAST(date_diff('month', lag(month) OVER (PARTITION BY CustomerID ORDER BY month), month)
                   AS INTEGER) AS gap_months FROM bought)
          SELECT gap_months, COUNT(*) AS gaps, COUNT(DISTINCT CustomerID) AS customers FROM gaps
          WHERE gap_months IS NOT NULL GROUP BY gap_months"""),
        "q6_01_top_products_by_revenue": top_products(
            f"{QTY} AS quantity, {ORDERS} AS orders, {REV} AS revenue, {ASP} AS avg_selling_price, {SHARE} AS revenue_share_pct",
            "revenue DESC",
        ),
        "q6_01_usual_names": usual_names(f"""
          p AS (SELECT StockCode, {QTY} AS quantity, {ORDERS} AS orders, {REV} AS revenue, {ASP} AS avg_selling_price,
                       {SHARE} AS revenue_share_pct FROM s WHERE {PRODUCT} GROUP BY StockCode)
          SELECT StockCode, Description AS description, quantity, orders, revenue, avg_selling_price, revenue_share_pct
          FROM p LEFT JOIN u USING (StockCode) ORDER BY revenue DESC, StockCode LIMIT 10"""),
        "q9_03_usual_names": usual_names(f"""
          p AS (SELECT StockCode, {ORDERS} AS orders, {BUYERS} AS customers, {QTY} AS quantity, {REV} AS revenue,
                       {ASP} AS avg_selling_price FROM s GROUP BY StockCode)
          SELECT StockCode, Description, orders, customers, quantity, revenue, avg_selling_price
          FROM p LEFT JOIN u USING (StockCode)"""),
        "q6_02_top_products_by_quantity": top_products(
            f"{QTY} AS quantity, {REV} AS revenue, {ASP} AS avg_selling_price", "quantity DESC"
        ),
        "q6_03_top_products_by_orders": top_products(
            f"{ORDERS} AS orders_containing, {r(pct(ORDERS, f'(SELECT {ORDERS} FROM s)'))} AS order_penetration_pct,"
            f" {BUYERS} AS customers",
            "orders_containing DESC",
        ),
        "q6_04_bottom_products": top_products(
            f"{QTY} AS quantity, {REV} AS revenue", "revenue", having="HAVING SUM(Quantity) >= 10"
        ),
        "q6_05_price_bands": sales(f"""
          SELECT {amount_case('UnitPrice', (500, 1000, 2500, 5000, 10000))} AS price_band,
                 COUNT(DISTINCT StockCode) AS products, {QTY} AS quantity, {REV} AS revenue, {SHARE} AS revenue_share_pct,
                 {r(pct('SUM(Quantity)', '(SELECT SUM(Quantity) FROM s)'))} AS quantity_share_pct FROM s GROUP BY 1"""),
        "q6_06_code_type_split": sales(f"""
          SELECT CASE WHEN {PRODUCT} THEN 'Product' ELSE 'Non-product (fees/postage/manual)' END AS code_type,
                 COUNT(DISTINCT StockCode) AS codes, COUNT(*) AS line_items, {REV} AS revenue, {SHARE} AS revenue_share_pct
          FROM s GROUP BY 1"""),
        "q6_07_top_products_by_countries": top_products(
            f"COUNT(DISTINCT Country) AS countries, {REV} AS revenue", "countries DESC, revenue DESC"
        ),
        "q6_08_product_pareto": pareto(
            "StockCode", "products", [("10", "0.1"), ("20", "0.2")], "Products needed for 80% revenue"
        ),
        "q6_08_product_pareto_gaps": pareto(
            "StockCode",
            "products",
            [("10", "0.1"), ("20", "0.2")],
            "Products needed for 80% revenue",
            revenue=CODE_GAPS,
        ),
        "q6_09_premium_products": top_products(
            f"{r(div('SUM(UnitPrice)', 'COUNT(UnitPrice)'))} AS avg_unit_price, {QTY} AS quantity, {REV} AS revenue",
            "avg_unit_price DESC",
            having="HAVING SUM(UnitPrice) / COUNT(UnitPrice) >= 20",
        ),
        "q7_01_country_league": grouped(
            "Country",
            f"{BUYERS} AS customers, {ORDERS} AS orders, {QTY} AS quantity, {REV} AS revenue, {SHARE} AS revenue_share_pct,"
            f" {AOV} AS aov, {r(div('SUM(Revenue)', BUYERS))} AS revenue_per_customer",
        ),
        "q7_02_home_vs_rest": sales(f"""
          SELECT CASE WHEN Country = '{HOME}' THEN '{HOME}' ELSE 'International' END AS market,
                 COUNT(DISTINCT Country) AS countries, {BUYERS} AS customers, {ORDERS} AS orders, {REV} AS revenue,
                 {SHARE} AS revenue_share_pct, {AOV} AS aov, {r(div('SUM(Revenue)', BUYERS))} AS revenue_per_customer,
                 {r(div('SUM(Quantity)', ORDERS), 1)} AS units_per_order FROM s GROUP BY 1"""),
        "q7_03_repeat_rate_by_country": sales(f"""
          c AS (SELECT Country, CustomerID, {ORDERS} AS orders FROM s GROUP BY 1, 2)
          SELECT Country, COUNT(*) AS customers, {n('SUM(CAST(orders > 1 AS INTEGER))')} AS repeat_customers,
                 {r(pct('SUM(CAST(orders > 1 AS INTEGER))', 'COUNT(*)'))} AS repeat_rate_pct
          FROM c GROUP BY Country HAVING COUNT(*) >= 20"""),
        "q7_04_top_products_per_country": sales(f"""
          t AS (SELECT Country FROM s WHERE Country <> '{HOME}' GROUP BY Country
                ORDER BY SUM(Revenue) DESC, Country LIMIT 5),
          k AS (SELECT Country, StockCode, MIN(Description) AS description, {QTY} AS quantity, {REV} AS revenue,
                       row_number() OVER (PARTITION BY Country ORDER BY SUM(Revenue) DESC, StockCode) AS rnk
                FROM s WHERE {PRODUCT} AND Country IN (SELECT Country FROM t) GROUP BY Country, StockCode)
          SELECT Country, CAST(rnk AS INTEGER) AS rank_in_country, StockCode, description, quantity, revenue
          FROM k WHERE rnk <= 3"""),
        "q7_05_monthly_home_vs_rest": sales(f"""
          SELECT YearMonth, {r(f"SUM(CASE WHEN Country = '{HOME}' THEN Revenue ELSE 0 END)")} AS uk_revenue,
                 {r(f"SUM(CASE WHEN Country <> '{HOME}' THEN Revenue ELSE 0 END)")} AS international_revenue,
                 {r(pct(f"SUM(CASE WHEN Country <> '{HOME}' THEN Revenue ELSE 0 END)", 'SUM(Revenue)'))}
                   AS international_share_pct FROM s GROUP BY YearMonth"""),
        "q8_01_customer_pareto": pareto(
            "CustomerID",
            "customers",
            [("1", "0.01"), ("5", "0.05"), ("10", "0.1"), ("20", "0.2")],
            "Customers needed for 80% of revenue",
            count_first=True,
        ),
        "q8_01_customer_pareto_gaps": pareto(
            "CustomerID",
            "customers",
            [("1", "0.01"), ("5", "0.05"), ("10", "0.1"), ("20", "0.2")],
            "Customers needed for 80% of revenue",
            count_first=True,
            revenue=CUSTOMER_GAPS,
        ),
        "q8_02_order_value_bands": sales(f"""
          {BY_ORDER}
          SELECT {amount_case('order_value', (75000, 125000, 200000, 300000, 400000))} AS order_value_band,
                 COUNT(*) AS orders, {r(pct('COUNT(*)', '(SELECT COUNT(*) FROM o)'))} AS order_share_pct,
                 {r('SUM(order_value)')} AS revenue,
                 {r(pct('SUM(order_value)', '(SELECT SUM(order_value) FROM o)'))} AS revenue_share_pct FROM o GROUP BY 1"""),
        "q8_03_basket_size_bands": sales(f"""
          b AS (SELECT COUNT(DISTINCT StockCode) AS items FROM s GROUP BY InvoiceNo)
          SELECT CASE WHEN items = 1 THEN '1 item' WHEN items = 2 THEN '2 items' WHEN items <= 4 THEN '3-4 items'
                      WHEN items <= 6 THEN '5-6 items' WHEN items <= 8 THEN '7-8 items' ELSE '9+ items' END AS basket_size,
                 COUNT(*) AS orders, {r(pct('COUNT(*)', '(SELECT COUNT(*) FROM b)'))} AS order_share_pct
          FROM b GROUP BY 1"""),
        "q8_04_basket_pairs": pairs("StockCode", "Description", "regexp_matches(code, '^[0-9]{5}')"),
        "q8_04_brand_pairs": pairs("Brand", "upper(Brand)", "true"),
        "q8_04_frequent_sets": frequent("Brand", "true", "0.006"),
        "q8_04_frequent_product_sets": frequent("StockCode", PRODUCT, "0.0001"),
        "q8_05_tukey_upper": events(tukey()),
        "q8_05_tukey_upper_lines": sales(tukey()),
        "q8_06_largest_lines": sales(f"""
          SELECT InvoiceNo, {iso('InvoiceDateTime')} AS InvoiceDateTime, CustomerID, Country, StockCode, Description,
                 Quantity, CAST(UnitPrice AS DOUBLE) AS UnitPrice, {r('Revenue')} AS revenue FROM s
          ORDER BY {r('Revenue')} DESC, InvoiceNo, s.InvoiceDateTime, CustomerID, Country, StockCode, Description, Quantity,
                   s.UnitPrice LIMIT 10"""),
        "q8_07_sensitivity_top_order": sales(f"""
          {BIG}
          SELECT 'As provided' AS scenario, {REV} AS total_revenue, {ORDERS} AS orders, {AOV} AS aov, {ASP} AS asp FROM s
          UNION ALL
          SELECT 'Without largest order', {REV}, {ORDERS}, {AOV}, {ASP} FROM s
          WHERE InvoiceNo NOT IN (SELECT InvoiceNo FROM big)"""),
        "q8_08_sensitivity_dedup": sales(f"""
          d AS (SELECT DISTINCT {key}, Revenue FROM s)
          SELECT 'As provided' AS scenario, COUNT(*) AS line_items, {REV} AS total_revenue, {QTY} AS quantity FROM s
          UNION ALL SELECT 'Duplicates removed', COUNT(*), {REV}, {QTY} FROM d"""),
        "q8_08_sensitivity_dedup_line_numbers": sales(f"""
          d AS (SELECT MIN(Revenue) AS Revenue, MIN(Quantity) AS Quantity FROM s GROUP BY l_orderkey, l_linenumber)
          SELECT 'As provided' AS scenario, COUNT(*) AS line_items, {REV} AS total_revenue, {QTY} AS quantity FROM s
          UNION ALL SELECT 'Duplicates removed', COUNT(*), {REV}, {QTY} FROM d"""),
        "q8_09_correlation": sales(f"""
          SELECT {r('corr(CAST(UnitPrice AS DOUBLE), CAST(Quantity AS DOUBLE))', 4)} AS corr_price_quantity FROM s"""),
        "q8_10_invoice_timestamps": sales(
            f"""
          SELECT InvoiceNo, MIN(CustomerID) AS CustomerID, COUNT(DISTINCT InvoiceDateTime) AS timestamps,
                 {iso('MIN(InvoiceDateTime)')} AS first_ts, {iso('MAX(InvoiceDateTime)')} AS last_ts
          FROM s GROUP BY InvoiceNo HAVING COUNT(DISTINCT InvoiceDateTime) > 1""",
            "l_shipdate",
        ),
        "q9_01_mart_monthly": grouped(
            "YearMonth, Year, MonthNum, MonthName",
            f"{ORDERS} AS orders, {BUYERS} AS customers, {QTY} AS quantity, {REV} AS revenue, {AOV} AS aov",
        ),
        "q9_02_mart_customer": sales(f"""
          SELECT CustomerID, MIN(Country) AS Country, {iso('MIN(InvoiceDay)')} AS first_purchase,
                 {iso('MAX(InvoiceDay)')} AS last_purchase, {ORDERS} AS orders, {QTY} AS quantity, {REV} AS revenue,
                 {AOV} AS aov, CASE WHEN {ORDERS} > 1 THEN 'Repeat' ELSE 'One-time' END AS customer_type
          FROM s GROUP BY CustomerID"""),
        "q9_03_mart_product": sales(f"""
          SELECT StockCode, MIN(Description) AS Description, {ORDERS} AS orders, {BUYERS} AS customers, {QTY} AS quantity,
                 {REV} AS revenue, {ASP} AS avg_selling_price FROM s GROUP BY StockCode"""),
        "q9_04_mart_country": grouped(
            "Country",
            f"{BUYERS} AS customers, {ORDERS} AS orders, {QTY} AS quantity, {REV} AS revenue, {AOV} AS aov",
        ),
        "q9_05_mart_counts": sales("""
          m AS (SELECT DISTINCT YearMonth, Year, MonthNum, MonthName FROM s)
          SELECT (SELECT COUNT(*) FROM m) AS monthly_rows,
                 (SELECT COUNT(*) FROM (SELECT DISTINCT CustomerID FROM s)) AS customer_rows,
                 (SELECT COUNT(*) FROM (SELECT DISTINCT StockCode FROM s)) AS product_rows,
                 (SELECT COUNT(*) FROM (SELECT DISTINCT Country FROM s)) AS country_rows,
                 (SELECT COUNT(*) FROM (SELECT DISTINCT CustomerID FROM s)) AS rfm_rows"""),
        "x1_top_international": sales(f"""
          SELECT Country, {REV} AS revenue FROM s WHERE Country <> '{HOME}' GROUP BY Country
          ORDER BY 2 DESC, Country LIMIT 10"""),
    }
