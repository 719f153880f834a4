"""Equivalent DuckDB SQL for every registered query (the correctness oracle).

Written independently of the Spark code: plain SQL over the driver's tables,
with the domain views of FIXTURES.md §2 as CTEs. Only the fixed lists (rules,
lines, member lists as written, option lists) are shared, rendered as VALUES /
list literals; columns, membership, levels and repairs are spelt out here.
Money sums use the same exact DECIMAL(38,6) accumulation as the Spark side.
"""

from __future__ import annotations

from .. import fixed

ACCOUNT_NAMES = [d for _, d in fixed.ACCOUNTS]
RATIOS = fixed.RATIO_FIELDS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def qi(s: str) -> str:
    """SQL identifier."""
    return '"' + s.replace('"', '""') + '"'


def lst(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(values: list[str], key: str) -> str:
    return f"({lst(values)})[({key}) % {len(values)} + 1]"


def msum(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(38,6))) AS DOUBLE)"


def week_end(d: str) -> str:
    return (f"CASE WHEN day({d}) <= 28 THEN make_date(year({d}), month({d}), "
            f"CAST(ceil(day({d}) / 7) AS INTEGER) * 7) ELSE last_day({d}) END")


def split(amount: str, ratio: str) -> str:
    return f"({amount}) / NULLIF({ratio}, 0) * 100"


def _ledger(income: bool, forecast: bool) -> str:
    if income:
        heads = fixed.INCOME_FORECAST_HEADS if forecast else fixed.INCOME_ACTUAL_HEADS
        accounts = fixed.INCOME_ACCOUNTS
    else:
        heads, accounts = fixed.EXPENSE_HEADS, fixed.EXPENSE_ACCOUNTS
    week = ", CAST(NULL AS DATE) AS week_date" if (forecast or income) else ""
    return f"""SELECT CAST(l_shipdate AS DATE) AS expenses_date,
      {pick(accounts, 'l_partkey')} AS main_account,
      {pick(heads, 'l_partkey')} AS expenses_head,
      {pick(fixed.CURRENCIES, 'l_suppkey')} AS currency,
      CASE WHEN l_returnflag = 'R' THEN -(l_extendedprice * l_discount)
           ELSE l_extendedprice * l_discount END AS amount{week}
    FROM lineitem
    WHERE l_linestatus = {q('O' if forecast else 'F')} AND l_linenumber % 2 = {1 if income else 0}"""


FIXTURES = {
    "buyers": """SELECT c_name AS buyer_name, CAST(15 * (c_custkey % 5) + 30 AS INTEGER) AS realised_day,
      n_name AS bank FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "bank_ratio": """SELECT n_name AS name, CAST(10 * (n_nationkey % 5) AS DOUBLE) AS margin,
      CAST(5 + n_nationkey % 3 AS DOUBLE) AS bildup_unifill, CAST(50 AS DOUBLE) AS erq,
      CAST(2 * (n_nationkey % 4) AS DOUBLE) AS bildup_machine,
      CAST(20 + n_nationkey % 7 AS DOUBLE) AS bildup_regular FROM nation""",
    "shipment_forecast": """SELECT c_name AS buyer, CAST(l_partkey AS VARCHAR) AS style,
      CAST(l_orderkey AS VARCHAR) AS po_no, CAST(NULL AS VARCHAR) AS color,
      CAST(NULL AS VARCHAR) AS team, CAST(NULL AS VARCHAR) AS oc,
      l_extendedprice / l_quantity AS fobpc, l_quantity AS po_qty,
      l_extendedprice / l_quantity AS fob_price, l_quantity AS order_qty,
      CAST(NULL AS DOUBLE) AS shipped_qty, CAST(l_shipdate AS DATE) AS exfty_date,
      CASE WHEN l_returnflag = 'R' THEN 'Inactive' ELSE 'Active' END AS status
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "bills": """SELECT CAST(o_orderkey AS VARCHAR) AS invoice, c_name AS buyer,
      o_totalprice AS total__fob_income, CAST(o_orderdate AS DATE) AS ex_fty_date,
      CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 10 END AS ex1,
      CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderdate AS DATE) + 20 END AS ex2,
      CASE WHEN o_orderkey % 12 = 0 THEN CAST(o_orderdate AS DATE) + 30 END AS ex3,
      CASE WHEN o_orderstatus = 'F' THEN 'FULLY REALIZED' WHEN o_orderstatus = 'O' THEN 'OPEN'
           WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'PENDING' END AS status
    FROM orders JOIN customer ON o_custkey = c_custkey""",
    "income_forecast": _ledger(True, True),
    "income_actual": _ledger(True, False),
    "expenses_forecast": _ledger(False, True),
    "expenses_actual": _ledger(False, False),
    "shipments": """SELECT CAST(l_shipdate AS DATE) AS shipment_date,
      CASE WHEN l_linestatus = 'F' THEN 'Actual' ELSE 'Projected' END AS shipment_type,
      l_quantity AS quentity, l_extendedprice AS amount, CAST(NULL AS DATE) AS week_date
    FROM lineitem""",
    # --- views of the domain ---
    "v_buyer": "SELECT * FROM buyers JOIN bank_ratio ON bank = name",
    "v_sf_report": f"""SELECT sf.buyer, sf.style, sf.exfty_date AS ex_date,
      sf.exfty_date + t.realised_day AS r_day, sf.po_qty AS quantity, sf.fobpc AS rate,
      sf.po_qty * sf.fobpc AS amount, t.buyer_name, t.bank, {', '.join('t.' + r for r in RATIOS)},
      sf.status
    FROM shipment_forecast sf JOIN v_buyer t ON sf.buyer = t.buyer_name""",
    "v_shipment_forecast": "SELECT * FROM v_sf_report WHERE status = 'Active'",
    "v_bills": f"""SELECT b.invoice, b.buyer, b.ex_fty_date,
      COALESCE(b.ex3, b.ex2, b.ex1, b.ex_fty_date + t.realised_day) AS r_day,
      b.total__fob_income, {', '.join('t.' + r for r in RATIOS)}, b.status
    FROM bills b JOIN v_buyer t ON b.buyer = t.buyer_name""",
}


def with_fixtures(body: str, names: list[str] | None = None) -> str:
    names = list(FIXTURES) if names is None else names
    ctes = ",\n".join(f"{n} AS (\n{FIXTURES[n]}\n)" for n in names)
    return f"WITH RECURSIVE {ctes},\n{body}"


def weekly_long(rows_cte: str, amount: str, day: str) -> str:
    """CTE text: weekly five-way split of ``rows_cte`` -> long rows (final CTE ``wl``)."""
    splits = ", ".join(f"{split(amount, r)} AS {r}" for r in RATIOS)
    sums = ", ".join(f"{msum(r)} AS {r}" for r in RATIOS)
    unions = "\n  UNION ALL ".join(
        f"SELECT weekend AS variable, 'USD' AS Unit, {q(d)} AS Descriptio, {r} AS value FROM {rows_cte}_w"
        for r, d in fixed.ACCOUNTS)
    return f"""{rows_cte}_s AS (SELECT {week_end(day)} AS weekend, {splits} FROM {rows_cte}),
{rows_cte}_w AS (SELECT weekend, {sums} FROM {rows_cte}_s GROUP BY weekend),
{rows_cte}_l AS ({unions})"""


def net_shipment(price: str, qty: str) -> str:
    g = f"CAST({price} * {qty} AS DECIMAL(20,6))"
    return f"CAST(round_even({g} - {g} * 0.001, 0) AS DOUBLE)"


SHIP_ROWS = f"""ship_rows AS (SELECT {net_shipment('rate', 'quantity')} AS amount, r_day,
  {', '.join(RATIOS)} FROM v_shipment_forecast)"""


def bill_rows(where: str) -> str:
    return f"""bill_rows AS (SELECT total__fob_income - total__fob_income * 0.001 AS amount, r_day,
  {', '.join(RATIOS)} FROM v_bills WHERE {where})"""


NOT_REALISED = "NOT (upper(status) LIKE '%REALIZED%')"
IS_REALISED = "upper(status) LIKE '%REALIZED%'"


def q4_sql() -> str:
    return with_fixtures(f"""{SHIP_ROWS},
{weekly_long('ship_rows', 'amount', 'r_day')}
SELECT * FROM ship_rows_l""")


def q5_sql(where: str = NOT_REALISED) -> str:
    return with_fixtures(f"""{bill_rows(where)},
{weekly_long('bill_rows', 'amount', 'r_day')}
SELECT * FROM bill_rows_l""")


def pivot_side(long_cte: str, suffix: str) -> str:
    cols = ", ".join(
        f"CASE WHEN count(*) FILTER (WHERE Descriptio = {q(d)}) > 1 THEN error('duplicate') "
        f"ELSE first(value) FILTER (WHERE Descriptio = {q(d)}) END AS {qi(d + suffix)}"
        for d in ACCOUNT_NAMES)
    return f"SELECT variable, {cols} FROM {long_cte} GROUP BY variable"


def q7_sql() -> str:
    return with_fixtures(f"""{SHIP_ROWS},
{weekly_long('ship_rows', 'amount', 'r_day')},
{bill_rows(NOT_REALISED)},
{weekly_long('bill_rows', 'amount', 'r_day')},
a AS ({pivot_side('ship_rows_l', '_x')}),
b AS ({pivot_side('bill_rows_l', '_y')})
SELECT COALESCE(a.variable, b.variable) AS variable,
  {', '.join(qi(d + '_x') for d in ACCOUNT_NAMES)}, {', '.join(qi(d + '_y') for d in ACCOUNT_NAMES)}
FROM a FULL OUTER JOIN b ON a.variable = b.variable""")


# --- report grid -----------------------------------------------------------------
def lit(v) -> str:
    import datetime as _dt
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, _dt.date):
        return f"DATE '{v.isoformat()}'"
    return q(v)


def values(rows: list[tuple], names: list[str]) -> str:
    body = ",\n    ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES\n    {body}) AS t({', '.join(names)})"


def line_rows() -> list[tuple]:
    return [(f"CFRL{n:04d}", report, group, line, unit, n) for n, report, group, line, unit in fixed.REPORT_LINES]


#: Report columns: a week begins on each 1st, 8th, 15th, 22nd and 29th of the data's years.
COLS_SQL = f"""SELECT printf('CFC%05d', col_no) AS name, col_no,
       ({lst(fixed.MONTHS)})[month(date1)] AS month, date1, date2, ismonth, col_status
FROM (SELECT *, CAST(2 * row_number() OVER (PARTITION BY ismonth, col_status ORDER BY date1)
                     - CASE WHEN col_status = 'Projected' THEN 1 ELSE 0 END
                     + CASE WHEN ismonth THEN 50000 ELSE 0 END AS INTEGER) AS col_no
      FROM (SELECT d AS date1, CASE WHEN day(d) = 29 THEN last_day(d) ELSE d + 6 END AS date2, FALSE AS ismonth
            FROM col_days WHERE day(d) IN (1, 8, 15, 22, 29)
            UNION ALL SELECT d, last_day(d), TRUE FROM col_days WHERE day(d) = 1),
           (VALUES ('Projected'), ('Actual')) AS st(col_status))"""
COL_DAYS_SQL = """SELECT CAST(unnest(generate_series(make_date(y0, 1, 1), make_date(y1 + 1, 12, 31), INTERVAL 1 DAY)) AS DATE) AS d
FROM (SELECT CAST(year(min(d)) AS INTEGER) AS y0, CAST(year(max(d)) AS INTEGER) AS y1
      FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem UNION ALL SELECT CAST(o_orderdate AS DATE) FROM orders))"""


def rule_rows() -> list[tuple]:
    scaled = set(fixed.USD_PER_THOUSAND_RULES)
    return [(s, line, src, dim, key if key is not None else line,
             "usd_per_thousand" if (s, line) in scaled else None)
            for s, line, src, dim, key in fixed.RULES]


def report_ctes(usd_rate: float = fixed.DEFAULT_SETTINGS["usd_rate"], more_lines: list[tuple] = ()) -> str:
    """CTEs ending in ``cells`` (Q1 rows) plus config CTEs rules_t, lines_t, cols_t."""
    facts = "\n  UNION ALL ".join([
        "SELECT 'income_forecast' AS source, expenses_head AS Descriptio, main_account AS account, "
        "COALESCE(week_date, expenses_date) AS variable, amount FROM income_forecast",
        "SELECT 'income_actual', expenses_head, main_account, COALESCE(week_date, expenses_date), "
        "amount FROM income_actual",
        "SELECT 'expenses_forecast', expenses_head, main_account, "
        "COALESCE(week_date, expenses_date), amount FROM expenses_forecast",
        "SELECT 'expenses_actual', expenses_head, main_account, expenses_date, amount "
        "FROM expenses_actual",
        "SELECT 'shipments_qty', 'Shipped Qty', NULL, COALESCE(week_date, shipment_date), quentity "
        "FROM shipments WHERE shipment_type = 'Actual'",
        "SELECT 'shipments_fob', 'Shipped FOB', NULL, COALESCE(week_date, shipment_date), amount "
        "FROM shipments WHERE shipment_type = 'Actual'",
        "SELECT 'final_proj_income', Descriptio, NULL, variable, value FROM ship_rows_l",
        "SELECT 'final_proj_income', Descriptio, NULL, variable, value FROM bill_rows_l",
    ])
    return f"""{SHIP_ROWS},
{weekly_long('ship_rows', 'amount', 'r_day')},
{bill_rows(NOT_REALISED)},
{weekly_long('bill_rows', 'amount', 'r_day')},
rules_t AS ({values(rule_rows(), ['col_status', 'line_name', 'source', 'dim', 'key', 'scale'])}),
lines_t AS ({values([*line_rows(), *more_lines], ['name', 'report_name', 'group_no', 'line_name', 'unit', 'line_number'])}),
col_days AS ({COL_DAYS_SQL}),
cols_t AS ({COLS_SQL}),
facts AS ({facts}),
keyed AS (SELECT source, 'head' AS dim, trim(Descriptio) AS key, variable, amount FROM facts
          WHERE Descriptio IS NOT NULL
          UNION ALL SELECT source, 'account', trim(account), variable, amount FROM facts
          WHERE account IS NOT NULL),
daily AS (SELECT source, dim, key, variable, SUM(CAST(amount AS DECIMAL(38,6))) AS amount
          FROM keyed GROUP BY source, dim, key, variable),
grid AS (SELECT r.source, r.dim, trim(r.key) AS key, r.scale, l.name AS report_line, l.line_name,
                l.group_no, c.name AS report_col, c.col_no AS col_index, c.month, c.date1, c.date2
         FROM rules_t r JOIN lines_t l ON trim(l.line_name) = trim(r.line_name)
         JOIN cols_t c ON c.col_status = r.col_status),
cell_sums AS (SELECT g.report_line, g.report_col, g.col_index, g.date2, g.month, g.line_name,
                     g.group_no, g.scale, SUM(d.amount) AS s
              FROM daily d JOIN grid g ON d.source = g.source AND d.dim = g.dim AND d.key = g.key
                   AND d.variable BETWEEN g.date1 AND g.date2
              GROUP BY g.report_line, g.report_col, g.col_index, g.date2, g.month, g.line_name,
                       g.group_no, g.scale),
cell_v AS (SELECT *, CASE WHEN scale = 'usd_per_thousand'
                  THEN CAST(CAST({usd_rate!r} AS DOUBLE) * CAST(s AS DOUBLE) / 1000 AS DECIMAL(38,6))
                  ELSE s END AS v FROM cell_sums),
cells AS (SELECT report_line, report_col, col_index, date2 AS ex_date, month, line_name, group_no,
                 CAST(round_even(v, 3) AS DOUBLE) AS amount FROM cell_v WHERE v > 0)"""


CELL_COLS = "report_line, report_col, col_index, ex_date, month, line_name, group_no, amount"


def q1_sql() -> str:
    return with_fixtures(f"{report_ctes()}\nSELECT * FROM cells")


def _roll_sql(cells: str, level: int, mode: str) -> str:
    window = ("x.ex_date > k.date1 AND x.ex_date <= k.date2" if mode == "literal"
              else "x.ex_date BETWEEN k.date1 AND k.date2")
    group = "CAST(NULL AS VARCHAR)" if mode == "literal" else "l.group_no"
    return f"""SELECT a.total_line AS report_line, a.report_col, k.col_no AS col_index,
       k.date2 AS ex_date, k.month, l.line_name, {group} AS group_no,
       CAST(round_even(a.v, 0) AS DOUBLE) AS amount
FROM (SELECT m.total_line, x.report_col, SUM(CAST(x.amount AS DECIMAL(38,6)) * m.sign) AS v
      FROM {cells} x JOIN cols_t k ON x.report_col = k.name
      JOIN members_t m ON x.report_line = m.member_line AND m.level = {level}
      WHERE {window}
      GROUP BY m.total_line, x.report_col) a
JOIN cols_t k ON a.report_col = k.name JOIN lines_t l ON a.total_line = l.name
WHERE a.v > 0"""


#: More levels than any list of totals needs: a level without lines adds nothing.
LEVELS = 5


def member_ctes(mode: str, closings: bool, more: list[tuple] = ()) -> str:
    """CTE ``members_t`` (total_line, member_line, sign, level): lists by their place
    among the lists of their name, lines by theirs among the lines of their name."""
    written = [(k, name, j, m) for k, (name, ms) in enumerate(fixed.TOTALS_AS_WRITTEN) for j, m in enumerate(ms)]
    lists = [(k, name) for k, (name, _) in enumerate(fixed.TOTALS_AS_WRITTEN)]
    closed = [(f"CFRL{c:04d}", f"CFRL{m:04d}", sign) for c, o, plus, minus in fixed.CLOSINGS
              for ms, sign in (([o, *plus], 1), (minus, -1)) for m in ms] + list(more)
    match = ("l.line_name = t.name AND t.k = (SELECT max(k) FROM lists_t z WHERE z.name = t.name)" if mode == "literal"
             else "l.line_name = t.name AND l.nth = t.nth")
    member = "w.member" if mode == "literal" else "CASE WHEN starts_with(w.member, 'CCFRL') THEN substr(w.member, 2) ELSE w.member END"
    extra = f"UNION ALL SELECT * FROM ({values(closed, ['total_line', 'member_line', 'sign'])})" if closings else ""
    return f"""written_t AS ({values(written, ['k', 'name', 'j', 'member'])}),
lists_t AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k) AS nth FROM ({values(lists, ['k', 'name'])})),
named_t AS (SELECT name, line_name, row_number() OVER (PARTITION BY line_name ORDER BY line_number) AS nth FROM lines_t),
pairs_t AS (SELECT l.name AS total_line, {member} AS member_line, 1 AS sign
            FROM lists_t t JOIN named_t l ON {match} JOIN written_t w ON w.k = t.k {extra}),
above_t AS (SELECT DISTINCT total_line, 1 AS level FROM pairs_t
            UNION SELECT p.total_line, a.level + 1 FROM pairs_t p JOIN above_t a ON p.member_line = a.total_line
            WHERE a.level < {LEVELS}),
members_t AS (SELECT p.*, (SELECT max(a.level) FROM above_t a WHERE a.total_line = p.total_line) AS level FROM pairs_t p)"""


def totals_ctes(mode: str, cells: str = "cells", closings: bool = True, more: list[tuple] = ()) -> str:
    parts = [member_ctes(mode, closings, more)]
    current = cells
    outs = []
    for lv in range(1, LEVELS + 1):
        parts.append(f"lvl{lv} AS MATERIALIZED ({_roll_sql(current, lv, mode)})")
        parts.append(f"cur{lv} AS MATERIALIZED (SELECT {CELL_COLS} FROM {current} UNION ALL "
                     f"SELECT {CELL_COLS} FROM lvl{lv})")
        current = f"cur{lv}"
        outs.append(f"SELECT {CELL_COLS} FROM lvl{lv}")
    parts.append("totals AS (" + " UNION ALL ".join(outs) + ")")
    return ",\n".join(parts)


def q2_sql(mode: str = "repaired") -> str:
    return with_fixtures(f"{report_ctes()},\n{totals_ctes(mode)}\nSELECT * FROM totals")


def members_sql(more_lines: list[tuple], more: list[tuple]) -> str:
    return with_fixtures(f"{report_ctes(more_lines=more_lines)},\n{totals_ctes('repaired', more=more)}\nSELECT * FROM totals")


def openings_ctes(cells: str) -> str:
    pairs = [(f"CFRL{o:04d}", f"CFRL{c:04d}") for c, o, _, _ in fixed.CLOSINGS]
    return f"""omap AS ({values(pairs, ['open_line', 'close_line'])}),
openings AS (
  SELECT o.open_line AS report_line, k.name AS report_col, k.col_no AS col_index,
         k.date2 AS ex_date, k.month, l.line_name, CAST(NULL AS VARCHAR) AS group_no,
         CAST(round_even(SUM(CAST(x.amount AS DECIMAL(38,6))), 0) AS DOUBLE) AS amount
  FROM {cells} x JOIN omap o ON x.report_line = o.close_line
  JOIN cols_t k ON x.col_index = k.col_no - 2
  JOIN lines_t l ON l.name = o.open_line
  WHERE x.ex_date > k.date1 - 7 AND x.ex_date <= k.date2 - 7
  GROUP BY o.open_line, k.name, k.col_no, k.date2, k.month, l.line_name
  HAVING SUM(CAST(x.amount AS DECIMAL(38,6))) > 0)"""


def q3_openings_sql() -> str:
    return with_fixtures(f"""{report_ctes()},
{totals_ctes('literal')},
pass1 AS (SELECT {CELL_COLS} FROM cells UNION ALL SELECT {CELL_COLS} FROM totals),
{openings_ctes('pass1')}
SELECT * FROM openings""")


def roll_forward_ctes(cells: str = "cells") -> str:
    rows = []
    acc = []
    for closing, opening, plus, minus in fixed.CLOSINGS:
        cid = fixed.LINE_ID_FORMAT % closing
        acc.append((cid, fixed.LINE_ID_FORMAT % opening))
        rows += [(cid, fixed.LINE_ID_FORMAT % m, 1) for m in plus]
        rows += [(cid, fixed.LINE_ID_FORMAT % m, -1) for m in minus]
    return f"""netmem AS ({values(rows, ['account', 'member_line', 'sign'])}),
acc_t AS ({values(acc, ['account', 'open_line'])}),
nets AS (SELECT n.account, x.report_col, SUM(CAST(x.amount AS DECIMAL(38,6)) * n.sign) AS net
         FROM {cells} x JOIN netmem n ON x.report_line = n.member_line
         GROUP BY n.account, x.report_col),
chain_grid AS (SELECT a.account, a.open_line, k.name AS report_col, k.col_no AS col_index,
                      k.date1, k.date2, k.month, k.col_status,
                      COALESCE(n.net, CAST(0 AS DECIMAL(38,6))) AS net
               FROM cols_t k JOIN acc_t a ON NOT k.ismonth
               LEFT JOIN nets n ON n.account = a.account AND n.report_col = k.name),
chain_s AS (SELECT *, SUM(net) OVER w AS s FROM chain_grid
            WINDOW w AS (PARTITION BY account, col_status ORDER BY date1, col_index
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
chain_c AS (SELECT *, s - LEAST(0, MIN(s) OVER w) AS closing FROM chain_s
            WINDOW w AS (PARTITION BY account, col_status ORDER BY date1, col_index
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
chain AS (SELECT *, COALESCE(LAG(closing) OVER (PARTITION BY account, col_status
                                               ORDER BY date1, col_index), 0) AS opening
          FROM chain_c),
mchain AS (SELECT c.account, c.open_line, m.name AS report_col, m.col_no AS col_index, m.date2,
                  m.month, arg_min(c.opening, c.date1) AS opening,
                  arg_max(c.closing, c.date2) AS closing
           FROM chain c JOIN cols_t m ON m.ismonth AND c.col_status = m.col_status
                AND c.date1 >= m.date1 AND c.date2 <= m.date2
           GROUP BY c.account, c.open_line, m.name, m.col_no, m.date2, m.month),
allbal AS (SELECT account, open_line, report_col, col_index, date2, month, opening, closing FROM chain
           UNION ALL SELECT account, open_line, report_col, col_index, date2, month, opening, closing
           FROM mchain),
rolled AS (
  SELECT c.open_line AS report_line, c.report_col, c.col_index, c.date2 AS ex_date, c.month,
         l.line_name, l.group_no, CAST(round_even(c.opening, 0) AS DOUBLE) AS amount
  FROM allbal c JOIN lines_t l ON l.name = c.open_line WHERE c.opening > 0
  UNION ALL
  SELECT c.account, c.report_col, c.col_index, c.date2, c.month, l.line_name, l.group_no,
         CAST(round_even(c.closing, 0) AS DOUBLE)
  FROM allbal c JOIN lines_t l ON l.name = c.account WHERE c.closing > 0)"""


def q3_roll_forward_sql() -> str:
    return with_fixtures(f"{report_ctes()},\n{roll_forward_ctes()}\nSELECT * FROM rolled")


def a8_sql() -> str:
    return with_fixtures(f"""{report_ctes()}
SELECT x.group_no, x.col_index, CAST(SUM(CAST(x.amount AS DECIMAL(38,6))) AS DOUBLE) AS amount
FROM cells x JOIN cols_t k ON x.col_index = k.col_no
WHERE x.ex_date BETWEEN k.date1 AND k.date2 AND x.group_no IS NOT NULL
GROUP BY x.group_no, x.col_index""")


def w3_sql(line_name: str, group_no: str) -> str:
    return with_fixtures(f"""{report_ctes()},
{totals_ctes('repaired')},
stored AS (SELECT {CELL_COLS} FROM cells UNION ALL SELECT {CELL_COLS} FROM totals),
gt AS (SELECT x.group_no, x.col_index, CAST(SUM(CAST(x.amount AS DECIMAL(38,6))) AS DOUBLE) AS amount
       FROM stored x JOIN cols_t k ON x.col_index = k.col_no
       WHERE x.ex_date BETWEEN k.date1 AND k.date2 AND x.group_no = {q(group_no)} AND x.line_name <> {q(line_name)}
       GROUP BY x.group_no, x.col_index),
fresh AS (SELECT l.name AS report_line, k.name AS report_col, gt.col_index, k.date2 AS ex_date, k.month, l.line_name,
                 gt.group_no, gt.amount
          FROM gt JOIN cols_t k ON gt.col_index = k.col_no JOIN lines_t l ON l.line_name = {q(line_name)})
SELECT {CELL_COLS} FROM stored s
WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.report_line = s.report_line AND f.report_col = s.report_col)
UNION ALL SELECT {CELL_COLS} FROM fresh""")


def lint_sql() -> str:
    return with_fixtures(f"""{report_ctes()},
seen AS (SELECT DISTINCT source, dim, key FROM daily)
SELECT r.col_status, r.line_name, r.source, r.dim, trim(r.key) AS key FROM rules_t r
WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.source = r.source AND s.dim = r.dim
                  AND s.key = trim(r.key))""")


def q8_sql(line_name: str = "USD Sales from build up account") -> str:
    return with_fixtures(f"""{report_ctes()},
rb AS (SELECT invoice, COALESCE(ex3, ex2, ex1) AS revised_date FROM bills
       WHERE ex1 IS NOT NULL OR ex2 IS NOT NULL OR ex3 IS NOT NULL),
rw AS (SELECT invoice, revised_date, {week_end('revised_date')} AS week_end FROM rb)
SELECT rw.invoice, rw.revised_date, rw.week_end, c.report_line, c.report_col, c.col_index,
       c.ex_date, c.line_name, c.amount
FROM rw JOIN cells c ON c.line_name = {q(line_name)}
     AND c.ex_date > rw.week_end - 7 AND c.ex_date <= rw.week_end""")


# --- forecast-side queries -------------------------------------------------------
def q4_from_cf_date_sql(cf_date: str = fixed.DEFAULT_SETTINGS["cf_date"]) -> str:
    return with_fixtures(f"""ship_rows AS (SELECT {net_shipment('rate', 'quantity')} AS amount, r_day,
  {', '.join(RATIOS)} FROM v_shipment_forecast WHERE r_day >= DATE '{cf_date}'),
{weekly_long('ship_rows', 'amount', 'r_day')}
SELECT * FROM ship_rows_l""")


def q9_sql() -> str:
    return with_fixtures("SELECT * FROM v_sf_report")


def q10_sql() -> str:
    return with_fixtures("SELECT * FROM v_buyer")


def q11_sql() -> str:
    return """SELECT CAST(c_custkey AS VARCHAR) AS name, c_name AS buyer_name, n_name AS bank
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'Total', NULL, NULL"""


def q17_sql(name: str) -> str:
    return with_fixtures(f"""SELECT bank, buyer_name FROM buyers WHERE buyer_name = {q(name)}
ORDER BY buyer_name, bank LIMIT 1""")


def early_sql(view: str, amount: str, day: str, not_null: list[str]) -> str:
    sums = ", ".join(f"{msum(split(amount, r))} AS {r}" for r in RATIOS)
    cond = " AND ".join(f"{c} IS NOT NULL" for c in not_null)
    return with_fixtures(f"""e AS (SELECT * FROM {view} WHERE {cond})
SELECT strftime({week_end(day)}, '%Y-%m-%d') AS w, {sums} FROM e GROUP BY 1""")


def q15_ship_sql() -> str:
    cols = ["buyer", "style", "ex_date", "r_day", "quantity", "rate", "amount", "buyer_name",
            "bank", *RATIOS, "status"]
    return early_sql("v_shipment_forecast", "amount", "r_day", cols)


def q15_bills_sql() -> str:
    cols = ["invoice", "buyer", "ex_fty_date", "r_day", "total__fob_income", *RATIOS, "status"]
    return early_sql("v_bills", "total__fob_income", "r_day", cols)


def q16_sql() -> str:
    return with_fixtures("""SELECT buyer, style, po_no, exfty_date AS ex_date, fobpc AS fob_price,
  fobpc AS rate, po_qty AS quantity, po_qty AS order_qty, po_qty * fobpc AS total,
  oc AS original_shipment_date, status FROM shipment_forecast""")


def q12_sql(target: float = fixed.YEARLY_SHIPMENT_TARGET) -> str:
    return with_fixtures(f"""g AS (SELECT COALESCE(SUM(COALESCE(order_qty, 0)), 0) AS total
       FROM shipment_forecast)
SELECT total, CASE WHEN total >= {target!r} THEN 1 ELSE 0 END AS res,
  CASE WHEN total >= {target!r} THEN {q(fixed.GATE_MESSAGE_OK)} ELSE {q(fixed.GATE_MESSAGE_SHORT)} END AS msg
FROM g""")


def q13_sql(target: float = fixed.YEARLY_SHIPMENT_TARGET) -> str:
    return with_fixtures(f"""SELECT CASE WHEN SUM(quantity) < {target!r} THEN {q(fixed.CHECK_MESSAGE)}
  ELSE '' END AS chkfile FROM v_shipment_forecast""")


def w1_sql() -> str:
    return with_fixtures("""SELECT buyer, style, po_no, color, team, oc, fobpc, po_qty, fob_price,
  order_qty, shipped_qty, exfty_date, 'Inactive' AS status FROM shipment_forecast
UNION ALL
SELECT buyer, style, po_no, COALESCE(color, '0'), COALESCE(team, '0'), COALESCE(oc, '0'),
  CAST(NULL AS DOUBLE), COALESCE(order_qty, 0), COALESCE(fob_price, 0), COALESCE(order_qty, 0),
  COALESCE(shipped_qty, 0), exfty_date, 'Active' FROM shipment_forecast""")


def import_forecast_sql() -> str:
    """Receipts of the rows an upload adds (all older rows are Inactive then)."""
    return with_fixtures(f"""n AS (SELECT buyer, exfty_date, order_qty * 2 AS quantity,
  CAST(round_even(CAST(fob_price AS DECIMAL(20,6)) * 1.05, 2) AS DOUBLE) AS rate FROM shipment_forecast),
v AS (SELECT n.rate, n.quantity, n.exfty_date + t.realised_day AS r_day, {', '.join('t.' + r for r in RATIOS)}
      FROM n JOIN v_buyer t ON n.buyer = t.buyer_name),
ship_rows AS (SELECT {net_shipment('rate', 'quantity')} AS amount, r_day, {', '.join(RATIOS)} FROM v),
{weekly_long('ship_rows', 'amount', 'r_day')}
SELECT * FROM ship_rows_l""")


_BILL_NULLS = """CAST(NULL AS VARCHAR) AS style_no, invoice AS po_no, CAST(NULL AS DOUBLE) AS qty_pcs,
  CAST(NULL AS DOUBLE) AS unit_price"""


def bills_import_sql() -> str:
    return with_fixtures(f"""b AS (SELECT *, {_BILL_NULLS} FROM bills)
SELECT invoice, buyer, style_no, po_no, qty_pcs, unit_price, total__fob_income, ex_fty_date, ex1, ex2, ex3,
  'Inactive' AS status FROM b
UNION ALL
SELECT COALESCE(invoice, '0'), COALESCE(buyer, '0'), COALESCE(style_no, '0'), COALESCE(po_no, '0'),
  COALESCE(qty_pcs, 0), COALESCE(unit_price, 0), CAST(NULL AS DOUBLE), ex_fty_date, CAST(NULL AS DATE),
  CAST(NULL AS DATE), CAST(NULL AS DATE), 'Active' FROM b""")


def _sheet_ctes() -> str:
    return """ev AS (SELECT event_type, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, value FROM events),
types AS (SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) AS INTEGER) AS row_no
          FROM (SELECT DISTINCT event_type FROM ev)),
days AS (SELECT DISTINCT day FROM ev),
sums AS (SELECT event_type, day, CAST(SUM(CAST(value AS DECIMAL(38,6))) AS DOUBLE) AS v
         FROM ev GROUP BY event_type, day)"""


def r1_sql() -> str:
    return with_fixtures(f"""{_sheet_ctes()},
cells AS (SELECT t.event_type, d.day AS variable, s.v AS value FROM types t CROSS JOIN days d
          LEFT JOIN sums s ON s.event_type = t.event_type AND s.day = d.day
          UNION ALL
          SELECT t.event_type, m.variable, CAST(NULL AS DOUBLE) FROM types t
          CROSS JOIN (VALUES ('Apr'), ('May'), ('Jun')) m(variable))
SELECT event_type AS Descriptio, 'USD' AS Unit, variable, value FROM cells""")


def q14_sql(first: int, last: int) -> str:
    return with_fixtures(f"""{_sheet_ctes()}
SELECT t.event_type AS Descriptio, 'USD' AS Unit, CAST(d.day AS DATE) AS variable, s.v AS value
FROM types t CROSS JOIN days d LEFT JOIN sums s ON s.event_type = t.event_type AND s.day = d.day
WHERE t.row_no BETWEEN {first} AND {last}""")


def regions_sql(sheet: str, only: str | None = None) -> str:
    """Regions of the sheet: rows by place under the header, months (and, where they are
    not dropped, the empty quarter columns) as values."""
    parts = []
    for table, name, _, first, last, dropped, _, _ in fixed.SHEET_REGIONS:
        if name != sheet or only not in (None, table):
            continue
        heads = ["2024-%02d-01" % m for m in range(1, 13)] + ([] if dropped else ["Apr", "May", "Jun"])
        parts.append(f"""SELECT {q(table)} AS "table", p.event_type || '/' || p.g AS Descriptio, 'USD' AS Unit, h.variable, s.v AS value
FROM place p CROSS JOIN (SELECT unnest({lst(heads)}) AS variable) h
LEFT JOIN sums s ON s.event_type = p.event_type AND s.g = p.g AND s.variable = h.variable
WHERE p.k > {first} AND p.k <= {last}""")
    return f"""WITH ev AS (SELECT event_type, CAST(user_id % 25 AS INTEGER) AS g, CAST(ts AS DATE) AS d, value FROM events),
place AS (SELECT event_type, g, row_number() OVER (ORDER BY g, event_type) AS k FROM (SELECT DISTINCT event_type, g FROM ev)),
sums AS (SELECT event_type, g, printf('2024-%02d-01', CAST(month(d) AS INTEGER)) AS variable,
                CAST(SUM(CAST(value AS DECIMAL(38,6))) AS DOUBLE) AS v FROM ev GROUP BY 1, 2, 3)
""" + "\nUNION ALL ".join(parts)


def k4_columns_sql() -> str:
    return with_fixtures(f"""{report_ctes()}
{_viol('report_columns', 'unique', 'col_no', "SELECT col_no AS value, 2 AS rows FROM cols_t WHERE month = 'January'")}""".replace(
        "2 AS rows", "CAST(2 AS BIGINT) AS rows"))


def k5_report_sql() -> str:
    return with_fixtures(f"""{report_ctes()}
{_viol('cashflow_report', 'foreign_key', 'report_col', "SELECT report_col AS value, count(*) AS rows FROM cells WHERE report_col IN (SELECT name FROM cols_t WHERE ismonth) GROUP BY 1")}
UNION ALL {_viol('cashflow_report', 'foreign_key', 'report_line', "SELECT report_line AS value, count(*) AS rows FROM cells WHERE report_line IN (SELECT name FROM lines_t WHERE line_number > 150) GROUP BY 1")}""")


def k3_sql() -> str:
    return with_fixtures("SELECT invoice, COALESCE(status, 'Active') AS status, CAST(0 AS DOUBLE) AS qty_pcs FROM bills")


def q12_branches_sql() -> str:
    return with_fixtures(f"""g AS (SELECT SUM(order_qty) AS total FROM shipment_forecast)
SELECT 'reached' AS "case", total, 1 AS res, {q(fixed.GATE_MESSAGE_OK)} AS msg FROM g
UNION ALL SELECT 'missed', total, 0, {q(fixed.GATE_MESSAGE_SHORT)} FROM g
UNION ALL SELECT 'empty', 0, 0, {q(fixed.GATE_MESSAGE_SHORT)} FROM g""")


def q13_branches_sql() -> str:
    return f"SELECT 'reached' AS \"case\", '' AS chkfile UNION ALL SELECT 'missed', {q(fixed.CHECK_MESSAGE)}"


def text_amounts_sql() -> str:
    return with_fixtures("""t AS (SELECT invoice, CAST(CAST(total__fob_income AS DECIMAL(20,2)) AS VARCHAR) AS a FROM bills)
SELECT invoice, a || CASE WHEN CAST(invoice AS BIGINT) % 5 = 0 THEN ' approx' ELSE '' END AS bare,
  CASE WHEN CAST(invoice AS BIGINT) % 5 <> 0 THEN CAST(a AS DOUBLE) END AS amount FROM t""")


def dates_halves_sql() -> str:
    return with_fixtures("""s AS (SELECT CAST(year(shipment_date) AS INTEGER) AS y, CAST(month(shipment_date) AS INTEGER) AS m,
       CAST(day(shipment_date) AS INTEGER) AS d, shipment_date, amount FROM shipments)
SELECT y, m, d, d <= 12 AS swapped, d + 3 <= day(last_day(shipment_date)) AS three_later,
       CAST(SUM(CAST(amount * 0.5 AS DECIMAL(38,6))) AS DOUBLE) AS half
FROM s GROUP BY y, m, d, 4, 5""")


def q15_handover_sql() -> str:
    return q15_ship_sql().replace("FROM v_shipment_forecast WHERE", "FROM v_shipment_forecast WHERE quantity % 3 = 1 AND")


def export_upload_sql() -> str:
    return with_fixtures("SELECT invoice, buyer, ex_fty_date FROM bills")


def sinks_sql() -> str:
    return with_fixtures("""SELECT shipment_date, count(*) AS n, CAST(SUM(CAST(quentity AS DECIMAL(38,6))) AS DOUBLE) AS quentity
FROM shipments WHERE quentity > 10 OR quentity <= 5 GROUP BY shipment_date""")


def r3_sql() -> str:
    return with_fixtures(f"""{SHIP_ROWS},
{weekly_long('ship_rows', 'amount', 'r_day')}
{pivot_side('ship_rows_l', '')}""")


def forecast_rows_sql() -> str:
    splits = ", ".join(f"{split('amount', r)} AS {r}" for r in RATIOS)
    return with_fixtures(f"""x AS (SELECT buyer, style, {net_shipment('rate', 'quantity')} AS amount, r_day
       , {', '.join(RATIOS)} FROM v_shipment_forecast)
SELECT buyer, style, amount, r_day, {week_end('r_day')} AS weekend, {splits} FROM x""")


def bill_rows_sql() -> str:
    splits = ", ".join(f"{split('amount', r)} AS {r}" for r in RATIOS)
    return with_fixtures(f"""x AS (SELECT invoice, total__fob_income - total__fob_income * 0.001 AS amount, r_day,
       {', '.join(RATIOS)} FROM v_bills)
SELECT invoice, amount, r_day, {week_end('r_day')} AS weekend, {splits} FROM x""")


def calendar_sql(weekday: int = 4) -> str:
    """Brute force: count the matching weekdays day by day."""
    iso = weekday + 1
    return with_fixtures(f"""d AS (SELECT DISTINCT shipment_date AS d FROM shipments)
SELECT d AS shipment_date, {week_end('d')} AS week_end,
  strftime({week_end('d')}, '%Y-%m-%d') AS week_key,
  CAST(isodow(d) - 1 AS INTEGER) AS weekday,
  CAST(len(list_filter(generate_series(CAST(date_trunc('year', d) AS DATE), d, INTERVAL 1 DAY),
                       lambda x: isodow(x) = {iso})) AS INTEGER) AS week_no,
  d - 7 AS week_before
FROM d""")


def weekday_dates_sql(weekday: int = 4) -> str:
    iso = weekday + 1
    return with_fixtures(f"""y AS (SELECT DISTINCT CAST(year(shipment_date) AS INTEGER) AS year FROM shipments),
days AS (SELECT year, CAST(unnest(generate_series(make_date(year, 1, 1), make_date(year, 12, 31),
                                                  INTERVAL 1 DAY)) AS DATE) AS day FROM y)
SELECT year, day FROM days WHERE isodow(day) = {iso}""")


# --- contracts ---------------------------------------------------------------------
def _viol(table: str, check: str, field: str, src: str) -> str:
    return (f"SELECT {q(table)} AS \"table\", {q(check)} AS \"check\", {q(field)} AS field, "
            f"CAST(value AS VARCHAR) AS value, rows FROM ({src})")


def k1_sql() -> str:
    parts = []
    for t in ("income_forecast", "income_actual", "expenses_forecast", "expenses_actual"):
        parts.append(_viol(t, "required", "expenses_date",
                           f"SELECT expenses_date AS value, count(*) AS rows FROM {t} "
                           f"WHERE expenses_date IS NULL GROUP BY 1"))
    parts.append(_viol("shipments", "required", "shipment_date",
                       "SELECT shipment_date AS value, count(*) AS rows FROM shipments "
                       "WHERE shipment_date IS NULL GROUP BY 1"))
    for f in ("invoice", "status"):
        parts.append(_viol("bills_under_collection", "required", f,
                           f"SELECT {f} AS value, count(*) AS rows FROM bills "
                           f"WHERE {f} IS NULL OR trim({f}) = '' GROUP BY 1"))
    return with_fixtures("\nUNION ALL ".join(parts))


def k2_checks() -> list[tuple[str, str, list[str]]]:
    return [
        ("income_forecast", "main_account", fixed.INCOME_ACCOUNTS),
        ("income_forecast", "expenses_head", fixed.INCOME_FORECAST_HEADS),
        ("income_forecast", "currency", fixed.CURRENCIES),
        ("income_actual", "main_account", fixed.INCOME_ACCOUNTS),
        ("income_actual", "expenses_head", fixed.INCOME_ACTUAL_HEADS),
        ("expenses_forecast", "main_account", fixed.EXPENSE_ACCOUNTS),
        ("expenses_forecast", "expenses_head", fixed.EXPENSE_HEADS),
        ("expenses_actual", "main_account", fixed.EXPENSE_ACCOUNTS),
        ("expenses_actual", "expenses_head", fixed.EXPENSE_HEADS),
        ("shipments", "shipment_type", fixed.SHIPMENT_TYPES),
        ("shipment_forecast", "status", fixed.RECORD_STATUSES),
        ("bills_under_collection", "status", fixed.RECORD_STATUSES),
    ]


def k2_sql() -> str:
    parts = []
    for t, f, opts in k2_checks():
        src = "bills" if t == "bills_under_collection" else t
        parts.append(_viol(t, "option", f,
                           f"SELECT {f} AS value, count(*) AS rows FROM {src} WHERE {f} IS NOT NULL "
                           f"AND NOT list_contains({lst(list(dict.fromkeys(opts)))}, {f}) GROUP BY 1"))
    return with_fixtures("\nUNION ALL ".join(parts))


def k4_sql() -> str:
    parts = [_viol("bills_under_collection", "unique", "invoice",
                   "SELECT invoice AS value, count(*) AS rows FROM bills WHERE invoice IS NOT NULL "
                   "GROUP BY 1 HAVING count(*) > 1"),
             _viol("shipment_forecast", "unique", "po_no",
                   "SELECT po_no AS value, count(*) AS rows FROM shipment_forecast "
                   "WHERE po_no IS NOT NULL GROUP BY 1 HAVING count(*) > 1")]
    return with_fixtures("\nUNION ALL ".join(parts))


def k5_sql() -> str:
    def fk(t, src, f, parent, pf):
        return _viol(t, "foreign_key", f,
                     f"SELECT {f} AS value, count(*) AS rows FROM {src} WHERE {f} IS NOT NULL "
                     f"AND {f} NOT IN (SELECT {pf} FROM {parent} WHERE {pf} IS NOT NULL) GROUP BY 1")
    parts = [fk("buyers", "buyers", "bank", "bank_ratio", "name"),
             fk("shipment_forecast", "shipment_forecast", "buyer", "buyers", "buyer_name"),
             fk("bills_under_collection", "bills", "buyer", "buyers", "buyer_name")]
    return with_fixtures("\nUNION ALL ".join(parts))


def w2_sql() -> str:
    return with_fixtures(f"""{report_ctes()},
{roll_forward_ctes('cells')},
chain_cells AS (SELECT {CELL_COLS} FROM cells UNION ALL SELECT {CELL_COLS} FROM rolled),
{totals_ctes('repaired', 'chain_cells', closings=False)}
SELECT {CELL_COLS} FROM chain_cells UNION ALL SELECT {CELL_COLS} FROM totals""")


def incremental_sql() -> str:
    """The whole report over the two ledgers as they are after the corrections."""
    sql = w2_sql()
    for t in ("income_actual", "expenses_actual"):
        week = ", week_date" if t == "income_actual" else ""
        booked = f"""(SELECT expenses_date, main_account, expenses_head,
      CASE WHEN year(expenses_date) = 1997 AND day(expenses_date) = 6 THEN amount * 2 ELSE amount END AS amount{week} FROM {t}
    WHERE NOT (year(expenses_date) = 1997 AND day(expenses_date) = 5 AND amount < 500)
    UNION ALL SELECT expenses_date - 40, main_account, expenses_head, amount{week} FROM {t}
    WHERE year(expenses_date) = 1997 AND day(expenses_date) = 8)"""
        head, tail = sql.split("facts AS (", 1)
        sql = head + "facts AS (" + tail.replace(f"FROM {t}", f"FROM {booked}", 1)
    return sql


def versions_sql() -> str:
    """The forecast after three imports: prices 5 % up and quantities doubled, then the table's own
    rows, then the first upload again."""
    up = """SELECT buyer, style, po_no, COALESCE(color, '0') AS color, COALESCE(team, '0') AS team, COALESCE(oc, '0') AS oc,
  CAST(NULL AS DOUBLE) AS fobpc, COALESCE(order_qty, 0) * {k} AS po_qty, {price} AS fob_price,
  COALESCE(order_qty, 0) * {k} AS order_qty, COALESCE(shipped_qty, 0) AS shipped_qty, exfty_date, '{status}' AS status, {v} AS version
FROM shipment_forecast"""
    dear = "CAST(round_even(CAST(fob_price AS DECIMAL(20,6)) * 1.05, 2) AS DOUBLE)"
    return with_fixtures(f"""n AS (SELECT buyer, style, po_no, color, team, oc, fobpc, po_qty, fob_price, order_qty, shipped_qty, exfty_date,
  'Inactive' AS status, 0 AS version FROM shipment_forecast
UNION ALL {up.format(k=2, price=dear, status='Inactive', v=1)}
UNION ALL {up.format(k=1, price='COALESCE(fob_price, 0)', status='Inactive', v=2)}
UNION ALL {up.format(k=2, price=dear, status='Active', v=3)})
SELECT * REPLACE (CAST(version AS BIGINT) AS version) FROM n""")


def append_batches_sql() -> str:
    return with_fixtures("""SELECT shipment_date, quentity, 'small' AS batch FROM shipments WHERE quentity <= 5
UNION ALL SELECT shipment_date, quentity, 'large' FROM shipments WHERE quentity > 45""")


def configuration_sql() -> str:
    bad = lambda t, check, f, src, where: _viol(t, check, f, f"SELECT {f} AS value, count(*) AS rows FROM {src} WHERE {where} GROUP BY 1")
    outside = lambda f, options: f"{f} IS NOT NULL AND NOT list_contains({lst(options)}, {f})"
    cash = lambda types: f"""SELECT {pick([*types, 'Planned'], 'user_id')} AS type, {pick([*fixed.CF_OUTFLOW_ACCOUNTS, 'EUR'], 'event_id')} AS account FROM events"""
    return with_fixtures(f"""{report_ctes()},
c AS (SELECT CASE WHEN col_no % 11 <> 1 THEN date1 END AS date1, CASE WHEN col_no % 11 = 2 THEN month[1:3] ELSE month END AS month,
             CASE WHEN col_no % 11 = 3 THEN 'Draft' ELSE col_status END AS col_status FROM cols_t),
l AS (SELECT CASE line_number % 7 WHEN 1 THEN '' WHEN 2 THEN 'Old report' ELSE {q(fixed.REPORT_NAMES[0])} END AS report_name FROM lines_t),
inflow AS ({cash(fixed.CF_INFLOW_TYPES)}), outflow AS ({cash(fixed.CF_OUTFLOW_TYPES)})
{bad('cf_columns', 'required', 'date1', 'c', 'date1 IS NULL')}
UNION ALL {bad('report_lines', 'required', 'report_name', 'l', "trim(report_name) = ''")}
UNION ALL {bad('cf_columns', 'option', 'month', 'c', outside('month', fixed.MONTHS))}
UNION ALL {bad('cf_columns', 'option', 'col_status', 'c', outside('col_status', fixed.COLUMN_STATUSES))}
UNION ALL {bad('report_lines', 'option', 'report_name', 'l', outside('report_name', [*fixed.REPORT_NAMES, '']))}
UNION ALL {bad('cf_inflow', 'option', 'type', 'inflow', outside('type', fixed.CF_INFLOW_TYPES))}
UNION ALL {bad('cf_outflow', 'option', 'type', 'outflow', outside('type', fixed.CF_OUTFLOW_TYPES))}
UNION ALL {bad('cf_outflow', 'option', 'account', 'outflow', outside('account', fixed.CF_OUTFLOW_ACCOUNTS))}""")


def configuration_defaults_sql() -> str:
    ledgers = " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", CASE WHEN currency = 'USD' AND day(expenses_date) <= 15 THEN 'BDT' ELSE currency END AS value FROM {t}"
        for t in ("income_forecast", "income_actual", "expenses_forecast", "expenses_actual"))
    return with_fixtures(f"""{report_ctes()},
v AS ({ledgers} UNION ALL SELECT 'report_lines', CASE WHEN line_number % 7 = 3 OR unit IS NULL THEN 'USD' ELSE unit END FROM lines_t)
SELECT "table", value, count(*) AS rows FROM v GROUP BY 1, 2""")


def rejects_sql() -> str:
    return with_fixtures("""b AS (SELECT *, CAST(invoice AS BIGINT) AS k, CAST(CAST(total__fob_income AS DECIMAL(20,2)) AS DOUBLE) AS amount FROM bills),
w AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'quote not closed' WHEN k % 17 = 0 THEN 'number of fields'
                     WHEN k % 11 = 0 AND k % 13 = 0 THEN 'amount: not a number; day: not a date'
                     WHEN k % 11 = 0 THEN 'amount: not a number' WHEN k % 13 = 0 THEN 'day: not a date' ELSE '' END AS problems FROM b)
SELECT invoice, CASE WHEN problems = '' THEN buyer || ', Ltd' END AS buyer, CASE WHEN problems = '' THEN amount END AS amount,
       CASE WHEN problems = '' THEN ex_fty_date END AS day, problems FROM w""")


def forecast_totals_sql() -> str:
    total = lambda c: f"CAST(SUM(CAST({c} AS DECIMAL(38,6))) AS DOUBLE) AS {c}"
    return with_fixtures(f"""r AS (SELECT bank, buyer, quantity, amount FROM v_sf_report)
SELECT 'buyer' AS level, bank, buyer, {total('quantity')}, {total('amount')} FROM r GROUP BY bank, buyer
UNION ALL SELECT 'bank', bank, NULL, {total('quantity')}, {total('amount')} FROM r GROUP BY bank
UNION ALL SELECT 'all', NULL, NULL, {total('quantity')}, {total('amount')} FROM r""")


def settings_sql() -> str:
    return q4_from_cf_date_sql("1900-01-01").replace("r_day >= DATE '1900-01-01'", "r_day >= (SELECT min(exfty_date) + 1000 FROM shipment_forecast)")


def k6_sql(fmt_sql: str) -> str:
    return with_fixtures(f"""SELECT invoice, buyer, {_BILL_NULLS}, total__fob_income, ex_fty_date, ex1, ex2, ex3,
  status, printf({q(fmt_sql)}, row_number() OVER (ORDER BY ex_fty_date, invoice)) AS name FROM bills""")
