"""Shared common table expressions of the SQL twins (DuckDB dialect)."""

from __future__ import annotations

AS_OF = "1997-06-30"
HORIZON = 90
SCENARIOS = 100
STEP_DAYS = 30
MIN_HISTORY = 400
OBLIGATION_ROWS = 30
#: Period that queries sample delays by, unless their name says another.
GRAIN = "month"

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body.strip())


def twin(body: str, *needs: str) -> str:
    """Prefix ``body`` with the CTEs it needs, each once, dependencies first."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    head = ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in order)
    return f"WITH RECURSIVE {head}\n{body.strip()}" if order else body.strip()


cte(
    "payments",
    """
SELECT CAST(c.c_nationkey AS BIGINT) AS business_id, o.o_orderkey AS invoice_id, o.o_custkey AS payer_id,
  o.o_custkey % 12 AS counterparty_id,
  CAST(o.o_orderdate AS DATE) AS issue_date,
  CAST(o.o_orderdate AS DATE) + CAST(15 * (1 + o.o_custkey % 4) AS INTEGER) AS due_date,
  o.o_totalprice AS amount, CAST(round(o.o_totalprice * 100) AS BIGINT) AS cents,
  1 + (o.o_orderkey * 7919) % 40 + ((year(o.o_orderdate) * 12 + month(o.o_orderdate)) * 37) % 20 AS delay_days,
  NOT (o.o_orderstatus = 'P' AND o.o_orderpriority IN ('1-URGENT', '2-HIGH')) AS paid,
  CASE WHEN NOT (o.o_orderstatus = 'P' AND o.o_orderpriority IN ('1-URGENT', '2-HIGH')) THEN
    CAST(o.o_orderdate AS DATE) + CAST(15 * (1 + o.o_custkey % 4)
      + 1 + (o.o_orderkey * 7919) % 40 + ((year(o.o_orderdate) * 12 + month(o.o_orderdate)) * 37) % 20 AS INTEGER) END AS paid_date
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
""",
)
cte(
    "flows",
    """
SELECT business_id, date, CAST(sum(r) AS BIGINT) AS receipts_u, CAST(sum(s) AS BIGINT) AS sales_u, CAST(sum(x) AS BIGINT) AS outflow_u
FROM (
  SELECT business_id, paid_date AS date, cents * 75 AS r, 0 AS s, 0 AS x FROM payments WHERE paid
  UNION ALL SELECT business_id, issue_date, 0, cents * 25, 0 FROM payments
  UNION ALL SELECT p.business_id, CAST(l.l_shipdate AS DATE), 0, 0,
    CAST(round(l.l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l.l_discount * 100) AS BIGINT))
  FROM lineitem l JOIN payments p ON l.l_orderkey = p.invoice_id
) GROUP BY 1, 2
""",
    "payments",
)
cte(
    "span",
    "SELECT business_id, min(date) AS d0, max(date) AS d1, CAST(sum(outflow_u) AS BIGINT) AS all_out FROM flows GROUP BY 1",
    "flows",
)
cte(
    "ledger",
    """
SELECT s.business_id, s.date, coalesce(receipts_u, 0) AS receipts_u, coalesce(sales_u, 0) AS sales_u,
  coalesce(outflow_u, 0) AS outflow_u,
  CAST(s.opening_u + sum(coalesce(receipts_u, 0) + coalesce(sales_u, 0) - coalesce(outflow_u, 0))
    OVER (PARTITION BY s.business_id ORDER BY s.date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance_u,
  (coalesce(sales_u, 0) - coalesce(outflow_u, 0)) / 10000.0::DOUBLE AS y
FROM (SELECT business_id, (all_out * 30) // (date_diff('day', d0, d1) + 1) AS opening_u,
        CAST(unnest(generate_series(CAST(d0 AS TIMESTAMP), CAST(d1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM span) s
LEFT JOIN flows f ON f.business_id = s.business_id AND f.date = s.date
""",
    "span",
    "flows",
)
cte("hist", f"SELECT * FROM ledger WHERE date <= DATE '{AS_OF}'", "ledger")
cte(
    "opening",
    "SELECT business_id, arg_max(balance_u, date) / 10000.0::DOUBLE AS opening_balance FROM hist GROUP BY 1",
    "hist",
)
cte(
    "open_items",
    f"""
SELECT i.business_id, i.invoice_id, i.counterparty_id, i.amount, i.cents,
  date_diff('day', DATE '{AS_OF}', i.due_date) AS days_until_due
FROM payments i
WHERE i.issue_date <= DATE '{AS_OF}' AND i.invoice_id NOT IN (
  SELECT invoice_id FROM payments WHERE paid AND paid_date <= DATE '{AS_OF}')
""",
    "payments",
)
cte("settled", f"SELECT * FROM payments WHERE paid AND paid_date <= DATE '{AS_OF}'", "payments")
cte(
    "naive_path",
    f"""
SELECT t.business_id, g.h AS h, t.y AS point, s.half7 * sqrt(g.h / 7.0::DOUBLE) AS half
FROM (SELECT business_id, y, row_number() OVER (PARTITION BY business_id ORDER BY date DESC) AS back FROM hist) t
JOIN (SELECT unnest(generate_series(1, {HORIZON})) AS h) g ON t.back = 7 - (g.h - 1) % 7
JOIN (SELECT business_id, 1.959963984540054 * stddev_samp(diff) AS half7 FROM (
        SELECT business_id, y - lag(y, 7) OVER (PARTITION BY business_id ORDER BY date) AS diff FROM hist) GROUP BY 1) s
  ON s.business_id = t.business_id
""",
    "hist",
)
