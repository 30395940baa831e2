"""Common parts of the oracle SQL: the loan tape and its derived columns, in DuckDB's dialect."""

TAPE = """
lines AS (
  SELECT l_orderkey, sum(l_extendedprice * l_tax) AS revol_bal, sum(l_extendedprice) AS tot_cur_bal,
    sum(l_extendedprice * (1 - l_discount)) AS total_rev_hi_lim, count(*) AS open_acc, sum(l_quantity) AS total_acc,
    sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) * 0.03 AS recoveries,
    sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) * 0.003 AS collection_recovery_fee,
    sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END) * 0.02 AS out_prncp
  FROM lineitem GROUP BY l_orderkey),
tape AS (
  SELECT o_orderkey AS id, o_orderdate AS issue_ts, strftime(o_orderdate, '%b-%Y') AS issue_d,
    CASE o_orderstatus WHEN 'F' THEN 'Fully Paid' WHEN 'P' THEN 'Charged Off' ELSE 'Current' END AS loan_status,
    o_totalprice / 10 AS loan_amnt,
    CASE WHEN o_orderkey % 97 = 0 THEN 0.0 ELSE o_totalprice / 10 END AS funded_amnt,
    concat(5 + o_orderkey % 20, '.', o_orderkey % 10, '%') AS int_rate,
    CASE WHEN o_orderkey % 3 = 0 THEN ' 60 months' ELSE ' 36 months' END AS term,
    CASE WHEN o_orderkey % 13 = 12 THEN NULL WHEN o_orderkey % 13 = 0 THEN '< 1 year'
      WHEN o_orderkey % 13 >= 10 THEN '10+ years' ELSE concat(o_orderkey % 13, ' years') END AS emp_length,
    substr('ABCDE', CAST(substr(o_orderpriority, 1, 1) AS INTEGER), 1) AS grade,
    concat(substr('ABCDE', CAST(substr(o_orderpriority, 1, 1) AS INTEGER), 1), 1 + o_orderkey % 5) AS sub_grade,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE c_acctbal * 10 + 30000 END AS annual_inc,
    CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE (o_orderkey % 400) / 10 END AS dti,
    CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE c_mktsegment END AS purpose,
    r_name AS home_ownership, o_totalprice / 360 AS installment,
    revol_bal, tot_cur_bal, total_rev_hi_lim, open_acc, total_acc, recoveries, collection_recovery_fee, out_prncp,
    year(o_orderdate) AS issue_year,
    CASE WHEN year(o_orderdate) <= 1998 THEN 'train' WHEN year(o_orderdate) >= 2000 THEN 'test' ELSE 'val' END AS split,
    CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS default_flag
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey LEFT JOIN lines ON l_orderkey = o_orderkey),
resolved AS (SELECT * FROM tape WHERE loan_status IN ('Fully Paid', 'Charged Off'))
"""

SCORES = TAPE + """,
scores AS (
  SELECT id, split, model, default_flag AS label, CASE model
    WHEN 'uniform' THEN ((id * 37) % 1000 + 0.5) / 1000 WHEN 'tied' THEN (id * 37) % 20 / 20.0
    WHEN 'second' THEN ((id * 61) % 1000 + 0.5) / 1000
    WHEN 'informed' THEN CAST(0.2 AS DOUBLE) + CAST(0.3 AS DOUBLE) * default_flag
      + CAST(0.4 AS DOUBLE) * (((id * 17) % 1000 + CAST(0.5 AS DOUBLE)) / 1000)
    ELSE CAST(0.1 AS DOUBLE) + CAST(0.5 AS DOUBLE) * default_flag
      + CAST(0.35 AS DOUBLE) * (((id * 29) % 1000 + CAST(0.5 AS DOUBLE)) / 1000) END::DOUBLE AS score
  FROM resolved, (VALUES ('uniform'), ('tied'), ('second'), ('informed'), ('sharp')) m(model))
"""


def with_tape(query: str) -> str:
    return f"WITH {TAPE}{query}"


def with_scores(query: str) -> str:
    return f"WITH {SCORES}{query}"


def unpivot(columns: list[str], keep: str = "", source: str = "tape") -> str:
    """Long `(keep, feature, value)` rows without nulls."""
    lead = f"{keep}, " if keep else ""
    parts = [f"SELECT {lead}'{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {source}" for c in columns]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL"


def determinant(cell, rows: list[int], columns: list[int]) -> str:
    """SQL for the determinant of a small matrix whose entries are `cell(i, j)`, by expansion along the first row."""
    if not rows:
        return "1"
    parts = []
    for k, j in enumerate(columns):
        minor = determinant(cell, rows[1:], columns[:k] + columns[k + 1:])
        parts.append(f"{'-' if k % 2 else '+'} {cell(rows[0], j)} * ({minor})")
    return " ".join(parts)


def inflation(columns: list[str], source: str = "resolved") -> str:
    """CTE `vifs(feature, vif)`: variance inflation without intercept over the rows that hold all columns."""
    n = range(len(columns))
    cells = ", ".join(f"sum({columns[i]} * {columns[j]}) / sqrt(sum({columns[i]} * {columns[i]}) * sum({columns[j]} * {columns[j]})) AS g{i}_{j}"
                      for i in n for j in n if i < j)
    cell = lambda i, j: "1" if i == j else f"g{min(i, j)}_{max(i, j)}"
    whole = determinant(cell, list(n), list(n))
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, ({determinant(cell, [i for i in n if i != k], [i for i in n if i != k])}) / ({whole}) AS vif FROM gram"
        for k, c in enumerate(columns))
    return (f"gram AS (SELECT {cells} FROM {source} WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in columns) + f"), vifs AS ({rows})")
