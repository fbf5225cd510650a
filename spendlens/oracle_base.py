"""DuckDB SQL shared by every oracle: the stand-in input and the base query.

``purchases_raw`` and ``catalogue`` shape the driver tables like
``sources.fixtures`` does; ``purchases`` is the reference's base query
(LEFT JOIN + SUM over the 22 keys) written independently in SQL.
"""

BASE_CTES = """
catalogue AS (
  SELECT DISTINCT n.n_nationkey AS cost_center_id, c.c_mktsegment AS unit,
         r.r_name AS destination, n.n_name AS level6,
         CAST(NULL AS VARCHAR) AS level7, CAST(NULL AS VARCHAR) AS level8,
         CAST(NULL AS VARCHAR) AS nature
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE n.n_nationkey % 5 <> 4),
purchases_raw AS (
  SELECT o.o_orderpriority AS origin, CAST(NULL AS VARCHAR) AS system,
    c.c_mktsegment AS company,
    CASE WHEN l.l_orderkey % 103 = 0 THEN NULL ELSE l.l_shipdate END AS request_date,
    o.o_orderdate AS order_date, c.c_nationkey AS cost_center,
    CAST(NULL AS VARCHAR) AS business_line,
    CASE WHEN l.l_orderkey % 89 = 0 THEN -l.l_extendedprice
         WHEN l.l_orderkey % 83 = 0 THEN CAST(0 AS DOUBLE)
         WHEN l.l_orderkey % 997 = 0 THEN l.l_extendedprice * 90
         WHEN o.o_orderpriority = '1-URGENT' THEN l.l_extendedprice * 3
         WHEN o.o_orderpriority = '5-LOW' THEN l.l_extendedprice * 0.2
         ELSE l.l_extendedprice END AS amount,
    CASE l.l_linenumber % 6 WHEN 0 THEN 'Cant. 12' WHEN 1 THEN 'Cantidad: 7'
         WHEN 2 THEN 'caja PZA 3' WHEN 3 THEN 'UN:4 Cant 9' WHEN 4 THEN 'sin dato'
         ELSE NULL END AS detail,
    CAST(NULL AS VARCHAR) AS requester, CAST(NULL AS VARCHAR) AS preparer,
    CAST(l.l_orderkey AS VARCHAR) AS request_id, CAST(l.l_linenumber AS VARCHAR) AS line_no,
    CASE WHEN l.l_orderkey % 97 = 0 THEN NULL
         WHEN l.l_orderkey % 101 = 0 THEN 'Desconocido' ELSE p.p_type END AS category,
    p.p_brand AS class, p.p_name AS family, CAST(NULL AS VARCHAR) AS buying_entity
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN customer c ON o.o_custkey = c.c_custkey
                  JOIN part p ON l.l_partkey = p.p_partkey),
purchases AS (
  SELECT a.origin, a.system, a.company, d.unit, a.request_date, a.order_date,
         a.cost_center, d.destination, d.level6, d.level7, d.level8, d.nature,
         a.business_line, SUM(a.amount) AS amount, a.detail, a.requester, a.preparer,
         a.request_id, a.line_no, concat_ws('', a.request_id, a.line_no) AS request_line,
         a.category, a.class, a.family, a.buying_entity
  FROM purchases_raw a
  LEFT JOIN catalogue d ON d.cost_center_id = a.cost_center AND d.unit = a.company
  GROUP BY a.origin, a.system, d.unit, a.company, a.request_date, a.order_date,
           a.cost_center, d.destination, d.level6, d.level7, d.level8, d.nature,
           a.business_line, a.detail, a.requester, a.preparer, a.request_id,
           a.line_no, a.category, a.class, a.family, a.buying_entity)
"""

MONTH_NAMES_SQL = ("['Enero','Febrero','Marzo','Abril','Mayo','Junio','Julio','Agosto',"
                   "'Septiembre','Octubre','Noviembre','Diciembre']")


def oracle(select: str, ctes: str = "", rounding: dict[str, int] | None = None) -> str:
    """Full DuckDB statement: base CTEs + query CTEs + rounded final select."""
    with_part = "WITH " + BASE_CTES.strip() + ((",\n" + ctes.strip()) if ctes.strip() else "")
    if rounding:
        rep = ", ".join(f"round({c}, {n}) AS {c}" for c, n in rounding.items())
        return f"{with_part}\nSELECT * REPLACE ({rep}) FROM (\n{select.strip()}\n) q"
    return f"{with_part}\n{select.strip()}"
