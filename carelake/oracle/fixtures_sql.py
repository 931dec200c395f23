"""The fixture derivation of FIXTURES.md section 3, as DuckDB CTEs."""

FIXTURE_CTES = r"""
line AS (
  SELECT l.*, o.o_custkey, o.o_orderstatus, o.o_orderpriority,
         p.p_partkey, p.p_name, p.p_brand, p.p_type, p.p_size, p.p_retailprice,
         s.s_suppkey, s.s_name, n.n_nationkey, n.n_name,
         'P' || lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0') AS plant,
         n.n_name AS plant_name,
         CAST(p.p_partkey AS VARCHAR) AS material_code,
         CAST(l.l_quantity AS DECIMAL(12,2)) AS q,
         CAST(p.p_retailprice AS DECIMAL(12,2)) AS mrp_base,
         CAST(CAST(p.p_retailprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))
              * CASE WHEN l.l_orderkey % 97 = 0 THEN 12 WHEN l.l_orderkey % 89 = 0 THEN 0.05 ELSE 1 END
              AS DECIMAL(18,4)) AS net_price,
         CAST(o.o_orderdate AS DATE) AS odate,
         CAST(l.l_shipdate AS DATE) AS sdate,
         'S' || CAST(l.l_linenumber AS VARCHAR) AS sloc
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON p.p_partkey = l.l_partkey
  JOIN supplier s ON s.s_suppkey = l.l_suppkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey
),
fact_consumption AS (
  SELECT material_code AS material, p_name AS material_desc, plant, sloc, '201' AS mvt,
         'CC' || CAST(o_custkey % 40 AS VARCHAR) AS cost_ctr, q AS qty, CAST(q * net_price AS DECIMAL(24,6)) AS amount_lc,
         'EA' AS uom, sdate AS posting_date, CAST(year(sdate) AS INTEGER) AS year,
         CAST(month(sdate) AS INTEGER) AS month_num, strftime(sdate, '%B') AS month
  FROM line
  WHERE l_returnflag <> 'R'
),
fact_grn AS (
  SELECT plant, sloc,
         CASE WHEN l_linenumber = 7 AND l_partkey % 3 = 0 THEN NULL ELSE material_code END AS material,
         p_name AS material_desc, CAST(s_suppkey AS VARCHAR) AS vendor_code, s_name AS vendor_name,
         CAST(l_orderkey AS VARCHAR) AS po_no,
         CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS gr_no,
         q AS gr_qty, CAST(mrp_base AS DECIMAL(18,4)) AS base_price, net_price,
         CAST(CASE WHEN l_tax > 0.02 THEN mrp_base * 1.25 ELSE 0 END AS DECIMAL(18,4)) AS unit_mrp,
         CAST(q * net_price AS DECIMAL(24,6)) AS total_amount_wo_tax,
         CAST(date_diff('day', odate, sdate) AS INTEGER) AS po_to_gr_tat,
         CAST(date_diff('day', odate, sdate) + l_linenumber AS INTEGER) AS pr_to_gr_tat,
         CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_brand END AS major_group,
         p_type AS minor_group, odate AS po_date, sdate AS gr_date,
         CASE WHEN l_partkey % 11 = 0 THEN NULL
              ELSE sdate + CAST(60 + (l_partkey % 12) * 60 AS INTEGER) END AS expiry_date,
         sdate AS posting_date, CAST(year(sdate) AS INTEGER) AS year,
         CAST(month(sdate) AS INTEGER) AS month_num, strftime(sdate, '%B') AS month
  FROM line
),
fact_po AS (
  SELECT plant, plant_name, sloc,
         CASE WHEN l_linenumber = 7 AND l_partkey % 3 = 0 THEN NULL ELSE material_code END AS material,
         p_name AS material_desc, CAST(s_suppkey AS VARCHAR) AS vendor_code, s_name AS vendor_name,
         CAST(l_orderkey AS VARCHAR) AS po_no, o_orderpriority AS doc_type, q AS po_qty,
         CAST(CASE WHEN o_orderstatus = 'O' THEN q
                   WHEN o_orderstatus = 'P' THEN CAST(floor(q / 4) AS DECIMAL(12,2))
                   ELSE 0 END AS DECIMAL(12,2)) AS open_qty,
         net_price, CAST(q * net_price AS DECIMAL(24,6)) AS total_value_wo_tax,
         CAST(CAST(q * net_price AS DECIMAL(24,6)) * 1.12 AS DECIMAL(26,8)) AS total_value_tax,
         CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_brand END AS major_group,
         p_type AS minor_group, odate AS po_date, odate + 14 AS delivery_date,
         odate AS posting_date, CAST(year(odate) AS INTEGER) AS year,
         CAST(month(odate) AS INTEGER) AS month_num, strftime(odate, '%B') AS month
  FROM line
),
fact_inventory AS (
  SELECT plant, sloc,
         ['IP PHARMACY', 'OP PHARMACY', 'IP/OP STORE', 'OT STORE', 'MAIN STORE'][l_linenumber % 5 + 1] AS sloc_desc,
         material_code AS material, p_name AS material_desc,
         'HSN' || CAST(p_partkey % 50 AS VARCHAR) AS hsn,
         CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS batch,
         q AS qty, 'EA' AS uom, CAST(q * net_price AS DECIMAL(24,6)) AS total_cost,
         CAST(q * mrp_base * 1.25 AS DECIMAL(24,6)) AS total_mrp,
         net_price AS moving_avg_price,
         CAST(date_diff('day', sdate, DATE '2001-05-31') AS INTEGER) AS aging_days,
         p_brand AS manufacturer_desc, string_split(p_name, ' ')[-1] AS generic_name,
         CASE WHEN p_size % 5 = 0 THEN 'OUT OF FORMULARY' ELSE 'IN FORMULARY' END AS formulary,
         CASE WHEN p_size % 7 = 0 THEN 'ZCON' ELSE 'ZMED' END AS material_type,
         p_type AS material_group, p_brand AS major_group_desc, p_type AS minor_group_desc,
         CASE WHEN l_partkey % 11 = 0 THEN NULL
              ELSE sdate + CAST(60 + (l_partkey % 12) * 60 AS INTEGER) END AS expiry_date,
         sdate AS grn_date, DATE '2001-05-31' AS snapshot_date
  FROM line
  WHERE l_linestatus = 'O' AND sdate <= DATE '2001-05-31'
),
sales_line AS (
  SELECT sdate AS sale_date, material_code AS material, p_name AS material_desc, q AS qty,
         CAST(q * mrp_base * 1.25 AS DECIMAL(24,6)) AS revenue, CAST(q * net_price AS DECIMAL(24,6)) AS cost, p_brand AS manufacturer,
         plant AS hospital, CASE WHEN l_returnflag = 'A' THEN 'IP' ELSE 'OP' END AS patient_type,
         CAST(year(sdate) AS INTEGER) AS year, CAST(month(sdate) AS INTEGER) AS month_num,
         strftime(sdate, '%B') AS month
  FROM line
  WHERE l_returnflag <> 'R' AND sdate BETWEEN DATE '2000-12-01' AND DATE '2001-05-31'
),
dim_material AS (
  SELECT COALESCE(c.material, i.material) AS material,
         COALESCE(c.desc_cons, i.desc_inv) AS material_desc,
         i.material_group, i.major_group_desc, i.minor_group_desc, i.generic_name,
         i.manufacturer_desc, i.formulary, i.material_type
  FROM (SELECT material, min(material_desc) AS desc_cons FROM fact_consumption
        WHERE material IS NOT NULL GROUP BY material) c
  FULL OUTER JOIN (
        SELECT material, a.material_desc AS desc_inv, a.material_group, a.major_group_desc,
               a.minor_group_desc, a.generic_name, a.manufacturer_desc, a.formulary, a.material_type
        FROM (SELECT material, min({'material_desc': material_desc, 'material_group': material_group,
                                    'major_group_desc': major_group_desc,
                                    'minor_group_desc': minor_group_desc, 'generic_name': generic_name,
                                    'manufacturer_desc': manufacturer_desc, 'formulary': formulary,
                                    'material_type': material_type}) AS a
              FROM fact_inventory WHERE material IS NOT NULL GROUP BY material)) i
  ON c.material = i.material
),
dim_plant AS (
  SELECT codes.plant, COALESCE(nm.plant_name, codes.plant) AS plant_name
  FROM (SELECT plant FROM fact_po UNION SELECT plant FROM fact_inventory
        UNION SELECT plant FROM fact_consumption) codes
  LEFT JOIN (SELECT plant, min(plant_name) AS plant_name FROM fact_po
             WHERE plant IS NOT NULL AND plant_name IS NOT NULL AND lower(plant_name) <> 'nan'
             GROUP BY plant) nm ON codes.plant = nm.plant
  WHERE codes.plant IS NOT NULL AND lower(codes.plant) <> 'nan'
),
dim_sloc AS (
  SELECT plant, sloc, min(sloc_desc) AS sloc_desc FROM fact_inventory
  WHERE plant IS NOT NULL AND sloc IS NOT NULL AND sloc_desc IS NOT NULL GROUP BY plant, sloc
),
dim_vendor AS (
  SELECT vendor_code, min({'src': src, 'vendor_name': vendor_name}).vendor_name AS vendor_name
  FROM (SELECT vendor_code, vendor_name, 0 AS src FROM fact_po
        UNION ALL SELECT vendor_code, vendor_name, 1 AS src FROM fact_grn)
  WHERE vendor_code IS NOT NULL AND lower(vendor_code) <> 'nan' AND vendor_name IS NOT NULL
  GROUP BY vendor_code
),
dim_costcenter AS (
  SELECT DISTINCT cost_ctr, cost_ctr AS department_name FROM fact_consumption
  WHERE cost_ctr IS NOT NULL AND lower(cost_ctr) <> 'nan'
)"""


def with_fixtures(body: str) -> str:
    """``body`` is either ``SELECT ...`` or ``name AS (...), ... SELECT ...``."""
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return "WITH " + FIXTURE_CTES + "\n" + body
    return "WITH " + FIXTURE_CTES + ",\n" + body
