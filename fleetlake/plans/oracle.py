"""Hand-written DuckDB SQL for every registered query (the correctness oracle).

Written independently of the Spark code: keyword lists, templates and rules
are spelled out here again, so a slip on either side shows up as a mismatch.
The driver registers the parquet tables as views under their own names.
"""

from __future__ import annotations

WS = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


WO = """
li AS (
  SELECT l_orderkey,
         max(l_shipdate) AS ship,
         sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amt,
         sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty
  FROM lineitem GROUP BY l_orderkey
),
wo AS (
  SELECT o.o_orderkey AS row_ix,
         c.c_mktsegment AS sheet_name,
         'V' || CAST(o.o_custkey AS VARCHAR) AS vehicle_id,
         CASE WHEN o.o_orderkey % 89 <> 0
              THEN CASE WHEN o.o_orderkey % 71 = 0 THEN '  ' ELSE '' END || 'WO-' || CAST(o.o_orderkey AS VARCHAR) || '/' || CAST(o.o_custkey % 10 AS VARCHAR) END AS wo_no,
         n.n_name AS loc,
         o.o_orderstatus AS st,
         CASE WHEN o.o_orderkey % 11 = 0 THEN CAST(o.o_orderkey AS VARCHAR) || '.0'
              WHEN o.o_orderkey % 13 = 0 THEN NULL
              ELSE CAST(o.o_orderkey * 7 AS VARCHAR) END AS mileage,
         CASE WHEN o.o_orderkey % 97 = 0 THEN 'invalid_date'
              WHEN o.o_orderkey % 101 = 0 THEN NULL
              WHEN o.o_orderkey % 103 = 0 THEN '45291'
              WHEN o.o_orderkey % 107 = 0 THEN '10:30'
              WHEN o.o_orderkey % 109 = 0 THEN '13/02/2024'
              WHEN o.o_orderkey % 113 = 0 THEN ' Jan 5, 2024 '
              WHEN o.o_orderkey % 127 = 0 THEN '1/2/2024 5:06'
              WHEN o.o_orderkey % 131 = 0 THEN (['2024-01', '2024/01/05', '2024-1-5', '5 Jan 2024', 'January 5, 2024', '2024-01-01T09:00:00Z', '2024-01-01 09:00:00.1234567',
                '1/2/2024 5:06 PM', '01-02-2024', '2024-13-05', '1/2/2024 13:06 PM', 'Fri, 5th Jan. 2024 17:30:05 +08:00'])[o.o_orderkey // 131 % 12 + 1]
              ELSE strftime(o.o_orderdate, '%Y-%m-%d %H:%M:%S') END AS open_date,
         CASE WHEN o.o_orderstatus <> 'O' THEN strftime(li.ship, '%Y-%m-%d %H:%M:%S') END AS done_date,
         CASE WHEN o.o_orderstatus = 'F' THEN strftime(li.ship, '%Y-%m-%d %H:%M:%S') END AS actual_finish_date,
         (['Engine hunts at idle', 'Brake squeal', 'Flat tyre', 'Aircon not cold', 'Body dent', 'Horn silent',
           'Wiper streaks', NULL])[((o.o_orderkey % 128) - (o.o_orderkey % 16)) // 16 + 1] AS nature_of_complaint,
         'F' || lpad(CAST(o.o_orderkey % 50 AS VARCHAR), 3, '0') AS fault_codes,
         (['  Engine   runs  rough   at  idle  ',
           'Urgent: brake pedal sinks, immediate stop',
           'Routine tire check, swapped front pair',
           'Replace clutch and gearbox oil',
           'Battery dead, starter not working',
           'Shock absorber leak, replace mounting',
           'DPF regen required, check exhaust',
           'Fuel filter service',
           'Radiator overheat, smoke from hose',
           'Power steering rack loose',
           'Tyre breakdown on highway',
           'Cosmetic scratch, polish door panel',
           'Monitor and note cabin odour',
           'Engine knocking when cold',
           '',
           NULL])[o.o_orderkey % 16 + 1] AS job_description,
         CASE WHEN o.o_orderkey % 4 <> 0 THEN 'SRR' || CAST(o.o_orderkey AS VARCHAR) END AS srr_no,
         'Mechanic ' || CAST(o.o_custkey % 20 AS VARCHAR) AS mechanic_name,
         CAST(c.c_custkey AS VARCHAR) AS customer,
         c.c_name AS customer_name,
         CASE WHEN o.o_orderkey % 6 = 0 THEN 'Check brake pads' END AS recommendation_4_next,
         (['REPAIR', 'SERVICE', 'TYREBD', 'PDI', NULL])[o.o_orderkey % 5 + 1] AS cat,
         'Lead ' || CAST(o.o_custkey % 7 AS VARCHAR) AS lead_tech,
         'B' || CAST(o.o_orderkey AS VARCHAR) AS bill_no,
         CAST(CAST(li.qty AS DECIMAL(18,2)) AS VARCHAR) AS intercoamt,
         CASE WHEN o.o_orderkey % 17 = 0 THEN 'n/a' WHEN o.o_orderkey % 61 = 0 THEN '100d'
              WHEN o.o_orderkey % 67 = 0 THEN '1e3' ELSE CAST(CAST(li.amt AS DECIMAL(18,2)) AS VARCHAR) END AS custamt
  FROM orders o
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN li ON li.l_orderkey = o.o_orderkey
)"""

PREP = WO + """,
prep AS (
  SELECT row_ix, sheet_name, vehicle_id,
         wo_no AS work_order, loc AS location, st AS status, mileage, open_date AS date,
         done_date AS completion_date, actual_finish_date, nature_of_complaint, fault_codes,
         job_description AS description, srr_no AS srr_number, mechanic_name AS mechanic,
         customer AS customer_id, customer_name, recommendation_4_next AS next_recommendation,
         cat AS category, lead_tech AS lead_technician, bill_no AS bill_number,
         intercoamt AS interco_amount, custamt AS cost, sheet_name AS vehicle_type
  FROM wo
)"""


def parse_ts(x: str) -> str:
    s = strip(x)
    # blanks, time, fraction and half of the day; the zone goes
    t = rf"regexp_replace({s}, '(T| +)(\d{{1,2}}:\d{{2}}(:\d{{2}})?)((\.\d{{1,6}})\d*)? ?(am|pm)? ?(z|utc|gmt|[-+]\d{{2}}:?\d{{2}})?$', ' \2\5\6', 'i')"
    joined = r"(-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)"
    day, year, weekday = r"(\d{1,2})(?:st|nd|rd|th)?", r",?[ -]+(\d{4})", r"^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +)?"

    def read(text: str, *dates: str) -> str:
        clocks = [" %H:%M", " %H:%M:%S", " %H:%M:%S.%f"]
        halves = [" %I:%M%p", " %I:%M:%S%p", " %I:%M:%S.%f%p"]
        one = lambda ends: "coalesce(" + ", ".join(f"try_strptime({text}, '{d}{e}')" for d in dates for e in ends) + ")"
        return f"CASE WHEN regexp_matches({text}, '[ap]m$', 'i') THEN {one(halves)} ELSE {one(['', *clocks])} END"

    numbers = rf"regexp_replace({t}, '^(\d+)[-/.](\d+)[-/.](\d+)', '\1-\2-\3')"
    named = rf"regexp_replace({t}, '{weekday}([a-z]+)\.?[ -]{day}{year}', '\1-\2-\3', 'i')"
    dayed = rf"regexp_replace({t}, '{weekday}{day}[ -]([a-z]+)\.?{year}', '\1-\2-\3', 'i')"
    return f"""CASE
      WHEN regexp_matches({t}, '^\\d{{4}}{joined}\\d{{1,2}}( |$)') THEN {read(numbers, '%Y-%m-%d')}
      WHEN regexp_matches({t}, '^\\d{{1,2}}{joined}\\d{{4}}( |$)') THEN {read(numbers, '%m-%d-%Y', '%d-%m-%Y')}
      WHEN regexp_matches({t}, '^\\d{{8}}( |$)') THEN {read(t, '%Y%m%d')}
      WHEN regexp_matches({t}, '{weekday}[a-z]{{3,9}}\\.?[ -]{day}{year}( |$)', 'i') THEN {read(named, '%b-%d-%Y', '%B-%d-%Y')}
      WHEN regexp_matches({t}, '{weekday}{day}[ -][a-z]{{3,9}}\\.?{year}( |$)', 'i') THEN {read(dayed, '%d-%b-%Y', '%d-%B-%Y')}
      WHEN regexp_full_match({t}, '\\d{{4}}[-/.]\\d{{1,2}}') THEN try_strptime(translate({t}, '/.', '--'), '%Y-%m') END"""


CLEAN = PREP + f""",
cl AS (
  SELECT p.*,
         description AS description_raw,
         regexp_replace(work_order, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS wo_clean,
         strftime({parse_ts('date')}, '%Y-%m-%d %H:%M:%S') AS date_fmt,
         CASE WHEN description IS NULL OR description = '' THEN description
              ELSE {strip(f"regexp_replace(description, '{WS}+', ' ', 'g')")} END AS desc_clean
  FROM prep p
),
lc AS (SELECT *, lower(coalesce(desc_clean, '')) AS t FROM cl),
sc AS (
  SELECT *,
    3 * (contains(t, 'urgent')::INT + contains(t, 'emergency')::INT + contains(t, 'critical')::INT
       + contains(t, 'severe')::INT + contains(t, 'dangerous')::INT + contains(t, 'immediate')::INT
       + contains(t, 'safety')::INT + contains(t, 'broken')::INT + contains(t, 'failed')::INT
       + contains(t, 'not working')::INT + contains(t, 'breakdown')::INT + contains(t, 'accident')::INT
       + contains(t, 'collision')::INT + contains(t, 'smoke')::INT + contains(t, 'fire')::INT
       + contains(t, 'overheat')::INT + contains(t, 'stall')::INT + contains(t, 'stuck')::INT
       + contains(t, 'dead')::INT + contains(t, 'major')::INT + contains(t, 'serious')::INT) AS severity_high,
    2 * (contains(t, 'repair')::INT + contains(t, 'replace')::INT + contains(t, 'fix')::INT
       + contains(t, 'check')::INT + contains(t, 'inspect')::INT + contains(t, 'warning')::INT
       + contains(t, 'attention')::INT + contains(t, 'maintenance')::INT + contains(t, 'service')::INT
       + contains(t, 'worn')::INT + contains(t, 'noise')::INT + contains(t, 'vibration')::INT
       + contains(t, 'leak')::INT + contains(t, 'loose')::INT + contains(t, 'adjustment')::INT
       + contains(t, 'alignment')::INT + contains(t, 'update')::INT) AS severity_medium,
    1 * (contains(t, 'monitor')::INT + contains(t, 'observe')::INT + contains(t, 'note')::INT
       + contains(t, 'clean')::INT + contains(t, 'minor')::INT + contains(t, 'cosmetic')::INT
       + contains(t, 'scratch')::INT + contains(t, 'polish')::INT + contains(t, 'touch up')::INT
       + contains(t, 'routine')::INT + contains(t, 'normal')::INT + contains(t, 'regular')::INT
       + contains(t, 'standard')::INT) AS severity_low,
    concat_ws(', ',
      CASE WHEN regexp_matches(t, 'brake|abs|rotor|caliper') THEN 'brake' END,
      CASE WHEN regexp_matches(t, 'coolant|radiator|water pump|thermostat|fan|hose|temperature|overheat') THEN 'cooling' END,
      CASE WHEN regexp_matches(t, 'electrical|battery|light|cigar lighter|cigarette lighter|aircon|wiring|fuse|relay|switch|sensor|starter|alternator|ecu') THEN 'electrical' END,
      CASE WHEN regexp_matches(t, 'engine|dpf|timing belt|pulley|water pump|oil|coolant|motor|cylinder|piston|crankshaft|valve|head gasket|turbo') THEN 'engine' END,
      CASE WHEN regexp_matches(t, 'exhaust|dpf|regen|muffler|catalytic|emission|silencer') THEN 'exhaust' END,
      CASE WHEN regexp_matches(t, 'fuel|diesel|petrol|gas|injector|carburetor|tank|pump|filter') THEN 'fuel' END,
      CASE WHEN regexp_matches(t, 'steering|rack|tie rod') THEN 'steering' END,
      CASE WHEN regexp_matches(t, 'suspension|shock|absorber|mounting|link rod|strut|spring|bushing|ball joint|control arm|stabilizer') THEN 'suspension' END,
      CASE WHEN regexp_matches(t, 'tyre|tire|wheel|rim|alignment|balancing|puncture|flat') THEN 'tire' END,
      CASE WHEN regexp_matches(t, 'transmission|gear|clutch|trans|drive shaft|differential|flywheel|synchro') THEN 'transmission' END
    ) AS comp
  FROM lc
),
lab AS (
  SELECT *,
    CASE WHEN description_raw = '' THEN NULL
         WHEN severity_high = 0 AND severity_medium = 0 AND severity_low = 0 THEN 'medium'
         WHEN severity_high >= severity_medium AND severity_high >= severity_low THEN 'high'
         WHEN severity_medium >= severity_low THEN 'medium'
         ELSE 'low' END AS severity,
    CASE WHEN description_raw = '' THEN NULL ELSE NULLIF(comp, '') END AS component,
    CASE WHEN contains(t, 'service') OR coalesce(category, '') = 'SERVICE' THEN 'Maintenance'
         WHEN contains(t, 'breakdown') OR coalesce(category, '') = 'TYREBD' THEN 'Breakdown'
         WHEN contains(t, 'inspect') OR contains(t, 'check') THEN 'Inspection'
         WHEN contains(t, 'repair') OR contains(t, 'replace') OR coalesce(category, '') = 'REPAIR' THEN 'Repair'
         ELSE 'Other' END AS fault_category
  FROM sc
),
enr AS (
  SELECT row_ix, sheet_name, vehicle_id,
         wo_clean AS work_order, location, status, mileage, date_fmt AS date, completion_date,
         actual_finish_date, nature_of_complaint, fault_codes, desc_clean AS description, srr_number,
         mechanic, customer_id, customer_name, next_recommendation, category, lead_technician,
         bill_number, interco_amount, cost, vehicle_type, severity, component, fault_category,
         concat_ws(',',
           CASE WHEN wo_clean IS NULL OR wo_clean = '' THEN 'missing_work_order' END,
           CASE WHEN date_fmt IS NULL OR date_fmt = '' THEN 'missing_date' END,
           CASE WHEN desc_clean IS NULL OR desc_clean = '' THEN 'missing_description' END,
           CASE WHEN cost IS NOT NULL AND TRY_CAST(trim(cost) AS DOUBLE) IS NULL THEN 'invalid_cost' END,
           CASE WHEN mileage IS NOT NULL AND NOT regexp_full_match(trim(mileage), '[+-]?[0-9]+') THEN 'invalid_mileage' END
         ) AS errors,
         CASE WHEN date_fmt IS NULL THEN 'invalid_date' END AS reject
  FROM lab
)"""

GOOD = CLEAN + """,
good AS (SELECT * EXCLUDE (reject), errors = '' AS is_valid FROM enr WHERE reject IS NULL)"""

P18 = """
  CASE
    WHEN regexp_matches(kt, 'service|maintenance|inspection|oil change|filter') THEN 'Maintenance'
    WHEN regexp_matches(kt, 'body|door|window|paint|dent|scratch') THEN 'Body'
    WHEN regexp_matches(kt, 'suspension|shock|strut|spring|steering|wheel|tire') THEN 'Suspension'
    WHEN regexp_matches(kt, 'brake|abs|rotor|pad') THEN 'Brakes'
    WHEN regexp_matches(kt, 'battery|electrical|wire|fuse|light|sensor') THEN 'Electrical'
    WHEN regexp_matches(kt, 'transmission|gear|clutch|differential') THEN 'Transmission'
    WHEN regexp_matches(kt, 'engine|motor|cylinder|piston|fuel|oil leak|coolant') THEN 'Engine'
    ELSE 'Other' END"""

FT = PREP + f""",
ft0 AS (SELECT *, lower(coalesce(nature_of_complaint, '')) || ' ' || lower(coalesce(description, '')) AS kt FROM prep),
ft AS (SELECT * EXCLUDE (kt), {P18} AS fault_category_kw FROM ft0)"""

HEADERS = ["WO No", "Loc", "ST", "Mileage", "Open Date", "Done Date", "Actual Finish Date",
           "Nature of Complaint", "Fault Codes", "Job Description", "SRR No.", "Mechanic Name",
           "Customer", "Customer Name", "Recommendation 4 next", "Cat", "Lead Tech", "Bill No.",
           "Intercoamt", "Custamt"]
IDENTS = ["wo_no", "loc", "st", "mileage", "open_date", "done_date", "actual_finish_date",
          "nature_of_complaint", "fault_codes", "job_description", "srr_no", "mechanic_name",
          "customer", "customer_name", "recommendation_4_next", "cat", "lead_tech", "bill_no",
          "intercoamt", "custamt"]

_DATA_CELLS = ", ".join(f"{{'col_ix': {i}, 'value': {c}}}" for i, c in enumerate(IDENTS))
_HEADER_CELLS = ", ".join(f"{{'row_ix': 3, 'col_ix': {i}, 'cell_type': 'str', 'value': '{h}'}}"
                          for i, h in enumerate(HEADERS))

CELLS = WO + f""",
wrows AS (
  SELECT 'kardex_' || CAST(row_ix % 4 AS VARCHAR) || '.xlsx' AS path,
         CAST(list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], sheet_name) - 1 AS INTEGER) AS sheet_ix,
         sheet_name, row_ix + 4 AS row_ix,
         [{_DATA_CELLS}] AS cl
  FROM wo
),
dcells AS (
  SELECT path, sheet_ix, sheet_name, row_ix, u.col_ix AS col_ix, 'str' AS cell_type, u.value AS value
  FROM (SELECT path, sheet_ix, sheet_name, row_ix, unnest(cl) AS u FROM wrows)
  WHERE u.value IS NOT NULL
),
sheets0 AS (SELECT DISTINCT path, sheet_ix, sheet_name FROM wrows),
lcells AS (
  SELECT path, sheet_ix, sheet_name, u.row_ix AS row_ix, u.col_ix AS col_ix, u.cell_type AS cell_type, u.value AS value
  FROM (SELECT path, sheet_ix, sheet_name, unnest([
          {{'row_ix': -1, 'col_ix': -1, 'cell_type': 'sheet', 'value': NULL}},
          {{'row_ix': 0, 'col_ix': 0, 'cell_type': 'str', 'value': 'Kardex ' || sheet_name}},
          {_HEADER_CELLS}]) AS u FROM sheets0)
),
books AS (SELECT path, count(*) AS n FROM wrows GROUP BY path),
xcells AS (
  SELECT path, 5 AS sheet_ix, 'Summary' AS sheet_name, -1 AS row_ix, -1 AS col_ix, 'sheet' AS cell_type, NULL AS value FROM books
  UNION ALL SELECT path, 6, 'Notes', -1, -1, 'sheet', NULL FROM books
  UNION ALL SELECT path, 6, 'Notes', 0, 0, 'str', 'Workshop notes' FROM books
  UNION ALL SELECT path, 6, 'Notes', 1, 0, 'str', 'Orders in book: ' || CAST(n AS VARCHAR) FROM books
),
cells AS (
  SELECT * FROM dcells UNION ALL SELECT * FROM lcells UNION ALL SELECT * FROM xcells
),
real AS (SELECT * FROM cells WHERE cell_type <> 'sheet')"""

_IDENT_EXPR = ("regexp_replace(regexp_replace(lower(" + strip("value") + "), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g')")
_PIVOT_COLS = ",\n         ".join(f"max(CASE WHEN h.h = '{c}' THEN b.value END) AS {c}" for c in IDENTS)

PIVOT = CELLS + f""",
hdr AS (
  SELECT path, sheet_ix, sheet_name, {_IDENT_EXPR} AS h, min(col_ix) AS col_ix
  FROM real WHERE row_ix = 3 GROUP BY ALL
),
piv AS (
  SELECT b.path, b.sheet_ix, b.sheet_name, b.row_ix,
         {_PIVOT_COLS}
  FROM real b JOIN hdr h ON b.path = h.path AND b.sheet_ix = h.sheet_ix AND b.col_ix = h.col_ix
  WHERE b.row_ix > 3
  GROUP BY b.path, b.sheet_ix, b.sheet_name, b.row_ix
)"""

COUNTS = CELLS + """,
per_sheet AS (
  SELECT path, sheet_ix, sheet_name,
         count(DISTINCT CASE WHEN row_ix >= 5 THEN row_ix END) AS body_rows,
         count(*) AS n_cells,
         max(CASE WHEN cell_type = 'error' THEN 1 ELSE 0 END) AS has_error
  FROM real GROUP BY ALL
),
st AS (
  SELECT s.path, s.sheet_ix, s.sheet_name,
         CASE WHEN p.has_error = 1 THEN 'error'
              WHEN p.n_cells IS NULL THEN 'empty'
              WHEN p.body_rows = 0 THEN 'no_body'
              ELSE 'ok' END AS status,
         p.body_rows
  FROM (SELECT path, sheet_ix, sheet_name FROM cells WHERE cell_type = 'sheet') s
  LEFT JOIN per_sheet p ON p.path = s.path AND p.sheet_ix = s.sheet_ix AND p.sheet_name = s.sheet_name
),
counts AS (
  SELECT path, sheet_ix, sheet_name,
         CASE WHEN status = 'empty' THEN CAST(0 AS BIGINT) WHEN status = 'ok' THEN CAST(body_rows AS BIGINT) END AS n,
         status
  FROM st
)"""

FAULT_LOG = """
fault_log AS (
  SELECT printf('F%03d', event_id + 1) AS fault_id,
         'V' || CAST(user_id AS VARCHAR) AS vehicle_id,
         event_type AS fault_description,
         CASE WHEN value < 20 THEN 'low' WHEN value < 55 THEN 'medium' ELSE 'high' END AS severity,
         ts AS timestamp,
         'open' AS status
  FROM events
)"""

APP_LOG = """
app_log AS (
  SELECT event_id AS log_id, ts, concat_ws(' ', event_type, props) AS message FROM events
)"""

NEW_FAULTS = GOOD + "," + FAULT_LOG + """,
newf AS (
  SELECT row_ix, vehicle_id, coalesce(description, '') AS fault_description, severity,
         TRY_CAST(date AS TIMESTAMP) AS timestamp
  FROM good WHERE severity = 'high'
),
numbered AS (
  SELECT newf.*,
         printf('F%03d', (SELECT coalesce(max(TRY_CAST(substr(fault_id, 2) AS BIGINT)), 0) FROM fault_log)
                         + row_number() OVER (ORDER BY timestamp, row_ix)) AS fault_id
  FROM newf
)"""

CLOSE = PREP + "," + FAULT_LOG + """,
req AS (SELECT DISTINCT printf('F%03d', row_ix + 1) AS fault_id FROM prep WHERE completion_date IS NOT NULL)"""

TEMPLATE_CLASSIFY = """Classify this vehicle fault into one of these categories:
Engine, Transmission, Electrical, Brakes, Suspension, Body, Maintenance

Nature of Complaint: {complaint}
Job Description: {description}

Consider:
1. The primary system affected
2. The type of maintenance (preventive vs corrective)
3. The severity and scope of the issue

Respond ONLY with the category name, nothing else.
"""

TEMPLATE_HISTORY = """Analyze the maintenance history for vehicle {vehicle_id}:
{history_data}
Provide:
1. Common issues identified
2. Maintenance patterns
3. Areas of concern
"""

TEMPLATE_QUICK = """Category: {category}
Issue: {issue}
Solution: {solution}
"""


def _fill(template: str, **cols) -> str:
    """SQL that substitutes each {name} of a literal template with a column."""
    expr = "'" + template.replace("'", "''") + "'"
    for k, v in cols.items():
        expr = f"replace({expr}, '{{{k}}}', coalesce(CAST({v} AS VARCHAR), ''))"
    return expr


def w(ctes: str, select: str) -> str:
    return "WITH " + ctes.strip() + "\n" + select


ORACLE: dict[str, str] = {}

ORACLE["fault_report"] = w(GOOD, """
SELECT vehicle_type, severity, fault_category, count(*) AS n,
       count(*) FILTER (WHERE completion_date IS NULL) AS open_n,
       CAST(sum(coalesce(TRY_CAST(cost AS DECIMAL(38,2)), CAST(0 AS DECIMAL(38,2)))) AS DECIMAL(38,2)) AS total_cost
FROM good GROUP BY vehicle_type, severity, fault_category""")

ORACLE["enriched_work_orders"] = w(GOOD, "SELECT * FROM good")

ORACLE["quarantine"] = w(CLEAN, """
SELECT row_ix, sheet_name, work_order, reject AS reason FROM enr WHERE reject IS NOT NULL""")

ORACLE["canonical_rename"] = w(PREP, "SELECT * FROM prep")

ORACLE["optional_columns"] = w(WO, """
SELECT row_ix, sheet_name, wo_no AS work_order, loc AS location, CAST(NULL AS VARCHAR) AS status,
       CAST(NULL AS VARCHAR) AS mileage, open_date AS date, CAST(NULL AS VARCHAR) AS completion_date,
       CAST(NULL AS VARCHAR) AS actual_finish_date, nature_of_complaint, CAST(NULL AS VARCHAR) AS fault_codes,
       job_description AS description, CAST(NULL AS VARCHAR) AS srr_number, CAST(NULL AS VARCHAR) AS mechanic,
       CAST(NULL AS VARCHAR) AS customer_id, CAST(NULL AS VARCHAR) AS customer_name,
       CAST(NULL AS VARCHAR) AS next_recommendation, cat AS category, CAST(NULL AS VARCHAR) AS lead_technician,
       CAST(NULL AS VARCHAR) AS bill_number, CAST(NULL AS VARCHAR) AS interco_amount, CAST(NULL AS VARCHAR) AS cost,
       sheet_name AS vehicle_type
FROM wo""")

ORACLE["typed_projection"] = w(PREP, f"""
SELECT row_ix, work_order, location, status,
       CASE WHEN regexp_full_match(trim(mileage), '[+-]?[0-9]+') THEN CAST(trim(mileage) AS BIGINT) END AS mileage,
       mileage AS mileage_raw,
       {parse_ts('date')} AS date, date AS date_raw,
       {parse_ts('completion_date')} AS completion_date, completion_date AS completion_date_raw,
       {parse_ts('actual_finish_date')} AS actual_finish_date, actual_finish_date AS actual_finish_date_raw,
       nature_of_complaint, fault_codes, description, srr_number, mechanic, customer_id, customer_name,
       next_recommendation, category, lead_technician, bill_number,
       TRY_CAST(trim(interco_amount) AS DOUBLE) AS interco_amount, interco_amount AS interco_amount_raw,
       TRY_CAST(trim(cost) AS DOUBLE) AS cost, cost AS cost_raw
FROM prep""")

ORACLE["clean_work_order"] = w(PREP, """
SELECT row_ix, work_order AS work_order_raw,
       regexp_replace(work_order, '[^\\p{L}\\p{N}]', '', 'g') AS work_order
FROM prep""")

ORACLE["trim_work_order"] = w(PREP, f"SELECT row_ix, {strip('work_order')} AS work_order FROM prep")

ORACLE["format_dates"] = w(CLEAN, """
SELECT row_ix, date AS date_raw, date_fmt AS date, CASE WHEN date_fmt IS NULL THEN 'invalid_date' END AS reason
FROM cl""")

ORACLE["coerce_dates"] = w(CLEAN, "SELECT row_ix, date_fmt AS date FROM cl WHERE date_fmt IS NOT NULL")

ORACLE["clean_description"] = w(CLEAN, "SELECT row_ix, description_raw, desc_clean AS description FROM cl")

ORACLE["fill_strip_text"] = w(PREP, f"""
SELECT row_ix, {strip("coalesce(description, '')")} AS description,
       {strip("coalesce(status, '')")} AS status, {strip("coalesce(category, '')")} AS category
FROM prep""")

ORACLE["coerce_amount"] = w(PREP, """
SELECT row_ix,
       coalesce(CASE WHEN isnan(TRY_CAST(trim(cost) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim(cost) AS DOUBLE) END, 0.0) AS cost
FROM prep""")

ORACLE["component_labels"] = w(CLEAN, "SELECT row_ix, desc_clean AS description, component FROM lab")

ORACLE["severity_score"] = w(CLEAN, """
SELECT row_ix, CAST(severity_high AS INTEGER) AS severity_high, CAST(severity_medium AS INTEGER) AS severity_medium,
       CAST(severity_low AS INTEGER) AS severity_low, severity
FROM lab""")

ORACLE["fault_category_rules"] = w(CLEAN, "SELECT row_ix, category, fault_category FROM lab")

ORACLE["fault_category_keywords"] = w(FT, "SELECT row_ix, fault_category_kw FROM ft")

ORACLE["cost_value"] = w(PREP, "SELECT row_ix, coalesce(TRY_CAST(trim(cost) AS DOUBLE), 0.0) AS cost_value FROM prep")

ORACLE["mileage_value"] = w(PREP, """
SELECT row_ix, CASE WHEN regexp_full_match(trim(mileage), '[+-]?[0-9]+') THEN CAST(trim(mileage) AS BIGINT) END AS mileage_value
FROM prep""")

ORACLE["completion_date"] = w(PREP, """
SELECT row_ix, strftime(try_strptime(completion_date, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS completion_ts
FROM prep""")

ORACLE["missing_columns"] = w(CELLS, """,
sh AS (SELECT path, sheet_name, list(DISTINCT """ + strip("value") + """) AS h FROM real WHERE row_ix = 3 GROUP BY ALL),
m AS (
  SELECT s.path, s.sheet_name,
         list_sort(list_filter(['WO No', 'Open Date', 'Nature of Complaint', 'Job Description'],
                               lambda x: NOT list_contains(coalesce(sh.h, []), x))) AS miss
  FROM (SELECT path, sheet_name FROM cells WHERE cell_type = 'sheet') s
  LEFT JOIN sh ON sh.path = s.path AND sh.sheet_name = s.sheet_name
)
SELECT path, sheet_name, array_to_string(miss, ', ') AS missing, CAST(len(miss) AS INTEGER) AS n_missing FROM m""")

ORACLE["drop_all_null"] = w(PREP, """
SELECT row_ix, work_order FROM prep
WHERE NOT (work_order IS NULL AND date IS NULL AND description IS NULL AND nature_of_complaint IS NULL)""")

ORACLE["active_faults"] = w(GOOD, "SELECT row_ix, work_order, vehicle_type FROM good WHERE completion_date IS NULL")

ORACLE["vehicle_history"] = w(GOOD, """
SELECT row_ix, vehicle_id, date, description FROM good WHERE starts_with(vehicle_id, 'V1')""")

ORACLE["faults_by_category"] = w(GOOD, "SELECT row_ix, category, description FROM good WHERE category = 'REPAIR'")

ORACLE["faults_by_severity"] = w(GOOD, "SELECT row_ix, severity, description FROM good WHERE severity = 'high'")

ORACLE["stored_page"] = w(GOOD, """
SELECT work_order, row_ix, date FROM good ORDER BY work_order ASC NULLS FIRST, row_ix LIMIT 25 OFFSET 2500""")
ORACLE["stored_search"] = w(GOOD, """
SELECT row_ix, work_order, location, nature_of_complaint, description, next_recommendation FROM good
WHERE contains(lower(concat_ws(' ', work_order, location, nature_of_complaint, description, next_recommendation)), 'brake pads')""")
ORACLE["stored_severity"] = ORACLE["faults_by_severity"]

ORACLE["row_validity"] = w(CLEAN, "SELECT row_ix, errors = '' AS is_valid, errors FROM enr")

ORACLE["raw_row_validity"] = w(CLEAN, """
SELECT row_ix, errors = '' AS is_valid, errors FROM (
  SELECT row_ix, concat_ws(',',
      CASE WHEN coalesce(work_order, '') = '' THEN 'missing_work_order' END,
      CASE WHEN coalesce(date, '') = '' THEN 'missing_date' END,
      CASE WHEN date <> '' AND NOT regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}') THEN 'invalid_date' END,
      CASE WHEN coalesce(description, '') = '' THEN 'missing_description' END,
      CASE WHEN cost IS NOT NULL AND TRY_CAST(trim(cost) AS DOUBLE) IS NULL THEN 'invalid_cost' END,
      CASE WHEN mileage IS NOT NULL AND NOT regexp_full_match(trim(mileage), '[+-]?[0-9]+') THEN 'invalid_mileage' END) AS errors
  FROM prep)""")

ORACLE["table_search"] = w(GOOD, """
SELECT row_ix, work_order, location, nature_of_complaint, description, next_recommendation FROM good
WHERE contains(lower(concat_ws(' ', work_order, location, nature_of_complaint, description, next_recommendation)), 'brake')""")

ORACLE["table_page"] = w(GOOD, """
SELECT work_order, row_ix, date FROM good ORDER BY work_order ASC NULLS FIRST, row_ix LIMIT 10 OFFSET 30""")

ORACLE["page_after"] = w(GOOD, """
SELECT work_order, row_ix, date FROM good WHERE work_order IS NOT NULL OR row_ix > 89
ORDER BY work_order ASC NULLS FIRST, row_ix LIMIT 200""")

ORACLE["fault_statistics"] = w(PREP, """
SELECT count(*) AS total_records,
       count(*) FILTER (WHERE completion_date IS NULL) AS active_faults,
       count(DISTINCT location) AS unique_locations,
       CAST(round(avg(TRY_CAST(mileage AS DOUBLE)), 4) AS DECIMAL(20,4)) AS avg_mileage,
       CAST(coalesce(sum(TRY_CAST(interco_amount AS DECIMAL(38,2))), 0) AS DECIMAL(38,2)) AS total_intercost,
       CAST(coalesce(sum(TRY_CAST(cost AS DECIMAL(38,2))), 0) AS DECIMAL(38,2)) AS total_custcost
FROM prep""")

ORACLE["value_counts"] = w(FT, """
SELECT 'categories' AS dimension, category AS value, count(*) AS n FROM ft WHERE category IS NOT NULL GROUP BY category
UNION ALL
SELECT 'complaints_by_type', nature_of_complaint, count(*) FROM ft WHERE nature_of_complaint IS NOT NULL GROUP BY nature_of_complaint
UNION ALL
SELECT 'fault_categories', fault_category_kw, count(*) FROM ft WHERE fault_category_kw IS NOT NULL GROUP BY fault_category_kw""")

ORACLE["top_values"] = w(FT, """
SELECT 'fault_categories' AS dimension, fault_category_kw AS value, count(*) AS n
FROM ft WHERE fault_category_kw IS NOT NULL GROUP BY fault_category_kw ORDER BY n DESC, value""")

ORACLE["fault_summary"] = w(GOOD, """
SELECT count(*) AS total_faults,
       count(*) FILTER (WHERE completion_date IS NULL) AS active_faults,
       count(*) FILTER (WHERE severity = 'high') AS high_severity_faults
FROM good""")

ORACLE["sheet_counts"] = w(COUNTS, "SELECT path, sheet_ix, sheet_name, n, status FROM counts")

ORACLE["sheet_share"] = w(COUNTS, """
SELECT path, sheet_name, n,
       CASE WHEN sum(n) OVER (PARTITION BY path) > 0
            THEN CAST(round(n * 100.0 / sum(n) OVER (PARTITION BY path), 4) AS DECIMAL(10,4)) END AS share_pct
FROM counts WHERE n IS NOT NULL""")

ORACLE["ingest_summary"] = w(COUNTS, """
SELECT path, count(*) AS total_sheets, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_rows FROM counts GROUP BY path""")

ORACLE["next_fault_ids"] = w(NEW_FAULTS, "SELECT fault_id, row_ix FROM numbered")

ORACLE["append_faults"] = w(NEW_FAULTS, """
SELECT fault_id, vehicle_id, fault_description, severity, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts, status
FROM fault_log
UNION ALL
SELECT fault_id, vehicle_id, fault_description, severity, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts, 'open'
FROM numbered""")

ORACLE["close_faults"] = w(CLOSE, """
SELECT f.fault_id, f.vehicle_id, CASE WHEN r.fault_id IS NOT NULL THEN 'closed' ELSE f.status END AS status
FROM fault_log f LEFT JOIN req r ON r.fault_id = f.fault_id""")

ORACLE["close_faults_unknown"] = w(CLOSE, """
SELECT r.fault_id, 'no fault has the id ' || r.fault_id AS error
FROM req r WHERE r.fault_id NOT IN (SELECT fault_id FROM fault_log)""")

ORACLE["latest_logs"] = w(APP_LOG, """
SELECT log_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts, message
FROM (SELECT * FROM app_log ORDER BY log_id DESC LIMIT 100)""")

ORACLE["log_retention"] = w(APP_LOG, """
SELECT log_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts, message
FROM (SELECT * FROM app_log ORDER BY log_id DESC LIMIT 1000)""")

ORACLE["log_store_retention"] = ORACLE["log_retention"]

ORACLE["logs_after"] = w(APP_LOG, """
SELECT log_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts, message FROM app_log WHERE log_id > 4999""")

ORACLE["log_parse"] = w(APP_LOG + """,
lines AS (SELECT log_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || '] ' || message AS line FROM app_log)""", r"""
SELECT log_id,
       regexp_extract(line, '^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3})\] ?(.*)$', 1) AS ts,
       regexp_extract(line, '^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3})\] ?(.*)$', 2) AS message
FROM lines""")

ORACLE["render_prompt"] = w(GOOD, f"""
SELECT row_ix, {_fill(TEMPLATE_CLASSIFY, complaint='nature_of_complaint', description='description')} AS prompt
FROM good""")

ORACLE["history_prompt"] = w(GOOD, f""",
ranked AS (
  SELECT vehicle_id, date, row_ix, description,
         row_number() OVER (PARTITION BY vehicle_id ORDER BY date, row_ix) AS rk
  FROM good
),
pages AS (
  SELECT vehicle_id, CAST((rk - 1) // 1000 AS BIGINT) AS page, count(*) AS n_entries,
         string_agg(coalesce(date, '') || ': ' || coalesce(description, ''), chr(10) ORDER BY rk) AS history
  FROM ranked GROUP BY ALL
)
SELECT vehicle_id, page, n_entries, {_fill(TEMPLATE_HISTORY, vehicle_id='vehicle_id', history_data='history')} AS prompt
FROM pages""")

ORACLE["render_report"] = w(GOOD, f"""
SELECT row_ix, {_fill(TEMPLATE_QUICK, category='fault_category', issue='description', solution='next_recommendation')} AS report
FROM good""")

ORACLE["classify_memoised"] = w(GOOD, """,
fw AS (SELECT row_ix, split_part(coalesce(nature_of_complaint, ''), ' ', 1) AS w FROM good)
SELECT row_ix,
       CASE WHEN upper(substr(w, 1, 1)) || lower(substr(w, 2)) IN
                 ('Engine', 'Transmission', 'Electrical', 'Brakes', 'Suspension', 'Body', 'Maintenance')
            THEN upper(substr(w, 1, 1)) || lower(substr(w, 2)) ELSE 'Other' END AS model_category
FROM fw""")

ORACLE["registered_format"] = w(WO, f""",
lite AS (
  SELECT row_ix, {strip('wo_no')} AS work_order, {strip("coalesce(st, '')")} AS status,
         strftime({parse_ts('open_date')}, '%Y-%m-%d %H:%M:%S') AS date,
         {strip("coalesce(job_description, '')")} AS description, {strip("coalesce(cat, '')")} AS category,
         coalesce(CASE WHEN isnan(TRY_CAST(trim(custamt) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim(custamt) AS DOUBLE) END, 0.0) AS cost,
         loc AS location, nature_of_complaint
  FROM wo
),
lite2 AS (SELECT *, lower(coalesce(nature_of_complaint, '')) || ' ' || lower(coalesce(description, '')) AS kt FROM lite WHERE date IS NOT NULL)
SELECT row_ix, work_order, status, date, description, category, cost, location, {P18} AS fault_category_kw
FROM lite2""")

ORACLE["sheet_pivot"] = w(PIVOT, "SELECT * FROM piv")

ORACLE["header_discovery"] = w(CELLS, """
SELECT DISTINCT ON (path) path, sheet_ix, sheet_name, row_ix AS header_row
FROM real WHERE contains(value, 'WO No') ORDER BY path, sheet_ix, row_ix""")

ORACLE["detect_format"] = w(CELLS, """,
d AS (
  SELECT path,
         bool_or(coalesce(contains(value, 'WO No') AND cell_type <> 'error', false)) AS found,
         max(CASE WHEN cell_type = 'error' THEN value END) AS err
  FROM cells GROUP BY path
)
SELECT path, CASE WHEN found THEN 'kardex' END AS format,
       CASE WHEN err IS NOT NULL THEN 'unreadable workbook: ' || err
            WHEN NOT found THEN 'no registered format matches' END AS reason
FROM d""")

ORACLE["sheet_vehicle_type"] = w(CELLS, """,
v AS (
  SELECT path, sheet_ix, sheet_name,
         max(CASE WHEN row_ix = 3 AND col_ix = 0 AND cell_type = 'str' THEN value END) AS v
  FROM real GROUP BY ALL
)
SELECT path, sheet_ix, sheet_name, coalesce(""" + strip("v") + """, 'Unknown') AS vehicle_type FROM v""")

ORACLE["sheet_body"] = w(CELLS, """,
v AS (
  SELECT path, sheet_ix, sheet_name,
         coalesce(""" + strip("max(CASE WHEN row_ix = 3 AND col_ix = 0 AND cell_type = 'str' THEN value END)") + """, 'Unknown') AS vehicle_type
  FROM real GROUP BY ALL
)
SELECT r.path, r.sheet_name, v.vehicle_type, r.row_ix, r.col_ix, r.value
FROM real r JOIN v ON v.path = r.path AND v.sheet_ix = r.sheet_ix AND v.sheet_name = r.sheet_name
WHERE r.row_ix >= 5""")

ORACLE["sheet_subset"] = w(PIVOT, """
SELECT *, sheet_name AS vehicle_type FROM piv
WHERE sheet_name IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')""")

ORACLE["file_admission"] = w("""
up AS (
  SELECT o_orderkey AS upload_id,
         'kardex_' || CAST(o_orderkey AS VARCHAR)
           || (['.xlsx', '.XLSX', '.pdf', '.txt', '.xls', '', '.xlsx.bak'])[o_orderkey % 7 + 1] AS name
  FROM orders
)""", """
SELECT upload_id, name,
       contains(name, '.') AND lower(regexp_extract(name, '\\.([^.]*)$', 1)) IN ('pdf', 'xlsx', 'xls') AS admitted
FROM up""")

_ALL_HEADERS = ", ".join(f"'{h}'" for h in HEADERS)

ORACLE["fault_file_flag"] = w(CELLS, f""",
h AS (SELECT path, list(DISTINCT {strip('value')}) AS h FROM real WHERE sheet_ix = 0 AND row_ix = 3 GROUP BY path),
f AS (SELECT DISTINCT path FROM cells)
SELECT f.path, coalesce(len(list_filter([{_ALL_HEADERS}], lambda x: NOT list_contains(coalesce(h.h, []), x))) = 0, false) AS is_fault_data
FROM f LEFT JOIN h ON h.path = f.path""")

ORACLE["load_status"] = w(CELLS, f""",
h AS (SELECT path, list(DISTINCT {strip('value')}) AS h FROM real WHERE sheet_ix = 0 AND row_ix = 3 GROUP BY path),
e AS (SELECT path, max(CASE WHEN cell_type = 'error' THEN value END) AS err FROM cells GROUP BY path),
m AS (
  SELECT e.path, e.err,
         list_sort(list_filter([{_ALL_HEADERS}], lambda x: NOT list_contains(coalesce(h.h, []), x))) AS miss
  FROM e LEFT JOIN h ON h.path = e.path
)
SELECT path, err IS NULL AND len(miss) = 0 AS success,
       CASE WHEN err IS NOT NULL THEN 'unreadable workbook: ' || err
            WHEN len(miss) > 0 THEN 'columns absent: ['
                 || array_to_string(list_transform(miss, lambda x: '''' || x || ''''), ', ') || ']'
            ELSE 'loaded' END AS message
FROM m""")

ORACLE["raw_preview"] = w(CELLS, """
SELECT path, row_ix, col_ix, value FROM real WHERE sheet_ix = 0 AND row_ix < 10 AND value IS NOT NULL""")

ORACLE["sheet_columns"] = w(CELLS, f"""
SELECT path, sheet_name, string_agg({strip('value')}, ' | ' ORDER BY col_ix) AS columns, count(*) AS n_columns
FROM real WHERE row_ix = 3 GROUP BY path, sheet_name""")

ORACLE["sheet_sample"] = w(PIVOT, """,
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY path, sheet_name ORDER BY row_ix) AS rn FROM piv
),
pairs AS (
  SELECT path, sheet_name, row_ix, 'wo_no' AS "column", wo_no AS value FROM firsts WHERE rn <= 4
  UNION ALL SELECT path, sheet_name, row_ix, 'open_date', open_date FROM firsts WHERE rn <= 4
  UNION ALL SELECT path, sheet_name, row_ix, 'job_description', job_description FROM firsts WHERE rn <= 4
)
SELECT * FROM pairs WHERE value IS NOT NULL""")

ORACLE["records_json"] = w(GOOD, """
SELECT row_ix,
       CAST(to_json(struct_pack(work_order := work_order, date := date, severity := severity,
                                component := component, fault_category := fault_category)) AS VARCHAR) AS json
FROM good""")

ORACLE["stack_sheets"] = w(PIVOT, """
SELECT * EXCLUDE (sheet_ix) FROM piv WHERE sheet_name IN ('AUTOMOBILE', 'FURNITURE', 'MACHINERY')
UNION ALL BY NAME
SELECT path, sheet_name, row_ix, wo_no, open_date, nature_of_complaint, job_description
FROM piv WHERE sheet_name IN ('BUILDING', 'HOUSEHOLD')""")

ORACLE["log_stitch"] = w("""
ev AS (SELECT event_id, ts, event_type, props FROM events)""", """
SELECT 'app.log' AS path,
       CAST(floor(event_id * 2 / 1500) * 1500 AS BIGINT) AS split_start,
       event_id * 2 AS line_id,
       strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts,
       CASE WHEN event_type = 'error' THEN event_type || chr(10) || '  details ' || coalesce(props, '')
            ELSE event_type END AS message
FROM ev""")


# Workbooks of up to 1500 orders, one sheet per status.  Of eight books the
# fourth is no zip file, the sixth has a broken second sheet, the seventh
# another layout.
BOOKS = """
bo AS (
  SELECT *, o_orderkey // 1500 AS b, 3 + row_number() OVER (PARTITION BY o_orderkey // 1500, o_orderstatus ORDER BY o_orderkey) AS r FROM orders
),
bs AS (
  SELECT b, 'book_' || b || '.xlsx' AS path, ix, st, 'Status ' || st AS sheet_name, b % 8 = 5 AND ix = 1 AS broken
  FROM (SELECT DISTINCT b FROM bo), (VALUES (0, 'F'), (1, 'O'), (2, 'P')) s(ix, st) WHERE b % 8 <> 3
),
heads AS (
  SELECT * FROM (VALUES (0, 'WO No', 'Ticket'), (1, 'Open Date', 'Opened'), (2, 'Customer', 'Client'), (3, 'Job Description', 'Work'), (4, 'Urgent', 'Urgent')) h(c, usual, other)
),
bc AS (
  SELECT path, ix, sheet_name, -1 AS r, -1 AS c, 'sheet' AS kind, NULL AS v FROM bs
  UNION ALL SELECT path, ix, sheet_name, -1, -1, 'error', 'ParseError' FROM bs WHERE broken
  UNION ALL SELECT DISTINCT 'book_' || b || '.xlsx', -1, NULL, -1, -1, 'error', 'BadZipFile' FROM bo WHERE b % 8 = 3
  UNION ALL SELECT path, ix, sheet_name, 0, 0, 'str', 'Book ' || b FROM bs WHERE NOT broken
  UNION ALL SELECT path, ix, sheet_name, 3, c, 'str', CASE WHEN b % 8 = 6 THEN other ELSE usual END FROM bs, heads WHERE NOT broken
  UNION ALL
  SELECT path, ix, sheet_name, r, c, CASE c WHEN 1 THEN 'date' WHEN 2 THEN CASE WHEN o_orderkey % 97 = 0 THEN 'cellerror' ELSE 'num' END WHEN 4 THEN 'bool' ELSE 'str' END,
         CASE c WHEN 0 THEN 'WO-' || o_orderkey WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
                WHEN 2 THEN CASE WHEN o_orderkey % 97 = 0 THEN '#N/A' ELSE (o_custkey // 4) || (['', '.25', '.5', '.75'])[o_custkey % 4 + 1] END
                WHEN 3 THEN o_orderpriority ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'True' ELSE 'False' END END
  FROM bs JOIN bo USING (b), heads WHERE st = o_orderstatus AND NOT broken
),
cells AS (
  SELECT path, CAST(ix AS INTEGER) AS sheet_ix, sheet_name, CAST(r AS BIGINT) AS row_ix, CAST(c AS INTEGER) AS col_ix, kind AS cell_type, v AS value FROM bc
),
books AS (
  SELECT DISTINCT b, 'book_' || b || '.xlsx' AS path FROM bo
)"""
ORACLE["workbook_cells"] = w(BOOKS, "SELECT * FROM cells")
ORACLE["workbook_limits"] = w(BOOKS, "SELECT * FROM cells WHERE sheet_ix = 0 AND row_ix BETWEEN 0 AND 5 AND col_ix IN (0, 2)")
ORACLE["workbook_headers"] = w(BOOKS, """
SELECT path, CAST(CASE WHEN b % 8 NOT IN (3, 6) THEN 0 END AS INTEGER) AS sheet_ix, CASE WHEN b % 8 NOT IN (3, 6) THEN 'Status F' END AS sheet_name,
       CAST(CASE WHEN b % 8 NOT IN (3, 6) THEN 3 END AS BIGINT) AS header_row, CASE WHEN b % 8 = 3 THEN 'BadZipFile' END AS reason FROM books""")
ORACLE["workbook_formats"] = w(BOOKS, """
SELECT path, CASE WHEN b % 8 NOT IN (3, 6) THEN 'kardex' END AS format,
       CASE b % 8 WHEN 3 THEN 'unreadable workbook: BadZipFile' WHEN 5 THEN 'unreadable workbook: ParseError' WHEN 6 THEN 'no registered format matches' END AS reason FROM books""")
ORACLE["workbook_load_status"] = w(BOOKS, """
SELECT path, b % 8 NOT IN (3, 5, 6) AS success,
       CASE b % 8 WHEN 3 THEN 'unreadable workbook: BadZipFile' WHEN 5 THEN 'unreadable workbook: ParseError'
                  WHEN 6 THEN 'columns absent: [''Open Date'', ''WO No'']' ELSE 'loaded' END AS message FROM books""")
ORACLE["workbook_fault_files"] = w(BOOKS, "SELECT path, b % 8 NOT IN (3, 6) AS is_fault_data FROM books")
ORACLE["workbook_sheet_counts"] = w(BOOKS, """
SELECT path, sheet_ix, sheet_name, CASE WHEN NOT bool_or(cell_type = 'error') THEN nullif(count(DISTINCT row_ix) FILTER (row_ix >= 4), 0) END AS n,
       CASE WHEN bool_or(cell_type = 'error') THEN 'error' WHEN count(*) FILTER (row_ix >= 4) = 0 THEN 'no_body' ELSE 'ok' END AS status
FROM cells GROUP BY ALL""")

LOG_LINES = """
SELECT CAST(event_id % 3 AS INTEGER) AS log, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts, CAST(n AS BIGINT) AS line_no,
       CASE WHEN n = 0 THEN event_type || ' ' || event_id ELSE '  details ' || coalesce(props, '') END AS line
FROM events, generate_series(0, 3) g(n) WHERE n <= CASE WHEN event_type = 'error' THEN event_id % 4 ELSE 0 END"""
ORACLE["log_entry_lines"] = LOG_LINES
ORACLE["log_stream_lines"] = LOG_LINES

# Odd ids are given first and even ones go on from there.
STORED_LOG = CLOSE + """,
stored AS (
  SELECT *, CAST(substring(fault_id, 2) AS BIGINT) AS n, row_number() OVER (ORDER BY CAST(substring(fault_id, 2) AS BIGINT) % 2 = 0, CAST(substring(fault_id, 2) AS BIGINT)) AS number FROM fault_log
),
asked AS (
  SELECT fault_id, CAST(substring(fault_id, 2) AS BIGINT) AS number FROM req
),
firsts AS (
  SELECT count(*) AS high FROM stored WHERE n % 2 = 1
)"""
ORACLE["fault_log_merge"] = w(STORED_LOG, """
SELECT printf('F%03d', number) AS fault_id, vehicle_id, fault_description, severity, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts,
       CASE WHEN number IN (SELECT number FROM asked, firsts WHERE number <= high OR number % 3 = 0) THEN 'closed' ELSE 'open' END AS status
FROM stored""")
ORACLE["fault_log_unknown"] = w(STORED_LOG, """
SELECT fault_id, 'no fault has the id ' || fault_id AS error FROM asked, firsts WHERE number > high""")
ORACLE["statistics_record"] = w(GOOD, """
SELECT unnest(['total_records', 'active_faults', 'high_severity_faults', 'unique_locations', 'avg_mileage', 'total_intercost', 'total_custcost']) AS measure, CAST(NULL AS VARCHAR) AS value,
       unnest(list_transform([count(*)::VARCHAR, (count(*) FILTER (completion_date IS NULL))::VARCHAR, (count(*) FILTER (severity = 'high'))::VARCHAR, count(DISTINCT location)::VARCHAR,
                              CAST(round(avg(TRY_CAST(mileage AS DOUBLE)), 4) AS DECIMAL(20,4))::VARCHAR,
                              coalesce(sum(TRY_CAST(interco_amount AS DECIMAL(38,2))), 0)::VARCHAR, coalesce(sum(TRY_CAST(cost AS DECIMAL(38,2))), 0)::VARCHAR],
                             lambda x: CAST(x AS DECIMAL(38,4)))) AS amount FROM good
UNION ALL SELECT 'categories', category, CAST(count(*) AS DECIMAL(38,4)) FROM good WHERE category IS NOT NULL GROUP BY category
UNION ALL SELECT 'complaints_by_type', nature_of_complaint, CAST(count(*) AS DECIMAL(38,4)) FROM good WHERE nature_of_complaint IS NOT NULL GROUP BY nature_of_complaint
UNION ALL SELECT 'fault_categories', fault_category, CAST(count(*) AS DECIMAL(38,4)) FROM good WHERE fault_category IS NOT NULL GROUP BY fault_category""")
ORACLE["first_sheet"] = w(PIVOT, " SELECT * FROM piv WHERE sheet_ix = 0")
ORACLE["fault_record"] = w(GOOD, """
SELECT 'vehicle_fault' AS data_type, count(*) AS total_records, count(*) FILTER (WHERE completion_date IS NULL) AS active_faults, count(DISTINCT location) AS unique_locations,
       CAST(round(avg(TRY_CAST(mileage AS DOUBLE)), 4) AS DECIMAL(20,4)) AS avg_mileage,
       CAST(coalesce(sum(TRY_CAST(interco_amount AS DECIMAL(38,2))), 0) AS DECIMAL(38,2)) AS total_intercost, CAST(coalesce(sum(TRY_CAST(cost AS DECIMAL(38,2))), 0) AS DECIMAL(38,2)) AS total_custcost,
       count(*) FILTER (WHERE severity = 'high') AS high_severity_faults
FROM good""")
