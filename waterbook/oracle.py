"""Oracle SQL (DuckDB) for every registered query.

Written apart from the Spark plans, from what each report means: filtered
aggregates over one row per bill, grouping sets, lists and correlated
subqueries where the plans pre-aggregate, join and use windows, so agreement
checks those plans.

Only the generated base tables are registered, so each query inlines the
domain tables it needs as CTEs built from ``waterbook.sources.fixtures``.
"""

from __future__ import annotations

import re

from waterbook import catalog as C
from waterbook.sources import fixtures as FX
from waterbook.sources import literals as L


def _cte(name: str, columns, source: str, where: str | None = None) -> str:
    cols = ", ".join(f"{expr} AS {alias}" for alias, expr in columns)
    w = f" WHERE {where}" if where else ""
    return f"{name} AS (SELECT {cols} FROM {source}{w})"


FIXTURE_CTES = {
    "d_customer": _cte("d_customer", FX.CUSTOMER, "customer"),
    "d_street": _cte(
        "d_street", FX.STREET, f"(SELECT n_nationkey, unnest([0, 1]) AS d FROM nation WHERE {FX.STREET_WHERE}) s"
    ),
    "d_consumption": _cte("d_consumption", FX.CONSUMPTION, "orders"),
    "d_large_reading": _cte(
        "d_large_reading", FX.LARGE_READING, "events JOIN customer ON c_custkey = user_id"
    ),
    "d_trip": (
        "d_trip AS (SELECT *, " + FX.TRIP_END_DUCKDB + " AS end_at FROM ("
        + "SELECT " + ", ".join(f"{e} AS {a}" for a, e in FX.TRIP) + f" FROM events WHERE {FX.TRIP_WHERE}) t0)"
    ),
    "d_fleet": f"d_fleet AS (SELECT DISTINCT {FX.PLATE} AS car FROM events)",
    "d_vehicle_profile": _cte(
        "d_vehicle_profile",
        FX.VEHICLE_PROFILE,
        "(SELECT DISTINCT user_id FROM events) v",
        FX.VEHICLE_PROFILE_WHERE,
    ),
    "d_profile_write": _cte("d_profile_write", FX.PROFILE_WRITE, "events", FX.PROFILE_WRITE_WHERE),
    "d_flush_job": _cte("d_flush_job", FX.FLUSH_JOB, "part"),
}
FIXTURE_ORDER = list(FIXTURE_CTES)


def with_fixtures(body: str) -> str:
    """Prefix the fixture CTEs a query body refers to. The body starts with
    its own CTE list (without ``WITH``) or with ``SELECT``."""
    used = [n for n in FIXTURE_ORDER if re.search(rf"\b{n}\b", body)]
    ctes = ",\n".join(FIXTURE_CTES[n] for n in used)
    if body.lstrip().upper().startswith("SELECT"):
        return f"WITH {ctes}\n{body}"
    return f"WITH {ctes},\n{body}"


# -- SQL snippets generated from the literal dimensions -------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def region_name(x: str) -> str:
    whens = " ".join(f"WHEN {x} IN ({', '.join(map(q, codes))}) THEN {q(n)}" for codes, n, _, _ in L.REGIONS)
    return f"CASE {whens} ELSE {q(L.REGION_OTHER_NAME)} END"


def region_ordinal(x: str) -> str:
    whens = " ".join(f"WHEN {x} IN ({', '.join(map(q, codes))}) THEN {o}" for codes, _, _, o in L.REGIONS)
    return f"CASE {whens} ELSE {L.REGION_OTHER_ORDINAL} END"


def region_upper(x: str) -> str:
    whens = " ".join(f"WHEN {x} IN ({', '.join(map(q, codes))}) THEN {q(u)}" for codes, _, u, _ in L.REGIONS)
    other = f"concat({q(L.REGION_OTHER_UPPER_PREFIX)}, {x}, {q(L.REGION_OTHER_UPPER_SUFFIX)})"
    return f"CASE {whens} ELSE {other} END"


def purpose_name(x: str) -> str:
    whens = " ".join(f"WHEN {x} = {q(c)} THEN {q(n)}" for c, n, _ in L.PURPOSES)
    return f"CASE {whens} ELSE {q(L.PURPOSE_OTHER_NAME)} END"


def purpose_ordinal(x: str) -> str:
    whens = " ".join(f"WHEN {x} = {q(c)} THEN {o}" for c, _, o in L.PURPOSES)
    return f"CASE {whens} ELSE {L.PURPOSE_OTHER_ORDINAL} END"


def class_name(x: str) -> str:
    whens = " ".join(f"WHEN {q(c)} THEN {q(n)}" for c, n in L.CLASSES)
    return f"CASE {x} {whens} ELSE {q(L.CLASS_OTHER_NAME)} END"


def norm(x: str) -> str:
    return f"upper(trim({x}))"


def growth(base: str, cmp_: str, policy: str = "zero", order: str = "sql") -> str:
    d = f"CAST(({cmp_}) - ({base}) AS DOUBLE)"
    b = f"CAST({base} AS DOUBLE)"
    ratio = f"({d} * 100.0) / {b}" if order == "sql" else f"({d} / {b}) * 100.0"
    if policy == "zero":
        at_zero = "0.0"
    elif policy == "null":
        at_zero = "CAST(NULL AS DOUBLE)"
    else:
        at_zero = f"CASE WHEN {d} > 0 THEN 'inf'::DOUBLE WHEN {d} < 0 THEN '-inf'::DOUBLE ELSE 0.0 END"
    return f"CASE WHEN {b} = 0 THEN {at_zero} ELSE {ratio} END"


def grouped_vi(x: str) -> str:
    return f"format('{{:t.}}', CAST(round({x}, 0) AS BIGINT))"


# -- consumption ------------------------------------------------------------------

M, Y = C.MONTH, C.YTD
V = "DECIMAL(28, 2)"

#: Volume sums of the two compared years over rows ``(m3, later)``.
PAIR = (
    f"CAST(COALESCE(SUM(m3) FILTER (WHERE NOT later), 0) AS {V}) AS base, "
    f"CAST(COALESCE(SUM(m3) FILTER (WHERE later), 0) AS {V}) AS cmp"
)


def bills(p, where: str = "", join: str = "LEFT", active: bool = True) -> str:
    """CTE ``bill``: a row per compared bill with its customer's attributes."""
    live = "AND COALESCE(b.is_cancelled, 0) = 0" if active else ""
    return f"""bill AS (
  SELECT c.*, concat(c.street_code, c.meter_code) AS code, {norm('c.region_code')} AS area,
         {norm('b.purpose_code')} AS purpose, b.year = {p.cmp_year} AS later, COALESCE(b.volume, 0) AS m3
  FROM d_consumption b {join} JOIN d_customer c ON c.customer_id = b.customer_id
  WHERE b.year IN ({p.base_year}, {p.cmp_year}) AND b.month BETWEEN {p.month_from} AND {p.month_to} {live} {where})"""


HAS_STREET = "AND EXISTS (SELECT 1 FROM d_street s WHERE s.street_code = c.street_code AND s.street_sub = c.street_sub)"


def compared(rows: str, policy: str = "zero", order: str = "sql") -> str:
    """``rows`` (a query with base and cmp) and its difference and growth."""
    return f"SELECT *, CAST(cmp - base AS {V}) AS diff, {growth('base', 'cmp', policy, order)} AS growth_pct FROM ({rows})"


def regional(policy: str = "zero") -> str:
    return compared(
        f"""SELECT CASE GROUPING(area_name) WHEN 1 THEN {q(L.REGION_TOTAL_NAME)} ELSE area_name END AS region,
         CASE GROUPING(area_name) WHEN 1 THEN {L.REGION_TOTAL_ORDINAL} ELSE ANY_VALUE(place) END AS region_ordinal,
         GROUPING(area_name) = 1 AS is_total, {PAIR}
  FROM (SELECT *, {region_name('area')} AS area_name, {region_ordinal('area')} AS place FROM bill)
  GROUP BY GROUPING SETS ((area_name), ())""",
        policy,
    )


def leaders(n: int = L.TOP_N) -> str:
    label = (
        f"concat({q(L.TOP_LABEL_PREFIX)}, rank, {q(L.TOP_LABEL_MIDDLE)}, customer_code, "
        f"{q(L.TOP_LABEL_SEPARATOR)}, customer_name)"
    )
    each = f"""SELECT {region_name('area')} AS region, {region_ordinal('area')} AS region_ordinal, code AS customer_code,
           name AS customer_name, {PAIR} FROM bill GROUP BY ALL"""
    ranked = f"""SELECT *, CAST(row_number() OVER (PARTITION BY region
             ORDER BY cmp DESC, customer_code NULLS FIRST, customer_name NULLS FIRST) AS INTEGER) AS rank FROM ({each})"""
    return f"SELECT *, {label} AS label FROM ({compared(ranked)}) WHERE rank <= {n}"


def sectioned() -> str:
    return f"""{bills(M)},
regions AS ({regional()}),
best AS ({leaders()}),
sheet AS (
  SELECT 1 AS section, 1 + is_total::INTEGER AS sort_order, region_ordinal, NULL::INTEGER AS rank, region AS label,
         base, cmp, diff, growth_pct, is_total FROM regions
  UNION ALL BY NAME
  SELECT 2 AS section, 1 AS sort_order, region_ordinal, 0 AS rank, false AS is_total,
         upper(concat({q(L.TOP_HEADER_PREFIX)}, region, {q(L.TOP_HEADER_SUFFIX)})) AS label
  FROM regions WHERE NOT is_total
  UNION ALL BY NAME
  SELECT 2 AS section, 2 AS sort_order, region_ordinal, rank, label, base, cmp, diff, growth_pct, false AS is_total
  FROM best)"""


def _status() -> str:
    return f"""CASE WHEN base IS NULL AND cmp IS NULL THEN {q(L.STATUS_SECTION)}
            WHEN contains(label, '{L.TOTAL_MARKER}') AND diff > 0 THEN {q(L.STATUS_TOTAL_UP)}
            WHEN diff > 0 THEN {q(L.STATUS_UP)} WHEN diff < 0 THEN {q(L.STATUS_DOWN)}
            ELSE {q(L.STATUS_STABLE)} END"""


def _hundredths(base: str, diff: str) -> str:
    """100 * diff / base to two decimals, half away from zero, in integers."""
    b, d = (f"CAST(({x}) * 100 AS HUGEINT)" for x in (base, diff))
    return (
        f"CASE WHEN ({base}) <> 0 THEN CAST(sign({diff}) * sign({base}) * "
        f"((20000 * abs({d}) + abs({b})) // (2 * abs({b}))) AS BIGINT) END"
    )


def _fixed2(h: str) -> str:
    return (
        f"concat(CASE WHEN {h} < 0 THEN '-' ELSE '' END, CAST(abs({h}) // 100 AS VARCHAR), ',', "
        f"lpad(CAST(abs({h}) % 100 AS VARCHAR), 2, '0'))"
    )


SQL: dict[str, str] = {}

SQL["region_month_growth"] = with_fixtures(f"""
{bills(M)}
SELECT region, base, cmp, diff, is_total,
       CASE WHEN is_total THEN {growth('base', 'cmp', 'zero', 'ratio')} ELSE {growth('base', 'cmp', 'inf', 'ratio')} END
         AS growth_pct
FROM ({regional()})
""")

SQL["region_month_growth_filtered"] = with_fixtures(f"{bills(M)}\n{regional()}")


def _typed_filters() -> str:
    f = C.MONTH_FILTERS
    wanted = ", ".join(q(t.upper()) for t in C.lists_parse(f.regions))
    return (
        f"AND {norm('c.region_code')} IN ({wanted}) AND {norm('c.class_code')} = {q(f.class_code.strip().upper())} "
        f"AND {norm('b.purpose_code')} = {q(f.purpose_code.strip().upper())}"
    )


SQL["region_month_filters"] = with_fixtures(f"{bills(M, _typed_filters())}\n{regional()}")
SQL["region_top_customers"] = with_fixtures(f"{bills(M)}\n{leaders()}")
SQL["region_sectioned_report"] = with_fixtures(f"{sectioned()}\nSELECT * FROM sheet")
SQL["growth_status_label"] = with_fixtures(f"{sectioned()}\nSELECT *, {_status()} AS status FROM sheet")

SQL["report_formatting"] = with_fixtures(f"""
{sectioned()},
h AS (SELECT *, {_hundredths('base', 'diff')} AS h FROM sheet)
SELECT section, sort_order, region_ordinal, rank, label,
  CASE WHEN base IS NULL THEN '' ELSE {grouped_vi('base')} END AS base_text,
  CASE WHEN cmp IS NULL THEN '' ELSE {grouped_vi('cmp')} END AS cmp_text,
  CASE WHEN diff IS NULL THEN '' WHEN diff > 0 THEN concat('+', {grouped_vi('diff')}) ELSE {grouped_vi('diff')} END
    AS diff_text,
  CASE WHEN growth_pct IS NULL THEN ''
       WHEN growth_pct > 0 THEN concat('+', {_fixed2('COALESCE(h, 0)')}, ' %')
       WHEN growth_pct = 0 THEN {q(L.ZERO_GROWTH_TEXT)}
       ELSE concat({_fixed2('COALESCE(h, 0)')}, ' %') END AS growth_text,
  {_status()} AS status
FROM h
""")

# an unknown (NULL) area never matches across a join of the years: one row for each year it has
_BY_AREA = "FROM bill GROUP BY area, CASE WHEN area IS NULL THEN later END"

SQL["region_ytd_growth"] = with_fixtures(f"""
{bills(Y, HAS_STREET, 'INNER')},
areas AS (SELECT area AS region_code, {region_upper('area')} AS region_label, {region_ordinal('area')} AS region_ordinal,
                 false AS is_total, {PAIR} {_BY_AREA}),
whole AS (SELECT {q(L.YTD_TOTAL_CODE)} AS region_code, {q(L.YTD_TOTAL_LABEL)} AS region_label, 6 AS region_ordinal,
                 true AS is_total, {PAIR} FROM bill)
{compared('FROM areas UNION ALL BY NAME FROM whole', 'null')}
""")

SQL["full_join_years"] = with_fixtures(f"""
{bills(Y, join='INNER')}
SELECT *, CAST(cmp - base AS {V}) AS diff FROM (SELECT area AS region_code, {PAIR} {_BY_AREA})
""")


def _purpose(p) -> str:
    known = ", ".join(q(c) for c, _, _ in L.PURPOSES)
    return with_fixtures(f"""
{bills(p, f"AND {norm('c.region_code')} = {q(C.REGION)} AND {norm('b.purpose_code')} IN ({known})", 'INNER')},
in_base AS (SELECT * FROM bill WHERE purpose IN (SELECT purpose FROM bill WHERE NOT later)),
lines AS (
  SELECT COALESCE(purpose, '') AS purpose_code, GROUPING(purpose) = 1 AS is_total, {PAIR}
  FROM in_base GROUP BY ROLLUP (purpose))
{compared(f'''SELECT *, CASE WHEN is_total THEN {L.PURPOSE_TOTAL_ORDINAL} ELSE {purpose_ordinal('purpose_code')} END AS ordinal,
  CASE WHEN is_total THEN {q(L.PURPOSE_TOTAL_NAME)} ELSE {purpose_name('purpose_code')} END AS purpose_name FROM lines''')}
""")


SQL["purpose_month_growth"] = _purpose(M)
SQL["purpose_ytd_growth"] = _purpose(Y)


def _class_growth() -> str:
    banned = ", ".join(q(t.upper()) for t in C.lists_parse(C.CLASS_EXCLUDED))
    where = (
        f"{HAS_STREET} AND {norm('c.region_code')} = {q(C.REGION)} "
        f"AND {norm('concat(c.street_code, c.meter_code)')} NOT IN ({banned})"
    )
    cls = norm("class_code")
    return with_fixtures(f"""
{bills(C.CLASS_PERIOD, where, 'INNER', active=False)},
labelled AS (
  SELECT *, COALESCE(MAX({cls}) FILTER (WHERE later) OVER (PARTITION BY code),
                     MAX({cls}) FILTER (WHERE NOT later) OVER (PARTITION BY code), {q(L.CLASS_UNCLASSIFIED)}) AS kind
  FROM bill)
{compared(f'''SELECT kind AS class_code, GROUPING(kind) = 1 AS is_total, {PAIR},
  CASE GROUPING(kind) WHEN 1 THEN {q(L.CLASS_TOTAL_NAME)} ELSE {class_name('kind')} END AS class_name
  FROM labelled GROUP BY ROLLUP (kind)''', 'null')}
""")


SQL["class_period_growth"] = _class_growth()

SQL["kpi_status"] = with_fixtures(f"""
bill AS (SELECT COALESCE(volume, 0) AS m3, year = {M.cmp_year} AS later FROM d_consumption
         WHERE month = {M.month_from} AND year IN ({M.base_year}, {M.cmp_year}) AND COALESCE(is_cancelled, 0) = 0)
SELECT *, CASE sign(diff) WHEN 1 THEN 'up' WHEN -1 THEN 'down' ELSE 'stable' END AS status
FROM ({compared(f'SELECT {PAIR} FROM bill', 'zero', 'ratio')})
""")

SQL["region_decode"] = with_fixtures(f"""
SELECT customer_id, region_code AS raw_code, {norm('region_code')} AS region_code,
       {region_name(norm('region_code'))} AS region_name, {region_upper(norm('region_code'))} AS region_label,
       {region_ordinal(norm('region_code'))} AS region_ordinal
FROM d_customer
""")

SQL["growth_policies"] = with_fixtures(f"""
bill AS (SELECT customer_id, COALESCE(volume, 0) AS m3, year = {M.cmp_year} AS later FROM d_consumption
         WHERE month = {M.month_from} AND year IN ({M.base_year}, {M.cmp_year}) AND COALESCE(is_cancelled, 0) = 0)
SELECT customer_id, base, cmp, CAST(cmp - base AS {V}) AS diff, {growth('base', 'cmp', 'zero')} AS growth_zero,
       {growth('base', 'cmp', 'null')} AS growth_null, {growth('base', 'cmp', 'inf', 'ratio')} AS growth_inf
FROM (SELECT customer_id, {PAIR} FROM bill GROUP BY customer_id)
""")

SQL["region_growth_rollup"] = with_fixtures(f"""
{bills(M)}
{compared(f'SELECT area AS region_code, GROUPING(area) = 1 AS is_total, {PAIR} FROM bill GROUP BY ROLLUP (area)')}
""")

_LIST_TEXT = (
    "concat(' ', concat(street_code, meter_code), ' ,', COALESCE(class_code, ''), chr(13), chr(10), "
    "COALESCE(region_code, ''), ',,')"
)
SQL["filter_list_tokens"] = with_fixtures(f"""
parts AS (
  SELECT unnest(string_split(replace(replace({_LIST_TEXT}, chr(13), ','), chr(10), ','), ',')) AS t
  FROM d_customer)
SELECT DISTINCT trim(t) AS token FROM parts WHERE trim(t) <> ''
""")


def _listed(op: str, class_code: str) -> str:
    return f"AND concat(c.street_code, c.meter_code) {op} (SELECT concat(street_code, meter_code) FROM d_customer " \
           f"WHERE class_code = {q(class_code)})"


SQL["customer_include_list"] = with_fixtures(f"{bills(M, _listed('IN', C.INCLUDE_CLASS))}\n{regional()}")
SQL["customer_exclude_list"] = with_fixtures(f"{bills(M, _listed('NOT IN', C.EXCLUDE_CLASS))}\n{regional()}")

# -- arrears ---------------------------------------------------------------------

_AMOUNT = "COALESCE(b.amount, 0) + CASE WHEN b.bill_mode = 0 THEN COALESCE(b.amount_1, 0) ELSE 0 END"
_LINES = (
    "(VALUES "
    + ", ".join(f"({q(c)}, {q(n)}, {o}, false)" for c, n, o in L.CASHIERS)
    + f", ({q(L.CASHIER_TOTAL[0])}, {q(L.CASHIER_TOTAL[1])}, {L.CASHIER_TOTAL[2]}, true)"
    + ") AS line(cashier, cashier_name, sort_order, is_total)"
)


def _open_at(day) -> str:
    """Posted by that day, and not paid by then."""
    d = f"DATE '{day.isoformat()}'"
    return f"(b.posted_at <= {d} AND NOT (COALESCE(b.is_paid, 0) = 1 AND COALESCE(b.paid_at <= {d}, true)))"


def _ledger(which: str, regions: str) -> str:
    """CTE ``owed``: open bills of listed cashiers with a known customer;
    ``which``: a CASE that gives the period's tag, NULL when not open."""
    listed = ", ".join(q(c) for c, _, _ in L.CASHIERS)
    areas = ", ".join(q(t.upper()) for t in C.lists_parse(regions))
    return f"""owed AS (
  SELECT {norm("COALESCE(b.cashier, '')")} AS who, {norm("COALESCE(b.pay_channel, '')")} = 'AB' AS bank, {which} AS tag
  FROM d_consumption b
  WHERE {_AMOUNT} > 0 AND {norm("COALESCE(b.cashier, '')")} IN ({listed})
    AND b.customer_id IN (SELECT customer_id FROM d_customer WHERE {norm('region_code')} IN ({areas})))"""


def _counts(columns: dict[str, str]) -> str:
    """A line per cashier and the total, which every open bill joins."""
    sums = ", ".join(f"COUNT(o.who) FILTER (WHERE {cond}) AS {name}" for name, cond in columns.items())
    return f"""SELECT cashier, cashier_name, sort_order, is_total, {sums}
FROM {_LINES} LEFT JOIN owed o ON o.tag IS NOT NULL AND (is_total OR o.who = cashier)
GROUP BY cashier, cashier_name, sort_order, is_total"""


def _arrears_snapshot() -> str:
    p = C.ARREARS
    y, m = p.previous_period
    which = f"""CASE WHEN b.year = {p.year} AND b.month = {p.month} AND {_open_at(p.cutoff)} THEN 'now'
                     WHEN b.year = {y} AND b.month = {m} AND {_open_at(p.previous_cutoff)} THEN 'before' END"""
    columns = {}
    for name, tag in (("cur", "now"), ("prev", "before")):
        columns |= {
            f"{name}_transfer": f"tag = '{tag}' AND bank",
            f"{name}_cash": f"tag = '{tag}' AND NOT bank",
            f"{name}_total": f"tag = '{tag}'",
        }
    return with_fixtures(f"""
{_ledger(which, p.regions)}
SELECT *, cur_total - prev_total AS diff FROM ({_counts(columns)})
""")


SQL["arrears_snapshot"] = _arrears_snapshot()


def _arrears_cumulative() -> str:
    p = C.CUMULATIVE
    low, high = p.from_year * 100 + p.from_month, p.to_year * 100 + p.to_month
    which = f"""CASE WHEN b.month BETWEEN 1 AND 12 AND b.year * 100 + b.month BETWEEN {low} AND {high}
                      AND {_open_at(p.cutoff)} THEN 'open' END"""
    return with_fixtures(f"""
{_ledger(which, p.regions)}
{_counts({'open_transfer': 'bank', 'open_cash': 'NOT bank', 'open_total': 'true'})}
""")


SQL["arrears_cumulative"] = _arrears_cumulative()


def _arrears_daily() -> str:
    p = C.CUMULATIVE
    low, high = p.from_year * 100 + p.from_month, p.to_year * 100 + p.to_month
    first, last = C.DAYS
    which = f"CASE WHEN b.month BETWEEN 1 AND 12 AND b.year * 100 + b.month BETWEEN {low} AND {high} THEN 'open' END"
    ledger = _ledger(which, p.regions).replace(" AS tag\n", " AS tag, b.posted_at, b.paid_at, COALESCE(b.is_paid, 0) = 1 AS closed\n")
    return with_fixtures(f"""
{ledger},
days AS (SELECT CAST(unnest(generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 DAY)) AS DATE) AS day),
open_on AS (SELECT day, who, bank FROM days JOIN owed ON tag IS NOT NULL AND posted_at <= day
            AND NOT (closed AND COALESCE(paid_at <= day, true)))
SELECT d.day, cashier, cashier_name, sort_order, is_total, COUNT(o.who) FILTER (WHERE bank) AS open_transfer,
  COUNT(o.who) FILTER (WHERE NOT bank) AS open_cash, COUNT(o.who) AS open_total
FROM (SELECT * FROM days CROSS JOIN {_LINES}) d LEFT JOIN open_on o ON o.day = d.day AND (is_total OR o.who = cashier)
GROUP BY d.day, cashier, cashier_name, sort_order, is_total
""")


SQL["arrears_daily"] = _arrears_daily()

SQL["arrears_rejected_months"] = with_fixtures("""
SELECT bill_id, customer_id, year, month FROM d_consumption
WHERE year IS NULL OR month IS NULL OR month < 1 OR month > 12
""")

SQL["positive_invoices"] = with_fixtures(f"""
SELECT b.bill_id, b.bill_mode, CAST({_AMOUNT} AS DECIMAL(19, 2)) AS invoice_amount
FROM d_consumption b WHERE {_AMOUNT} > 0
""")

# -- readings --------------------------------------------------------------------

_CLASS_OF = f"""class_of AS (
  SELECT concat(street_code, meter_code) AS customer_code, MIN({norm('class_code')}) AS class_code
  FROM d_customer GROUP BY 1)"""


def _deltas() -> str:
    p = C.READING
    return f"""{_CLASS_OF},
seen AS (
  SELECT customer_code, list({{'at': read_at, 'm3': COALESCE(volume, 0), 'who': name}}
           ORDER BY read_at DESC, volume DESC NULLS LAST, name NULLS FIRST)[1:2] AS two
  FROM d_large_reading
  WHERE {norm('region_code')} = {q(p.region)} AND read_at >= '{p.year}-01-01' AND read_at < '{p.year + 1}-01-01'
  GROUP BY customer_code),
delta AS (
  SELECT *, CAST(last_volume - prev_volume AS {V}) AS delta, {growth('prev_volume', 'last_volume')} AS growth_pct
  FROM (SELECT COALESCE(class_code, {q(L.DEFAULT_READING_CLASS)}) AS class_code, customer_code, two[1].who AS name,
               two[2].at AS prev_read_at, two[1].at AS last_read_at,
               CAST(COALESCE(two[2].m3, 0) AS {V}) AS prev_volume, CAST(two[1].m3 AS {V}) AS last_volume
        FROM seen LEFT JOIN class_of USING (customer_code)))"""


SQL["customer_dedup"] = with_fixtures(f"{_CLASS_OF}\nSELECT * FROM class_of")
SQL["reading_delta"] = with_fixtures(f"{_deltas()}\nSELECT * FROM delta")


def _class_summary() -> str:
    lines = ", ".join(f"({o}, {q(pn)}, {q(g)}, {q(c)})" for o, pn, g, c in L.CLASS_CATALOGUE)
    own = ", ".join(
        f"CAST(COALESCE((SELECT SUM(d.{m}) FROM delta d WHERE d.class_code = k.class_code), 0) AS {V}) AS {m}"
        for m in ("prev_volume", "last_volume", "delta")
    )
    whole = ", ".join(f"(SELECT CAST(SUM({m}) AS {V}) FROM delta) AS {m}" for m in ("prev_volume", "last_volume", "delta"))
    return with_fixtures(f"""
{_deltas()},
sheet AS (
  SELECT *, {own}, false AS is_total FROM (VALUES {lines}) AS k(sort_order, purpose_name, group_name, class_code)
  UNION ALL BY NAME
  SELECT {L.CATALOGUE_TOTAL_ORDINAL} AS sort_order, {q(L.CATALOGUE_TOTAL_LABEL)} AS purpose_name, {whole}, true AS is_total)
SELECT *, {growth('prev_volume', 'last_volume')} AS growth_pct FROM sheet
""")


SQL["reading_class_summary"] = _class_summary()

# -- trip log --------------------------------------------------------------------

_AS_OF = f"TIMESTAMP '{C.FLEET.as_of.strftime('%Y-%m-%d %H:%M:%S')}'"
_TRIP_COLS = "id, car, driver, leader, dest, start_at, end_at, duration_min, km_start, km_end"

SQL["trip_validation"] = with_fixtures("""
SELECT id, car, (start_at IS NOT NULL AND end_at IS NOT NULL AND dest IS NOT NULL AND dest <> '') AS is_valid,
       COALESCE(end_at < start_at, false) AS bad_interval
FROM d_trip
""")

SQL["trip_overlaps"] = with_fixtures("""
SELECT a.car, a.id AS first_id, b.id AS second_id
FROM d_trip a JOIN d_trip b ON a.car = b.car AND a.id < b.id AND a.start_at < b.end_at AND a.end_at > b.start_at
""")

SQL["trips_after_replacement"] = with_fixtures(f"""
SELECT {_TRIP_COLS} FROM d_trip t
WHERE NOT EXISTS (SELECT 1 FROM d_trip l WHERE l.car = t.car AND l.id > t.id
                  AND l.start_at < t.end_at AND l.end_at > t.start_at)
""")

# the pair-free sweep must give exactly the same survivors
SQL["trips_after_replacement_sweep"] = SQL["trips_after_replacement"]

# each car's orders in turn; kept ones are carried along as a list
SQL["trips_after_refusal"] = with_fixtures(f"""
turn AS (SELECT *, row_number() OVER (PARTITION BY car ORDER BY id) AS n FROM d_trip),
step AS (
  SELECT car, 0::BIGINT AS n, []::STRUCT(s TIMESTAMP, e TIMESTAMP, id BIGINT)[] AS kept FROM d_trip GROUP BY car
  UNION ALL
  SELECT t.car, t.n, CASE WHEN len(list_filter(p.kept, lambda k: k.s < t.end_at AND k.e > t.start_at)) > 0 THEN p.kept
                          ELSE list_append(p.kept, {{'s': t.start_at, 'e': t.end_at, 'id': t.id}}) END
  FROM step p JOIN turn t ON t.car = p.car AND t.n = p.n + 1),
last AS (SELECT car, arg_max(kept, n) AS kept FROM step GROUP BY car),
stays AS (SELECT unnest(kept).id AS id FROM last)
SELECT {_TRIP_COLS} FROM d_trip WHERE id IN (SELECT id FROM stays)
""").replace("WITH ", "WITH RECURSIVE ", 1)

SQL["order_conflicts"] = with_fixtures("""
SELECT id, car, EXISTS (SELECT 1 FROM d_trip l WHERE l.car = t.car AND l.id < t.id
                        AND l.start_at < t.end_at AND l.end_at > t.start_at) AS conflict
FROM d_trip t
""")

SQL["trip_status"] = with_fixtures(f"""
SELECT id, car, COALESCE(start_at <= {_AS_OF} AND {_AS_OF} <= end_at, false) AS on_road,
       CASE WHEN COALESCE(start_at <= {_AS_OF} AND {_AS_OF} <= end_at, false) THEN {q(L.TRIP_ON_ROAD)}
            ELSE {q(L.TRIP_DONE)} END AS status,
       concat({q(L.TRIP_ORIGIN + L.ROUTE_ARROW)}, dest) AS route,
       strftime(start_at, '%Y-%m-%d %H:%M') AS start_text, strftime(end_at, '%Y-%m-%d %H:%M') AS end_text
FROM d_trip
""")

SQL["trip_distance"] = with_fixtures(f"""
SELECT id, car, km_end - km_start AS distance_km,
       CASE WHEN km_end IS NOT NULL THEN concat(CAST(km_end - km_start AS VARCHAR), {q(L.DISTANCE_UNIT)})
            ELSE {q(L.DISTANCE_MISSING)} END AS distance_text
FROM d_trip
""")

_OVERDUE = f"COALESCE(CAST(p.next_maintenance AS TIMESTAMP) < {_AS_OF}, false)"

SQL["maintenance_overdue"] = with_fixtures(f"""
SELECT f.car, p.next_maintenance IS NOT NULL AS has_date, p.next_maintenance, {_OVERDUE} AS overdue
FROM d_fleet f LEFT JOIN d_vehicle_profile p ON f.car = p.car
""")

SQL["vehicles_available"] = with_fixtures(f"""
SELECT f.car, {_OVERDUE} AS overdue
FROM d_fleet f LEFT JOIN d_vehicle_profile p ON f.car = p.car
WHERE NOT EXISTS (SELECT 1 FROM d_trip t WHERE t.car = f.car AND t.start_at <= {_AS_OF} AND {_AS_OF} <= t.end_at)
""")

SQL["vehicle_history"] = with_fixtures("""
SELECT car, id, strftime(start_at, '%Y-%m-%d') AS trip_date, dest, leader FROM d_trip
""")

SQL["vehicle_history_one"] = with_fixtures(f"""
SELECT car, id, strftime(start_at, '%Y-%m-%d') AS trip_date, dest, leader FROM d_trip WHERE car = {q(C.PLATE)}
""")

SQL["profile_upsert"] = with_fixtures("""
w AS (
  SELECT car, CAST(NULL AS TIMESTAMP) AS written_at, CAST(NULL AS BIGINT) AS write_id, seats, year_made,
         next_maintenance, next_inspection FROM d_vehicle_profile
  UNION ALL
  SELECT car, written_at, write_id, seats, year_made, next_maintenance, next_inspection FROM d_profile_write),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY car ORDER BY written_at DESC NULLS LAST, write_id DESC NULLS LAST) AS rn
      FROM w)
SELECT car, seats, year_made, next_maintenance, next_inspection, written_at AS updated_at FROM r WHERE rn = 1
""")

SQL["trip_completion"] = with_fixtures(f"""
ret AS (SELECT id, CAST(km_start + duration_min AS BIGINT) AS km_end FROM d_trip
        WHERE km_end IS NULL AND end_at <= {_AS_OF})
SELECT t.id, t.car, t.driver, t.leader, t.dest, t.start_at, t.end_at, t.duration_min, t.km_start,
       COALESCE(r.km_end, t.km_end) AS km_end
FROM d_trip t LEFT JOIN ret r ON t.id = r.id
""")

SQL["trip_deletion"] = with_fixtures(f"""
SELECT {_TRIP_COLS} FROM d_trip
WHERE id NOT IN (SELECT id FROM d_trip WHERE km_end IS NULL AND start_at > {_AS_OF})
""")

# The newest write of a car, else its stored profile.
SQL["profile_store_batches"] = with_fixtures("""
SELECT COALESCE(w.car, v.car) AS car,
       CASE WHEN w.car IS NULL THEN v.seats ELSE w.seats END AS seats,
       CASE WHEN w.car IS NULL THEN v.year_made ELSE w.year_made END AS year_made,
       CASE WHEN w.car IS NULL THEN v.next_maintenance ELSE w.next_maintenance END AS next_maintenance,
       CASE WHEN w.car IS NULL THEN v.next_inspection ELSE w.next_inspection END AS next_inspection,
       w.written_at AS updated_at
FROM d_vehicle_profile v
FULL JOIN (SELECT * FROM d_profile_write
           QUALIFY ROW_NUMBER() OVER (PARTITION BY car ORDER BY written_at DESC, write_id DESC) = 1) w ON v.car = w.car
""")

SQL["trip_store_batches"] = with_fixtures(f"""
SELECT id, car, driver, leader, dest, start_at, end_at, duration_min, km_start,
       CASE WHEN km_end IS NULL AND end_at <= {_AS_OF} THEN CAST(km_start + duration_min AS BIGINT) ELSE km_end END
         AS km_end
FROM d_trip WHERE (km_end IS NULL AND start_at > {_AS_OF}) IS NOT TRUE
""")

SQL["trip_json_log"] = with_fixtures(f"""
SELECT id, car, driver, leader, dest, start_at, end_at, CAST(km_start AS DECIMAL(18, 2)) AS km_start,
       CAST(km_end AS DECIMAL(18, 2)) AS km_end, CAST(NULL AS VARCHAR) AS bad_line
FROM d_trip
UNION ALL
SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '{{"id":' || id || ',"car":"' || car
FROM d_trip WHERE km_end IS NULL AND start_at > {_AS_OF}
""")

# -- pipe flushing ---------------------------------------------------------------


def _quant(x: str) -> str:
    return f"floor(({x}) * 1000000.0 + 0.5) / 1000000.0"


def _flush() -> str:
    g2 = f"CAST({2.0 * L.GRAVITY!r} AS DOUBLE)"
    zeta = (
        f"(COALESCE(bends_90, 0) * CAST({L.BEND_90_LOSS!r} AS DOUBLE) "
        f"+ COALESCE(bends_45, 0) * CAST({L.BEND_45_LOSS!r} AS DOUBLE))"
    )
    return with_fixtures(f"""
j AS (
  SELECT *,
    CASE WHEN terrain = 'FLAT' THEN 0.0 ELSE COALESCE(z_start, 0.0) - COALESCE(z_end, 0.0) END AS dz,
    ((CASE WHEN end_min < start_min THEN end_min + 1440 ELSE end_min END) - start_min) * 60 AS secs,
    pow(diameter_mm / 1000.0 / 4.0, CAST(4.0 AS DOUBLE) / CAST(3.0 AS DOUBLE)) AS rh_pow,
    CAST({zeta} AS DOUBLE) AS zeta,
    pi() * pow(diameter_mm / 1000.0, 2.0) / 4.0 AS area
  FROM d_flush_job),
k AS (
  SELECT *, pressure_bar * 10.0 + dz - pig_loss_bar * 10.0 AS head,
    CASE WHEN rh_pow > 0 THEN pow(roughness, 2.0) * length_m / rh_pow END AS friction,
    zeta / {g2} AS loc
  FROM j),
r AS (
  SELECT *,
    CASE WHEN length_m + diameter_mm + roughness + pressure_bar + pig_loss_bar + start_min + end_min IS NULL
           THEN 'missing_input'
         WHEN length_m <= 0 THEN 'bad_length'
         WHEN diameter_mm < 0 THEN 'bad_diameter'
         WHEN roughness < 0 THEN 'bad_roughness'
         WHEN secs <= 0 THEN 'bad_duration'
         WHEN head <= 0 THEN 'low_head' END AS invalid_reason
  FROM k),
v AS (
  SELECT *,
    CASE WHEN invalid_reason IS NULL THEN
      least(CASE WHEN friction IS NULL THEN 0.0 WHEN friction + loc <= 0 THEN 15.0
                 ELSE sqrt(head / (friction + loc)) END, 15.0) END AS velocity
  FROM r)
SELECT id, invalid_reason, {_quant('dz')} AS dz, {_quant('head')} AS net_head,
       {_quant('CASE WHEN invalid_reason IS NULL THEN friction END')} AS friction_factor,
       {_quant('CASE WHEN invalid_reason IS NULL THEN loc END')} AS local_factor,
       {_quant('velocity')} AS velocity, {_quant('velocity * area * 1000.0')} AS flow_lps,
       {_quant(f'zeta * (pow(velocity, 2.0) / {g2})')} AS local_loss_m,
       CASE WHEN invalid_reason IS NULL THEN secs END AS duration_s,
       {_quant('velocity * area * secs')} AS volume_m3
FROM v
""")


SQL["flush_volume"] = _flush()

SQL["flush_codes"] = with_fixtures(f"""
SELECT id, material, pig_type,
       CASE {norm('material')} {' '.join(f"WHEN {q(c)} THEN CAST({n!r} AS DOUBLE)" for c, _, n in L.PIPE_MATERIALS)} END AS roughness,
       CASE {norm('pig_type')} {' '.join(f"WHEN {q(c)} THEN CAST({n!r} AS DOUBLE)" for c, _, n in L.PIG_TYPES)} END AS pig_loss_bar
FROM d_flush_job
""")


def _flush_text() -> str:
    def fixed(x: str, places: int, unit: str) -> str:
        return f"CASE WHEN {x} IS NOT NULL THEN concat(printf('%.{places}f', {x}), {q(L.FLUSH_UNITS[unit])}) END"

    cells = ", ".join(
        f"{fixed(x, places, unit)} AS {name}"
        for name, x, places, unit in (
            ("dz_text", "dz", 2, "dz"),
            ("net_head_text", "net_head", 2, "net_head"),
            ("local_loss_text", "local_loss_m", 2, "local_loss_m"),
            ("velocity_text", "velocity", 2, "velocity"),
            ("flow_text", "flow_lps", 2, "flow_lps"),
            ("duration_text", "duration_s / 60.0::DOUBLE", 1, "duration_min"),
            ("volume_text", "volume_m3", 2, "volume_m3"),
        )
    )
    return f"SELECT id, invalid_reason, {cells} FROM ({SQL['flush_volume']})"


SQL["flush_text"] = _flush_text()

# -- printed report text -----------------------------------------------------------


def _comma(x: str) -> str:
    return f"format('{{:,}}', CAST(round({x}, 0) AS BIGINT))"


def _signed_comma(x: str) -> str:
    return f"CASE WHEN round({x}, 0) >= 0 THEN concat('+', {_comma(x)}) ELSE {_comma(x)} END"


def _fixed2_dot(h: str) -> str:
    return (
        f"CASE WHEN {h} IS NULL THEN NULL ELSE concat(CASE WHEN {h} < 0 THEN '-' ELSE '' END, "
        f"CAST(abs({h}) // 100 AS VARCHAR), '.', lpad(CAST(abs({h}) % 100 AS VARCHAR), 2, '0')) END"
    )


def _trimmed_vi(h: str) -> str:
    frac = f"abs({h}) % 100"
    return (
        f"CASE WHEN {h} IS NULL THEN NULL ELSE concat(CASE WHEN {h} < 0 THEN '-' ELSE '' END, "
        f"format('{{:t.}}', abs({h}) // 100), "
        f"CASE WHEN {frac} = 0 THEN '' WHEN {frac} % 10 = 0 THEN concat(',', CAST({frac} // 10 AS VARCHAR)) "
        f"ELSE concat(',', lpad(CAST({frac} AS VARCHAR), 2, '0')) END) END"
    )


def _right(text: str, n: int) -> str:
    return f"right(repeat(' ', {n}) || ({text}), {n})"


def _money(x: str) -> str:
    return f"replace(format('{{:,.2f}}', CAST({x} AS DOUBLE)), '.00', '')"


def _wrap(base: str, select: str) -> str:
    return f"SELECT {select}\nFROM (\n{base}\n) r"


SQL["region_month_text"] = _wrap(
    SQL["region_month_growth"],
    f"""region, is_total, {_comma('base')} AS base_text, {_comma('cmp')} AS cmp_text,
  {_signed_comma('diff')} AS diff_text,
  CASE WHEN growth_pct = 'inf'::DOUBLE THEN '+inf %' WHEN growth_pct = '-inf'::DOUBLE THEN '-inf %'
       ELSE concat(CASE WHEN growth_pct >= 0 THEN '+' ELSE '' END,
                   {_fixed2_dot('COALESCE(' + _hundredths('base', 'diff') + ', 0)')}, ' %') END AS growth_text""",
)

SQL["kpi_text"] = _wrap(
    SQL["kpi_status"],
    f"""{_comma('base')} AS base_text, {_comma('cmp')} AS cmp_text, {_signed_comma('diff')} AS diff_text,
  concat(CASE WHEN COALESCE({_hundredths('base', 'diff')}, 0) >= 0 THEN '+' ELSE '' END,
         {_fixed2_dot('COALESCE(' + _hundredths('base', 'diff') + ', 0)')}, '%') AS growth_text,
  CASE WHEN status = 'up' THEN {q(L.KPI_UP)} WHEN status = 'down' THEN {q(L.KPI_DOWN)}
       ELSE {q(L.KPI_STABLE)} END AS status_label""",
)

SQL["ytd_report_text"] = _wrap(
    SQL["region_ytd_growth"],
    f"""region_code, region_label, is_total, region_ordinal,
  {_right(grouped_vi('base'), 15)} AS base_text, {_right(grouped_vi('cmp'), 15)} AS cmp_text,
  {_right(grouped_vi('diff'), 15)} AS diff_text,
  {_right(_trimmed_vi(_hundredths('base', 'diff')) + " || ' %'", 10)} AS growth_text""",
)


def _blank_zero(x: str) -> str:
    return f"CASE WHEN round({x}, 0) = 0 THEN '' ELSE {grouped_vi(x)} END"


SQL["class_report_text"] = _wrap(
    SQL["class_period_growth"],
    f"""class_code, class_name, is_total, {_blank_zero('base')} AS base_text, {_blank_zero('cmp')} AS cmp_text,
  {_blank_zero('diff')} AS diff_text, {_fixed2_dot(_hundredths('base', 'diff'))} AS growth_text""",
)

SQL["reading_list_text"] = _wrap(
    SQL["reading_delta"],
    f"""customer_code, name, strftime(prev_read_at, '%d/%m/%Y') AS prev_date,
  strftime(last_read_at, '%d/%m/%Y') AS last_date, {_money('prev_volume')} AS prev_text,
  {_money('last_volume')} AS last_text, {_money('delta')} AS delta_text,
  {_fixed2_dot('COALESCE(' + _hundredths('prev_volume', 'delta') + ', 0)')} AS growth_text""",
)

SQL["reading_summary_text"] = _wrap(
    SQL["reading_class_summary"],
    f"""sort_order, purpose_name, group_name, class_code, {_money('prev_volume')} AS prev_text,
  {_money('last_volume')} AS last_text, {_money('delta')} AS delta_text,
  {_fixed2_dot('COALESCE(' + _hundredths('prev_volume', 'delta') + ', 0)')} AS growth_text""",
)


def _arrears_text() -> str:
    p = C.ARREARS
    cur, prev = p.cutoff.strftime("%d/%m"), p.previous_cutoff.strftime("%d/%m")
    cols = [
        ("cur_transfer", cur + L.ARREARS_TRANSFER_SUFFIX),
        ("cur_cash", cur + L.ARREARS_CASH_SUFFIX),
        ("cur_total", cur + L.ARREARS_TOTAL_SUFFIX),
        ("prev_transfer", prev + L.ARREARS_TRANSFER_SUFFIX),
        ("prev_cash", prev + L.ARREARS_CASH_SUFFIX),
        ("prev_total", prev + L.ARREARS_TOTAL_SUFFIX),
        ("diff", L.ARREARS_DIFF_HEADING),
    ]
    sel = ", ".join(f'{k} AS "{v}"' for k, v in cols)
    return _wrap(SQL["arrears_snapshot"], f"cashier, sort_order, {sel}")


SQL["arrears_report_text"] = _arrears_text()

SQL["arrears_cumulative_text"] = _wrap(
    SQL["arrears_cumulative"], "sort_order, " + ", ".join(f'{k} AS "{v}"' for k, v in L.CUMULATIVE_HEADINGS.items())
)

_PERCENT = f'"{L.PURPOSE_HEADINGS["growth_text"]}"'
SQL["purpose_month_text"] = _wrap(
    SQL["purpose_month_growth"],
    f"""ordinal, purpose_code AS "{L.PURPOSE_HEADINGS['purpose_code']}", purpose_name AS "{L.PURPOSE_HEADINGS['purpose_name']}",
  {grouped_vi('base')} AS "T{M.month_to}/{M.base_year}", {grouped_vi('cmp')} AS "T{M.month_to}/{M.cmp_year}",
  {grouped_vi('diff')} AS "{L.PURPOSE_HEADINGS['diff_text']}",
  concat({_trimmed_vi('COALESCE(' + _hundredths('base', 'diff') + ', 0)')}, ' %') AS {_PERCENT}""",
)

# -- printed order ---------------------------------------------------------------


def _numbered(base: str, order: str) -> str:
    return _wrap(SQL[base], f"*, row_number() OVER (ORDER BY {order}) AS row_no")


SQL["region_sectioned_ordered"] = _numbered(
    "region_sectioned_report",
    "section NULLS FIRST, region_ordinal NULLS FIRST, sort_order NULLS FIRST, rank NULLS FIRST",
)
SQL["region_month_ordered"] = _numbered("region_month_growth", "is_total, region NULLS FIRST")
SQL["region_ytd_ordered"] = _numbered(
    "region_ytd_growth",
    "is_total, region_ordinal NULLS FIRST, region NULLS FIRST, base NULLS FIRST, cmp NULLS FIRST",
)
SQL["class_period_ordered"] = _numbered("class_period_growth", "is_total, class_code NULLS FIRST")
SQL["arrears_cumulative_ordered"] = _numbered("arrears_cumulative", "is_total, sort_order NULLS FIRST")
SQL["reading_list_ordered"] = _numbered("reading_delta", "customer_code NULLS FIRST")
SQL["reading_summary_ordered"] = _numbered("reading_class_summary", "sort_order NULLS FIRST")
SQL["trip_list_ordered"] = _numbered("trip_status", "id DESC NULLS LAST")

# Comparisons from stored monthly sums give what the bills give.
for _stored, _bills in {
    "region_sectioned_from_months": "region_sectioned_report",
    "region_month_from_months": "region_month_growth",
    "region_ytd_from_months": "region_ytd_growth",
    "purpose_ytd_from_months": "purpose_ytd_growth",
    "class_period_from_months": "class_period_growth",
}.items():
    SQL[_stored] = SQL[_bills]
