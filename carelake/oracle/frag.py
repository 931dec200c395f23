"""Shared DuckDB SQL fragments for the oracles (mirrors of carelake.functions.expr)."""

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December"]


def money(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 4)"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def month_idx(x: str) -> str:
    whens = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(MONTHS))
    return f"(CASE {x} {whens} ELSE 13 END)"


def aging_bucket(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL OR {x} <= -1 THEN NULL WHEN {x} <= 30 THEN '0-30' "
            f"WHEN {x} <= 90 THEN '31-90' WHEN {x} <= 180 THEN '91-180' "
            f"WHEN {x} <= 365 THEN '181-365' ELSE '365+' END)")


def aging_rank(x: str) -> str:
    return (f"(CASE {x} WHEN '0-30' THEN 0 WHEN '31-90' THEN 1 WHEN '91-180' THEN 2 "
            f"WHEN '181-365' THEN 3 WHEN '365+' THEN 4 ELSE 5 END)")


def safe_div(n: str, d: str, otherwise: str = "NULL") -> str:
    return f"(CASE WHEN CAST({d} AS DOUBLE) > 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) ELSE {otherwise} END)"


def clip(x: str, lo=None, hi=None) -> str:
    r = x
    if lo is not None:
        r = f"greatest({r}, {lo})"
    if hi is not None:
        r = f"least({r}, {hi})"
    return r


def weighted_age() -> str:
    w = "greatest(CAST(qty AS DECIMAL(16,4)), CAST(0.0001 AS DECIMAL(16,4)))"
    return (f"(CASE WHEN count(*) = count(aging_days) THEN "
            f"CAST(sum(CAST(aging_days AS DECIMAL(12,0)) * {w}) AS DOUBLE) / CAST(sum({w}) AS DOUBLE) END)")


def health_score(aging: str, turnover: str, cost: str) -> str:
    return (f"round_even(0.4 * ((1.0 - least(greatest(CAST({aging} AS DOUBLE), 0), 365) / 365.0) * 100.0)"
            f" + 0.4 * (least(greatest(CAST({turnover} AS DOUBLE), 0), 6) / 6.0 * 100.0)"
            f" + 0.2 * (CASE WHEN {cost} > 0 THEN 100.0 ELSE 0.0 END), 1)")


def health_tier(s: str) -> str:
    return (f"(CASE WHEN {s} IS NULL OR {s} <= -1 OR {s} > 101 THEN 'nan' WHEN {s} <= 40 THEN 'At Risk' "
            f"WHEN {s} <= 70 THEN 'Watch' ELSE 'Healthy' END)")


def risk_level(dte: str, aging: str, consumed: str) -> str:
    return (f"(CASE WHEN {dte} <= 90 THEN 'High' WHEN {aging} > 365 OR NOT {consumed} THEN 'High' "
            f"WHEN {aging} > 180 THEN 'Medium' ELSE 'Low' END)")


def near_expiry_bucket(d: str) -> str:
    return (f"(CASE WHEN {d} IS NULL OR {d} <= -9999 OR {d} > 180 THEN 'nan' WHEN {d} <= 0 THEN 'Expired' "
            f"WHEN {d} <= 30 THEN '0-30d' WHEN {d} <= 90 THEN '31-90d' ELSE '91-180d' END)")


def expiry_slab(d: str) -> str:
    return (f"(CASE WHEN {d} IS NULL THEN NULL WHEN {d} <= -1 THEN 'Expired' WHEN {d} <= 30 THEN '0-30d' "
            f"WHEN {d} <= 90 THEN '31-90d' WHEN {d} <= 180 THEN '91-180d' "
            f"WHEN {d} <= 365 THEN '181-365d' ELSE '365d+' END)")


def fill_category(x: str) -> str:
    return f"COALESCE(NULLIF({x}, 'nan'), 'Uncategorized')"


def plausible(x: str) -> str:
    return f"(CASE WHEN {x} BETWEEN 0 AND 365 THEN {x} END)"


def aging_risk_label(x: str) -> str:
    d = f"COALESCE(CAST({x} AS DOUBLE), 0.0)"
    return (f"(CASE WHEN {d} <= -1 THEN 'nan' WHEN {d} <= 90 THEN '<3 Months' WHEN {d} <= 180 THEN '3-6 Months' "
            f"WHEN {d} <= 365 THEN '6-12 Months' ELSE '1+ Year' END)")


def left_band(x: str, edges: list, labels: list) -> str:
    parts = [f"WHEN {x} IS NULL THEN NULL"]
    for i, lab in enumerate(labels):
        hi = edges[i + 1] if i + 1 < len(edges) else None
        cond = f"{x} >= {edges[i]}" + (f" AND {x} < {hi}" if hi is not None else "")
        parts.append(f"WHEN {cond} THEN '{lab}'")
    return "(CASE " + " ".join(parts) + " END)"


SNAP = "(SELECT max(snapshot_date) FROM fact_inventory)"
SPAN = ("(SELECT greatest(date_diff('day', min(posting_date), max(posting_date)), 1) "
        "FROM fact_consumption)")


def as_cte(name: str, body: str) -> str:
    """Turn an oracle body (``SELECT ...`` or ``ctes SELECT ...``) into ``name AS (...)``."""
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return f"{name} AS ({body})"
    return f"{name} AS (WITH {body})"


def band_sql(src: str, band: str, labels: list, measures: dict, where: str = "") -> str:
    """Oracle twin of ``band_table``: fixed label skeleton LEFT JOIN a grouped result."""
    vals = ", ".join("('{}', {})".format(lab.replace("'", "''"), i) for i, lab in enumerate(labels))
    inner = []
    outer = []
    for name, (kind, col) in measures.items():
        if kind == "sum":
            inner.append(f"CAST(sum({col}) AS DOUBLE) AS {name}")
            outer.append(f"round(COALESCE(g.{name}, 0.0), 4) AS {name}")
        elif kind == "count":
            inner.append(f"count(*) AS {name}")
            outer.append(f"COALESCE(g.{name}, 0) AS {name}")
        elif kind == "nunique":
            inner.append(f"count(DISTINCT {col}) AS {name}")
            outer.append(f"COALESCE(g.{name}, 0) AS {name}")
        elif kind == "avg":
            inner.append(f"avg({col}) AS {name}")
            outer.append(f"round(COALESCE(g.{name}, 0.0), 6) AS {name}")
        elif kind == "median":
            inner.append(f"median({col}) AS {name}")
            outer.append(f"round(COALESCE(g.{name}, 0.0), 6) AS {name}")
    w = f"WHERE {where}" if where else ""
    return (f"SELECT s.label, CAST(s.ord AS INTEGER) AS ord, {', '.join(outer)} "
            f"FROM (VALUES {vals}) s(label, ord) LEFT JOIN "
            f"(SELECT {band} AS b, {', '.join(inner)} FROM {src} {w} GROUP BY 1) g ON g.b = s.label")
