"""COL-*: scalar column expressions, all native Catalyst expressions (no UDFs).

Every function returns a ``Column``; none collects data. Boundary conventions follow
the reference exactly (right-closed vs left-closed bins are called out per function).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (labels and bin edges that must equal the reference's output).
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July",
               "August", "September", "October", "November", "December"]
AGING_LABELS = ["0-30", "31-90", "91-180", "181-365", "365+"]
HEALTH_TIERS = ["At Risk", "Watch", "Healthy"]
NEAR_EXPIRY_LABELS = ["Expired", "0-30d", "31-90d", "91-180d"]
AGING_RISK_LABELS = ["<3 Months", "3-6 Months", "6-12 Months", "1+ Year"]
UNCATEGORISED_TOKENS = ["", "nan", "none"]
UNCAT_LABELS = ["uncategorized", "", "nan", "none"]
CAPEX_DOC_TYPES = ["Service PO", "Dom Capital PO", "CMC", "AMC", "Imp capital PO"]
DATE_FORMATS = ["yyyy-M-d", "d.M.yyyy", "d-M-yyyy", "M/d/yyyy"]      # slash dates are month-first
YEAR_FIRST = r"^[+-]?\d{4,}-"
SPREADSHEET_EPOCH = "1899-12-30"
Z_95 = 1.645


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- COL-01..06
def to_number(x) -> Column:
    """COL-01: coerce text to a number; unparseable -> NULL (never an error)."""
    return F.expr(f"try_cast({x} AS DOUBLE)") if isinstance(x, str) else c(x).try_cast("double")


def normalize_id(x, trimmed: bool = False) -> Column:
    """COL-02 / COL-30: trim (unless ``trimmed`` text is given) and drop a trailing '.0' (``'100301.0'`` -> ``'100301'``)."""
    s = c(x) if trimmed else F.trim(c(x).cast("string"))
    return F.when(s.contains(".0"), F.regexp_replace(s, r"\.0$", "")).otherwise(s)      # the pattern only where it can match


def calendar_columns(date_col: str) -> list[Column]:
    """COL-03: year, month_num and English month name of a date."""
    d = F.col(date_col)
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])      # a look-up: formatting every date costs many times that
    return [F.year(d).alias("year"), F.month(d).alias("month_num"),
            F.try_element_at(names, F.month(d)).alias("month")]      # element_at gives the last name where there is no date


def month_index(label) -> Column:
    """COL-04: month label -> 0-based chronological index; unknown labels sort last (13)."""
    m = F.create_map(*[x for i, n in enumerate(MONTH_NAMES) for x in (F.lit(n), F.lit(i))])
    return F.coalesce(m[c(label)], F.lit(13))


def parse_fixed_date(x, fmt: str = "dd.MM.yyyy") -> Column:
    """COL-05: fixed-format text date, a time of day after it or not -> DATE, unparseable -> NULL."""
    return F.try_to_timestamp(date_part(x), F.lit(fmt)).cast("date")


def date_part(x) -> Column:
    """Text up to the first blank or 'T' after a digit (``2026-05-31 00:00:00``)."""
    s = F.trim(c(x).cast("string"))
    return F.when(s.contains(" ") | s.contains("T"), F.regexp_replace(s, r"(?<=\d)[T ].*$", "")).otherwise(s)


def parse_any_date(x, day: Column | None = None) -> Column:
    """COL-06: several text formats, else a spreadsheet serial day number; ``day`` is ``date_part(x)``,
    if it has a column already, and ``x`` trimmed text then.

    A format is tried only on texts that hold its separator (year first: and the year), as a failed
    parse costs many times a parse that succeeds.
    """
    s, day = (F.trim(c(x).cast("string")), date_part(x)) if day is None else (c(x), day)
    fits = [day.rlike(YEAR_FIRST), day.contains("."), day.contains("-"), day.contains("/")]
    parsed = [F.when(fit, F.try_to_timestamp(day, F.lit(f))) for f, fit in zip(DATE_FORMATS, fits)]
    serial = F.when(s.rlike(r"^\d{1,6}(\.\d+)?$"),
                    F.date_add(F.lit(SPREADSHEET_EPOCH).cast("date"),
                               s.try_cast("double").cast("int")))
    return F.coalesce(F.coalesce(*parsed).cast("date"), serial)


# ---------------------------------------------------------------- COL-07..13
def aging_bucket(days) -> Column:
    """COL-07: right-closed bins (-1,30],(30,90],(90,180],(180,365],(365,inf); else NULL."""
    d = c(days)
    return (F.when(d.isNull() | (d <= -1), F.lit(None).cast("string"))
             .when(d <= 30, "0-30").when(d <= 90, "31-90").when(d <= 180, "91-180")
             .when(d <= 365, "181-365").otherwise("365+"))


def aging_bucket_rank(bucket) -> Column:
    """Order of COL-07 labels (decision D6: rank, not label text)."""
    m = F.create_map(*[x for i, n in enumerate(AGING_LABELS) for x in (F.lit(n), F.lit(i))])
    return F.coalesce(m[c(bucket)], F.lit(len(AGING_LABELS)))


def ip_op_class(desc) -> Column:
    """COL-08: ward class from the storage-location description."""
    u = F.upper(c(desc))
    has_ip = u.rlike(r"\bIP\b|IP[-/ ]") | u.startswith("IP")
    has_op = u.rlike(r"\bOP\b|OP[-/ ]") | u.startswith("OP")
    return (F.when(u.isNull(), "OTHER").when(has_ip & has_op, "IP/OP").when(has_ip, "IP")
             .when(has_op, "OP").when(u.contains("OT"), "OT").otherwise("OTHER"))


def title_case(x) -> Column:
    """COL-10: title case that restarts after any non-letter (``J&J``, ``O'Neil``)."""
    parts = F.regexp_extract_all(c(x), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")


def is_uncategorised(x) -> Column:
    """COL-13: label counts as uncategorised (NULL, blank, 'nan', ...)."""
    return c(x).isNull() | F.lower(F.trim(c(x))).isin(UNCATEGORISED_TOKENS)


def clean_category(x, fallback: str = "Uncategorised") -> Column:
    """COL-09: NULL/nan/none -> fallback; keep text after the first '-'; title case."""
    tail = F.trim(F.regexp_replace(c(x), r"^[^-]*-", ""))
    return F.when(is_uncategorised(x) | (tail == ""), F.lit(fallback)).otherwise(title_case(tail))


def fill_category(x, fallback: str = "Uncategorized") -> Column:
    """COL-12: missing (or literal 'nan') category -> 'Uncategorized'."""
    return F.coalesce(F.nullif(c(x), F.lit("nan")), F.lit(fallback))


def hospital_code(invoice, location) -> Column:
    """COL-11: invoice prefix before '-' upper-cased, else location, else UNKNOWN."""
    inv = F.trim(c(invoice).cast("string"))
    pref = F.when(inv.contains("-"), F.upper(F.trim(F.split(inv, "-").getItem(0))))
    pref = F.when(pref != "", pref)
    loc = F.when(F.trim(c(location)) != "", F.upper(F.trim(c(location))))
    return F.coalesce(pref, loc, F.lit("UNKNOWN"))


# ---------------------------------------------------------------- COL-14..18
def safe_div(num, den, otherwise=None) -> Column:
    """COL-14: num/den as DOUBLE when den > 0, else ``otherwise`` (NULL by default)."""
    n, d = c(num).cast("double"), c(den).cast("double")
    o = F.lit(otherwise).cast("double") if not isinstance(otherwise, Column) else otherwise
    return F.when(d > 0, n / d).otherwise(o)


def clip(x, lo=None, hi=None) -> Column:
    """COL-15 (NULL stays NULL)."""
    r = c(x)
    if lo is not None:
        r = F.when(r.isNull(), r).otherwise(F.greatest(r, F.lit(lo)))
    if hi is not None:
        r = F.when(r.isNull(), r).otherwise(F.least(r, F.lit(hi)))
    return r


def plausible_days(x, lo: int = 0, hi: int = 365) -> Column:
    """COL-16: NULL out values < 0 or > 365."""
    return F.when(c(x).between(lo, hi), c(x))


def round_half_even(x, scale: int) -> Column:
    """COL-17: ties to even on the scaled DOUBLE (the rule of numpy and of the SQL oracle)."""
    return F.rint(c(x).cast("double") * F.lit(10.0 ** scale)) / F.lit(10.0 ** scale)


# ---------------------------------------------------------------- COL-19..29
def health_score(aging_days, turnover, consumption_cost) -> Column:
    """COL-19: 0.4 aging + 0.4 turnover + 0.2 movement sub-scores, half-even to 0.1."""
    aging_score = (F.lit(1.0) - clip(c(aging_days).cast("double"), 0, 365) / 365.0) * 100.0
    turn_score = clip(c(turnover).cast("double"), 0, 6) / 6.0 * 100.0
    move_score = F.when(c(consumption_cost) > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    return round_half_even(0.4 * aging_score + 0.4 * turn_score + 0.2 * move_score, 1)


def health_tier(score) -> Column:
    """COL-19 tiers, right-closed (-1,40],(40,70],(70,101]."""
    s = c(score)
    return (F.when(s.isNull() | (s <= -1) | (s > 101), "nan").when(s <= 40, "At Risk")
             .when(s <= 70, "Watch").otherwise("Healthy"))


def risk_level(days_to_expiry, aging_days, consumed) -> Column:
    """COL-20: High / Medium / Low; comparisons with NULL are False (N6)."""
    return (F.when(c(days_to_expiry) <= 90, "High")
             .when((c(aging_days) > 365) | ~c(consumed), "High")
             .when(c(aging_days) > 180, "Medium").otherwise("Low"))


def near_expiry_bucket(days) -> Column:
    """COL-21: (-9999,0],(0,30],(30,90],(90,180] -> Expired/0-30d/31-90d/91-180d."""
    d = c(days)
    return (F.when(d.isNull() | (d <= -9999) | (d > 180), F.lit("nan"))
             .when(d <= 0, "Expired").when(d <= 30, "0-30d").when(d <= 90, "31-90d")
             .otherwise("91-180d"))


def expiry_slab(days) -> Column:
    """COL-22: (..,-1],(-1,30],(30,90],(90,180],(180,365],(365,..) - day 0 is not expired."""
    d = c(days)
    return (F.when(d.isNull(), F.lit(None).cast("string")).when(d <= -1, "Expired")
             .when(d <= 30, "0-30d").when(d <= 90, "31-90d").when(d <= 180, "91-180d")
             .when(d <= 365, "181-365d").otherwise("365d+"))


EXPIRY_SLABS = ["Expired", "0-30d", "31-90d", "91-180d", "181-365d", "365d+"]


def non_moving_reason(consumed) -> Column:
    """COL-23."""
    return F.when(~c(consumed), "No consumption in 6mo").otherwise("Aging > 180d")


def radar_status(replenishment_qty, coverage_months, aging_days) -> Column:
    """COL-24."""
    return (F.when((c(replenishment_qty) > 0) & (c(coverage_months).isNull() | (c(coverage_months) < 1)),
                   "Stock-Out Risk")
             .when(c(aging_days) > 180, "Overstock/Aging").otherwise("Healthy"))


def cover_months(stock, demand) -> Column:
    """COL-25 cover: stock / demand; 999 when stock exists without demand; 0 otherwise."""
    return (F.when(c(demand) > 0, c(stock).cast("double") / c(demand).cast("double"))
             .when(c(stock) > 0, F.lit(999.0)).otherwise(F.lit(0.0)))


def reorder_status(stock, demand_forecast, demand_monthly, reorder_qty, aging_days) -> Column:
    """COL-25: Stock-out / Dead stock / Reorder now / Overstocked / Healthy, in that order."""
    cover = cover_months(stock, demand_monthly)
    age = F.coalesce(c(aging_days), F.lit(0.0))
    return (F.when((c(stock) <= 0) & (c(demand_forecast) > 0), "Stock-out")
             .when((age > 365) & (c(stock) > 0), "Dead stock")
             .when((c(reorder_qty) > 0) & (cover < 1), "Reorder now")
             .when((cover > 9) | (age > 180), "Overstocked").otherwise("Healthy"))


def aging_risk_label(aging_days) -> Column:
    """COL-26: (-1,90],(90,180],(180,365],(365,inf) on coalesce(aging, 0)."""
    d = F.coalesce(c(aging_days).cast("double"), F.lit(0.0))
    return (F.when(d <= -1, "nan").when(d <= 90, "<3 Months").when(d <= 180, "3-6 Months")
             .when(d <= 365, "6-12 Months").otherwise("1+ Year"))


def left_closed_band(x, edges: list, labels: list) -> Column:
    """COL-28 / COL-29: [e0,e1) ... bands; below the first edge or NULL -> NULL."""
    v = c(x)
    expr = F.when(v.isNull(), F.lit(None).cast("string"))
    for i, lab in enumerate(labels):
        hi = edges[i + 1] if i + 1 < len(edges) else None
        cond = v >= edges[i] if hi is None else (v >= edges[i]) & (v < hi)
        expr = expr.when(cond, lab)
    return expr


DATE_LABELS = {"month": "MMM", "month_year": "MMM yyyy", "day": "dd MMM yyyy", "short": "MM/dd/yy",
               "month_yy": "MMM yy"}


def date_label(d, style: str = "month") -> Column:
    """COL-31: date labels 'Jun', 'Jun 2026', '05 Jun 2026', '06/01/26' (and 'Jun 26')."""
    return F.date_format(c(d), DATE_LABELS[style])


def is_capex(doc_type, material, types: list = CAPEX_DOC_TYPES) -> Column:
    """COL-32: one of the capital/service document types, or a line without material."""
    return F.coalesce(c(doc_type).isin(types), F.lit(False)) | c(material).isNull()


def margin_pct(mrp, cost) -> Column:
    """COL-34: (mrp - cost) / mrp * 100, only when both are positive."""
    m, k = c(mrp).cast("double"), c(cost).cast("double")
    return F.when((m > 0) & (k > 0), (m - k) / m * 100.0)


def any_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols, F.lit(False))


def median_of(x, accuracy: int | None = None) -> Column:
    """AGG-03 median as DOUBLE: exact, or approximate in bounded memory where ``accuracy`` is given.

    For small frames; detail rows with hot keys go through ``common.key_medians``.
    """
    v = c(x).cast("double")
    return F.median(v) if accuracy is None else F.percentile_approx(v, 0.5, accuracy)


def r6(x) -> Column:
    """Output rounding for ratios (both engines round the same DOUBLE)."""
    return F.round(c(x).cast("double"), 6)


def money(x) -> Column:
    """Exact DECIMAL sum -> DOUBLE rounded to 4 places for output."""
    return F.round(c(x).cast("double"), 4)
