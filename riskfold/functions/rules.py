"""Row-level rules as Spark column expressions (JVM-side, codegen friendly).

Every function here either builds a ``Column`` or is a ``DataFrame ->
DataFrame`` transform that only adds columns (narrow, no shuffle), except
where a fitted scalar is needed; then the scalar comes either from the caller
(fitted state, e.g. in a stream) or from a scalar subquery on the input.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --------------------------------------------------------------------------
# type coercion and missing values
# --------------------------------------------------------------------------
def coerce_numeric(col) -> Column:
    """string -> double; unparsable text becomes NULL (pandas errors='coerce').

    Only plain decimal notation counts as a number ("1d" and "1f" are text), and
    NaN is missing. "inf" and "infinity", with a sign or without, are infinite,
    as are numbers beyond the double range.
    """
    t = F.trim(_c(col).cast("string"))
    number = t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    infinite = t.rlike(r"^(?i)[+-]?inf(inity)?$")
    sign = F.when(F.startswith(t, F.lit("-")), F.lit("-Infinity")).otherwise(F.lit("Infinity"))
    return F.when(number, t.try_cast("double")).when(infinite, sign.cast("double"))


def nan_to_null(col) -> Column:
    """One notion of missing: NaN is turned into NULL."""
    c = _c(col)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def normalise_missing(df: DataFrame, cols=None) -> DataFrame:
    cols = cols or [f.name for f in df.schema.fields
                    if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: nan_to_null(c) for c in cols})


def fill_zero(col) -> Column:
    return F.coalesce(_c(col), F.lit(0.0))


def derive_salary(annual) -> Column:
    return _c(annual) / 12.0


# --------------------------------------------------------------------------
# log transform and re-binning
# --------------------------------------------------------------------------
def log1p_clipped(col) -> Column:
    """log1p(max(x, 0)) keeping NULL; ``greatest`` would turn NULL into 0."""
    c = _c(col)
    return F.log1p(F.when(c < 0, F.lit(0.0)).otherwise(c))


def log1p_linearise(df: DataFrame, cols=None) -> DataFrame:
    cols = [c for c in (cols or C.LOG_FEATS) if c in df.columns]
    return df.withColumns({c: log1p_clipped(c) for c in cols})


def expm1_guard(col, col_max) -> Column:
    """Undo the log when the column looks logged (its max is below 30)."""
    c = _c(col)
    return F.when(_c(col_max) < C.EXPM1_GUARD_MAX, F.expm1(c)).otherwise(c)


def right_closed_bins(col, edges, labels, missing: str = C.MISSING_BIN) -> Column:
    """Interval label for (edges[i], edges[i+1]]; outside or NULL -> 'nan'."""
    c = _c(col)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (c > F.lit(float(lo))) & (c <= F.lit(float(hi)))
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr.otherwise(missing)


def bin_age(col="Age") -> Column:
    return right_closed_bins(col, C.AGE_EDGES, C.AGE_LABELS)


def bin_income(col="Annual_Income", col_max=None) -> Column:
    """Income bracket on un-logged income; missing is filled with 0 first."""
    c = _c(col)
    raw = expm1_guard(c, col_max) if col_max is not None else c
    return right_closed_bins(fill_zero(raw), C.INCOME_EDGES, C.INCOME_LABELS)


def bin_delay(col="Delay_from_due_date") -> Column:
    return right_closed_bins(fill_zero(col), C.DELAY_EDGES, C.DELAY_LABELS)


def rebin(df: DataFrame, income_max=None) -> DataFrame:
    """Add Age_Group, Income_Bracket, Delay_Bucket.

    ``income_max`` is fitted state (a number or Column); when absent it is a
    scalar subquery over ``df`` (one partial aggregate, no cross join).
    """
    if income_max is None:
        income_max = df.select(F.max("Annual_Income")).scalar()
    elif not isinstance(income_max, Column):
        income_max = F.lit(float(income_max))
    return df.withColumns({
        "Age_Group": bin_age("Age"),
        "Income_Bracket": bin_income("Annual_Income", income_max),
        "Delay_Bucket": bin_delay("Delay_from_due_date"),
    })


# --------------------------------------------------------------------------
# engineered features
# --------------------------------------------------------------------------
def ratio(num, den, offset) -> Column:
    # try_divide: ANSI mode raises on a zero divisor, pandas gives inf/NaN
    return F.try_divide(_c(num), _c(den) + F.lit(float(offset)))


def product_fill(left, right) -> Column:
    return _c(left) * fill_zero(right)


def engineer(df: DataFrame) -> DataFrame:
    cols = {name: ratio(n, d, off) for name, n, d, off in C.RATIO_FEATS}
    cols.update({name: product_fill(a, b) for name, a, b in C.PRODUCT_FEATS})
    return df.withColumns(cols)


# --------------------------------------------------------------------------
# label rules
# --------------------------------------------------------------------------
def scorecard_score(income_max) -> Column:
    """Weighted scorecard in [0, 1] (noise term of the generator dropped)."""
    s = C.SCORECARD
    m = C.SCORECARD_MISSING
    inc = F.coalesce(F.col("Annual_Income") / income_max, F.lit(0.0))
    debt = F.coalesce(F.col("Outstanding_Debt"), F.lit(m["Outstanding_Debt"]))
    delay = F.coalesce(F.col("Delay_from_due_date"), F.lit(m["Delay_from_due_date"]))
    delayed = F.coalesce(F.col("Num_of_Delayed_Payment"), F.lit(m["Num_of_Delayed_Payment"]))
    util = F.coalesce(F.col("Credit_Utilization_Ratio"), F.lit(m["Credit_Utilization_Ratio"]))
    hist = F.col("Credit_History_Age")
    hist_t = F.when(hist.isNull(), F.lit(0.0)).otherwise(
        F.when(hist > s["history_div"], F.lit(s["history_div"])).otherwise(hist) / s["history_div"])
    mix = (F.when(F.col("Credit_Mix") == "Good", s["mix"]["Good"])
           .when(F.col("Credit_Mix") == "Standard", s["mix"]["Standard"])
           .otherwise(s["mix"]["Bad"]))
    total = (s["w_income"] * inc
             + s["w_debt"] * (1 - debt / s["debt_div"])
             + s["w_delay"] * (1 - delay / s["delay_div"])
             + s["w_history"] * hist_t
             + s["w_delayed"] * (1 - delayed / s["delayed_div"])
             + s["w_mix"] * mix
             + s["w_util"] * (1 - util / s["util_div"]))
    return F.when(total < 0, 0.0).when(total > 1, 1.0).otherwise(total)


def scorecard_label(df: DataFrame, income_max=None) -> DataFrame:
    if income_max is None:
        income_max = df.select(F.max("Annual_Income")).scalar()
    elif not isinstance(income_max, Column):
        income_max = F.lit(float(income_max))
    lo, hi = C.SCORECARD_CUTS
    s = scorecard_score(income_max)
    return df.withColumn(C.LABEL, F.when(s < lo, 0).when(s < hi, 1).otherwise(2).cast("int"))


def label_map_on_read(col) -> Column:
    """Text label -> 0/1/2; any other text -> NULL."""
    c = F.trim(_c(col).cast("string"))
    return (F.when(c == C.CLASS_NAMES[0], 0).when(c == C.CLASS_NAMES[1], 1)
            .when(c == C.CLASS_NAMES[2], 2)).cast("int")


def label_name(col) -> Column:
    """0/1/2 -> class name; any other value -> NULL (no ANSI error)."""
    m = F.create_map(*[x for i, n in enumerate(C.CLASS_NAMES) for x in (F.lit(i), F.lit(n))])
    return F.try_element_at(m, _c(col).cast("int"))


def label_binarize(df: DataFrame, label: str = C.LABEL, n_classes: int = 3) -> DataFrame:
    return df.withColumns({f"y_{k}": (F.col(label) == k).cast("int") for k in range(n_classes)})


# --------------------------------------------------------------------------
# scoring rules
# --------------------------------------------------------------------------
def proba_to_score(p1, p2) -> Column:
    """int(300 + 200 p1 + 550 p2): truncation; the value is positive."""
    v = F.lit(float(C.SCORE_BASE)) + _c(p1) * C.SCORE_W1 + _c(p2) * C.SCORE_W2
    return F.floor(v).cast("bigint")


def score_band(score) -> Column:
    s = _c(score)
    z = C.SCORE_ZONES
    expr = None
    for hi, name in zip(z[1:-1], C.SCORE_ZONE_NAMES[:-1]):
        expr = F.when(s < hi, name) if expr is None else expr.when(s < hi, name)
    return expr.otherwise(C.SCORE_ZONE_NAMES[-1])


def score_colour(score) -> Column:
    s = _c(score)
    (g, gn), (a, an) = C.SCORE_COLOUR
    return F.when(s >= g, gn).when(s >= a, an).otherwise("red")


def expected_range(income) -> Column:
    """struct(lo, hi) by annual income; missing income -> NULL range."""
    inc = _c(income)
    lo = hi = None
    for bound, l_, h_ in C.EXPECTED_RANGE:
        lo = F.when(inc < bound, l_) if lo is None else lo.when(inc < bound, l_)
        hi = F.when(inc < bound, h_) if hi is None else hi.when(inc < bound, h_)
    lo = lo.when(inc.isNotNull(), C.EXPECTED_RANGE_TOP[0])
    hi = hi.when(inc.isNotNull(), C.EXPECTED_RANGE_TOP[1])
    return F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))


def range_midpoint(lo, hi) -> Column:
    return F.floor((_c(lo) + _c(hi)) / 2).cast("bigint")


def _or_default(col, default) -> Column:
    """Python ``x or d``: missing or zero takes the default."""
    c = _c(col)
    return F.when(c.isNull() | (c == 0), F.lit(float(default))).otherwise(c)


def risk_dimensions(df: DataFrame, prefix: str = "risk_") -> DataFrame:
    """Six 0..100 risk dimensions from raw applicant inputs."""
    delayed = _or_default("Num_of_Delayed_Payment", 0)
    delay = _or_default("Delay_from_due_date", 0)
    debt = _or_default("Outstanding_Debt", 0)
    income_any = F.coalesce(F.col("Annual_Income"), F.lit(1.0))
    hist = _or_default("Credit_History_Age", 0)
    inq = _or_default("Num_Credit_Inquiries", 0)
    util = _or_default("Credit_Utilization_Ratio", 30)
    inv = _or_default("Amount_invested_monthly", 0)
    sal = _or_default("Monthly_Inhand_Salary", 1)
    inc0 = _or_default("Annual_Income", 0)
    mix = F.col("Credit_Mix")
    zero, hundred = F.lit(0.0), F.lit(100.0)
    return df.withColumns({
        prefix + "payment": F.greatest(zero, 100 - delayed / 22 * 80 - delay / 62 * 20),
        prefix + "debt": F.greatest(zero, 100 - debt / F.greatest(income_any, F.lit(1.0)) * 100),
        prefix + "history": F.least(hundred, hist / 35 * 100),
        prefix + "mix": (F.when(mix == "Good", C.RISK_MIX["Good"])
                         .when(mix == "Standard", C.RISK_MIX["Standard"])
                         .when(mix == "Bad", C.RISK_MIX["Bad"])
                         .otherwise(C.RISK_MIX_DEFAULT)),
        prefix + "activity": F.greatest(zero, 100 - inq / 17 * 50
                                        - F.greatest(zero, util - 30) / 20 * 50),
        prefix + "savings": F.least(hundred, inv / F.greatest(sal, F.lit(1.0)) * 80
                                    + F.least(F.lit(20.0), inc0 / 150000 * 20)),
    })


RISK_DIM_COLUMNS = ["payment", "debt", "history", "mix", "activity", "savings"]


def insight_codes(score="score", lo="range_lo", hi="range_hi") -> Column:
    """Ordered array of fired rule codes, fallback when none fired."""
    L = C.INSIGHT_LIMITS
    dfd, od, ai = F.col("Delay_from_due_date"), F.col("Outstanding_Debt"), F.col("Annual_Income")
    rules = [
        ("high_delay", dfd > L["delay"]),
        ("debt_to_income", F.try_divide(od, ai + 1) > L["debt_ratio"]),
        ("high_utilisation", F.col("Credit_Utilization_Ratio") > L["util"]),
        ("short_history", F.col("Credit_History_Age") < L["history"]),
        ("bad_mix", F.col("Credit_Mix") == "Bad"),
        ("many_delayed", F.col("Num_of_Delayed_Payment") > L["delayed"]),
        ("many_inquiries", F.col("Num_Credit_Inquiries") > L["inquiries"]),
        ("above_range", _c(score) >= _c(hi)),
        ("below_range", (_c(score) < _c(lo)) & ~F.coalesce(_c(score) >= _c(hi), F.lit(False))),
    ]
    fired = F.filter(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]),
                     lambda x: x.isNotNull())
    return F.when(F.size(fired) == 0, F.array(F.lit("fallback"))).otherwise(fired)


def insight_text(code, lo="range_lo", hi="range_hi") -> Column:
    m = F.create_map(*[x for k, v in C.INSIGHT_TEXT.items() for x in (F.lit(k), F.lit(v))])
    t = F.try_element_at(m, _c(code))
    t = F.replace(t, F.lit("{lo}"), F.coalesce(_c(lo).cast("string"), F.lit("")))
    return F.replace(t, F.lit("{hi}"), F.coalesce(_c(hi).cast("string"), F.lit("")))


def insight_severity(text) -> Column:
    t = _c(text)
    return (F.when(F.contains(t, F.lit("⚠️")), "warn")
            .when(F.contains(t, F.lit("✅")), "good").otherwise("info"))


def proba_bar(p) -> Column:
    n = F.floor(_c(p) * C.PROBA_BAR_CELLS).cast("int")
    return F.concat(F.repeat(F.lit(C.PROBA_BAR_FULL), n),
                    F.repeat(F.lit(C.PROBA_BAR_EMPTY), F.lit(C.PROBA_BAR_CELLS) - n))


def name_cleanup(text) -> Column:
    t = F.replace(F.replace(_c(text), F.lit("_"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    for emo, tag in C.EMOJI_TAGS:
        t = F.replace(t, F.lit(emo), F.lit(tag))
    return t


def deviation_pct(u, g, p, lower_is_better: bool) -> Column:
    """(u - g) / (range + 1e-9) * 100, sign flipped when lower is better.

    range = |g - p| when p is present and non-zero, else |g| + 1; NULL when
    the applicant value or the Good profile value is missing.
    """
    u, g, p = _c(u), _c(g), _c(p)
    rng = F.when(p.isNotNull() & (p != 0), F.abs(g - p)).otherwise(F.abs(g) + 1)
    pct = (u - g) / (rng + 1e-9) * 100
    return -pct if lower_is_better else pct
