"""Column functions: dates, codes, safe numbers, rules. All stay in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of all kinds.
WHITE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def double(value: float) -> Column:
    return F.lit(float(value)).cast("double")


def strip(c: Column) -> Column:
    """Without white space at the ends, of whatever kind."""
    return F.btrim(c.cast("string"), F.lit(WHITE))


def safe_number(c: Column) -> Column:
    """A double, or null for what isn't a finite decimal number (Java suffixes and 'nan' included)."""
    text = c.cast("string")
    return F.when(text.rlike(_NUMBER), strip(text).try_cast("double"))


def number_or(c: Column, default: float) -> Column:
    return F.coalesce(safe_number(c), double(default))


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < double(float("inf"))), c)


def norm_ymd(c: Column) -> Column:
    """Text of a date: trimmed, without a trailing '.0'; numbers as whole numbers; null as ''."""
    text = F.regexp_replace(strip(c), r"\.0$", "")
    # worked out once for each row: the text is looked at again and again
    known = F.transform(F.array(text), lambda t: F.when(t.rlike(r"^\d{8}$"), t).otherwise(F.coalesce(_whole(t), t)))
    return F.coalesce(F.get(known, F.lit(0)), F.lit(""))


def _whole(text: Column) -> Column:
    """A number without its fraction, towards 0, as text."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double").try_cast("bigint").cast("string"))


def to_ymd(c: Column) -> Column:
    """YYYY-MM-DD becomes YYYYMMDD; anything else stays, trimmed."""
    text = strip(c)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.replace(text, F.lit("-"), F.lit(""))).otherwise(text)


def parse_ymd(c: Column) -> Column:
    """Either date form as YYYYMMDD; null if it is neither."""
    text = to_ymd(norm_ymd(c))
    return F.when(text.rlike(r"^\d{8}$"), text)


def trade_date_text(c: Column) -> Column:
    return F.substring(F.replace(c.cast("string"), F.lit("-"), F.lit("")), 1, 8)


def is_ymd(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{8}$"), F.lit(False))


def ymd_date(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyyMMdd")).cast("date")


def add_days(c: Column, days: int) -> Column:
    return F.date_format(F.date_add(ymd_date(c), days), "yyyyMMdd")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def choose_exec_date(target: Column, trade: Column) -> Column:
    return F.coalesce(blank_to_null(target), trade)


def exchange_code(c: Column) -> Column:
    """The suffixes .SZ and .SH become .XSHE and .XSHG; null becomes ''."""
    text = F.coalesce(strip(c), F.lit(""))
    return F.when(text.endswith(".SZ"), F.regexp_replace(text, r"\.SZ$", ".XSHE")).when(text.endswith(".SH"), F.regexp_replace(text, r"\.SH$", ".XSHG")).otherwise(text)


def first_text(columns: list[str]) -> Column:
    """The first non-blank text among the columns."""
    return F.coalesce(*[blank_to_null(F.col(c)) for c in columns], F.lit(None).cast("string"))


def clip(c: Column, low: float, high: float) -> Column:
    """Null stays null: ``least`` and ``greatest`` alone would skip it and give a bound."""
    return F.when(c.isNotNull(), F.greatest(double(low), F.least(double(high), c)))


# The coefficients of the two rules, costs and penalties.
def fill_probability(open_times: Column, seal_amount: Column, turnover_rate: Column) -> Column:
    """.35 + .06 per opening (0-5) - .05 per 1e8 sealed (up to 5) + .005 per turnover point (0-20), in .02-.98."""
    opened = double(0.06) * clip(safe_number(open_times), 0, 5)
    sealed = double(0.05) * clip(safe_number(seal_amount) / double(1e8), float("-inf"), 5)
    turned = double(0.005) * clip(safe_number(turnover_rate), 0, 20)
    zero = double(0)
    return clip(double(0.35) + F.coalesce(opened, zero) - F.coalesce(sealed, zero) + F.coalesce(turned, zero), 0.02, 0.98)


def overnight_return(probability: Column, strength: Column, theme: Column, regime: Column | None = None) -> Column:
    base = (clip(number_or(probability, 0.3), 0, 1) - double(0.2)) * double(0.03) + clip(number_or(strength, 0), -2, 10) * double(0.001) + clip(number_or(theme, 0), -1, 3) * double(0.003)
    if regime is not None:
        base = base - F.when(is_risk_off(regime), double(0.006)).otherwise(double(0))
    return clip(base, -0.05, 0.08)


def is_risk_off(regime: Column) -> Column:
    return F.coalesce(F.upper(strip(regime)).isin("RISK_OFF", "OFF", "DEFENSE"), F.lit(False))


COST = 8 / 1e4


def risk_penalty(regime: Column) -> Column:
    return F.when(is_risk_off(regime), double(0.02)).otherwise(double(0))


def expected_value(p_fill: Column, e_ret: Column, cost: Column, penalty: Column) -> Column:
    return p_fill * e_ret - cost - penalty


def fill_rate(target: Column, filled: Column) -> Column:
    t, f = number_or(target, 0), number_or(filled, 0)
    return F.when(t <= 0, double(0)).otherwise(clip(F.try_divide(f, t), 0, 1))


def forward_return(later: Column, earlier: Column) -> Column:
    """later / earlier - 1; null where the earlier one is 0."""
    return F.try_divide(later, earlier) - double(1)


def binarise(ret: Column, threshold: float = 0.0) -> Column:
    return F.coalesce((ret > double(threshold)).cast("int"), F.lit(0))


def risk_level(high: Column) -> Column:
    return F.when(high, "HIGH").when(~high, "LOW")


def fixed_number(c: Column, digits: int) -> Column:
    """Fixed digits, trailing zeros and point removed."""
    text = F.format_string(f"%.{digits}f", c)
    return text if digits == 0 else F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def percent(c: Column, digits: int = 2) -> Column:
    return F.coalesce(F.when(~F.isnan(c), F.concat(F.format_string(f"%.{digits}f", c * 100), F.lit("%"))), F.lit("-"))
