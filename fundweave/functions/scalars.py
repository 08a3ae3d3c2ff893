"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the token prices, in VND for 2,000 tokens, and the display zone.
INPUT_PRICE, OUTPUT_PRICE, PRICE_UNIT = 7, 28, 2000
DISPLAY_ZONE = "Asia/Ho_Chi_Minh"
MILLION = 1_000_000


def is_blank(s: Column) -> Column:
    """Empty or all Unicode white space; null stays null."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "") == ""


def missing_id(s: Column) -> Column:
    return F.coalesce(is_blank(s), F.lit(True))


def is_finite(x: Column) -> Column:
    """False for null, NaN and both infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def lenient_double(c: Column) -> Column:
    """Null where the value is no number; text is not trimmed."""
    text = c.cast("string")
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(NaN|Infinity)$"), text.try_cast("double"))


def sorted_unique(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def utc_seconds(t: Column) -> Column:
    """2024-01-01T00:00:00Z."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def month_key(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM")


def tick_to_time(start: Column, tick: Column, seconds: float) -> Column:
    """start + tick * seconds, exact to the microsecond."""
    micros = F.unix_micros(start.cast("timestamp")) + tick.cast("long") * int(round(seconds * 1_000_000))
    return F.timestamp_micros(micros)


def nearest_millis(t: Column) -> Column:
    """Milliseconds since the epoch, to the nearest; what lies in the middle goes away from the epoch."""
    micros = F.unix_micros(t)
    return F.call_function("div", micros + F.when(micros < 0, -500).otherwise(500), F.lit(1000))


def pass_through(amount_in: Column, amount_out: Column) -> Column:
    """Share of what came in that went out: 0 without income, 1 at most."""
    return F.when(amount_in == 0, 0.0).otherwise(F.least(amount_out / F.nullif(amount_in, F.lit(0.0)), F.lit(1.0)))


def format_vnd_millions(amount: Column) -> Column:
    """Whole VND as millions, exactly: 12345678 -> "12.345678 tr", 10000000 -> "10.0 tr"."""
    whole = F.abs(amount.cast("decimal(38,0)"))
    million = F.lit(MILLION).cast("decimal(10,0)")
    rest = F.rtrim(F.lpad((whole % million).cast("decimal(10,0)").cast("string"), 6, "0"), F.lit("0"))
    sign = F.when(amount < 0, "-").otherwise("")
    return F.concat(sign, F.floor(whole / million).cast("decimal(38,0)").cast("string"), F.lit("."), F.when(rest == "", "0").otherwise(rest), F.lit(" tr"))


def format_transaction(amount: Column, currency: Column, at: Column) -> Column:
    """Amount and local time of an edge, in the display zone; VND in millions."""
    text = (
        F.when(currency == "VND", format_vnd_millions(amount))
        .when(currency.isNull(), F.concat(amount.cast("decimal(38,2)").cast("string"), F.lit(" (unknown currency)")))
        .otherwise(F.concat_ws(" ", amount.cast("decimal(38,2)").cast("string"), currency))
    )
    clock = F.coalesce(F.date_format(F.from_utc_timestamp(at, DISPLAY_ZONE), "HH:mm"), F.lit("unknown time"))
    return F.concat(text, F.lit(" ("), clock, F.lit(")"))


def amount_band(amount: Column, currency: Column, high: float = 100 * MILLION, middle: float = 40 * MILLION) -> Column:
    """Line width of an edge."""
    vnd = F.coalesce(currency == "VND", F.lit(False))
    return F.when(vnd & (amount >= high), 4.5).when(vnd & (amount >= middle), 3.0).otherwise(1.8)


def url_component(s: Column) -> Column:
    """Percent-encodes like a browser's component encoding: !'()*~ and space as %20."""
    out = F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def cost_vnd(tokens_in: Column, tokens_out: Column) -> Column:
    """Price of a call, rounded up to whole VND."""
    total = tokens_in.cast("long") * INPUT_PRICE + tokens_out.cast("long") * OUTPUT_PRICE + (PRICE_UNIT - 1)
    return F.floor(total / PRICE_UNIT).cast("long")


def next_model_family(neighbour_gain: Column, heterogeneous: Column, typed_gain: Column, temporal_gap: Column, temporal_gain: Column) -> Column:
    """Which model family an experiment justifies next.

    Without a gain from neighbours: none. Else a heterogeneous graph not yet gained from
    asks for the typed family, a temporal gap not yet gained from for the temporal one, and
    gains from both for the hybrid.
    """
    return (
        F.when(neighbour_gain <= 0, "JUSTIFIED_NULL")
        .when(heterogeneous & (typed_gain <= 0), "hgt")
        .when(temporal_gap & (temporal_gain <= 0), "tgn")
        .when((typed_gain > 0) & (temporal_gain > 0), "hybrid")
        .otherwise("JUSTIFIED_NULL")
    )
