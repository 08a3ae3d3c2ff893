"""Canonical JSON and hashes of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import utc_seconds


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shortest(v: Column) -> Column:
    """(d, p) of the fewest digits with 0.d x 10^p = x, nearest to the digits given, by reading candidates back."""
    n, number, x = F.length(v["d"]), v["d"].cast("long"), v["x"]
    tens = F.array(*[F.lit(10**k) for k in range(18)])

    def cut(k: Column) -> Column:
        """The better of the two numbers of n - k digits next to the given ones, null if neither reads back as x."""
        ten = F.get(tens, k)
        rest = F.pmod(number, ten)
        low = F.call_function("div", number, ten)
        # Digits in the middle between two candidates: whole numbers tell on which side x itself lies.
        above = F.coalesce((x < 9e18) & (x.cast("long") > number * F.get(tens, v["p"] - n)), F.lit(True))
        up = (rest * 2 > ten) | ((rest * 2 == ten) & above)
        reads = lambda d: F.concat(d.cast("string"), F.lit("E"), (v["p"] - n + k).cast("string")).cast("double") == x
        near, far = F.when(up, low + 1).otherwise(low), F.when(up, low).otherwise(low + 1)
        found = F.when(reads(near), near).when(reads(far), far)
        # A number that grows by a digit (99 to 100) moves the power.
        return F.when(found.isNotNull(), F.struct(F.rtrim(found.cast("string"), F.lit("0")).alias("d"), (v["p"] + F.length(found.cast("string")) - n + k).alias("p")))

    same = F.struct(v["d"].alias("d"), v["p"].alias("p"))
    every = F.filter(F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), cut), lambda f: f.isNotNull())
    # No two numbers of up to 15 digits read as one normal double; if any shorter number reads back, one that is shorter by a single digit does.
    return F.when((n <= 15) & ((x == 0) | (x > 2.3e-308)), same).when(cut(F.lit(1)).isNull(), same).otherwise(F.element_at(every, 1))


def float_text(c: Column) -> Column:
    """Shortest text that reads back as the double, as JSON writers of scripting languages print it; null of NaN.

    The digits are the engine's own, shortened where fewer read back. Where 17 digits are
    needed above 2^63, the last of them may be the second nearest.
    """

    def laid_out(v: Column) -> Column:
        digits, point, n = v["d"], v["p"], F.length(v["d"])
        rest = F.substring(digits, F.lit(2), n)
        exponent = F.concat(F.when(point < 1, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(point - 1).cast("string"), F.greatest(F.length(F.abs(point - 1).cast("string")), F.lit(2)), F.lit("0")))
        scientific = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), rest)).otherwise(F.lit("")), F.lit("e"), exponent)
        whole = F.concat(F.rpad(digits, point, F.lit("0")), F.lit(".0"))
        mixed = F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
        return F.when(digits == "", F.lit("0.0")).when((point < -3) | (point > 16), scientific).when(point <= 0, small).when(n <= point, whole).otherwise(mixed)

    def parted(m: Column) -> Column:
        """Significant digits d and power p of the magnitude 0.d x 10^p, from the engine's own text of it."""
        every = F.concat(m["s"][0], m["s"][1])
        zeros = F.length(every) - F.length(F.ltrim(every, F.lit("0")))
        power = F.length(m["s"][0]) + F.coalesce(F.get(m["s"], 2).cast("int"), F.lit(0)) - zeros
        return F.struct(F.trim(every, F.lit("0")).alias("d"), power.alias("p"), m["x"].alias("x"))

    x = F.abs(c.cast("double"))
    text = F.when(F.isnan(x) | (x == float("inf")), F.lit("0.0")).otherwise(x.cast("string"))
    plain = _let(_let(_let(F.struct(F.split(text, "[.E]").alias("s"), x.alias("x")), parted), _shortest), laid_out)
    text = F.when(F.isnan(x), F.lit(None)).when(x == float("inf"), F.lit("inf")).otherwise(plain)
    negative = (c < 0) | ((c == 0) & F.startswith(c.cast("double").cast("string"), F.lit("-")))
    return F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), text)


def _value(c: Column, kind: T.DataType) -> Column:
    """JSON text of a value."""
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        text = F.concat(F.lit('"'), utc_seconds(c), F.lit('"'))
    elif isinstance(kind, T.DoubleType | T.FloatType):
        text = float_text(c)
    elif isinstance(kind, T.StringType | T.ArrayType):
        body = F.to_json(F.struct(c.alias("v")))  # {"v":...}, but {} of a null
        text = F.when(c.isNotNull(), F.substr(body, F.lit(6), F.length(body) - 6))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))


def canonical_json(df: DataFrame, names: list[str]) -> Column:
    """One JSON object: keys sorted, no blanks, raw UTF-8, UTC seconds, nulls kept."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return canonical_object({n: (df[n], kinds[n]) for n in names})


def canonical_object(fields: dict[str, tuple[Column, T.DataType]]) -> Column:
    """canonical_json() of columns that are given with their types."""
    parts = [F.concat(F.lit(f'"{n}":'), _value(*fields[n])) for n in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def integrity_hash(df: DataFrame, names: list[str]) -> Column:
    return F.sha2(canonical_json(df, names), 256)


def verify_hash(df: DataFrame, names: list[str], hash_col: str) -> DataFrame:
    """df with hash_ok: whether the stored hash is that of the named columns."""
    return df.withColumn("hash_ok", integrity_hash(df, names).eqNullSafe(df[hash_col]))


def content_hash(df: DataFrame) -> DataFrame:
    """One row (row_count, content_hash) that does not depend on the order or the files of the rows."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*[df[f"`{c}`"] for c in sorted(df.columns)])), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    total = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("s"))
    return total.select("row_count", F.sha2(F.concat_ws(":", F.col("row_count").cast("string"), "s"), 256).alias("content_hash"))
