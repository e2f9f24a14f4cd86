"""Column building blocks. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.settings import DAY_MS

NULL_TOKEN = "<null>"


def event_ms(ts: str | Column = "event_ts") -> Column:
    """Epoch milliseconds of a timestamp, with or without a zone (session zone is UTC)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_millis(col.cast("timestamp"))


def milli_units(amount: Column) -> Column:
    """Money as exact integers, thousandths, rounded half to even."""
    return F.rint(amount * 1000).cast("bigint")


def cents(amount: Column) -> Column:
    """Money as exact integer hundredths, rounded half to even."""
    return F.rint(amount * 100).cast("bigint")


def day_number(ms: Column) -> Column:
    """Whole UTC days since 1970-01-01."""
    return F.floor(ms / F.lit(DAY_MS)).cast("bigint")


def ratio(numerator: Column, denominator: Column) -> Column:
    """A double ratio that is null, never zero, when the denominator is zero."""
    den = denominator.cast("double")
    return F.when(den != 0, numerator.cast("double") / den)


def finite_or_null(value: Column) -> Column:
    """NaN and infinities become null: JSON has neither."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def composite_key(columns: Sequence[str | Column]) -> Column:
    """Join key parts with ``|``; a null part keeps its place as an explicit token."""
    parts = [
        F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(NULL_TOKEN))
        for c in columns
    ]
    return F.concat_ws("|", *parts)


def stable_id(prefix: str, key: Column) -> Column:
    """A short id that depends only on the key text; a null key gives a null id."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(key, 256), 1, 16))


def unit_uniform(seed: int | str, key: Column) -> Column:
    """A uniform draw strictly inside (0, 1) that depends only on ``seed`` and ``key``.

    52 hash bits, centred in their cell, so neither 0 nor 1 can come out.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / float(2**52)


def _horner(coefficients: Sequence[float], x: Column) -> Column:
    acc = F.lit(coefficients[0])
    for c in coefficients[1:]:
        acc = acc * x + F.lit(c)
    return acc


# Wichura's AS 241 (PPND16) rational approximation, highest power first.
AS241_CENTRE = (
    (
        2.5090809287301226727e3,
        3.3430575583588128105e4,
        6.7265770927008700853e4,
        4.5921953931549871457e4,
        1.3731693765509461125e4,
        1.9715909503065514427e3,
        1.3314166789178437745e2,
        3.3871328727963666080e0,
    ),
    (
        5.2264952788528545610e3,
        2.8729085735721942674e4,
        3.9307895800092710610e4,
        2.1213794301586595867e4,
        5.3941960214247511077e3,
        6.8718700749205790830e2,
        4.2313330701600911252e1,
        1.0,
    ),
)
AS241_MIDDLE = (
    (
        7.74545014278341407640e-4,
        2.27238449892691845833e-2,
        2.41780725177450611770e-1,
        1.27045825245236838258e0,
        3.64784832476320460504e0,
        5.76949722146069140550e0,
        4.63033784615654529590e0,
        1.42343711074968357734e0,
    ),
    (
        1.05075007164441684324e-9,
        5.47593808499534494600e-4,
        1.51986665636164571966e-2,
        1.48103976427480074590e-1,
        6.89767334985100004550e-1,
        1.67638483018380384940e0,
        2.05319162663775882187e0,
        1.0,
    ),
)
AS241_TAIL = (
    (
        2.01033439929228813265e-7,
        2.71155556874348757815e-5,
        1.24266094738807843860e-3,
        2.65321895265761230930e-2,
        2.96560571828504891230e-1,
        1.78482653991729133580e0,
        5.46378491116411436990e0,
        6.65790464350110377720e0,
    ),
    (
        2.04426310338993978564e-15,
        1.42151175831644588870e-7,
        1.84631831751005468180e-5,
        7.86869131145613259100e-4,
        1.48753612908506148525e-2,
        1.36929880922735805310e-1,
        5.99832206555887937690e-1,
        1.0,
    ),
)


def with_inverse_normal(df: DataFrame, p: str, out: str) -> DataFrame:
    """Add the standard normal quantile of column ``p``, in (0, 1), after Wichura (1988).

    The shared terms are columns of their own: inlined, they would repeat in every polynomial step
    and the generated code would be too long to compile.
    """
    q = F.col(p) - 0.5
    staged = df.withColumns(
        {
            "_c": F.lit(0.180625) - q * q,
            "_r": F.sqrt(-F.ln(F.least(F.col(p), F.lit(1.0) - F.col(p)))),
        }
    )
    staged = staged.withColumns({"_m": F.col("_r") - 1.6, "_t": F.col("_r") - 5.0})

    def rational(pair: tuple[Sequence[float], Sequence[float]], x: str) -> Column:
        return _horner(pair[0], F.col(x)) / _horner(pair[1], F.col(x))

    outer = F.when(F.col("_r") <= 5.0, rational(AS241_MIDDLE, "_m")).otherwise(
        rational(AS241_TAIL, "_t")
    )
    value = F.when(F.abs(q) <= 0.425, q * rational(AS241_CENTRE, "_c")).otherwise(
        F.when(q < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * outer
    )
    return staged.withColumn(out, value).drop("_c", "_r", "_m", "_t")


def clipped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def logit(p: Column, eps: float = 1e-9) -> Column:
    x = clipped(p, eps, 1 - eps)
    return F.ln(x / (F.lit(1.0) - x))


def packed(text: Column) -> Column:
    """A text as bytes, for shuffles: digits and dashes, of which ids are made, take half a byte each.

    A first half byte of 15 marks packed digits, a first byte of 0 the bytes of any other text.
    """
    digits = F.replace(text, F.lit("-"), F.lit("a"))
    filled = F.concat(F.when(F.length(text) % 2 == 0, F.lit("ff")).otherwise(F.lit("f")), digits)
    other = F.concat(F.lit(b"\x00"), text.cast("binary"))
    return F.when(text.rlike(r"\A[0-9-]*\z"), F.unhex(filled)).otherwise(other)


def unpacked(packed_text: Column) -> Column:
    """The text that was ``packed``."""
    digits = F.replace(F.ltrim(F.hex(packed_text), F.lit("F")), F.lit("A"), F.lit("-"))
    other = F.substring(packed_text, 2, 1 << 30).cast("string")
    return F.when(F.substring(packed_text, 1, 1) == F.lit(b"\x00"), other).otherwise(digits)


def lookup(column: str, table: Mapping[str, float], default: float) -> Column:
    """A small dictionary as a map literal; null stays null, unknown keys take ``default``.

    Only for tables of a bounded size, such as a vocabulary capped at a few hundred levels.
    """
    col = F.col(column)
    if not table:
        return F.when(col.isNotNull(), F.lit(float(default)))
    pairs = [F.lit(x) for kv in table.items() for x in (kv[0], float(kv[1]))]
    return F.when(col.isNotNull(), F.coalesce(F.element_at(F.create_map(*pairs), col), F.lit(float(default))))


def money_text(value: Column, currency: Column) -> Column:
    """``1,234.50 USD``."""
    return F.concat(F.format_number(value, 2), F.lit(" "), currency)


def percent_text(value: Column) -> Column:
    return F.concat(F.format_string("%.2f", value * 100), F.lit("%"))
