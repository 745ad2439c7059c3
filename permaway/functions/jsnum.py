"""Numbers and white space as browsers read and print them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest prefix that is a number.
_PREFIX = r"^\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"
_SPACE = "[\\s\\u00A0\\uFEFF\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"


def parse_float(text: Column) -> Column:
    """The number a text begins with; null (instead of NaN) where there is none."""
    found = F.regexp_extract(text, _PREFIX, 1)
    return F.when(found != "", found.try_cast("double"))


def parse_int(text: Column) -> Column:
    """The whole number a text begins with."""
    found = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    return F.when(found != "", found.try_cast("int"))


def trim(text: Column) -> Column:
    """Without Unicode white space and byte order marks at both ends."""
    return F.regexp_replace(text, f"^{_SPACE}|{_SPACE}$", "")


def _printed(x: Column, pattern: str) -> Column:
    return F.call_function("format_number", x, F.lit(pattern))


def to_fixed(x: Column, digits: int) -> Column:
    """Fixed decimals from the exact binary value, ties away from zero, up to 15 digits in all; NaN prints as such.

    A double's shortest text rounds as its exact value does, unless it ends in a 5 one
    digit after the last one kept: no other decimal of so few digits lies between the
    two, as long as all have 15 digits at most.  So most values are printed as decimals.  The rest goes through the exact
    value, the decimal expansion of the double; ties occur only where that ends
    within one digit after the last one kept, so such values are nudged.
    """
    pattern = "0" if digits == 0 else "0." + "0" * digits
    scaled = F.abs(x) * F.lit(10.0**digits)
    ends_in_5 = F.abs(x) == (F.floor(scaled) + F.lit(0.5)) / F.lit(10.0**digits)
    # decimals below 1e-6 print with an exponent, and a negative one that rounds to zero loses its sign
    plain = (F.abs(x) < 10.0 ** (14 - digits)) & ~ends_in_5 & ((F.abs(x) >= 1e-6) if digits > 6 else F.lit(True)) & ~((x < 0) & (scaled < 0.5))

    def exactly(x: Column) -> Column:
        scaled = F.abs(x) * F.lit(10.0**digits)
        # x * 10^digits is exact for the dyadic fractions that can tie: k + 0.5 with a denominator of at most 2^(digits + 1)
        dyadic = F.abs(x) * F.lit(2.0 ** (digits + 1))
        tie = (scaled - F.floor(scaled) == 0.5) & (dyadic == F.floor(dyadic)) & (F.abs(x) < 1e9)
        up = (F.floor(scaled) + 1) / F.lit(10.0**digits)
        value = F.when(tie, F.when(x < 0, -up).otherwise(up)).otherwise(x)
        # format_number gives -0.000 for -0.0, where only a true negative keeps its sign
        return F.when(F.isnan(x), F.lit("NaN")).when(x == 0, _printed(F.lit(0.0), pattern)).otherwise(_printed(value, pattern))

    # a function of one element keeps the rare cases out of the generated method, which would grow too large to be compiled
    return F.when(plain, x.try_cast(f"decimal(18,{digits})").cast("string")).otherwise(F.get(F.transform(F.array(x), exactly), F.lit(0)))


def signed_fixed(x: Column, digits: int) -> Column:
    """``to_fixed`` with the sign of a negative zero, which a tiny negative number becomes when its printed text is read again."""
    return F.when(x == 0, F.concat(F.when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit("")), to_fixed(F.lit(0.0), digits))).otherwise(to_fixed(x, digits))


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(x + 0.5)


def section_order(name: Column, first: Column) -> Column:
    """Sort key of dictionary keys: whole numbers below 2^32 - 1 ascending, then others by first appearance."""
    number = F.when(name.rlike("^(0|[1-9][0-9]{0,9})$"), name.try_cast("bigint"))
    whole = F.when(number < F.lit(4294967295), number)
    return F.struct(whole.isNull().alias("is_text"), F.coalesce(whole, F.lit(0).cast("bigint")).alias("number"), F.when(whole.isNull(), first).alias("first"))
