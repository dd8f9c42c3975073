"""Column functions: quantization, vectors, hashes, null-safe predicates, text measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantize(x: Column, zero: Column, scale: Column) -> Column:
    """Codes -127..127, rounded half to even; clipped before the cast, which would else overflow."""
    return F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint((x - zero) / scale))).cast("tinyint")


def dequantize(q: Column, zero: Column, scale: Column) -> Column:
    return q * scale + zero


def quant_scale(sd: Column) -> Column:
    return F.greatest(sd * 4 / 127, F.lit(1e-6))


def standardize(x: Column, mean: Column, sd: Column) -> Column:
    return (x - mean) / F.greatest(sd, F.lit(1e-6))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    """The vector over its norm; a zero vector is an error."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a))).otherwise(F.raise_error(F.lit("a zero vector has no direction")).cast("array<double>"))


def harmonic_mean(xs: Column) -> Column:
    """Zero if any value is not positive."""
    inverse = F.aggregate(xs, F.lit(0.0), lambda s, x: s + 1 / x)
    return F.when(F.exists(xs, lambda x: x <= 0), F.lit(0.0)).otherwise(F.size(xs) / inverse)


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def at_least(x: Column, bar: float) -> Column:
    """False on a missing value."""
    return ~missing(x) & F.coalesce(x >= bar, F.lit(False))


def at_most(x: Column, bar: float) -> Column:
    """False on a missing value."""
    return ~missing(x) & F.coalesce(x <= bar, F.lit(False))


def check_at_least(x: Column, bar: float) -> Column:
    """True on a missing value: a check that cannot be made passes."""
    return missing(x) | F.coalesce(x >= bar, F.lit(True))


def window_of(a: Column, i: Column, size: int) -> Column:
    """The i-th window of `size` elements, the last one shorter."""
    return F.slice(a, i * size + 1, size)


def normal_key(text: Column) -> Column:
    """Lower-cased ASCII words, joined by one space: the key of exact duplicates."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))


def let(value: Column, f) -> Column:
    """f(value), with the value computed once, however often f's lambdas use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shingles(text: Column, n: int = 8) -> Column:
    """Distinct n-word shingles; a shorter text is one shingle."""

    def of(w: Column) -> Column:
        many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))
        return F.when(F.size(w) > n, many).otherwise(F.array(F.array_join(w, " ")))

    return let(words(text), of)


def share_of(text: Column, keep: str) -> Column:
    """The share of characters of a class, e.g. 'a-zA-Z '."""
    return F.length(F.regexp_replace(text, f"[^{keep}]", "")) / F.greatest(F.length(text), F.lit(1))


def md5_int(x: Column) -> Column:
    """The first eight hex digits of md5 as an integer: a seed that is the same everywhere."""
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")


def md5_parity(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x), 32, 1), 16, 10).cast("int") % 2


def locate(text: Column, part: Column) -> Column:
    """Where the part starts, from 0: as written, else letter case aside, else null."""
    first = F.nullif(F.instr(text, part), F.lit(0))
    return F.coalesce(first, F.nullif(F.instr(F.lower(text), F.lower(part)), F.lit(0))) - 1


def bits(x: Column, n: int) -> Column:
    """The lowest n bits, the least first."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(x, i).cast("int"))
