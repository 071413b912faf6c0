"""Version keys and their comparison.

A key is an array of parts, each a number or a string. Comparison goes part by part;
where one part is a number and the other a string both compare as strings, which is
not transitive (2 < 10 < "10a" < 2), so there is no sort key for all versions and
comparison stays a predicate on pairs. Versions of numbers alone do have one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "array<struct<n:bigint,s:string>>"
#: Numbers in front of a version, at most; fewer than LEAST are filled up with zeros.
MOST, LEAST = 4, 3
#: What a number of more digits than a bigint holds has as ``n``; its digits are its ``s`` then.
HUGE = (1 << 63) - 1


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), 0)


def _part(text: Column) -> Column:
    """A number if the text is digits alone, else a string."""

    def number(digits: Column) -> Column:
        big = F.length(digits) > 18
        return F.struct(F.when(big, F.lit(HUGE)).otherwise(F.when(~big, digits).cast("bigint")).alias("n"), F.when(big, digits).alias("s"))

    digits = F.when(text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+(?=[0-9])", ""))
    return let(digits, lambda d: F.when(d.isNotNull(), number(d)).otherwise(_word(text)))


def _word(text: Column) -> Column:
    return F.struct(F.lit(None).cast("bigint").alias("n"), text.alias("s"))


def _leading(pieces: Column) -> Column:
    """How many pieces in front are digits alone."""
    stop = F.array_position(F.transform(pieces, lambda p: p.rlike("^[0-9]+$")), F.lit(False))
    return let(stop, lambda at: F.when(at > 0, at - 1).otherwise(F.size(pieces)).cast("int"))


def _filled(parts: Column) -> Column:
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("s"))
    return let(parts, lambda p: F.concat(p, F.array_repeat(zero, F.greatest(F.lit(0), F.lit(LEAST) - F.size(p)))))


def _numbers(pieces: Column, k: Column) -> Column:
    return _filled(F.transform(F.slice(pieces, F.lit(1), F.greatest(k, F.lit(0))), _part))


def _regular(bare: Column, otherwise: Column) -> Column:
    """The key of a version that begins with a number; ``otherwise`` where it doesn't."""

    def with_rest(s: Column) -> Column:
        k, rest = s["k"], s["rest"]
        # a separator with nothing behind it belongs to the rest, together with the number before it
        bare_end = F.coalesce(rest == "", F.lit(False))
        last = F.concat(F.get(s["front"], F.greatest(k, F.lit(1)) - 1), F.when(k < F.size(s["front"]), ".").otherwise("-"))
        done = F.struct(F.when(bare_end, k - 1).otherwise(k).alias("k"), F.when(bare_end, last).otherwise(rest).alias("rest"))
        return let(done, lambda d: F.when(d["k"] < 1, otherwise).otherwise(F.concat(_numbers(s["front"], d["k"]), F.when(d["rest"].isNull(), F.array().cast(KEY)).otherwise(F.array(_word(d["rest"]))))))

    def with_front(s: Column) -> Column:
        k, front, label = F.least(F.lit(MOST), s["k"]), s["front"], s["label"]
        behind = F.array_join(F.slice(front, k + 1, F.greatest(F.lit(0), F.size(front) - k)), ".")
        rest = F.when(k < F.size(front), F.concat(behind, F.coalesce(F.concat(F.lit("-"), label), F.lit("")))).otherwise(label)
        return let(F.struct(k.alias("k"), front.alias("front"), rest.alias("rest")), with_rest)

    dash = F.instr(bare, "-")
    pieces = F.struct(F.split(F.split_part(bare, F.lit("-"), F.lit(1)), "[.]").alias("front"), F.when(dash > 0, F.substring(bare, dash + 1, F.length(bare))).alias("label"))
    return let(pieces, lambda s: let(F.struct(s["front"].alias("front"), s["label"].alias("label"), _leading(s["front"]).alias("k")), with_front))


def parse_version(version: Column) -> Column:
    """The key of a version; null, empty, ``*``, ``-`` and ``unknown`` are 0.0.0.

    What stands before the first dash is split at dots; the numbers in front of it, four
    at most, are the first parts, and all the rest of the text is one more part. A
    separator with nothing behind it belongs to the rest, together with the number
    before it. A version that doesn't begin with a number is split at dots and dashes,
    up to its first part that is none. Numbers may have any number of digits.
    """
    bare = F.regexp_replace(F.trim(version), "^v(?=[0-9])", "")
    loose = let(F.split(version, "[-.]"), lambda p: _numbers(p, F.least(F.size(p), _leading(p) + 1)))
    none = version.isNull() | version.isin("", "*", "-", "unknown")
    return F.when(none, _filled(F.array().cast(KEY))).otherwise(let(bare, lambda b: _regular(b, loose))).cast(KEY)


def compare_keys(a: Column, b: Column) -> Column:
    """-1, 0 or 1; the shorter key is filled up with zeros."""

    def one(x: Column, y: Column) -> Column:
        xn, yn = F.when(x.isNull(), F.lit(0).cast("bigint")).otherwise(x["n"]), F.when(y.isNull(), F.lit(0).cast("bigint")).otherwise(y["n"])
        numbers = xn.isNotNull() & yn.isNotNull()
        xs, ys = F.coalesce(x["s"], xn.cast("string")), F.coalesce(y["s"], yn.cast("string"))
        longer = F.when((xn == HUGE) & (yn == HUGE), F.signum(F.length(xs) - F.length(ys)).cast("int")).otherwise(0)  # of two numbers kept as digits the longer is the larger
        less = F.when(numbers & (xn != yn), xn < yn).when(longer != 0, longer < 0).otherwise(F.when(numbers & (xn != HUGE), F.lit(False)).otherwise(xs < ys))
        more = F.when(numbers & (xn != yn), xn > yn).when(longer != 0, longer > 0).otherwise(F.when(numbers & (xn != HUGE), F.lit(False)).otherwise(xs > ys))
        return F.when(less, -1).when(more, 1).otherwise(0)

    return F.aggregate(F.zip_with(a, b, one), F.lit(0), lambda acc, x: F.when(acc != 0, acc).otherwise(x))


def sort_key(key: Column) -> Column:
    """A key of numbers alone as an array of bigints that sorts as the versions compare; null for all other keys."""
    plain = (F.size(key) <= MOST) & F.forall(key, lambda p: p["n"].isNotNull() & p["s"].isNull())
    return F.when(plain, F.transform(F.sequence(F.lit(0), F.lit(MOST - 1)), lambda i: F.coalesce(F.get(key, i)["n"], F.lit(0).cast("bigint"))))


def with_keys(df: DataFrame, version: str, key: str) -> DataFrame:
    """Adds the key of a version column; each different version is parsed once."""
    keys = df.select(version).distinct().withColumn(key, parse_version(F.col(version))).withColumnRenamed(version, "__v")
    return df.join(keys, df[version].eqNullSafe(keys["__v"])).drop("__v")


def compare_versions(a: Column, b: Column) -> Column:
    return compare_keys(parse_version(a), parse_version(b))


def range_contains(key: Column, start: Column, end: Column, start_incl: Column, end_excl: Column) -> Column:
    """Is a version key within a range? ``start`` and ``end`` are keys or null where the range is open."""
    low, high = compare_keys(key, start), compare_keys(key, end)
    above = start.isNull() | F.when(start_incl, low >= 0).otherwise(low > 0)
    below = end.isNull() | F.when(end_excl, high < 0).otherwise(high <= 0)
    return above & below


def bound_key(version: Column) -> Column:
    """Key of a range's end; null (open) for an empty or missing one."""
    return F.when((version != "") & version.isNotNull(), parse_version(version))
