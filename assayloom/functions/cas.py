"""Registry numbers: normal form, shape, check digit, and the decision whether one is genuine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold

#: Dash code points that stand for a hyphen.
DASHES = "‐‑‒–—―−－"
SHAPE = r"^[0-9]{2,7}-[0-9]{2}-[0-9]$"
TOKEN = r"(?<![0-9-])([0-9]{2,7}-[0-9]{2}-[0-9])(?![0-9-])"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
#: Words by which a sheet withholds a number.
SECRECY = ("영업비밀", "해당없음", "비공개", "secret", "proprietary", "n/a")


def normalise(text: Column) -> Column:
    """Compatibility forms and dashes folded, spaces around a hyphen between digits removed, ends trimmed."""
    folded = F.translate(fold(text), DASHES, "-" * len(DASHES))
    return F.trim(F.regexp_replace(folded, r"(?<=[0-9])\s*-\s*(?=[0-9])", "-"))


def normalise_in_text(text: Column) -> Column:
    """Separators changed only inside tokens of the number's shape; dates and ranges stay."""
    return F.regexp_replace(F.translate(fold(text), DASHES, "-" * len(DASHES)), r"(?<![0-9-])([0-9]{2,7})\s*-\s*([0-9]{2})\s*-\s*([0-9])(?![0-9-])", "$1-$2-$3")


def digits(cas: Column) -> Column:
    return F.regexp_replace(cas, "[^0-9]", "")


def well_formed(cas: Column) -> Column:
    return cas.rlike(SHAPE)


def checksum_holds(cas: Column) -> Column:
    """The digits before the last, weighted 1, 2, ... from the right, sum to the last modulo 10.

    Arithmetic on the number itself. The functions of one-element arrays bind it to a name: cas may be a long expression, which a
    filter would evaluate anew at each mention.
    """

    def holds(n: Column) -> Column:
        total = F.lit(0)
        for i in range(1, 10):
            total = total + F.pmod(F.floor(n / F.lit(10**i)), F.lit(10)) * i
        return total % 10 == n % 10

    digits_hold = lambda c: F.exists(F.array(F.replace(c, F.lit("-"), F.lit("")).try_cast("bigint")), holds)
    return F.exists(F.array(cas), lambda c: well_formed(c) & digits_hold(c))


def strip_zeros(cas: Column) -> Column:
    return F.regexp_replace(cas, "^0+", "")


def genuine(cas: Column, in_master: Column, grounding: Column) -> Column:
    """The ordered decision: dates are none, known or grounded numbers hold without a checksum, withheld ones pass."""
    bare = F.regexp_replace(F.coalesce(grounding, F.lit("")), r"\s", "")
    found = F.contains(F.coalesce(grounding, F.lit("")), cas) | F.contains(bare, F.regexp_replace(cas, r"\s", ""))
    withheld = F.lit(False)
    for word in SECRECY:
        withheld = withheld | F.contains(F.lower(cas), F.lit(word))
    return (
        F.when(cas.isNull() | (F.trim(cas) == ""), False).when(cas.rlike(DATE), False).when(in_master, True)
        .when(found, True).when(withheld, True).otherwise(checksum_holds(cas))
    )


def hamming_one(a: Column, b: Column) -> Column:
    """Same length and at most one differing character."""
    differ = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(1)))
    return (F.length(a) == F.length(b)) & (differ <= 1)
