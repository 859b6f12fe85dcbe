"""Recovering a whole number from a printed ratio, only when exactly one fits.

All arithmetic is on whole numbers in columns. A printed ratio is ``digits * 10**-places``; it stands for an interval
half a unit of the last place wide on either side, plus ``FUZZ`` of its size for the division that made it. In
units of ``10**-places / UNIT`` both ends of the interval are whole, so whether a candidate lies inside is
a comparison of two products. The candidates form a range, whose ends integer division gives. Numbers whose
products leave 38 digits are reported as such.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One unit of the last place is UNIT parts; a ratio of size s may be off by 4 * s parts: 8 * 2**-53 of it.
UNIT, FUZZ = 2**52, 4
WHOLE = "decimal(38,0)"
NUMBER = r"^\s*([+-]?)(\d*)\.?(\d*)(?:[eE]([+-]?\d{1,2}))?\s*$"


def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of named values, each computed once."""
    bound = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.transform(bound, body)[0]


def whole(value: int) -> Column:
    return F.lit(str(value)).cast(WHOLE)


def times(*factors: Column) -> Column:
    """Product in 38 digits, NULL beyond them."""
    out = factors[0].cast(WHOLE)
    for f in factors[1:]:
        out = F.try_multiply(out, f.cast(WHOLE)).try_cast(WHOLE)
    return out


def ten_to(power: Column) -> Column:
    return F.rpad(F.lit("1"), 1 + F.greatest(power, F.lit(0)), "0").try_cast(WHOLE)


def printed(text: Column) -> Column:
    """Struct of digits (signed whole number) and places of decimal text; NULL digits for other text."""
    part = lambda i: F.regexp_extract(text, NUMBER, i)
    digits = F.concat(part(1), part(2), part(3))
    return F.struct(
        F.when(text.rlike(NUMBER) & digits.rlike(r"\d"), digits.try_cast(WHOLE)).alias("digits"),
        (F.length(part(3)) - F.coalesce(part(4).try_cast("int"), F.lit(0))).alias("places"))


def ends(ratio: Column) -> dict[str, Column]:
    """The interval of a printed ratio in parts, and what one is worth: ``many`` parts make ``one``."""
    middle, slack = times(ratio["digits"], whole(UNIT)), times(F.abs(ratio["digits"]), whole(FUZZ)) + whole(UNIT // 2)
    return {"least": (middle - slack).try_cast(WHOLE), "most": (middle + slack).try_cast(WHOLE),
            "many": times(ten_to(ratio["places"]), whole(UNIT)), "one": ten_to(-ratio["places"])}


def down(top: Column, bottom: Column, cap: Column) -> Column:
    """floor(top / bottom) of non-negative numbers, ``cap`` at most. The division is made where it fits 64 bits."""
    return F.when(times(bottom, cap + 1) <= top, cap).otherwise(F.call_function("div", top, bottom))


def up(top: Column, bottom: Column, cap: Column) -> Column:
    """ceil(top / bottom) of non-negative numbers, ``cap`` + 1 at most."""
    floor = down(top, bottom, cap)
    return floor + F.when(times(floor, bottom) < top, 1).otherwise(0)


def outcome(refusal: Column, first: Column, last: Column) -> Column:
    """The result struct for a range of fitting numbers, or for the reason why there is none to look at."""
    fits = F.greatest(last - first + 1, F.lit(0)).cast("bigint")
    found = refusal.isNull() & (fits == 1)
    why = F.coalesce(refusal, F.when(fits.isNull(), "needs more than 38 digits").when(fits == 0, "nothing fits").when(fits == 1, "one fits").otherwise("more than one fits"))
    return F.struct(
        F.when(found, first.cast("bigint")).alias("value"), F.when(found, "inferred").otherwise("unavailable").alias("status"),
        F.when(refusal.isNull(), F.coalesce(fits, F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("candidates"), why.alias("reason"))


def infer_denominator(numerator: Column, printed_ratio: Column, low: Column, high: Column, scale: int = 1) -> Column:
    """The n in [low, high] for which ``scale * numerator / n`` prints as the ratio; both are decimal text.

    n fits when ``least * n <= scale * numerator <= most * n`` in parts.
    """
    given = {"n": printed(numerator.cast("string")), "r": printed(printed_ratio), "first": F.greatest(low.cast("bigint"), F.lit(1)), "last": high.cast("bigint"),
             "no_number": numerator.isNull(), "no_ratio": F.coalesce(F.trim(printed_ratio), F.lit("")) == ""}

    def measured(g: Column) -> Column:
        e = ends(g["r"])
        # both sides times 10**places of the numerator, so that it is whole as well
        unit = times(e["one"], ten_to(g["n"]["places"]))
        return let({"g": g, "top": times(g["n"]["digits"], whole(scale), e["many"], ten_to(-g["n"]["places"])),
                    "least": times(e["least"], unit), "most": times(e["most"], unit)}, solved)

    def solved(m: Column) -> Column:
        g, top = m["g"], m["top"]
        nothing = (m["most"] <= 0) & (top != 0) | (top < 0)
        first = F.when(nothing | ((top == 0) & (m["least"] > 0)) | ((top == 0) & (m["most"] < 0)), g["last"] + 1).when(top == 0, g["first"]).otherwise(
            F.greatest(g["first"], up(top, m["most"], g["last"])))
        last = F.when((top > 0) & (m["least"] > 0), down(top, m["least"], g["last"])).otherwise(g["last"])
        refusal = (F.when(g["no_ratio"], "no ratio printed").when(g["no_number"], "no numerator")
                   .when(g["r"]["digits"].isNull() | g["n"]["digits"].isNull(), "not a decimal number")
                   .when(g["last"].isNull() | (g["last"] < g["first"]), "no number to choose from")
                   .when(top.isNull() | m["least"].isNull() | m["most"].isNull(), "needs more than 38 digits"))
        return let({"refusal": refusal, "first": F.when(refusal.isNull(), first), "last": F.when(refusal.isNull(), last)},
                   lambda x: outcome(x["refusal"], x["first"], x["last"]))

    return let(given, measured)


def infer_numerator(printed_rate: Column, denominator: Column) -> Column:
    """The k in [0, denominator] for which ``100 * k / denominator`` prints as the rate.

    k fits when ``least * denominator <= 100 * k <= most * denominator`` in parts.
    """
    given = {"r": printed(printed_rate), "n": denominator.cast("bigint"), "no_rate": F.coalesce(F.trim(printed_rate), F.lit("")) == ""}

    def measured(g: Column) -> Column:
        e = ends(g["r"])
        return let({"g": g, "unit": times(e["many"], whole(100)), "least": times(e["least"], e["one"], g["n"]), "most": times(e["most"], e["one"], g["n"])}, solved)

    def solved(m: Column) -> Column:
        n = m["g"]["n"]
        refusal = (F.when(m["g"]["no_rate"], "no rate printed").when(n.isNull() | (n <= 0), "no positive denominator")
                   .when(m["g"]["r"]["digits"].isNull(), "not a decimal number")
                   .when(m["unit"].isNull() | m["least"].isNull() | m["most"].isNull(), "needs more than 38 digits"))
        first = F.when(m["least"] <= 0, F.lit(0).cast("bigint")).otherwise(up(m["least"], m["unit"], n))
        last = F.when(m["most"] < 0, F.lit(-1).cast("bigint")).otherwise(down(m["most"], m["unit"], n))
        return let({"refusal": refusal, "first": F.when(refusal.isNull(), first), "last": F.when(refusal.isNull(), last)},
                   lambda x: outcome(x["refusal"], x["first"], x["last"]))

    return let(given, measured)


def aov_denominator(gmv_text: Column, aov_text: Column, orders: Column) -> Column:
    """Orders with items, from exported order value and GMV."""
    return infer_denominator(gmv_text, aov_text, F.lit(1), orders)
