"""Array and text expressions whose cost stays near linear on long values.

A fold copies its state at every element, so a state that gathers an array or a text costs the square of its length.
The expressions here keep such states to single numbers.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64
_CHARS = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element the combination of those before it, ``zero`` for the first; null for null.

    ``combine`` is associative, such as a sum or a maximum. Blocks of 64 are combined first, then what lies before each
    block, then before each element in its block: about 33 n + (n / 64)^2 / 2 steps.
    """

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, combine)

    def inside(block: Column, lead: Column) -> Column:
        return F.transform(block, lambda _, i: combine(lead, total(F.slice(block, 1, i))))

    def all_blocks(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)))

        def with_totals(x: Column) -> Column:
            leads = F.transform(x["totals"], lambda _, i: total(F.slice(x["totals"], 1, i)))
            return F.flatten(F.zip_with(x["blocks"], leads, inside))

        both = let(blocks, lambda b: F.struct(b.alias("blocks"), F.transform(b, total).alias("totals")))
        return let(both, with_totals)

    return let(values, lambda v: F.when(F.size(v) > 0, all_blocks(v)).otherwise(v))


def sums_before(values: Column) -> Column:
    """For each integer of an array the sum of those before it."""
    return before(values, F.lit(0), lambda a, b: a + b)


def text_blocks(text: Column) -> Column:
    """The text cut every 4096 characters, for :func:`part_of`."""
    return F.when(F.length(text) <= _CHARS, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHARS}}}"), F.lit(0))
    )


def part_of(blocks: Column, start: Column, length: Column) -> Column:
    """``length`` characters from position ``start`` (0 for the first) of a text given as :func:`text_blocks`.

    Cutting a text itself counts characters from its first; here only those of a block or two.
    """
    first, last = F.floor(start / _CHARS).cast("int"), F.floor((start + length) / _CHARS).cast("int")
    near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.substring(near, start - first * _CHARS + 1, length)


def furthest(sums: Column, start: Column, most: Column, powers: Column) -> Column:
    """The last position, from ``start`` on, whose value in the ascending array ``sums`` is at most ``most``, or ``start``.

    A binary search; ``powers`` are :func:`falling_powers` of the array's size, made once for all searches.
    """
    size = F.size(sums)

    def step(at: Column, p: Column) -> Column:
        return F.when((at + p < size) & (F.get(sums, at + p) <= most), at + p).otherwise(at)

    return F.aggregate(powers, start, step)


def falling_powers(size: Column) -> Column:
    """Powers of two below ``size``, the greatest first."""
    return F.transform(F.sequence(F.floor(F.log2(F.greatest(size, F.lit(2)))).cast("int"), F.lit(0), F.lit(-1)), lambda e: F.pow(F.lit(2), e).cast("int"))


def first_from(values: Column, size: Column) -> Column:
    """For each place, and one behind the last, the first place from there on whose flag is true; ``size`` if none is."""
    places = F.concat(F.transform(values, lambda v, i: F.when(v, i).otherwise(size)), F.array(size))

    def backward(r: Column) -> Column:
        return F.reverse(F.zip_with(before(r, size, lambda a, b: F.least(a, b)), r, lambda a, b: F.least(a, b)))

    return let(F.reverse(places), backward)


def chain(following: Column) -> Column:
    """The places 0, following[0], following[following[0]] ... before the array's end, in order; empty for an empty array.

    Each value is greater than its place. Steps of one, two, four ... places are taken at once, so an array of n values
    costs n log n, however many places there are.
    """

    def walk(f: Column) -> Column:
        size = F.size(f)
        none = F.struct(f.alias("jump"), F.array(F.lit(0)).alias("seen"))

        def double(state: Column, _: Column) -> Column:
            ahead = F.filter(F.transform(state["seen"], lambda p: F.get(state["jump"], p)), lambda q: q < size)
            jump = F.transform(state["jump"], lambda p: F.coalesce(F.get(state["jump"], p), size))
            return F.struct(jump.alias("jump"), F.concat(state["seen"], ahead).alias("seen"))

        rounds = F.sequence(F.lit(0), F.floor(F.log2(size)).cast("int"))
        return F.when(size > 0, F.aggregate(rounds, none, double)["seen"]).otherwise(F.array().cast("array<int>"))

    return let(following, walk)


def greedy_starts(sizes: Column, budget: Column) -> Column:
    """Where the groups of an ordered greedy packing begin: a group ends before the element that would exceed ``budget``.

    An element over the budget is a group of its own. ``sizes`` are whole numbers, none negative.
    """

    def following(s: Column) -> Column:
        n = F.size(s)

        def pointers(x: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), n - 1),
                lambda i: F.greatest(i + 1, furthest(x["sums"], i, F.get(x["sums"], i) + budget, x["powers"])),
            )

        both = F.struct(sums_before(F.concat(s, F.array(F.lit(0)))).alias("sums"), falling_powers(n + 1).alias("powers"))
        return F.when(n > 0, let(both, pointers)).otherwise(F.array().cast("array<int>"))

    return chain(let(sizes, following))
