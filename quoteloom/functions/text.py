"""Text cleaning that follows Unicode rather than the space character alone."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[\\p{IsWhite_Space}\\x1c-\\x1f]"
# The characters of SPACE, for trimming without a pattern.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """``text`` without white space at either end."""
    return F.btrim(text, F.lit(SPACES))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; blank is null."""
    return F.nullif(F.btrim(F.regexp_replace(text, f"{SPACE}+", " ")), F.lit(""))


def ascii_upper(text: Column) -> Column:
    """a-z as A-Z; every other letter stays."""
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def lookup(key: Column, values: dict[str, str]) -> Column:
    """The value of ``key``, or null."""
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once for all its uses: expressions of arrays' elements share nothing."""
    return F.transform(F.array(value), use)[0]


def whole_json(text: Column) -> Column:
    """``text`` as a variant if all of it is one JSON value, else null. The parser itself stops behind
    the first value, so it is given the text as the first of two; the second is a hash of the text. Text that
    begins like no JSON value is not given to it at all: failing takes it longer than reading."""
    text = F.when(F.left(F.ltrim(text, F.lit(" \t\n\r")), F.lit(1)).isin(*'{["-0123456789tfn'), text)
    end = F.xxhash64(text)
    both = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), end.cast("string"), F.lit("]"))), "$", "array<variant>")
    return F.when((F.size(both) == 2) & (F.try_variant_get(both[1], "$", "long") == end), both[0])
