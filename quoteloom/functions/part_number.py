"""Part-number keys and how two part numbers relate."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoteloom.functions.text import ascii_upper, strip

SEPARATORS = "-_/."
BLANKS = " \t\n\x0b\x0c\r"


def key(text: Column) -> Column:
    """Comparison key: stripped, a-z in capitals, inner ASCII white space as one hyphen; text of
    separators only has the empty key. Everything else stays."""
    bare = strip(text)
    joined = F.when(F.translate(bare, BLANKS, "") == bare, bare).otherwise(F.regexp_replace(bare, f"[{BLANKS}]+", "-"))
    return F.when(F.btrim(bare, F.lit(BLANKS + SEPARATORS)) == "", "").otherwise(ascii_upper(joined))


def compare(requested: Column, candidate: Column) -> Column:
    """EXACT, NORMALIZED_EXACT or UNKNOWN."""
    one, two = key(requested), key(candidate)
    found = F.when((one == "") | (two == ""), "UNKNOWN").when(strip(requested) == strip(candidate), "EXACT").when(one == two, "NORMALIZED_EXACT")
    return F.when(requested.isNull() | candidate.isNull(), "UNKNOWN").otherwise(found.otherwise("UNKNOWN"))


def partial(one: Column, two: Column) -> Column:
    """Whether the shorter key starts the longer one and ends there at a separator."""
    short = F.when(F.length(one) < F.length(two), one).otherwise(two)
    long = F.when(F.length(one) < F.length(two), two).otherwise(one)
    joint = long.substr(F.length(short) + 1, F.lit(1))
    return F.coalesce((one != "") & (two != "") & (F.length(one) != F.length(two)) & F.startswith(long, short) & joint.isin(*SEPARATORS), F.lit(False))


def without_label(text: Column) -> Column:
    """Text of a part-number field without a leading ``mpn:``."""
    bare = strip(text)
    return F.when(F.lower(F.left(bare, F.lit(4))) == "mpn:", strip(F.substring(bare, 5, 2**31 - 1))).otherwise(bare)


def in_title(title: Column, mpn: Column) -> Column:
    """Whether the part number stands in the title as a token of its own."""
    quoted = F.concat(F.lit("(?<![A-Za-z0-9])\\Q"), F.replace(mpn, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![A-Za-z0-9])"))
    # the pattern is built only for titles that hold the part number at all
    return F.coalesce(F.when((mpn != "") & F.contains(title, mpn), F.regexp_like(title, quoted)), F.lit(False))


def outline(text: Column) -> dict[str, Column]:
    """What ``near_miss`` looks at first, to be made once for a part number that meets many others: its
    length and a hash of each half."""
    half = F.floor(F.length(text) / 2).cast("int")
    return {"length": F.length(text), "head": F.hash(F.left(text, half)), "tail": F.hash(F.substr(text, half + 1))}


def near_miss(one: Column, two: Column, *outlines: dict[str, Column]) -> Column:
    """TRUNCATION (one starts the other), SUBSTITUTION (one character differs), or null. With ``outlines`` of
    both, made before, only texts that share a half are compared for a substitution, in generated code."""
    if outlines:
        o, t = outlines
        unequal = o["length"] != t["length"]
        # at one length a single edit can only be a substitution
        single = ((o["head"] == t["head"]) | (o["tail"] == t["tail"])) & (o["length"] == t["length"]) & (F.levenshtein(one, two, 1) == 1)
    else:
        unequal = F.length(one) != F.length(two)
        differing = F.aggregate(F.zip_with(F.split(one, ""), F.split(two, ""), lambda a, b: F.when(a == b, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
        single = (F.length(one) == F.length(two)) & (differing == 1)
    shorter = unequal & (F.startswith(one, two) | F.startswith(two, one)) & (one != "") & (two != "")
    return F.when(shorter, "TRUNCATION").when(single, "SUBSTITUTION")


def alias_base(mpn: Column) -> Column:
    """Part number without its final packaging letter R or T."""
    return F.regexp_replace(mpn, "[RT]$", "")


def alias_family(mpn: Column) -> Column:
    base = alias_base(mpn)
    return F.array(base, F.concat(base, F.lit("R")), F.concat(base, F.lit("T")))
