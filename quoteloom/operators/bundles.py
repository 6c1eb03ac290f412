"""What a published text says a bundle holds, and whether two bundles are the same.

A text gives a clause, a list of what is in the box, and a state of it: ABSENT (a bundle without contents,
or a count alone), PARTIAL (cut off, or said to be incomplete), SYNTACTICALLY_VALID (reads as a whole), or
ESTABLISHED (a statement that the list is complete ends it). Two clauses agree if they are the same text
or the same multiset of counted things; they differ for certain only if both can be read to the last
character. All of it is columns; a clause is split once, and its entries are read side by side.
"""

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.functions.text import SPACE, collapsed, once, strip
from quoteloom.operators import authority

# Words that a list is not complete, and statements that it is.
OPEN_WORDS, OPEN_RUNS, OPEN_MARKS = ("etc",), ("and more", "+ more", "and so on", "among others", "and other"), ("…", "...")
STATEMENTS = ("complete list", "all items listed", "everything included", "all included", "full contents", "nothing else included")
PUNCTUATION = ",;:()[]\"'.!?"
MOST_UNITS = 99_999
# The versions of the rules, oldest first.
CONTRACTS = {"SEMANTIC_AUTHORITY_V2_S2A_FU2": "no unit", "SEMANTIC_AUTHORITY_V2_S2A_FU3": "counted", "SEMANTIC_AUTHORITY_V2_S2A_FU4": "composed"}

_UNITS = "[1-9][0-9]{0,4}"
_HEAD = f"(?i)^(bundle({SPACE}+of{SPACE}+{_UNITS})?|{_UNITS}{SPACE}*[- ]{SPACE}*unit{SPACE}+bundle)"
_ENDING = "(?i)([,;][ \\t]+|(?<![\\p{L}\\p{N}])[+&(—–][ \\t]*|(?<![\\p{L}\\p{N}])and[ \\t]+)(" + "|".join(STATEMENTS) + ")[ \\t]*$"
CLAUSE = "struct<clause:string,state:string,statement:string>"
ITEMS = "array<struct<quantity:int,item:string>>"


def _is_open(clause: Column) -> Column:
    """Whether a clause says that it leaves something out."""
    words = F.transform(F.split(collapsed(clause), " "), lambda w: F.btrim(F.lower(w), F.lit(PUNCTUATION)))
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    marked = F.lit(False)
    for mark in OPEN_MARKS:
        marked = marked | F.contains(clause, F.lit(mark))
    said = lambda text: functools.reduce(operator.or_, (F.contains(text, F.lit(f" {run} ")) for run in (*OPEN_WORDS, *OPEN_RUNS)))
    return marked | once(line, said)


def _dangles(clause: Column) -> Column:
    """Whether a clause ends at a separator, or at a count of nothing."""
    return F.right(strip(clause), F.lit(1)).isin("+", ",", "&", ";") | strip(clause).rlike(f"[0-9]{SPACE}*[x×]$")


def _reads(clause: Column) -> Column:
    return F.coalesce((strip(clause) != "") & ~_is_open(clause) & ~_dangles(clause), F.lit(False))


def composition(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: clause, state and statement (of completeness, as published) of a column."""
    bare = strip(F.col(text))
    rows = rows.withColumns({"_bare": bare, "_head": F.regexp_extract(bare, _HEAD, 0)})
    rest = strip(F.substr("_bare", F.length("_head") + 1))
    mark = F.left(rest, F.lit(1))
    headed, marked = F.col("_head") != "", mark.isin(":", "(")
    after = F.substr(rest, F.lit(2))
    boxed = headed & (mark == "(")
    closed = ~boxed | after.endswith(")")
    inner = F.when(boxed & closed, F.left(after, F.length(after) - 1)).otherwise(after)
    clause = F.when(headed & marked, strip(inner)).when(headed & (rest == ""), None).otherwise(F.col("_bare"))
    rows = rows.withColumns({"_clause": F.nullif(clause, F.lit("")), "_closed": closed})
    rows = rows.withColumn("_statement", F.regexp_extract("_clause", _ENDING, 0))
    stated = F.col("_statement") != ""
    # the statement, and blanks before it, end the clause
    list_ = F.rtrim(F.left(F.col("_clause"), F.length("_clause") - F.length("_statement")))
    rows = rows.withColumns({"_list": F.when(stated, list_), "_whole": F.col("_closed") & _reads(F.col("_clause"))})
    alone = F.lower(F.col("_clause")).isin(*STATEMENTS)
    proven = stated & _reads(F.col("_list"))
    state = F.when(F.col("_clause").isNull(), "ABSENT").when(~F.col("_whole"), "PARTIAL").when(alone, "ABSENT").when(proven, "ESTABLISHED").when(stated, "PARTIAL").otherwise("SYNTACTICALLY_VALID")
    rows = rows.withColumn("_state", state)
    clause = F.when(F.col("_state") == "ESTABLISHED", F.col("_list")).when(F.col("_state") != "ABSENT", F.col("_clause"))
    found = F.struct(clause.alias("clause"), F.col("_state").alias("state"), F.when(F.col("_state") == "ESTABLISHED", F.rtrim("_statement")).alias("statement"))
    return rows.withColumn(name, found).drop("_bare", "_head", "_clause", "_closed", "_statement", "_list", "_whole", "_state")


def united(compositions: Column) -> Column:
    """One composition of several texts of a listing (an array of them, the leading text first).

    Different clauses contradict each other, but one beside a text without contents is only a part; of equal
    ones a cut-off one makes all a part, and a statement in any of them establishes them.
    """
    first = compositions[0]
    clauses = F.array_distinct(F.transform(compositions, lambda c: c["clause"]))
    some = F.filter(compositions, lambda c: c["state"] == "ESTABLISHED")
    one = F.when(F.exists(compositions, lambda c: c["state"] == "PARTIAL"), "PARTIAL").when(F.size(some) > 0, "ESTABLISHED").otherwise(first["state"])
    several = F.when(~F.exists(clauses, lambda c: c.isNull()), "CONTRADICTED_PUBLISHED").when(first["clause"].isNull(), "ABSENT").otherwise("PARTIAL")
    state = F.when(F.size(clauses) > 1, several).otherwise(one)
    statement = F.when(state == "ESTABLISHED", F.coalesce(first["statement"], some[0]["statement"]))
    return F.when(F.size(compositions) > 0, F.struct(first["clause"].alias("clause"), state.alias("state"), statement.alias("statement")))


def _entry(read: Column) -> Column:
    """The quantity and the thing of one entry (digits of its count, if it has one, and thing); a null thing where it cannot be read."""
    digits, thing = read["digits"], read["thing"]
    plain = (F.translate(F.lower(thing), "abcdefghijklmnopqrstuvwxyz0123456789 .-_", "") == "") & (F.btrim(thing, F.lit(" .-_")) == thing) & (thing != "")
    number = F.when(digits != "", digits.try_cast("int")).otherwise(1)
    fine = plain & ((digits == "") | (~digits.startswith("0") & (number <= MOST_UNITS)))
    return F.struct(number.alias("quantity"), F.when(fine, F.regexp_replace(F.lower(thing), " {2,}", " ")).alias("item"))


def items(clause: Column) -> Column:
    """The sorted multiset of (quantity, item) that a clause lists, or null if any of it cannot be read.

    Each step is a pass over the entries, so that what the next one uses several times is worked out once."""
    parts = F.split(strip(clause), f"(?i){SPACE}*([+,&]|\\band\\b){SPACE}*")
    counted = F.transform(parts, lambda p: F.struct(p.alias("part"), F.regexp_extract(p, "^([0-9]+)[x× \t]", 1).alias("digits")))
    # behind the digits stands one mark or blank, then perhaps more blanks
    thing = lambda e: F.when(e["digits"] == "", e["part"]).otherwise(F.ltrim(F.substr(e["part"], F.length(e["digits"]) + 2), F.lit(" \t")))
    read = F.transform(counted, lambda e: F.struct(e["digits"].alias("digits"), thing(e).alias("thing")))
    return once(F.transform(read, _entry), lambda es: F.when(F.forall(es, lambda e: e["item"].isNotNull()), F.sort_array(es))).cast(ITEMS)


def relation(rows: DataFrame, one: str, two: str, name: str) -> DataFrame:
    """Adds ``name``: AGREE, DIFFERENT, or UNESTABLISHED where texts differ that cannot both be read."""
    rows = rows.withColumns({"_listed_one": items(F.col(one)), "_listed_two": items(F.col(two))})
    both = F.col("_listed_one").isNotNull() & F.col("_listed_two").isNotNull()
    found = F.when(F.col(one) == F.col(two), "AGREE").when(both & (F.col("_listed_one") == F.col("_listed_two")), "AGREE").when(both, "DIFFERENT").otherwise("UNESTABLISHED")
    return rows.withColumn(name, F.when(F.col(one).isNotNull() & F.col(two).isNotNull(), found)).drop("_listed_one", "_listed_two")


def quantity_axis(candidate: Column, target: Column, attested: Column) -> Column:
    """How the published counts of two bundles stand to each other. ``attested``: the side (CANDIDATE,
    TARGET) whose missing count is attested not to matter; REFUSED where that is not the side without one."""
    missing = F.when(candidate.isNull() & target.isNotNull(), "CANDIDATE").when(candidate.isNotNull() & target.isNull(), "TARGET")
    told = F.when(missing.isNotNull(), F.when(attested.isNull(), "UNDETERMINED").otherwise("ATTESTED_NOT_MATERIAL"))
    told = told.when(candidate.isNull(), "BOTH_UNPUBLISHED").when(candidate == target, "CONSISTENT").otherwise("CONTRADICTED")
    return F.when(attested.isNotNull() & ~attested.eqNullSafe(missing), "REFUSED").otherwise(told)


def unit_authority(rows: DataFrame) -> DataFrame:
    """Adds relation, quantity_axis and unit_authority (PROVEN_EQUIVALENT, CONTRADICTED, UNPROVEN; REFUSED
    for inputs that cannot go together).

    Reads unit_kind, unit_quantity and composition of the candidate (a null kind is an unknown unit),
    target_kind (null: a single unit), target_quantity and target_composition, and attested_side. Only
    bundles have a composition or an attestation; other kinds go by kind and count.
    """
    c = F.col
    rows = rows.withColumns({"_one": c("composition.clause"), "_two": c("target_composition.clause")})
    rows = relation(rows, "_one", "_two", "relation")
    bundle, both = c("unit_kind").eqNullSafe(F.lit("BUNDLE")), c("target_kind").eqNullSafe(F.lit("BUNDLE"))
    rows = rows.withColumn("quantity_axis", F.when(bundle & both, quantity_axis(c("unit_quantity"), c("target_quantity"), c("attested_side"))))
    state, wanted = F.coalesce("composition.state", F.lit("ABSENT")), F.coalesce("target_composition.state", F.lit("ABSENT"))
    unread = state.isin("ABSENT", "PARTIAL", "CONTRADICTED_PUBLISHED") | wanted.isin("ABSENT", "PARTIAL")
    proven = (state == "ESTABLISHED") & (wanted == "ESTABLISHED")
    agree = c("relation") == "AGREE"
    composed = (
        F.when(c("quantity_axis") == "REFUSED", "REFUSED")
        .when(unread, "UNPROVEN")
        .when(agree & (c("quantity_axis") == "CONTRADICTED"), "CONTRADICTED")
        .when(proven & (c("relation") == "DIFFERENT"), "CONTRADICTED")
        .when(proven & agree & c("quantity_axis").isin("CONSISTENT", "BOTH_UNPUBLISHED", "ATTESTED_NOT_MATERIAL"), "PROVEN_EQUIVALENT")
        .otherwise("UNPROVEN")
    )
    foreign = ~bundle & (c("composition").isNotNull() | c("attested_side").isNotNull())
    counted = authority.sales_unit_authority(c("unit_kind"), c("unit_quantity"), c("target_kind"), c("target_quantity"))
    unit = F.when(foreign, "REFUSED").when(bundle & ~both, "CONTRADICTED").when(bundle, composed).otherwise(counted)
    return rows.withColumn("unit_authority", unit).drop("_one", "_two")


def contract_tier(rows: DataFrame) -> DataFrame:
    """Adds contract_tier: ``tier`` under the rules that ``contract`` names. The oldest know no sales unit,
    the next its kind and count, the newest (``unit_authority``) a bundle's composition too; REFUSED for an
    unknown version and for evidence that a version does not know."""
    c = F.col
    rules = F.try_element_at(F.create_map(*(F.lit(x) for pair in CONTRACTS.items() for x in pair)), c("contract"))
    counted = authority.sales_unit_authority(c("unit_kind"), c("unit_quantity"), c("target_kind"), c("target_quantity"))
    composed = c("composition").isNotNull() | c("target_composition").isNotNull() | c("attested_side").isNotNull()
    unit = c("unit_kind").isNotNull() | c("unit_quantity").isNotNull() | c("target_kind").isNotNull()
    tier = (
        F.when((rules == "no unit") & ~unit & ~composed, c("tier"))
        .when((rules == "counted") & ~composed, authority.with_sales_unit(c("tier"), counted))
        .when((rules == "composed") & (c("unit_authority") != "REFUSED"), authority.with_sales_unit(c("tier"), c("unit_authority")))
        .otherwise("REFUSED")
    )
    return rows.withColumn("contract_tier", tier)
