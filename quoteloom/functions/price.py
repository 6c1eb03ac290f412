"""Price text to an exact amount and currency, or a reason for neither."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.functions.text import SPACES, ascii_upper, strip

AMOUNT = "decimal(38,10)"

# The currencies that price text may name.
CODES = ["USD", "EUR", "GBP", "JPY", "CAD", "AUD", "CHF", "CNY", "INR", "MXN", "BRL", "SEK", "NOK", "DKK", "NZD", "SGD", "HKD", "KRW", "ZAR"]
SYMBOLS = "$€£¥"
# Words that make a price a range, an instalment or a discount.
MARKERS = ["from ", "as low as", "starting at", "save", "you save", "% off", "off%", "/mo", "/yr", "/wk", "per month", "per year", "per week", "a month", "a year", " to "]

# one amount: digits, or groups of three behind commas, and a fraction
AMOUNTS = "^([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\\.[0-9]+)?$"
NUMBERS = "[0-9]+(\\.[0-9]+)?"  # once commas are gone


def _of_symbol(symbol: Column) -> Column:
    """A dollar or yen sign names no one currency."""
    return F.when(symbol == "€", "EUR").when(symbol == "£", "GBP")


def _sign(char: Column) -> Column:
    return F.when(char.isin(*SYMBOLS), char)


def _code(letters: Column, gap: Column) -> Column:
    """A currency code that a blank sets apart from the amount."""
    code = ascii_upper(letters)
    return F.when(code.isin(*CODES) & gap.isin(*SPACES), code)


def with_price(rows: DataFrame, text: str, name: str = "_price") -> DataFrame:
    """Adds a struct ``name`` of amount, currency (that the text itself names) and issue.

    One decoration (a sign, or a code and a blank) is taken off either end; what is left must be an
    amount. A price that is decorated at both ends is unclear.
    """
    # each step is a column of its own (not a field of one), so that it is computed once
    bare, rest, decorations = F.col("_bare"), F.col("_rest"), ("_sign_1", "_code_1", "_sign_2", "_code_2")
    sign_1, code_1, sign_2, code_2 = map(F.col, decorations)
    rows = rows.withColumn("_bare", strip(F.col(text)))
    rows = rows.withColumn("_plain", F.coalesce(bare.rlike(AMOUNTS), F.lit(False)))
    dressed = lambda value: F.when(~F.col("_plain"), value)  # noqa: E731  # an amount alone wears nothing
    rows = rows.withColumns({"_sign_1": dressed(_sign(F.left(bare, F.lit(1)))), "_code_1": dressed(_code(F.left(bare, F.lit(3)), F.substring(bare, 4, 1)))})
    rows = rows.withColumn("_rest", F.substring(bare, F.when(sign_1.isNotNull(), 2).when(code_1.isNotNull(), 4).otherwise(1), F.length(bare)))
    rows = rows.withColumns({"_sign_2": dressed(_sign(F.right(rest, F.lit(1)))), "_code_2": dressed(_code(F.right(rest, F.lit(3)), F.left(F.right(rest, F.lit(4)), F.lit(1))))})
    cut = F.length(rest) - F.when(sign_2.isNotNull(), 1).when(code_2.isNotNull(), 3).otherwise(0)
    rows = rows.withColumn("_core", F.btrim(F.left(rest, cut), F.lit(SPACES)))
    rows = rows.withColumn("_amount", F.col("_plain") | F.coalesce(F.col("_core").rlike(AMOUNTS), F.lit(False)))
    both = F.col("_amount") & (sign_1.isNotNull() | code_1.isNotNull()) & (sign_2.isNotNull() | code_2.isNotNull())
    rows = rows.withColumn("_both", both).withColumn("_clean", F.col("_amount") & ~F.col("_both"))
    marked = reduce(or_, (F.contains(F.lower(bare), F.lit(m)) for m in MARKERS))  # a pattern tries them all at every place
    unclear = F.col("_both") | marked | (F.regexp_count(F.translate(bare, ",", ""), F.lit(NUMBERS)) >= 2)
    issue = F.when(F.col(text).isNull() | F.col("_clean"), None).when(unclear, "AMBIGUOUS_PRICE").otherwise("INVALID_PRICE")
    named = F.coalesce(code_1, code_2, _of_symbol(sign_1), _of_symbol(sign_2))
    value = F.replace(F.col("_core"), F.lit(","), F.lit("")).try_cast(AMOUNT)
    found = F.struct(F.when(F.col("_clean"), value).alias("amount"), F.when(F.col("_clean"), named).alias("currency"), issue.alias("issue"))
    return rows.withColumn(name, found).drop("_bare", "_plain", "_rest", "_core", "_amount", "_clean", "_both", *decorations)


def currency(text: Column) -> Column:
    """Code that a currency field names, or null."""
    bare = strip(text)
    return F.when(bare.isin("€", "£"), _of_symbol(bare)).when(F.upper(bare).isin(*CODES), F.upper(bare))


def reconciled(stated: Column, embedded: Column) -> Column:
    """The one currency both sources allow; null if they differ."""
    return F.when(stated.isNotNull() & embedded.isNotNull() & (stated != embedded), None).otherwise(F.coalesce(stated, embedded))
