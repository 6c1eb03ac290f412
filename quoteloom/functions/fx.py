"""Exchange-rate arithmetic and calendar rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F

NARROW, RATE = "decimal(18,4)", "decimal(12,6)"
USD_SCALE = 4


def usd_equivalent(amount: Column, currency: Column, base: Column, rate: Column, usd_rate: Column) -> Column:
    """Struct of usd, available and reason.

    Dollars pass through; the base currency is multiplied by the dollar rate; others go through
    the base. The amount is narrowed so that the quotient keeps its digits; one that does not fit
    (over four decimals, or too large) is unavailable rather than rounded twice.
    """
    narrow = amount.try_cast(NARROW)
    fits = narrow.isNotNull() & (narrow == amount)
    direct = narrow * usd_rate.cast(RATE)
    value = F.when(currency == "USD", narrow.cast("decimal(38,11)")).when(currency == base, direct.cast("decimal(38,11)")).otherwise((direct / rate.cast(RATE)).cast("decimal(38,11)"))
    reason = F.when(amount.isNull() | currency.isNull(), "NO_AMOUNT").when(~fits, "AMOUNT_SCALE").when(currency == "USD", None).when(base.isNull(), "NO_SNAPSHOT").when(usd_rate.isNull(), "NO_USD_RATE").when((currency != base) & rate.isNull(), "NO_CURRENCY_RATE")
    return F.struct(F.when(reason.isNull(), F.round(value, USD_SCALE).cast("decimal(38,4)")).alias("usd"), reason.isNull().alias("available"), reason.alias("reason"))


def only_weekend(first: Column, last: Column) -> Column:
    """Whether every calendar day from ``first`` to ``last`` is a Saturday or Sunday, so that no
    rates can have been published between."""
    return (last >= first) & F.forall(F.sequence(first, last), lambda d: F.weekday(d) >= 5)


def json_text(text: Column) -> Column:
    """``text`` as a JSON string in ASCII."""
    quoted = F.regexp_extract(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("t"))), '(?s)^\\{"t":(.*)\\}$', 1)

    def ascii_only(c: Column) -> Column:
        code, high = F.ascii(c), F.ascii(c) - 0x10000
        unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
        pair = F.concat(unit(F.lit(0xD800) + F.floor(high / 1024)), unit(F.lit(0xDC00) + high % 1024))
        return F.when(code < 128, c).when(code < 0x10000, unit(code)).otherwise(pair)

    return F.when(quoted.rlike("^[\\x00-\\x7f]*$"), quoted).otherwise(F.array_join(F.transform(F.split(quoted, ""), ascii_only), ""))


def document_digest(provider: Column, base: Column, observed_on: Column, rates: Column) -> Column:
    """SHA-256 of a rate document's canonical JSON: base, day, provider and the (code, rate text) pairs
    (an array of such structs) in the order of codes, those of one code as they came. When it was fetched
    is no part of it."""
    pairs = F.transform(rates, lambda r: F.struct(F.upper(F.trim(r["currency_code"])).alias("code"), r["rate_text"].alias("rate")))
    by_code = lambda a, b: F.when(a["code"] < b["code"], -1).when(a["code"] > b["code"], 1).otherwise(0)
    listed = F.array_join(F.transform(F.array_sort(pairs, by_code), lambda r: F.concat(F.lit("["), json_text(r["code"]), F.lit(","), json_text(r["rate"]), F.lit("]"))), ",")
    parts = ['{"base_currency":', json_text(F.upper(F.trim(base))), ',"observation_date":', json_text(F.date_format(observed_on, "yyyy-MM-dd")), ',"provider_id":', json_text(F.trim(provider)), ',"rates":[', listed, "]}"]
    return F.sha2(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)), 256)
