"""Display text of quote rows."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currencies shown with a sign.
SIGNS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "CAD": "C$", "AUD": "A$", "CNY": "¥"}


def with_commas(number: Column) -> Column:
    """A decimal's own text (its scale kept) with the integer part grouped by three."""
    whole = F.substring_index(number, ".", 1)
    rest = F.substring(number, F.length(whole) + 1, F.length(number))
    return F.concat(F.when(F.length(whole) <= 3, whole).otherwise(F.regexp_replace(whole, "(?<=\\d)(?=(\\d{3})+$)", ",")), rest)


def price_text(number: Column, currency: Column) -> Column:
    sign = F.lit(None).cast("string")
    for code, mark in SIGNS.items():
        sign = F.when(F.upper(currency) == code, mark).otherwise(sign)
    return F.when(sign.isNotNull(), F.concat(sign, with_commas(number), F.lit(" "), currency)).otherwise(F.concat(currency, F.lit(" "), with_commas(number)))


def source_label(url: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("")), F.lit("Unknown Source"))


def notes(one: Column, two: Column) -> Column:
    return F.nullif(F.concat_ws("; ", F.nullif(one, F.lit("")), F.nullif(two, F.lit(""))), F.lit(""))


def safe_link(url: Column) -> Column:
    """Whether a link may be shown: absolute http or https."""
    return F.coalesce(url.rlike("(?i)^https?://[^/?#\\s]+"), F.lit(False))


def fetchable(url: Column) -> Column:
    """Absolute http(s) address with a host and without credentials."""
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(url.rlike("(?i)^https?://") & host.isNotNull() & (host != "") & F.try_parse_url(url, F.lit("USERINFO")).isNull(), F.lit(False))


def same_origin(one: Column, two: Column) -> Column:
    """Equal scheme, host and port, default ports filled in."""

    def origin(url: Column) -> Column:
        scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
        port = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:(\\d+)(?:[/?#]|$)", 1)
        filled = F.when(port != "", port).when(scheme == "https", "443").when(scheme == "http", "80")
        return F.concat_ws("|", scheme, F.lower(F.try_parse_url(url, F.lit("HOST"))), filled)

    return F.coalesce(origin(one) == origin(two), F.lit(False))


def public_ipv4(address: Column) -> Column:
    """Whether a dotted IPv4 address is publicly routable; null for other text."""
    parts = F.transform(F.split(address, "\\."), lambda x: x.try_cast("int"))
    a, b, c = parts[0], parts[1], parts[2]
    closed = (a.isin(0, 10, 127)) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    closed = closed | ((a == 100) & b.between(64, 127)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    good = address.rlike("^\\d{1,3}(\\.\\d{1,3}){3}$") & F.forall(parts, lambda x: x.between(0, 255))
    return F.when(good, ~closed)


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _with_groups(address: Column, then) -> Column:
    """``then`` of the eight numbers of an IPv6 address, or null for other text."""
    last = F.regexp_extract(address, "[0-9.]+$", 0)
    number = lambda k: F.split(last, "\\.")[k].try_cast("int")
    good = last.rlike("^(\\d|[1-9]\\d|1\\d\\d|2[0-4]\\d|25[0-5])(\\.(\\d|[1-9]\\d|1\\d\\d|2[0-4]\\d|25[0-5])){3}$")
    four = F.concat(F.lower(F.hex(number(0) * 256 + number(1))), F.lit(":"), F.lower(F.hex(number(2) * 256 + number(3))))
    text = F.when(~F.contains(last, F.lit(".")), address).when(good, F.concat(F.left(address, F.length(address) - F.length(last)), four))
    listed = lambda half: F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))

    def filled(halves: Column) -> Column:
        front, back = listed(halves[0]), F.coalesce(listed(F.try_element_at(halves, F.lit(2))), F.array().cast("array<string>"))
        missing = 8 - F.size(front) - F.size(back)
        zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
        return F.when(F.size(halves) == 1, front).when((F.size(halves) == 2) & (missing >= 1), F.concat(front, zeros, back))

    fine = lambda whole: F.when((F.size(whole) == 8) & F.forall(whole, lambda x: x.rlike("^[0-9A-Fa-f]{1,4}$")), F.transform(whole, lambda x: F.conv(x, 16, 10).cast("int")))
    return _let(F.split(text, "::", -1), lambda halves: _let(filled(halves), lambda whole: _let(fine(whole), then)))


def site_local(address: Column) -> Column:
    """Whether an IPv6 address is in fec0::/10, which was for sites' own use and is allocated to nobody."""
    return F.coalesce(address.rlike("(?i)^fe[c-f][0-9a-f]:"), F.lit(False))


def public_address(address: Column) -> Column:
    """Whether an address, IPv4 or IPv6, is publicly routable; null for other text.

    An IPv6 address that is another notation of an IPv4 one (mapped, 6to4) is what that one is. Of the rest
    2000::/3 is routable but for what is set aside in it, and so is fec0::/10, which no list of the special
    ones names any more.
    """

    def public6(g: Column) -> Column:
        zero = lambda a, b: F.forall(F.slice(g, a + 1, b - a), lambda x: x == 0)
        mapped, wrapped = zero(0, 5) & (g[5] == 0xFFFF), g[0] == 0x2002
        one, two = F.when(mapped, g[6]).when(wrapped, g[1]), F.when(mapped, g[7]).when(wrapped, g[2])
        four = F.concat_ws(".", F.shiftright(one, 8), one % 256, F.shiftright(two, 8), two % 256)
        service = (g[1] == 3) | g[1].between(0x20, 0x3F) | ((g[1] == 4) & (g[2] == 0x112)) | ((g[1] == 1) & zero(2, 7) & g[7].isin(1, 2))
        aside = ((g[0] == 0x2001) & ((g[1] == 0xDB8) | ((g[1] < 0x200) & ~service))) | ((g[0] == 0x3FFF) & (g[1] < 0x1000))
        native = (g[0].between(0x2000, 0x3FFF) & ~aside) | g[0].between(0xFEC0, 0xFEFF)
        return F.when(g.isNotNull(), F.when(mapped | wrapped, _let(four, public_ipv4)).otherwise(native))

    return F.when(F.contains(address, F.lit(":")), _with_groups(address, public6)).otherwise(public_ipv4(address))
