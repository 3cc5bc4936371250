"""Normalisers and predicates over names, addresses, phones and addresses of pages, as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that mark a price of 0 as a discount instead of a gift.
DISCOUNT = r"(?i)\$|cents|%|off|discount|half|bogo|special|deal|price|happy\s*hour|2\s*for\s*1|2-4-1|one\s*free"
#: Source types that are families of their own, and the families of directory sites.
OWN_FAMILY = ("overture", "overpass", "human", "own_site", "social")
FAMILY_ALIASES = {
    "mthappyhour.com": "mthappyhour",
    "bozemanmagazine.com": "local_directory",
    "visit-bozeman.com": "local_directory",
    "menupix.com": "menupix",
    "yelp.com": "yelp",
    "sellout.io": "sellout",
    "google.com": "google",
    "facebook.com": "facebook",
}


@F.pandas_udf(StringType())
def _nfkd_ascii(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def ascii_fold(c: Column) -> Column:
    """Compatibility decomposition without what lies beyond ASCII, so that accents go and their letters stay. Spark has
    no function for it; texts of ASCII alone pass through as they are."""
    return _nfkd_ascii(c)


def norm_name(c: Column) -> Column:
    """Lower-case words of a name without leading articles, each article taken off in turn."""
    s = F.trim(F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z0-9]+", " "))
    for article in ("the ", "a ", "an "):
        s = F.regexp_replace(s, f"^{article}", "")
    return F.trim(s)


def norm_address(c: Column) -> Column:
    """Lower case, one kind of separator, no state or ZIP, units as #, no doubled words."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[,.-]+", " ")
    s = F.regexp_replace(s, r"\b(mt|montana)\b", " ")
    s = F.regexp_replace(s, r"\b\d{5}\b", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"\b(suite|unit|ste|apt)\b", "#"), r"#\s*", "#")
    s = F.regexp_replace(s, r"(?U)\b(\w+)\s+\1\b", "$1")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def street_number(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(\d+)", 1)


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def street_token(c: Column) -> Column:
    return F.regexp_extract(compact(c), r"^(\d+[a-z])", 1)


def host_of(url: Column) -> Column:
    """Lower-case host without port and one leading www.; empty for what isn't a URL."""
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.", "")


def is_aggregator(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether a page belongs to one of the hosts or to a part of one."""
    h = host_of(url)
    return F.exists(F.array(*[F.lit(x) for x in hosts]), lambda a: (h == a) | F.endswith(h, F.concat(F.lit("."), a)))


def phone_key(c: Column) -> Column:
    """The last ten digits; null below seven."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    return F.when(F.length(digits) >= 7, F.right(digits, F.lit(10)))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "venue").otherwise(s)


def names_match(a: Column, b: Column) -> Column:
    """Equal, or one holds the other, without any "the"."""
    x, y = (F.regexp_replace(F.regexp_replace(F.lower(ascii_fold(c)), r"\bthe ", ""), "[^a-z0-9]+", "") for c in (a, b))
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def price_label(price: Column, description: Column) -> Column:
    """"$4.50"; a dash for a discount without a price, FREE for none."""
    return F.when(price > 0, F.format_string("$%.2f", price.cast("double"))).when(F.coalesce(description, F.lit("")).rlike(DISCOUNT), "—").otherwise("FREE")


def source_family(url: Column, source_type: Column) -> Column:
    """The family whose members copy each other: a first-hand type itself, else that of the first directory named in the
    address, else the type."""
    low = F.lower(F.coalesce(url, F.lit("")))
    family = F.when(source_type.isin(*OWN_FAMILY), source_type)
    for host, name in FAMILY_ALIASES.items():
        family = family.when(F.contains(low, F.lit(host)), name)
    return family.otherwise(F.coalesce(F.nullif(source_type, F.lit("")), F.lit("unknown")))


def content_hash(c: Column) -> Column:
    """The first 16 hexadecimal digits of the text's SHA-256."""
    return F.left(F.sha2(F.coalesce(c, F.lit("")), 256), F.lit(16))


def escape_html(c: Column) -> Column:
    s = F.coalesce(c, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def place_label(address: Column) -> Column:
    """What stands before the first comma."""
    return F.trim(F.split_part(F.coalesce(address, F.lit("")), F.lit(","), F.lit(1)))


def maps_query(*parts: Column) -> Column:
    """The parts, percent-encoded for the query of a map's address; blanks as %20, slashes as they are."""
    return F.replace(F.replace(F.url_encode(F.concat_ws(" ", *parts)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def in_cities(address: Column, city: Column, cities: list[str]) -> Column:
    """Whether address or city names one of the cities; true for no cities. A number may stand for "four"."""
    low = F.lower(F.concat(F.coalesce(address, F.lit("")), F.lit(" "), F.coalesce(city, F.lit(""))))
    names = [c.strip().lower() for c in cities]
    names += [n.replace("four ", "4 ") for n in names if n == "four corners"]
    hit = F.lit(not cities)
    for n in names:
        hit = hit | F.contains(low, F.lit(n))
    return hit


def is_challenge(html: Column) -> Column:
    """Whether a page is a guard's, not the site's: by its title, its script, or a thin page that asks for scripts."""
    low = F.lower(F.coalesce(html, F.lit("")))
    title = low.rlike(r"<title[^>]*>\s*(?:just a moment|attention required)")
    thin = F.contains(low, F.lit("challenge-platform")) & (F.length(html) < 20_000) & ~low.rlike(r"happy\s*hour|daily\s+special|menu|hours")
    asks = F.contains(low, F.lit("enable javascript and cookies to continue")) & (F.length(html) < 15_000)
    return title | F.contains(low, F.lit("cf-browser-verification")) | thin | asks


def normalize_hours(c: Column) -> Column:
    """One spelling of hours: Daily, day ranges without spaces, am and pm in small letters, "-" between times."""
    h = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    days = "Mon|Tue|Wed|Thu|Fri|Sat|Sun"
    for pattern, new in (
        (r"(?i)\bevery\s*day\b", "Daily"),
        (rf"(?i)\b({days})\s*-\s*({days})\b", "$1-$2"),
        (r"(?i)\s*a\.?m\.?\b", "am"),
        (r"(?i)\s*p\.?m\.?\b", "pm"),
        (r"(?i)\s+to\s+", "-"),
        (r"\s*[–—]\s*", "-"),
        (r"(?i)(\d(?:am|pm)?)\s+-\s+(\d)", "$1-$2"),
        *((rf"(?i)\b{d}\b", d) for d in ("Daily", *days.split("|"))),
    ):
        h = F.regexp_replace(h, pattern, new)
    return h


WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
_FULL = ("mondays?", "tuesdays?", "wednesdays?", "thursdays?", "fridays?", "saturdays?", "sundays?")


def weekday_mentions(c: Column) -> Column:
    """Days 1 to 7 that a text names; a range names its two ends only."""
    text = F.lower(F.coalesce(c, F.lit("")))
    flags = F.array(*[F.when(text.rlike(rf"\b({d}|{f})\b"), F.lit(i)) for i, (d, f) in enumerate(zip(WEEKDAYS, _FULL), 1)])
    return F.filter(flags, lambda x: x.isNotNull())


def hash_string(c: Column) -> Column:
    """|h| of h = 31 h + code in 32 bits."""
    codes = F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("bigint"))
    low = F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, x: F.pmod(h * 31 + x, F.lit(2**32)))
    return F.abs(F.when(low >= 2**31, low - 2**32).otherwise(low))


def seeded_draw(seed: Column) -> Column:
    """The first number of the minimal standard generator, from 0 to below 1."""
    s = F.pmod(seed.cast("bigint"), F.lit(2**31 - 1))
    s = F.when(s <= 0, s + 2**31 - 2).otherwise(s)
    return (F.pmod(s * 16807, F.lit(2**31 - 1)) - 1) / F.lit(2147483646.0)


def freshness(days: Column, ttl: Column) -> Column:
    """1 until ``ttl`` days, then falling to 0 at twice that."""
    return F.when(days <= ttl, 1.0).when(days >= 2 * ttl, 0.0).otherwise(1.0 - (days - ttl) / ttl)


def applies_on(c: Column, day: Column) -> Column:
    """Whether a text names weekdays and ``day`` is one of them."""
    return F.array_contains(weekday_mentions(c), day)
