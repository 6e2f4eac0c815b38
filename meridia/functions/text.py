"""Names, labels and terms as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridia.functions.cal import col

# Titles that short names leave out.
TITLES = ("Kingdom of ", "Empire of ", "Republic of ", "Duchy of ", "Principality of ")
TRAILING = (" Empire", " Kingdom", " Republic")


def decode_term(term: Column | str) -> Column:
    """The value of an RDF term: an IRI's last part, a quoted literal without its quotes, or the text itself."""
    t = col(term)
    literal = F.regexp_extract(t, r'^"((?:[^"\\]|\\.)*)"(?:@[\w-]+|\^\^.+)?$', 1)
    hexes = F.regexp_extract_all(literal, F.lit(r"\\u([0-9A-Fa-f]{4})"), F.lit(1))
    decoded = F.aggregate(F.array_distinct(hexes), literal, lambda s, h: F.replace(s, F.concat(F.lit("\\u"), h), F.decode(F.unhex(h), "UTF-16BE")))
    plain = F.replace(F.replace(F.replace(F.replace(decoded, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit("\\\\"), F.lit("\\"))
    return F.when(t.startswith("<"), F.regexp_extract(t, r"([^/#>]*)>$", 1)).when(t.startswith('"'), plain).otherwise(t)


def item_number(text: Column | str) -> Column:
    """The number of an id like Q42, null for any other text."""
    return F.regexp_extract(col(text), r"^Q([1-9]\d*)$", 1).try_cast("long")


def point(text: Column | str) -> Column:
    """struct(lon, lat) of 'Point(lon lat)'; null off Earth or at exactly (0, 0)."""
    pattern = r"^Point\((-?[\d.]+) (-?[\d.]+)\)$"
    lon, lat = (F.regexp_extract(col(text), pattern, i).try_cast("double") for i in (1, 2))
    good = lon.between(-180, 180) & lat.between(-90, 90) & ~((lon == 0) & (lat == 0))
    return F.when(good, F.struct(lon.alias("lon"), lat.alias("lat")))


def split_list(text: Column | str, mark: str = ";") -> Column:
    """The trimmed, not empty parts of a list in a text."""
    return F.filter(F.transform(F.split(col(text), mark), lambda x: F.trim(x)), lambda x: x != "")


def relation(name: Column | str) -> Column:
    """struct(kind, of, to) of a name like 'Vassalage of X to Y'."""
    pattern = r"^(\w+) of (.+) to (.+)$"
    part = lambda i: F.regexp_extract(col(name), pattern, i)
    return F.when(col(name).rlike(pattern), F.struct(part(1).alias("kind"), part(2).alias("of"), part(3).alias("to")))


def composite(name: Column | str) -> Column:
    """Whether a name in parentheses stands for several members."""
    return col(name).startswith("(") & col(name).endswith(")")


def clean(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def decimals(x: Column | str, places: int) -> Column:
    """A number with so many decimals at most, without trailing zeros."""
    fixed = F.format_string(f"%.{places}f", F.bround(col(x).cast("double"), places))
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def display_name(label: Column | str) -> Column:
    """A label without a trailing parenthesis (unless nothing else is left), its first letter large, quotes curly."""
    t = clean(label)
    bare = F.trim(F.regexp_replace(t, r"\s*\([^()]*\)$", ""))
    t = F.when(bare == "", t).otherwise(bare)
    t = F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))
    return F.replace(F.regexp_replace(t, r'"([^"]*)"', "“$1”"), F.lit("'"), F.lit("’"))


def article_url(title: Column | str) -> Column:
    """The address of an article by its title; ()!*,:;@/ stay as they are."""
    quoted = F.url_encode(F.replace(col(title), F.lit(" "), F.lit("_")))
    for plain, code in (("(", "%28"), (")", "%29"), ("!", "%21"), (",", "%2C"), (":", "%3A"), (";", "%3B"), ("@", "%40"), ("/", "%2F")):
        quoted = F.replace(quoted, F.lit(code), F.lit(plain))
    return F.concat(F.lit("https://example.org/wiki/"), quoted)


def day_mentions(text: Column | str) -> Column:
    """'d Month' of the days a text mentions, in both word orders, distinct and sorted."""
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    first = F.transform(F.regexp_extract_all(col(text), F.lit(rf"\b(\d{{1,2}} (?:{months}))\b"), F.lit(1)), lambda x: x)
    other = F.regexp_extract_all(col(text), F.lit(rf"\b((?:{months}) \d{{1,2}})\b"), F.lit(1))
    turned = F.transform(other, lambda x: F.concat_ws(" ", F.element_at(F.split(x, " "), 2), F.element_at(F.split(x, " "), 1)))
    return F.array_sort(F.array_union(first, turned))


def short_name(name: Column | str) -> Column:
    """A name without parentheses, what follows a comma, its first matching title and a trailing word."""
    t = F.trim(F.regexp_replace(F.regexp_replace(clean(name), r"\s*\([^()]*\)", ""), r",.*$", ""))
    untitled = F.coalesce(*[F.when(t.startswith(x), F.substr(t, F.lit(len(x) + 1))) for x in TITLES], t)
    return F.coalesce(*[F.when(untitled.endswith(x), F.substr(untitled, F.lit(1), F.length(untitled) - len(x))) for x in TRAILING], untitled)


def spoken_join(parts: Column) -> Column:
    """'a', 'a and b', 'a, b and c'."""
    n = F.size(parts)
    head = F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, F.get(parts, 0)).otherwise(F.concat(head, F.lit(" and "), F.element_at(parts, -1)))
