"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: A boundary of ASCII words; Java's own \b knows letters of other scripts.
BEFORE, AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity, as a long."""
    return F.floor(x + F.lit(0.5)).cast("long")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(1.0) - h, F.lit(0.0))))


def cell_id(lat: Column, lon: Column) -> Column:
    """The 1 by 1 degree cell of a place, as text."""
    return F.concat_ws(",", F.floor(lat), F.floor(lon))


def cell_centre(lat: Column, lon: Column) -> Column:
    """The middle of a place's cell."""
    return F.struct((F.floor(lat) + 0.5).alias("lat"), (F.floor(lon) + 0.5).alias("lon"))


def in_bbox(lat: Column, lon: Column, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> Column | None:
    """Whether a place is in the box, edges included; None where the box is invalid, which filters drop."""
    valid = -180 <= min_lon < max_lon <= 180 and -90 <= min_lat < max_lat <= 90
    return lat.between(min_lat, max_lat) & lon.between(min_lon, max_lon) if valid else None


def quoted(words: list[str]) -> str:
    """An alternation of literal words, for rlike."""
    special = set("\\.^$|?*+()[]{}")
    return "|".join("".join("\\" + c if c in special else c for c in w) for w in words)


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether any of the words is a substring of the text in lower case."""
    return F.lower(text).rlike(quoted(words)) if words else F.lit(False)


def region_relevant(title: Column, description: Column, words: list[str], chars: int | None = 500) -> Column:
    """Whether any of the words is in the first chars characters of title and description, or in all of them where chars is None."""
    both = F.concat_ws(" ", title, F.coalesce(description, F.lit("")))
    return contains_any(both if chars is None else F.substring(both, 1, chars), words)


def tokens(text: Column, min_length: int = 3) -> Column:
    """Words of letters, digits, _ ' and - in lower case, of min_length at least."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[A-Za-z0-9_'-]{{{min_length},}}"), F.lit(0))


def normal_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_\s]", ""), r"\s+", " "))


def without_attribution(title: Column) -> Column:
    """The title up to its last ' - ', if a source of 1 to 60 characters without . ! ? follows."""
    return F.regexp_replace(title, r"^(.*) - (?!.* - )[^.!?]{1,60}$", "$1")


def coded_entities(text: Column) -> Column:
    """CVE and APT codes in upper case, distinct, sorted."""
    found = F.regexp_extract_all(F.upper(text), F.lit(rf"{BEFORE}(CVE-[0-9]{{4}}-[0-9]{{4,}}|APT[0-9]+){AFTER}"), 1)
    return F.array_sort(F.array_distinct(found))


def named_entities(text: Column, names: list[str]) -> Column:
    """Codes as in coded_entities, then those of the names (in lower case) that the text holds as whole words, in their order."""
    found = F.array(*(F.when(F.lower(text).rlike(f"{BEFORE}{quoted([n])}{AFTER}"), n) for n in names)) if names else F.array().cast("array<string>")
    return F.concat(coded_entities(text), F.filter(found, lambda n: n.isNotNull()))


def plain_text(html: Column) -> Column:
    """Text of a scrap of HTML: tags become spaces, then five entities, then white space is collapsed."""
    out = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[\s\x{00A0}]+", " "))


def hashed_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.md5(key), 1, 12))


def domain_of(url: Column) -> Column:
    """The host of a search for one site (site:), else of the address, without www."""
    searched = F.regexp_extract(url, r"site:([^\s+&]+)", 1)
    host = F.when(searched != "", searched).otherwise(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)))
    return F.regexp_replace(host, r"^www\.", "")


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def banded(x: Column, bands: list[tuple[float, str]], other: str) -> Column:
    """The name of the first band whose floor x reaches."""
    out = None
    for floor, name in bands:
        out = F.when(x >= floor, name) if out is None else out.when(x >= floor, name)
    return out.otherwise(other) if out is not None else F.lit(other)


def magnitude_severity(m: Column) -> Column:
    return F.when(m >= 7, 5).when(m >= 6, 4).when(m >= 5, 3).when(m >= 4, 2).otherwise(1)


def radiation_severity(frp: Column) -> Column:
    return F.when(frp >= 150, 4).when(frp >= 80, 3).when(frp >= 40, 2).otherwise(1)


def radiation_confidence(frp: Column, sure: Column) -> Column:
    """40, 50 or 60 by power, then 15 more where the instrument is sure, 5 more where nominal, else 10 less; 80 at most."""
    base = F.when(frp >= 80, 60).when(frp >= 40, 50).otherwise(40)
    return F.least(F.lit(80), base + F.when(sure == "high", 15).when(sure == "nominal", 5).otherwise(-10))


# fixed values: postal codes of states and of Puerto Rico
US_STATES = (
    "AK AL AR AZ CA CO CT DE FL GA HI IA ID IL IN KS KY LA MA MD ME MI MN MO MS MT NC ND NE NH NJ NM NV NY OH OK OR PA PR RI SC SD TN TX UT VA VT WA WI WV WY"
).split()


def country_of_place(place: Column) -> Column:
    """What follows the last comma; United States for the code of a state, Unknown where nothing follows."""
    tail = F.trim(F.element_at(F.split(place, ","), -1))
    return F.when(F.coalesce(tail, F.lit("")) == "", "Unknown").when(F.upper(tail).isin(US_STATES), "United States").otherwise(tail)


def image_of(html: Column) -> Column:
    """The address of a page's og:image: of the meta tags, in any case and with attributes in any order, the first of that property with a web address."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\s[^>]*>"), 0)

    def attribute(tag: Column, name: str) -> Column:
        return F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*["']([^"']*)["']""", 1)

    images = F.filter(tags, lambda t: F.lower(attribute(t, "property")) == "og:image")
    found = F.filter(F.transform(images, lambda t: attribute(t, "content")), lambda c: c.rlike("^(?i:https?)://."))
    return F.get(found, 0)


def precision_of(importance: Column) -> Column:
    """How exact the place of a gazetteer entry is: approximate for towns (importance 2 and 3), else area."""
    return F.when(importance >= 2, "approximate").otherwise("area")
