"""Text: folding, slugs, entities, names, templates and keyword rules. All functions give columns."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Mapping
from functools import reduce
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coerce import blank_to_null, col, keyed
from .vectorised import vectorised

# Letters whose decomposition is an ASCII letter and marks, by rule rather than by hand.
_COMPOSED = [(chr(c), d[0]) for c in range(0xC0, 0x250) if (d := unicodedata.normalize("NFD", chr(c))) != chr(c) and d[0].isascii()]
_FROM, _TO = "".join(a for a, _ in _COMPOSED), "".join(b for _, b in _COMPOSED)


def fold(x: Column | str) -> Column:
    """Lower case without accents, for Latin letters and for combining marks U+0300 to U+036F."""
    return F.lower(F.regexp_replace(F.translate(col(x), _FROM, _TO), "[̀-ͯ]", ""))


@vectorised("string")
def fold_exact(x: pd.Series) -> pd.Series:
    """Lower case without accents for any script (canonical decomposition); slower than fold."""
    return x.str.normalize("NFD").str.replace("[̀-ͯ]", "", regex=True).str.lower()


def dashed(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug(x: Column | str, ampersand: str | None = None) -> Column:
    """Folded, with a dash for each run of other characters. ampersand: what & is read as."""
    text = F.replace(col(x), F.lit("&"), F.lit(f" {ampersand} ")) if ampersand else col(x)
    return dashed(fold(text))


# Words that say nothing about which lodging a name means.
STOP_WORDS = (
    "b bb bnb en de het t the la le les l d du vakantiewoning vakantiewoningen vakantiehuis vakantieappartement vakantiehoeve "
    "vakantievilla hotel boutique charmehotel bv nv bvba vzw comm v logies huis in van kasteel verblijf appartement gastenkamers "
    "hoeve villa sauna spa"
).split()


def plain_name(x: Column | str) -> Column:
    """A name in lower-case ASCII words, entities decoded; b&b is one word."""
    text = F.replace(fold(entities(x)), F.lit("b&b"), F.lit(" bnb "))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def name_tokens(x: Column | str) -> Column:
    """The distinct words of a name that tell it apart, in order."""
    words = F.filter(F.split(plain_name(x), " "), lambda w: F.length(w) > 1)
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


# Named entities.
ENTITIES = {"&quot;": '"', "&#39;": "'", "&#039;": "'", "&apos;": "'", "&lt;": "<", "&gt;": ">"}


def entities(x: Column | str, passes: int = 3) -> Column:
    """Decodes named and numeric entities, nested ones up to a few times; white space as single spaces."""

    def decoded(text: Column) -> Column:
        for name, sign in {"&amp;": "&", **ENTITIES}.items():
            text = F.replace(text, F.lit(name), F.lit(sign))
        return text

    # a fold, so that the expression doesn't grow with the passes
    text = F.aggregate(F.sequence(F.lit(1), F.lit(passes)), F.coalesce(col(x).cast("string"), F.lit("")), lambda t, _: F.transform(F.array(decoded(t)), _numeric_entities)[0])
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _numeric_entities(text: Column) -> Column:
    """&#n; for n up to 65535, in as many steps as the text has different ones."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(\d{1,5});"), F.lit(1)))
    # a character from its number, by way of its two bytes
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("int")), 4, "0")), "UTF-16BE")
    return F.when(F.size(found) > 0, F.aggregate(found, text, lambda t, n: F.replace(t, F.concat(F.lit("&#"), n, F.lit(";")), char(n)))).otherwise(text)


def html_entities(x: Column | str) -> Column:
    """Decodes the entities that page texts use, in any case; a non-breaking space is a space."""
    text = F.regexp_replace(col(x), "(?i)&nbsp;", " ")
    for name, sign in {"&amp;": "&", **ENTITIES}.items():
        text = F.regexp_replace(text, f"(?i){name}", sign)
    return text


def strip_tags(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(html_entities(F.regexp_replace(col(x), "<[^>]+>", " ")), r"\s+", " "))


# What is no content of a description. Elements that go with what they hold, as (tag, what its attributes match), ...
CHROME_ELEMENTS = (("script", ""), ("style", ""), ("i", r'class="[^"]*\bicn-'), ("a", r'class="[^"]*\bbtn\b'))
# ... elements whose contents stay, and tags that vanish wherever they stand.
CHROME_WRAPPERS = (("a", "data-glightbox"),)
CHROME_TAGS = ("figure", "div", "section")


def without_page_chrome(x: Column | str) -> Column:
    """HTML without PHP, scripts, styles, comments, icons and buttons; layout elements leave what they hold."""
    text = F.regexp_replace(F.regexp_replace(col(x), r"(?is)<\?php.*?\?>", ""), "(?s)<!--.*?-->", "")
    element = lambda tag, attributes: rf"(?is)<{tag}\b" + (f"[^>]*{attributes}[^>]*>" if attributes else "[^>]*>") + f"(.*?)</{tag}>"
    for tag, attributes in CHROME_ELEMENTS:
        text = F.regexp_replace(text, element(tag, attributes), "")
    for tag, attributes in CHROME_WRAPPERS:
        text = F.regexp_replace(text, element(tag, attributes), "$1")
    return F.regexp_replace(text, rf"(?i)</?(?:{'|'.join(CHROME_TAGS)})\b[^>]*>", "")


def escape_html(x: Column | str) -> Column:
    text = col(x)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def linked(x: Column | str) -> Column:
    """Plain text as HTML: escaped, addresses as links, line ends as breaks."""
    text = F.regexp_replace(escape_html(x), r"(https?://[^\s<]+)", '<a href="$1">$1</a>')
    return F.replace(text, F.lit("\n"), F.lit("<br>"))


def truncate(x: Column | str, most: int) -> Column:
    return F.when(F.length(col(x)) > most, F.concat(F.rtrim(F.substring(col(x), 1, most - 1)), F.lit("…"))).otherwise(col(x))


def clip(x: Column | str, most: int = 255) -> Column:
    return F.substring(col(x), 1, most)


def filename(x: Column | str) -> Column:
    """A name that is safe as a file's: the last part of a path, folded, signs as dashes, extension kept."""
    last = F.element_at(F.split(F.regexp_replace(col(x), r"[?#].*$", ""), r"[/\\]"), -1)
    extension = F.lower(F.regexp_extract(last, r"(\.[A-Za-z0-9]{1,5})$", 1))
    return F.concat(dashed(fold(F.regexp_replace(last, r"\.[A-Za-z0-9]{1,5}$", ""))), extension)


def is_email(x: Column | str) -> Column:
    return F.coalesce(col(x).rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False))


def is_phone(x: Column | str) -> Column:
    return F.coalesce(col(x).rlike(r"^\+?[0-9 ()./-]{6,30}$"), F.lit(False))


def is_url(x: Column | str) -> Column:
    return F.coalesce(col(x).rlike(r"(?i)^https?://") & F.try_parse_url(col(x), F.lit("HOST")).isNotNull(), F.lit(False))


def filled(template: Column | str, values: Mapping[str, Column]) -> Column:
    """A template with {name} replaced; null values are empty, names that aren't given stay."""
    text = col(template)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return text


def display_name(first: Column, last: Column, user: Column, default: str) -> Column:
    """First name with the initial of the last; else the user's name; else the default."""
    initial = F.concat(F.upper(F.substring(blank_to_null(last), 1, 1)), F.lit("."))
    return F.coalesce(F.nullif(F.concat_ws(" ", blank_to_null(first), F.when(blank_to_null(first).isNotNull(), initial)), F.lit("")), blank_to_null(user), F.lit(default))


def address(street: Column, number: Column, postcode: Column, city: Column) -> Column:
    """Two lines at most; what is missing leaves no gap."""
    line = lambda *parts: F.nullif(F.concat_ws(" ", *map(blank_to_null, parts)), F.lit(""))
    return F.concat_ws("\n", line(street, number), line(postcode, city))


def excerpt(*candidates: Column, most: int = 160) -> Column:
    """The first candidate with text, without tags, cut to a length."""
    return truncate(F.coalesce(*[F.nullif(strip_tags(c), F.lit("")) for c in candidates]), most)


def node_sequence(x: Column | str) -> Column:
    """The node numbers of a written sequence, as "12 - 7A - 30"."""
    return F.regexp_extract_all(col(x), F.lit(r"(\d+[A-Za-z]?)"), F.lit(1))


def decimals(x: Column | str) -> Column:
    """All numbers of a text, with decimal commas or points."""
    return F.transform(F.regexp_extract_all(col(x), F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1)), lambda n: F.regexp_replace(n, ",", ".").cast("double"))


def top_names(x: Column | str, n: int = 2, sep: str = ";", joint: str = " en ") -> Column:
    """The first names of a list, joined."""
    parts = F.filter(F.transform(F.split(col(x), sep), lambda p: F.trim(p)), lambda p: p != "")
    return F.nullif(F.array_join(F.slice(parts, 1, n), joint), F.lit(""))


# Remarks in a network's name, what kind of network it is, and articles.
NETWORK_REMARK = r"\([^)]*\)"
NETWORK_KIND = r"^(uitbreiding\s+)?(wandelnetwerk|fietsnetwerk|fietsroutenetwerk|wnw|fnw)\b[\s:-]*"
NETWORK_ARTICLE = r"^(de|het|t)\s+"


def network_key(x: Column | str) -> Column:
    """The slug of a network's own name."""
    plain = F.regexp_replace(F.trim(fold(x)), NETWORK_REMARK, " ")
    own = reduce(lambda name, before: F.regexp_replace(name, before, ""), (NETWORK_KIND, NETWORK_ARTICLE), plain)
    return dashed(own)


# Whole texts that are put right as they stand, in any case, and the characters that betray a wrong encoding.
WHOLE_TEXTS = {"Li\ufffdge": "Liège", "Liége": "Liège", "Bl\ufffdgny": "Blégny"}
BETRAYING = "ÃÂÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ\ufffd"
LOST = "\ufffd"


def _repaired(x: str) -> str:
    known = {k.lower(): v for k, v in WHOLE_TEXTS.items()}
    if x.lower() in known or not any(c in BETRAYING for c in x):
        return known.get(x.lower(), x)
    # each character's low byte was one of the text's bytes
    back = x.encode("utf-16-le", "surrogatepass")[::2].decode("utf-8", "replace")
    found = x.replace(LOST, "é") if LOST in back and back.lower() not in known else back
    return known.get(found.lower(), found)


@vectorised("string")
def repaired(x: pd.Series) -> pd.Series:
    """Text that was read as Latin-1 although it was UTF-8, put right where that gives whole text; else characters that were lost become é."""
    return x.map(_repaired, na_action="ignore")


# Aliases of countries, by slug.
COUNTRIES = {"belgie": "belgie", "belgium": "belgie", "be": "belgie", "nederland": "nederland", "netherlands": "nederland", "holland": "nederland", "nl": "nederland"}


def country_slug(x: Column | str) -> Column:
    own = F.nullif(slug(x), F.lit(""))
    return F.coalesce(keyed(COUNTRIES, own), own)


# Provinces of two countries, and of one its regions: name, slug and the region's slug.
REGIONS = [("Vlaanderen", "vlaanderen"), ("Wallonië", "wallonie"), ("Brussels Hoofdstedelijk Gewest", "brussels-hoofdstedelijk-gewest")]
PROVINCES = [
    ("Antwerpen", "antwerpen", "vlaanderen"), ("Limburg", "limburg", "vlaanderen"), ("Oost-Vlaanderen", "oost-vlaanderen", "vlaanderen"), ("Vlaams-Brabant", "vlaams-brabant", "vlaanderen"), ("West-Vlaanderen", "west-vlaanderen", "vlaanderen"),
    ("Brabant wallon", "brabant-wallon", "wallonie"), ("Hainaut", "hainaut", "wallonie"), ("Liege", "liege", "wallonie"), ("Luxembourg", "luxembourg", "wallonie"), ("Namur", "namur", "wallonie"),
]
DUTCH_PROVINCES = "Drenthe Flevoland Friesland Gelderland Groningen Limburg Noord-Brabant Noord-Holland Overijssel Utrecht Zeeland Zuid-Holland".split()
# Other names, by slug. They are looked up by slug, so names with spaces are never found; results are to equal what is computed elsewhere.
REGION_ALIASES = {
    "vlaanderen": "vlaanderen", "vlaams gewest": "vlaanderen", "flemish region": "vlaanderen", "flanders": "vlaanderen",
    "wallonie": "wallonie", "waals gewest": "wallonie", "region wallonne": "wallonie", "walloon region": "wallonie",
    "brussels hoofdstedelijk gewest": "brussels-hoofdstedelijk-gewest", "brussels-capital region": "brussels-hoofdstedelijk-gewest", "region de bruxelles-capitale": "brussels-hoofdstedelijk-gewest", "bruxelles-capitale": "brussels-hoofdstedelijk-gewest",
}
PROVINCE_ALIASES = {
    "antwerpen": "antwerpen", "anvers": "antwerpen", "province of antwerp": "antwerpen", "limburg": "limburg", "limbourg": "limburg",
    "oost-vlaanderen": "oost-vlaanderen", "east flanders": "oost-vlaanderen", "flandre orientale": "oost-vlaanderen",
    "vlaams-brabant": "vlaams-brabant", "flemish brabant": "vlaams-brabant", "brabant flamand": "vlaams-brabant",
    "west-vlaanderen": "west-vlaanderen", "west flanders": "west-vlaanderen", "flandre occidentale": "west-vlaanderen",
    "waals-brabant": "brabant-wallon", "brabant wallon": "brabant-wallon", "walloon brabant": "brabant-wallon", "hainaut": "hainaut", "henegouwen": "hainaut",
    "liege": "liege", "liege province": "liege", "luik": "liege", "luxembourg": "luxembourg", "belgian luxembourg": "luxembourg", "luxemburg": "luxembourg", "namur": "namur", "namen": "namur",
}
DUTCH_ALIASES = {
    "drenthe": "drenthe", "flevoland": "flevoland", "friesland": "friesland", "fryslan": "friesland", "gelderland": "gelderland", "groningen": "groningen", "limburg": "limburg",
    "noord-brabant": "noord-brabant", "north-brabant": "noord-brabant", "brabant": "noord-brabant", "noord-holland": "noord-holland", "north-holland": "noord-holland",
    "overijssel": "overijssel", "utrecht": "utrecht", "zeeland": "zeeland", "zuid-holland": "zuid-holland", "south-holland": "zuid-holland",
}


def province_slug(x: Column | str, country: str = "belgie") -> Column:
    own = F.nullif(slug(x), F.lit(""))
    return F.coalesce(keyed(PROVINCE_ALIASES if country == "belgie" else DUTCH_ALIASES, own), own)


def region_slug(x: Column | str) -> Column:
    own = F.nullif(slug(x), F.lit(""))
    return F.coalesce(keyed(REGION_ALIASES, own), own)


def areas(province: Column, region: Column, country: str = "belgie") -> Column:
    """struct(province, region): their own names; a region that isn't given is the province's. Unknown names stay; a country without regions has none."""
    own = province_slug(province, country)
    if country != "belgie":
        named = keyed({dashed_name: name for name, dashed_name in ((n, n.lower()) for n in DUTCH_PROVINCES)}, own)
        return F.struct(F.coalesce(named, province).alias("province"), F.lit(None).cast("string").alias("region"))
    above = F.coalesce(region_slug(region), keyed({s: r for _, s, r in PROVINCES}, own))
    return F.struct(
        F.when(own.isNotNull(), F.coalesce(keyed({s: n for n, s, _ in PROVINCES}, own), province)).alias("province"),
        F.when(above.isNotNull(), F.coalesce(keyed({s: n for n, s in REGIONS}, above), region)).alias("region"),
    )


def province_name(province: Column | str, country: Column | str) -> Column:
    """Limburg is the name of two provinces; the Belgian one gets its own."""
    belgian = (slug(province) == "limburg") & (country_slug(country) == "belgie")
    return F.when(belgian, F.lit("Limburg Vlaanderen")).otherwise(col(province))


# Kinds of points of interest and the words that tell buildings.
POI_TYPES = ["Gebouwen", "Locaties", "Wandelnetwerken"]
BUILDING_WORDS = (
    "molen kasteel kerk kapel belfort toren museum brouwerij abdij begraafplaats cemetery kerkhof memorial monument gedenkteken poort "
    "sluis sluiz stadhuis halle fort trap bezoekerscentrum kathedraal begijnhof basiliek station hoeve herberg cafe vuurtoren bunker "
    "schans priorij klooster pastorie gebouw paleis woning villa standbeeld beeld"
).split()
BUILDING_WHOLE_WORDS = ["brug", "sas"]


def poi_type(explicit: Column, *titles: Column) -> Column:
    """A known type as given; else by keywords of the titles; null without a title."""
    text = fold(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in titles]))
    whole = "(^|[^a-z])(" + "|".join(BUILDING_WHOLE_WORDS) + ")([^a-z]|$)"
    return (
        F.when(F.trim(explicit).isin(POI_TYPES), F.trim(explicit))
        .when(F.trim(text) == "", F.lit(None))
        .when(text.contains("wandelnetwerk"), "Wandelnetwerken")
        .when(text.rlike("|".join(BUILDING_WORDS)) | text.rlike(whole), "Gebouwen")
        .otherwise("Locaties")
    )


def type_tags(x: Column | str) -> Column:
    """Tags for a route's type."""
    kind = F.lower(F.trim(col(x)))
    return F.array_compact(F.array(
        F.when(kind.isin("city bike", "stadsfietsroute"), "Stadsfietsroute"),
        F.when(kind.isin("forrest bike", "forest bike", "bosfietsroute"), "Bosfietsroute"),
    ))


def difficulty(x: Column) -> Column:
    return F.when(x <= 2, "easy").when(x <= 4, "moderate").when(x > 4, "hard")


# What hashes look like.
PASSWORD_HASHES = {"md5": "^[A-Fa-f0-9]{32}$", "bcrypt": r"^\$2[aby]\$\d{2}\$[./A-Za-z0-9]{53}$"}


def password_kind(x: Column | str) -> Column:
    """Which kind of hash a stored password has; the value itself never leaves this expression."""
    found = F.lit("unknown")
    for kind, pattern in PASSWORD_HASHES.items():
        found = F.when(col(x).rlike(pattern), kind).otherwise(found)
    return found


def sorted_identity(email: Column, user: Column) -> Column:
    """(email, user) put right where the two were swapped."""
    swapped = ~F.coalesce(email, F.lit("")).contains("@") & F.coalesce(user, F.lit("")).contains("@")
    return F.struct(F.when(swapped, user).otherwise(email).alias("email"), F.when(swapped, email).otherwise(user).alias("user"))


@vectorised("double")
def bigram_dice(a: pd.Series, b: pd.Series) -> pd.Series:
    """Shared pairs of characters (with repeats) of all pairs; null where one is null."""

    def dice(x: str, y: str) -> float:
        if len(x) < 2 or len(y) < 2:
            return float(x == y)
        return 2 * (Counter(map("".join, pairwise(x))) & Counter(map("".join, pairwise(y)))).total() / (len(x) + len(y) - 2)

    return pd.Series([dice(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)], dtype=float)


def edit_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence: a bit for each character of a, cleared where the length grows."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@vectorised("double")
def subsequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common subsequence by all characters; 0 where one is empty or null."""
    return pd.Series([2 * _common_subsequence(x, y) / (len(x) + len(y)) if x and y else 0.0 for x, y in zip(a, b)], dtype=float)


def token_similarity(ta: Column, tb: Column) -> Column:
    """How alike two names are (arrays of distinct words): shared words, or alike as one word, or one within the other."""
    a, b = F.array_join(ta, ""), F.array_join(tb, "")
    jaccard = F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))
    alike = F.greatest(edit_ratio(a, b), bigram_dice(a, b), subsequence_ratio(a, b))
    within = (F.least(F.length(a), F.length(b)) >= 4) & (F.contains(a, b) | F.contains(b, a))
    found = F.greatest(jaccard, F.when(alike >= 0.8, alike).otherwise(0.0), F.when(within, 0.5).otherwise(0.0))
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).otherwise(found)


def with_similarity(df: DataFrame, a: str, b: str, out: str = "similarity") -> DataFrame:
    """df with how alike the names in two columns are. The words are columns of a step of their own, since they are used many times."""
    words = df.withColumns({"_a": name_tokens(a), "_b": name_tokens(b)})
    return words.withColumn(out, token_similarity(F.col("_a"), F.col("_b"))).drop("_a", "_b")
