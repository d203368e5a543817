"""Cleaning of names, titles and credits, as column expressions (two normal forms need Unicode tables)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"(?U)\s+"
#: Markers and separators of credits, brackets and quotes of chart pages. ASCII word edges, as the source has them.
EDGE_L, EDGE_R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
MARKERS = (EDGE_L + r"feat\.?", EDGE_L + r"ft\.?", EDGE_L + "featuring", EDGE_L + "with", EDGE_L + "w/", EDGE_L + r"w\.")
FEATURE_BLOCK = (
    rf"(?i)\(([^)]*?(?:{EDGE_L}feat(?:\.(?=[A-Za-z0-9_])|{EDGE_R})|{EDGE_L}ft(?:\.(?=[A-Za-z0-9_])|{EDGE_R})"
    rf"|{EDGE_L}featuring{EDGE_R}|{EDGE_L}with{EDGE_R}|w/|w\.)[^)]*)\)"
)
FEATURE_TAIL = (
    rf"(?i){EDGE_L}(?:feat(?:\.(?=[A-Za-z0-9_])|{EDGE_R})|ft(?:\.(?=[A-Za-z0-9_])|{EDGE_R})|featuring{EDGE_R}|with{EDGE_R}"
    r"|w/(?=[A-Za-z0-9_])|w\.(?=[A-Za-z0-9_])).*$"
)
SPLIT = rf"(?i)\s*(?:,|&| and |{EDGE_L}x{EDGE_R}|×|\+)\s*"
OPENING, CLOSING = "［【〔｛『«", "］】〕｝』»"
SINGLE_QUOTES, DOUBLE_QUOTES = "‚‛", "„‟«»‹›"
#: What stands between the artists of a weekly-chart credit.
CREDIT_WORDS, CREDIT_SIGNS = ("featuring", r"feat\.?", r"ft\.?", "with", "x", "&"), (r",\s+",)


@F.pandas_udf(StringType())
def nfd_strip(s: pd.Series) -> pd.Series:
    """Canonical decomposition without the combining marks U+0300 to U+036F."""
    return s.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFD", v) if not "̀" <= c <= "ͯ"))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def name_a(c: Column) -> Column:
    c = F.regexp_replace(F.trim(F.lower(c)), "&", " and ")
    c = F.regexp_replace(c, r"(?<![A-Za-z0-9_])feat\.?(?![A-Za-z0-9_])", "featuring")
    return collapse(F.regexp_replace(c, r"[^\p{L}\p{N} \t\n\r ]", ""))


def name_b(c: Column) -> Column:
    c = F.regexp_replace(nfd_strip(F.lower(c)), "&", "and")
    return collapse(F.regexp_replace(F.regexp_replace(c, "['\"`’‘]", ""), r"[^a-z0-9\s]", " "))


def name_c(c: Column) -> Column:
    return F.regexp_replace(collapse(F.lower(c)), "[^a-z0-9 ]", "")


def title_form(c: Column) -> Column:
    c = F.trim(F.lower(c))
    for pattern in (r"\(feat[^)]*\)", r"\(ft[^)]*\)", r"\[feat[^\]]*\]"):
        c = F.regexp_replace(c, pattern, "")
    return collapse(F.regexp_replace(c, r"[^\p{L}\p{N} \t\n\r]", ""))


def album_slug(title: Column, album_id: Column) -> Column:
    c = F.regexp_replace(F.trim(F.lower(title)), "['\"]", "")
    c = F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat_ws("-", c, F.substring(album_id, 1, 8))


#: What slugs write for signs, and for letters that are no accented ASCII letter. Two or more letters each:
LONG_FORMS = {
    "&": "and", "%": "percent", "$": "dollar", "<": "less", ">": "greater", "|": "or", "¢": "cent", "£": "pound", "¤": "currency", "¥": "yen", "€": "euro", "©": "c", "®": "r", "™": "tm",
    "∑": "sum", "∆": "delta", "∞": "infinity", "♥": "love", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ψ": "ps",
    "ё": "yo", "ж": "zh", "ч": "ch", "ш": "sh", "щ": "sh", "ю": "yu", "я": "ya", "є": "ye", "ї": "yi",
}
#: One letter each, in two rows: Latin, Greek, Cyrillic.
SHORT_FORMS = (
    "ðđøłı" "αβγδεζηθικλμνξοπρσςτυφχω" "абвгдезийклмнопрстуфхцыэіґ",
    "ddoli" "abgdezh8iklmn3oprsstyfxw" "abvgdezijklmnoprstufhcyeig",
)


def _accented() -> tuple[str, str]:
    """Small letters of the Latin and Greek blocks whose decomposition begins with another letter, and that letter."""
    pairs = []
    for block in ((0xC0, 0x250), (0x386, 0x3D0), (0x1E00, 0x2000)):
        for c in map(chr, range(*block)):
            base = unicodedata.normalize("NFD", c)[0]
            if base != c and c == c.lower():
                pairs.append((c, base))
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def slug(c: Column) -> Column:
    """Lower case in ASCII, words joined by "-": signs and foreign letters as they are commonly written ("&" is "and"), all else
    left out. JVM functions only: one translation for accents and single letters, one replacement for each longer form."""
    c = F.lower(F.trim(c))
    accented, plain = _accented()
    c = F.translate(F.translate(c, accented, plain), *SHORT_FORMS)
    for sign, form in LONG_FORMS.items():
        c = F.replace(c, F.lit(sign), F.lit(form))
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"[^a-z0-9\s-]", "")), r"[\s-]+", "-")


def split_artist_title(c: Column) -> Column:
    """struct(artist, title): at the last ' - ', else the last ' – ', else the first '-'; no artist otherwise."""
    forms = [r"(?s)^(.+) - (.*)$", r"(?s)^(.+) – (.*)$", r"(?s)^([^-]+)-(.*)$"]
    out = F.struct(F.lit("").alias("artist"), F.trim(c).alias("title"))
    for p in reversed(forms):
        out = F.when(F.regexp_like(c, F.lit(p)), F.struct(F.trim(F.regexp_extract(c, p, 1)).alias("artist"), F.trim(F.regexp_extract(c, p, 2)).alias("title"))).otherwise(out)
    return out


def dedupe_order(a: Column) -> Column:
    """Distinct without regard to case, first occurrence and its casing kept."""
    return F.aggregate(a, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def _parts(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), lambda x: F.trim(x)), lambda x: x != "")


def normalize_all(c: Column) -> Column:
    """Without format characters and no-break spaces, wide brackets as round ones, white space collapsed."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\p{Cf}\x{FEFF}\x{00A0}]", "")
    return collapse(F.translate(plain, OPENING + CLOSING, "(" * len(OPENING) + ")" * len(CLOSING)))


def ascii_quotes(c: Column) -> Column:
    return F.translate(c, SINGLE_QUOTES + DOUBLE_QUOTES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))


def normalize_basic(c: Column) -> Column:
    return collapse(nfkc(ascii_quotes(F.coalesce(c, F.lit("")))))


def norm_key(c: Column) -> Column:
    return F.lower(normalize_basic(c))


def track_key(artist: Column, title: Column) -> Column:
    """One key for what different pages write differently; one pass of the Unicode form over both parts."""
    both = norm_key(F.concat(F.coalesce(artist, F.lit("")), F.lit("\u0001"), F.coalesce(title, F.lit(""))))
    return F.concat_ws("::", F.trim(F.split_part(both, F.lit("\u0001"), F.lit(1))), F.trim(F.split_part(both, F.lit("\u0001"), F.lit(2))))


def ordered_union(*lists: Column) -> Column:
    """The names of all lists in order, each once without regard to case."""
    return dedupe_order(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))


def extract_features(c: Column) -> Column:
    """struct(title, featured): bracketed credits taken out of a title.

    The marker may stand anywhere in the bracket; of each kind of marker the first goes, in the order of ``MARKERS``, so
    the short forms also eat the start of the long one ("featuring X" gives "uring X"), as the source data has it.
    """
    c = F.translate(normalize_all(c), "[]", "()")
    found = F.regexp_extract_all(c, F.lit(FEATURE_BLOCK), F.lit(1))

    def names(block: Column) -> Column:
        for marker in MARKERS:
            block = F.regexp_replace(block, rf"(?is)^(.*?){marker}\s*", "$1")
        return _parts(F.trim(block), SPLIT)

    listed = F.flatten(F.transform(found, names))
    title = F.when(F.size(found) > 0, collapse(F.regexp_replace(c, FEATURE_BLOCK, ""))).otherwise(c)
    return F.struct(title.alias("title"), dedupe_order(listed).alias("featured"))


def split_artists(c: Column) -> Column:
    """struct(lead, others) of an artist field; what follows a feature marker is left out."""
    cleaned = F.trim(F.regexp_replace(normalize_all(c), FEATURE_TAIL, ""))
    parts = _parts(cleaned, SPLIT)
    others = F.when(F.size(parts) > 1, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return F.struct(F.coalesce(F.get(parts, F.lit(0)), cleaned).alias("lead"), others.alias("others"))


def title_case(c: Column) -> Column:
    """Lower case, with a capital at the start and after white space. Only ASCII word characters get one."""
    starts = F.split(F.regexp_replace(F.lower(c), r"(?<=^|\s)(?=[a-z])", "\u0001"), "\u0001")
    return F.array_join(F.transform(starts, lambda x, i: F.when(i > 0, F.concat(F.upper(F.substr(x, F.lit(1), F.lit(1))), F.substr(x, F.lit(2)))).otherwise(x)), "")


def split_credit(c: Column, slash: bool = False) -> Column:
    """array of the artists of a weekly-chart credit, parts of one character left out; the credit itself if none is left.

    ``slash``: the form in which "/" too stands between artists, names are put in title case, and a marker before the first
    artist goes.
    """
    c = title_case(c) if slash else c
    between = [rf"\s+{w}\s+" for w in CREDIT_WORDS] + list(CREDIT_SIGNS) + ["/"] * slash
    sign = "^[&,/]\\s*" if slash else "^[&,]\\s*"
    parts = F.transform(F.split(c, "(?i)" + "|".join(between)), lambda x: F.trim(F.regexp_replace(F.trim(x), sign, "")))
    parts = F.filter(parts, lambda x: F.length(x) > 1)
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.trim(c)))
    if slash:
        lead = lambda x: F.trim(F.regexp_replace(x, r"(?i)^(?:featuring|feat\.?|ft\.?)\s+", ""))
        parts = F.transform(parts, lambda x, i: F.when(i == 0, lead(x)).otherwise(x))
    return parts


def component(c: Column) -> Column:
    """Percent-encoded as in a URL's query, with ``! ' ( ) * ~`` and spaces as browsers write them."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def weekly_chart_url(base: Column, day: Column, path: Column, chart: Column) -> Column:
    return F.concat_ws("/", base, F.lit("charts"), path, F.date_format(day, "yyyyMMdd"), chart, F.lit(""))
