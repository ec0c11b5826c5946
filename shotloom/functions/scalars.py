"""Scalar functions on columns, in the JVM but for what needs Unicode or entity tables.

Normal forms and named entities go to Python as Arrow batches, and only the values
that can change do; the others pass as nulls. Python's rules are kept where Spark's differ: half-even rounding, Unicode white
space, first-occurrence order of distinct lists.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Lower bounds of the context tiers, in tokens (fixed values).
CONTEXT_TIERS = (("1m", 1_000_000), ("512k", 512_000), ("256k", 256_000), ("128k", 128_000))
#: Order of platforms wherever results are put side by side (fixed values).
PLATFORMS = ("bilibili", "douyin", "xiaohongshu", "youtube", "tiktok")
#: Hosts of the platforms' public pages (fixed values).
SOURCE_HOSTS = {
    "bilibili": ("bilibili.com", "b23.tv"),
    "douyin": ("douyin.com", "iesdouyin.com"),
    "xiaohongshu": ("xiaohongshu.com", "xhslink.com"),
    "youtube": ("youtube.com", "youtu.be"),
    "tiktok": ("tiktok.com",),
}


def strip_spaces(x: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapse_spaces(x: Column) -> Column:
    return strip_spaces(F.regexp_replace(x, r"(?U)\s+", " "))


@F.arrow_udf(StringType())
def _composed(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else unicodedata.normalize("NFC", v) for v in values.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _unescaped(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else html.unescape(v) for v in values.to_pylist()], pa.string())


def normal_form(x: Column) -> Column:
    """Unicode normal form C. Only texts with a code point from U+0300 on can change."""
    can_change = x.rlike(r"[^\x00-\u02FF]")
    return F.when(can_change, _composed(F.when(can_change, x))).otherwise(x)


def inline_text(x: Column) -> Column:
    """Normal form C, white space of any kind collapsed."""
    return collapse_spaces(normal_form(x))


def multiline_text(x: Column) -> Column:
    """Normal form C, line ends as \\n, no spaces at the ends of lines or of the text."""
    lines = F.regexp_replace(normal_form(x), r"\r\n?", "\n")
    return strip_spaces(F.regexp_replace(lines, r"(?U)[\s&&[^\n]]+(?=\n|$)", ""))


#: What case folding turns characters into that lower case does not: one character, or several.
_FOLDED = {c: c.lower().casefold() for c in map(chr, range(128, 0x20000)) if not 0xD800 <= ord(c) < 0xE000 and c.lower() == c != c.casefold()}
FOLDED_ONE = {c: f for c, f in _FOLDED.items() if len(f) == 1}
FOLDED_MORE = {c: f for c, f in _FOLDED.items() if len(f) > 1}


def case_folded(x: Column) -> Column:
    """Full case folding: lower case, then the characters that fold further (sharp s, final sigma, ligatures).

    Below U+0149 these are two, so that most texts need no look at all of them.
    """
    x = F.lower(x)
    low = F.replace(F.replace(x, F.lit("µ"), F.lit("μ")), F.lit("ß"), F.lit("ss"))
    one = F.translate(x, "".join(FOLDED_ONE), "".join(FOLDED_ONE.values()))
    more = one
    for c, folded in FOLDED_MORE.items():
        more = F.replace(more, F.lit(c), F.lit(folded))
    plain = F.when(one.rlike(f"[{''.join(FOLDED_MORE)}]"), more).otherwise(one)
    return F.when(x.rlike(r"[^\x00-\u0148]"), plain).otherwise(low)


def match_text(x: Column) -> Column:
    """Case-folded letters and digits only."""
    return F.regexp_replace(case_folded(x), r"[^\p{L}\p{N}]", "")


def match_words(x: Column) -> Column:
    """``match_text`` of each word, words separated by one space."""
    kept = F.regexp_replace(case_folded(x), r"[^\p{L}\p{N}\x20\x09-\x0D]", "")
    return F.trim(F.regexp_replace(kept, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))


def ordered_distinct(values: Column) -> Column:
    """Stripped, non-empty strings in the order of their first occurrence."""
    return F.array_distinct(F.filter(F.transform(values, strip_spaces), lambda x: x != ""))


def safe_id(x: Column) -> Column:
    """Whether a value can name a file: a letter or digit, then at most 127 more of a small set."""
    return F.coalesce(x.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}\z"), F.lit(False))


def stable_key(prefix: str, *parts: Column) -> Column:
    """``prefix:`` and the SHA-256 of the parts, separated by NUL; a null part is empty."""
    joined = F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(f"{prefix}:"), F.sha2(joined, 256))


def short_key(prefix: str, x: Column, length: int = 24) -> Column:
    """``prefix_`` and the first hex digits of a SHA-256."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(x, 256), 1, length))


def canonical_hash(*columns: str) -> Column:
    """``sha256:`` of the compact JSON of the columns in the order of their names.

    For strings, whole numbers and booleans; doubles print differently elsewhere.
    """
    ordered = F.struct(*(F.col(c) for c in sorted(columns)))
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256))


def clock_seconds(x: Column) -> Column:
    """Seconds of ``[[H:]M:]S``, white space around it ignored; null for anything else."""
    x = strip_spaces(x)
    parts = F.split(x, ":")
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 60 + p.try_cast("long"))
    return F.when(x.rlike(r"^\d{1,9}(:\d{1,9}){0,2}\z"), total)


def json_clock(raw: Column) -> Column:
    """Seconds of a JSON value: a number is taken as it is, but not below zero, a string as of ``clock_seconds``."""
    number = raw.try_cast("double")
    number = F.when(number < 0, 0.0).otherwise(number)
    return F.when(raw.startswith('"'), clock_seconds(F.substring(raw, F.lit(2), F.char_length(raw) - 2)).cast("double")).otherwise(number)


def clock_text(ms: Column) -> Column:
    """HH:MM:SS.mmm of milliseconds."""
    part = lambda div, mod: F.lpad(F.pmod(F.floor(ms / div), F.lit(mod)).cast("string"), 2, "0")
    hours = F.floor(ms / 3_600_000).cast("string")
    hours = F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours)
    return F.concat(hours, F.lit(":"), part(60_000, 60), F.lit(":"), part(1000, 60), F.lit("."), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"))


def subtitle_ms(x: Column) -> Column:
    """Milliseconds of HH:MM:SS,mmm (or with a point)."""
    part = lambda k: F.regexp_extract(x, r"^\s*(\d+):(\d{2}):(\d{2})[,.](\d{3})", k).try_cast("long")
    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)


def ratio(x: Column) -> Column:
    """Value of 'a:b' or 'a/b'; null unless both are positive."""
    parts = F.split(x, "[:/]")
    a, b = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when((F.size(parts) == 2) & (a > 0) & (b > 0), a / b)


def rational(x: Column) -> Column:
    """Value of 'n/d'; null if d is zero."""
    parts = F.split(x, "/")
    return F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))


def epoch_iso(seconds: Column) -> Column:
    """ISO-8601 UTC text of epoch seconds; null for zero and below."""
    return F.when(seconds > 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def ms_seconds(ms: Column) -> Column:
    return F.when(ms >= 0, ms / 1000)


def span_ms(ms: Column, seconds: Column) -> Column:
    """Milliseconds as given, else from seconds, rounded half to even."""
    return F.coalesce(ms.cast("long"), F.bround(seconds * 1000).cast("long"))


def canonical_url(x: Column) -> Column:
    """Scheme, lower-cased host and path, without query and fragment; null for what is no web address."""
    host = F.lower(F.regexp_extract(x, r"^[A-Za-z]+://([^/?#]+)", 1))
    path = F.regexp_extract(x, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    return F.when(host != "", F.concat(F.lower(F.regexp_extract(x, r"^([A-Za-z]+)://", 1)), F.lit("://"), host, path))


def source_url(x: Column, platform: str) -> Column:
    """Address of a platform's public page: https, lower-cased host and port, at least ``/`` as path.

    No query and no fragment. Null for other schemes, for user names or
    passwords in it, and for hosts that are not the platform's or below them.
    """
    parts = lambda k: F.regexp_extract(strip_spaces(x), r"^(?i:https)://([^/?#]+)([^?#]*)", k)
    place = F.lower(parts(1))
    host = F.regexp_replace(place, r":\d*\z", "")
    ours = F.lit(False)
    for name in SOURCE_HOSTS[platform]:
        ours = ours | (host == name) | host.endswith(f".{name}")
    return F.when(ours & ~place.contains("@"), F.concat(F.lit("https://"), place, F.when(parts(2) == "", "/").otherwise(parts(2))))


def clean_html(x: Column) -> Column:
    """Text without tags, entities of all names and numbers resolved and white space collapsed."""
    out = F.regexp_replace(x, r"<[^>]+>", "")
    marked = out.contains("&")
    return collapse_spaces(F.when(marked, _unescaped(F.when(marked, out))).otherwise(out))


def context_tier(tokens: Column) -> Column:
    """Name of the largest tier that ``tokens`` reaches; null below all."""
    out = F.lit(None).cast("string")
    for name, least in reversed(CONTEXT_TIERS):
        out = F.when(tokens >= least, F.lit(name)).otherwise(out)
    return out


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def aligned_similarity(a: Column, b: Column, bits: int = 64, reach: int = 4) -> Column:
    """Best of 1 - differing bits / compared bits over shifts of one hash list against the other; 0 if nothing overlaps."""

    def at(shift: Column) -> Column:
        skip_a, skip_b = F.greatest(shift, F.lit(0)), F.greatest(-shift, F.lit(0))
        n = F.greatest(F.least(F.size(a) - skip_a, F.size(b) - skip_b), F.lit(0))
        differ = F.aggregate(F.zip_with(F.slice(a, skip_a + 1, n), F.slice(b, skip_b + 1, n), lambda x, y: hamming(x, y)), F.lit(0), lambda s, x: s + x)
        return F.when(n > 0, 1 - differ / (n * bits)).otherwise(0.0)

    return F.array_max(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), at))


def display_ratio(width: Column, height: Column, pixel_ratio: Column | float = 1.0, rotation: Column | int = 0) -> Column:
    """Width by height as shown: pixels may not be square, and a quarter turn swaps the sides."""
    pixel = pixel_ratio if isinstance(pixel_ratio, Column) else F.lit(pixel_ratio)
    turned = F.pmod(F.abs(rotation if isinstance(rotation, Column) else F.lit(rotation)), F.lit(180)) == 90
    shown = F.when((width > 0) & (height > 0) & (pixel > 0), width * pixel / height)
    return F.when(turned, 1 / shown).otherwise(shown)


def geometry_disposition(shown: Column, target: float = 16 / 9, tolerance: float = 0.01) -> Column:
    """accepted, rejected or unknown, by the relative deviation from the target."""
    return F.when(shown.isNull(), "unknown").when(F.abs(shown - target) / target <= tolerance, "accepted").otherwise("rejected")


def work_id(platform: str, x: Column) -> Column:
    """The platform's own id in an address or text (xiaohongshu: also alone); null if there is none."""
    patterns = {"bilibili": r"(BV[0-9A-Za-z]{10})", "douyin": r"/(?:video|note)/(\d{6,})", "xiaohongshu": r"(?i)/(?:explore|discovery/item)/([0-9a-f]{24})"}
    found = F.nullif(F.regexp_extract(x, patterns[platform], 1), F.lit(""))
    if platform != "xiaohongshu":
        return found
    bare = strip_spaces(x)
    return F.lower(F.coalesce(found, F.when(bare.rlike(r"(?i)^[0-9a-f]{24}\z"), bare)))


def allowed_entries(x: Column, keys: tuple[str, ...]) -> Column:
    """JSON of the allowed keys of a map, in the order of their names."""
    kept = F.map_from_entries(F.sort_array(F.map_entries(F.map_filter(x, lambda k, v: k.isin(*keys)))))
    return F.to_json(kept)


def escape_html(x: Column) -> Column:
    """Text with &, <, > and both quotes as entities."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(plain), F.lit(entity))
    return x


def default_identity(platform: Column, source_id: Column, unit_id: Column, known: Column) -> Column:
    """The known identity map, or the one that the platform's ids give where it is null or empty."""
    video = F.create_map(F.lit("bvid"), source_id, F.lit("cid"), F.element_at(F.split(unit_id, ":"), -1))
    default = F.when(platform == "bilibili", video).when(platform == "douyin", F.create_map(F.lit("aweme_id"), source_id)).otherwise(F.create_map(F.lit("note_id"), source_id))
    return F.when(F.size(known) > 0, known).otherwise(default)


def one_signature(*columns: str) -> Column:
    """Aggregate: whether all rows of a group agree in all the columns; nulls agree with nulls."""
    whole = F.struct(*columns)
    return F.min(whole).eqNullSafe(F.max(whole))


def cache_key(*columns: str, length: int = 16) -> Column:
    """The first hex digits of the canonical hash of the columns."""
    return F.substring(canonical_hash(*columns), len("sha256:") + 1, length)


def stream_edge(width: Column, height: Column, name: Column) -> Column:
    """The shorter side; without sides the least number of three or four digits in the name."""
    told = F.array_min(F.transform(F.regexp_extract_all(name, F.lit(r"(?<!\d)(\d{3,4})(?!\d)"), F.lit(1)), lambda v: v.cast("int")))
    return F.when((width > 0) & (height > 0), F.least(width, height)).otherwise(told)


def matches_profile(profile: dict[str, object]) -> Column:
    """Whether every column has the value of the profile; a null never matches."""
    test = F.lit(True)
    for name, value in profile.items():
        test &= F.coalesce(F.col(name) == F.lit(value), F.lit(False))
    return test


def proxy_required(width: Column, height: Column, rotation: Column, max_width: int = 1280, max_height: int = 720) -> Column:
    """Whether the picture as shown, after a quarter turn, is larger than a policy allows."""
    turned = F.pmod(F.abs(rotation), F.lit(180)) == 90
    return F.when(turned, (height > max_width) | (width > max_height)).otherwise((width > max_width) | (height > max_height))


def unpack_words(x: Column) -> Column:
    """The little-endian unsigned 32-bit numbers of a binary value; a length that 4 does not divide is an error."""
    error = F.raise_error(F.lit("malformed raw fingerprint")).cast("array<bigint>")
    byte = lambda w, b: F.substring(w, b * 2 + 1, 2)
    number = lambda w: F.conv(F.concat(*(byte(w, b) for b in (3, 2, 1, 0))), 16, 10).cast("long")
    # The value is named once, so that one that is itself computed is not computed for each word.
    words = F.transform(F.regexp_extract_all(F.hex(x), F.lit("(.{8})"), F.lit(1)), number)
    return F.when(F.octet_length(x) % 4 != 0, error).otherwise(words)


def difference_hash(pixels: Column) -> Column:
    """64 bits of 8 rows of 9 grey values, first bit highest, as a signed number: whether a value is above its right neighbour."""
    none = F.lit(0).cast("long")
    start = F.struct(none.alias("h"), none.alias("left"), none.alias("n"))

    def step(s: Column, x: Column) -> Column:
        above = F.shiftleft(s["h"], 1).bitwiseOR((s["left"] > x).cast("long"))
        return F.struct(F.when(s["n"] % 9 == 0, s["h"]).otherwise(above).alias("h"), x.cast("long").alias("left"), (s["n"] + 1).alias("n"))

    return F.aggregate(pixels, start, step, lambda s: F.when(s["n"] == 72, s["h"]))


# Characters and names that file systems refuse.
FORBIDDEN_CHARACTERS = '<>:"/\\|?*'
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"{name}{k}" for name in ("COM", "LPT") for k in range(1, 10)))


def safe_title(x: Column, max_length: int = 80) -> Column:
    """A text as a file name; one that had to be changed or cut ends with ``--`` and 8 digits of its SHA-256."""

    @F.pandas_udf("string")
    def plain(values: pd.Series) -> pd.Series:
        # Compatibility forms and categories of characters are not to be had in SQL.
        named = values.map(lambda v: None if v is None else "".join("_" if unicodedata.category(c)[0] == "C" else c for c in unicodedata.normalize("NFKC", v)))
        return named.str.replace(f"[{re.escape(FORBIDDEN_CHARACTERS)}]", "_", regex=True).str.replace(r"\s+", " ", regex=True).str.strip(" .")

    name = plain(x)
    name = F.when(name == "", "untitled").otherwise(name)
    name = F.when(F.upper(F.substring_index(name, ".", 1)).isin(*RESERVED_NAMES), F.concat(F.lit("_"), name)).otherwise(name)
    short = F.concat(F.rtrim(F.substring(name, 1, max_length - 10), F.lit(" .")), F.lit("--"), F.substring(F.sha2(x, 256), 1, 8))
    return F.when((name != x) | (F.char_length(name) > max_length), short).otherwise(name)


def safe_identity(x: Column, readable: int = 10) -> Column:
    """The first letters and digits of an id, ``--`` and 8 digits of its SHA-256; only the digits if ``readable`` is zero."""
    digest = F.substring(F.sha2(x, 256), 1, 8)
    if readable <= 0:
        return digest

    @F.pandas_udf("string")
    def plain(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else "".join(c if c.isalnum() or c in "-_." else "_" for c in unicodedata.normalize("NFKC", v)).strip(" ._")[:readable].rstrip(" ._"))

    name = plain(x)
    return F.concat(F.when(name == "", "id").otherwise(name), F.lit("--"), digest)
