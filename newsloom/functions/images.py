"""Image URL column builders: size hints, usability rules, identity keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import urls as U
from newsloom.functions.html import bare_host, join_url
from newsloom.functions.texts import bind, contains_any

# Words, suffixes and sizes of the image rules.
LOW_QUALITY_TERMS = ("thumbnail", "thumb", "small", "tiny", "preview", "sprite")
BLOCKED_TERMS = (
    "logo", "icon", "avatar", "sprite", "favicon", "banner", "adserver", "pixel", "nojs", "placeholder", "blank",
)
BLOCKED_URLS = (
    "https://kun.uz/assets/6f64f80/img/business-bg.png", "https://kun.uz/assets/6f64f80/img/business-bg-img.png",
)
NON_IMAGE_SUFFIXES = (".js", ".css", ".json", ".xml", ".txt", ".pdf", ".woff", ".woff2", ".ttf", ".map")
DRAWING_SUFFIXES = (".svg", ".ico", ".gif")
MIN_HINT_WIDTH, MIN_HINT_HEIGHT = 640, 360
MIN_PUBLIC_WIDTH, MIN_PUBLIC_HEIGHT = 720, 400
MIN_ANY_WIDTH, MIN_ANY_HEIGHT = 360, 220
EXTRACTOR_BAD_WORDS = (
    "logo", "banner", "ads", "adserver", "icon", "avatar", "sprite", "thumb", "thumbnail", "placeholder",
)
EXTRACTOR_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".avif")
# The published lists of two rules together, each word once.
REJECTED_WORDS = (
    "logo", "icon", "avatar", "banner", "ads", "sprite", "placeholder", "pixel", "badge", "doubleclick", "googlesyndication",
)
STOCK_TERMS = (
    "mountain", "nature", "landscape", "forest", "beach", "sunset", "wallpaper", "background", "abstract", "businesswoman",
    "businessman",
)
TRACKING_KEYS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid", "ref",
    "ref_src", "source",
)
ID_KEYS = ("id", "img", "image", "photo", "media", "file", "filename", "name", "asset")
SIZE_PAIR = r"(?<!\d)(\d{2,4})[xX](\d{2,4})(?!\d)"
PATH_WIDTH = r"/(?:standard|news|thumb|thumbnail)/(\d{2,4})/"


def _ends_with_any(c: Column, suffixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | c.endswith(s)
    return out


def _number(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9]{1,9}$"), text.cast("int"))


def path_and_query(url: Column) -> Column:
    return F.concat_ws(" ", U.part(url, U.PATH), U.part(url, U.QUERY))


def size_hints(url: Column, width_keys: Sequence[str], height_keys: Sequence[str], path_width: bool = False) -> Column:
    """struct(width, height) from query parameters, a WxH pair, or a width folder; null where unknown."""
    query = U.part(url, U.QUERY)
    pair = path_and_query(url)
    widths = [_number(U.query_value(query, k)) for k in width_keys] + [_number(F.regexp_extract(pair, SIZE_PAIR, 1))]
    heights = [_number(U.query_value(query, k)) for k in height_keys] + [_number(F.regexp_extract(pair, SIZE_PAIR, 2))]
    if path_width:
        widths.append(_number(F.regexp_extract(U.part(url, U.PATH), PATH_WIDTH, 1)))
    return F.struct(F.coalesce(*widths).alias("width"), F.coalesce(*heights).alias("height"))


def candidate_size(url: Column) -> Column:
    return size_hints(url, ("w", "width", "imgw", "maxwidth"), ("h", "height", "imgh", "maxheight"))


def image_size(url: Column) -> Column:
    return size_hints(F.lower(F.trim(url)), ("w", "width", "imgw"), ("h", "height", "imgh"), path_width=True)


def candidate_ok(url: Column) -> Column:
    """Quality rule of the article feed: absolute, no low-quality word, no drawing, size not below minimum."""
    value = F.trim(F.coalesce(url, F.lit("")))
    size = candidate_size(value)
    return (
        value.rlike("(?i)^https?://")
        & ~contains_any(F.lower(value), LOW_QUALITY_TERMS)
        & ~_ends_with_any(F.lower(U.part(value, U.PATH)), DRAWING_SUFFIXES)
        & ~(F.coalesce(size["width"] < MIN_HINT_WIDTH, F.lit(False)))
        & ~(F.coalesce(size["height"] < MIN_HINT_HEIGHT, F.lit(False)))
    )


def news_photo(url: Column) -> Column:
    """Rule of the public image list: no blocked word or suffix, and no size hint below the public minimum."""

    def rule(value: Column) -> Column:
        combined, path, size = path_and_query(value), U.part(value, U.PATH), image_size(value)
        width, height = size["width"], size["height"]
        too_small = (
            F.coalesce(width < MIN_PUBLIC_WIDTH, F.lit(False))
            | F.coalesce(height < MIN_PUBLIC_HEIGHT, F.lit(False))
            | F.coalesce(width * height < MIN_PUBLIC_WIDTH * MIN_PUBLIC_HEIGHT, F.lit(False))
        )
        pairs = F.regexp_extract_all(combined, F.lit(f"({SIZE_PAIR})"), F.lit(1))
        tiny = F.exists(
            pairs,
            lambda p: (F.substring_index(F.lower(p), "x", 1).cast("int") < MIN_ANY_WIDTH)
            | (F.substring_index(F.lower(p), "x", -1).cast("int") < MIN_ANY_HEIGHT),
        )
        return (
            (value != "")
            & ~value.isin(*BLOCKED_URLS)
            & ~contains_any(combined, BLOCKED_TERMS + LOW_QUALITY_TERMS)
            & ~_ends_with_any(path, DRAWING_SUFFIXES + NON_IMAGE_SUFFIXES)
            & ~too_small
            & ~tiny
        )

    return bind(F.lower(F.trim(F.coalesce(url, F.lit("")))), rule)


def extractor_ok(url: Column) -> Column:
    """Rule of the page extractor: no bad word, an image suffix or an image folder."""
    value = F.lower(F.coalesce(url, F.lit("")))
    path = U.part(value, U.PATH)
    shaped = _ends_with_any(path, EXTRACTOR_SUFFIXES) | path.contains("img") | path.contains("images")
    return (value != "") & ~value.startswith("data:") & ~contains_any(value, EXTRACTOR_BAD_WORDS) & shaped


def rejected(url: Column) -> Column:
    """Rule of the image resolver: empty, inline, drawing or tell-tale word."""
    value = F.lower(F.coalesce(url, F.lit("")))
    return (value == "") | value.startswith("data:") | value.contains(".svg") | contains_any(value, REJECTED_WORDS)


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def normalize_candidate_url(url: Column, base: Column) -> Column:
    """Absolute image address from a protocol-relative, relative or bare one; null if there is none.

    Known small variants of one picture service are raised to width 1024.
    """
    value = F.trim(F.coalesce(url, F.lit("")))
    inline = F.lower(value).startswith("data:") | F.lower(value).startswith("javascript:")
    value = F.when(value.startswith("//"), F.concat(F.lit("https:"), value)).otherwise(value)
    absolute = r"(?i)^https?://"
    has_base = F.coalesce(base, F.lit("")) != ""
    joined = F.when(has_base & ~value.rlike(absolute), join_url(base, value)).otherwise(value)

    def finish(v: Column) -> Column:
        guessed = F.concat(F.lit("https://"), F.regexp_replace(v, "^/+", ""))
        host = U.part(guessed, U.AUTHORITY)
        full = F.when(v.rlike(absolute), v).when(host.contains(".") | (host == "localhost"), guessed)
        # widths from 10 to 719; the look-ahead keeps the group number apart from the digits
        small = r"(?<=/ace/standard/|/news/)(?:\d{2}|[1-6]\d{2}|7[01]\d)(?=/)"
        raised = F.regexp_replace(full, small, "1024")
        return F.when(F.lower(U.part(full, U.AUTHORITY)).contains("ichef.bbci.co.uk"), raised).otherwise(full)

    return F.when((value != "") & ~inline, bind(joined, finish))


def canonical_image_key(url: Column) -> Column:
    """Host, path and id-like parameters; tracking parameters do not matter."""

    def key(u: Column) -> Column:
        path = F.coalesce(F.nullif(U.part(u, U.PATH), F.lit("")), F.lit("/"))
        path = F.regexp_replace(path, "/+", "/")
        query = U.part(u, U.QUERY)
        named = F.array_compact(
            F.array(*[
                F.when(U.query_value(query, k) != "",
                       F.concat(F.lit(f"{k}="), U.encode_component(F.trim(U.decode_component(U.query_value(query, k))))))
                for k in sorted(ID_KEYS)
            ])
        )
        suffix = F.array_join(named, "&")
        return F.concat(bare_host(u), path, F.when(suffix != "", F.concat(F.lit("?"), suffix)).otherwise(""))

    return F.when(F.trim(url) == "", "").otherwise(bind(F.lower(F.trim(url)), key))


def visual_image_key(url: Column) -> Column:
    """Host and path with size and quality parts replaced, equal for variants of one picture."""

    def key(u: Column) -> Column:
        path = F.coalesce(F.nullif(U.part(u, U.PATH), F.lit("")), F.lit("/"))
        path = F.regexp_replace(U.decode_component(F.replace(path, F.lit("+"), F.lit("%2B"))), "/+", "/")
        path = F.regexp_replace(path, SIZE_PAIR.replace("(\\d{2,4})", "\\d{2,4}"), "{size}")
        path = F.regexp_replace(path, r"(w|h|width|height|q|quality)[=_-]?\d{1,4}", "$1={n}")
        path = F.regexp_replace(path, "/+$", "")
        return F.concat(bare_host(u), F.when(path == "", "/").otherwise(path))

    return F.when(F.trim(url) == "", "").otherwise(bind(F.lower(F.trim(url)), key))
