"""Page column builders: signals and fields read from HTML by portable patterns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import texts as X
from newsloom.functions import urls as U

# Fixed patterns of the page formats.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
JSON_LD = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
META_TAG = r"(?is)<meta\s[^>]*>"
HREF = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"
TITLE = r"(?is)<title[^>]*>([^<]*)</title>"
H1 = r"(?is)<h1[^>]*>(.*?)</h1>"
PARAGRAPH = r"(?is)<p(?:\s[^>]*)?>(.*?)(?:</p>|$)"
BLOCK_EDGE = r"(?i)(?=</?(?:article|main|section|div)[\s>])"
BLOCK_OPEN = r"(?i)^<(?:article|main|section|div)[\s>]"
BLOCK_CLOSE = r"(?i)^</(?:article|main|section|div)[\s>]"
ARTICLE_TYPES = r'"@?type"\s*:\s*(?:\[[^\]]*)?"(?:NewsArticle|Article)"'
IMAGE_TAG = r"(?is)<img\s[^>]*>"
TEXT = r">[^<]*[^<\s]"
IMAGE_ENDINGS = r"\.(?:jpg|jpeg|png|webp|gif|avif)$"
BAD_IMAGE_WORDS = ("logo", "banner", "ads", "adserver", "icon", "avatar", "sprite", "thumb", "thumbnail", "placeholder")
SMALL_IMAGE_WORDS = ("thumb", "thumbnail", "small", "icon", "sprite")
MIN_IMAGE_WIDTH = 240
# Selectors of single sites, tried in this order.
SITE_SELECTORS = {
    "gazeta.uz": {
        "title": ("h1.article__title",),
        "body": ("div[itemprop=articleBody]", ".article__content", ".article-content", ".post-content", ".entry-content"),
        "image": (),
    },
    "daryo.uz": {
        "title": ("h1.post__title",),
        "body": (
            ".news-section-main-content", ".post-content", ".article-body", ".entry-content", ".post-text", ".article__body",
            "div[itemprop=articleBody]", "article",
        ),
        "image": (".article-body", ".post-content", "figure"),
    },
    "kun.uz": {
        "title": ("h1.article-title",),
        "body": (".news-text", ".article__text", ".article-text", ".content", ".entry-content", "article"),
        "image": (".news-text", ".article__text", "figure"),
    },
}


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles and comments."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    return X.strip(X.collapse_space(X.unescape_html(X.strip_tags(shown, " "))))


def inner_text(fragment: Column) -> Column:
    return X.strip(X.collapse_space(X.unescape_html(X.strip_tags(fragment, " "))))


def tag_count(html: Column, tag: str) -> Column:
    return F.regexp_count(F.coalesce(html, F.lit("")), F.lit(rf"(?i)<{tag}[\s>]"))


def attribute(tag: Column, name: str) -> Column:
    """Value of a quoted attribute; empty if absent."""
    return F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def all_matches(html: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(group))


def meta_content(html: Column, names: Sequence[str]) -> Column:
    """Content of the first meta tag whose property, name or itemprop is one of ``names``."""
    alternatives = "|".join(n.replace(".", r"\.") for n in names)
    marker = rf"(?is)\s(?:property|name|itemprop)\s*=\s*[\"'](?:{alternatives})[\"']"
    found = F.filter(all_matches(html, META_TAG), lambda m: m.rlike(marker))
    return F.nullif(F.trim(attribute(F.get(found, F.lit(0)), "content")), F.lit(""))


def json_ld_blocks(html: Column) -> Column:
    """Bodies of the JSON-LD scripts that hold valid JSON."""
    return F.filter(all_matches(html, JSON_LD, 1), lambda b: F.try_parse_json(b).isNotNull())


def page_title(html: Column, host: Column | None = None) -> Column:
    """og:title or twitter:title, else the title tag, else the first h1; sites with rules put their headings before the title tag."""
    title = F.nullif(X.strip(X.unescape_html(F.regexp_extract(html, TITLE, 1))), F.lit(""))
    h1 = page_h1(html)
    heading = F.lit(None).cast("string")
    if host is not None:
        known = F.lit(False)
        for site in SITE_SELECTORS:
            known = known | (host == site) | host.endswith(f".{site}")
        heading = F.when(known, F.coalesce(F.nullif(inner_text(site_element(html, host, "title", TEXT)), F.lit("")), h1))
    return F.coalesce(meta_content(html, ["og:title"]), meta_content(html, ["twitter:title"]), heading, title, h1)


def page_h1(html: Column) -> Column:
    return F.nullif(inner_text(F.regexp_extract(html, H1, 1)), F.lit(""))


def largest_block(shown: Column) -> Column:
    """Text of the outermost article, main, section or div that has the most; empty without one.

    One walk over the parts between block tags.  Its state is the nesting depth
    and the bounds and sizes of the block at hand and of the best one so far,
    so a page takes time in proportion to its length.  A block's size is that
    of its visible characters without blanks; one that is never closed runs to
    the end of the page.
    """
    none = F.lit(0)
    start = F.struct(
        none.alias("at"), none.alias("depth"), none.alias("first"), none.alias("size"),
        F.struct(none.alias("size"), none.alias("first"), none.alias("n")).alias("best"),
    )

    def better(s: Column, first: Column, n: Column, size: Column) -> Column:
        return F.when(size > s["best"]["size"], F.struct(size.alias("size"), first.alias("first"), n.alias("n"))).otherwise(s["best"])

    def step(s: Column, part: Column) -> Column:
        at = s["at"] + 1
        closes = part.rlike(BLOCK_CLOSE) & (s["depth"] > 0)
        opens = part.rlike(BLOCK_OPEN)
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        ends = closes & (s["depth"] == 1)
        begins = opens & (s["depth"] == 0)
        inside = F.when(depth > 0, F.length(F.regexp_replace(part, r"<[^>]+>|\s+", ""))).otherwise(0)
        return F.struct(
            at.alias("at"),
            depth.alias("depth"),
            F.when(begins, at).otherwise(s["first"]).alias("first"),
            (F.when(begins, 0).otherwise(s["size"]) + inside).alias("size"),
            F.when(ends, better(s, s["first"], at - s["first"], s["size"])).otherwise(s["best"]).alias("best"),
        )

    def last(s: Column) -> Column:
        return F.when(s["depth"] > 0, better(s, s["first"], s["at"] - s["first"] + 1, s["size"])).otherwise(s["best"])

    def text(parts: Column) -> Column:
        best = F.aggregate(parts, start, step, last)
        return X.bind(best, lambda b: F.when(b["n"] > 0, inner_text(F.array_join(F.slice(parts, b["first"], b["n"]), ""))).otherwise(""))

    return X.bind(F.split(shown, BLOCK_EDGE), text)


def open_tag(selector: str) -> str:
    """Pattern of the opening tags that a selector of the form ``tag.class[name=value]`` takes; each part may be left out."""
    tag, css_class, name, value = re.fullmatch(r"([a-z][a-z0-9]*)?(?:\.([\w-]+))?(?:\[(\w+)=([\w:]+)\])?", selector).groups()
    pattern = rf"(?is)<({tag or '[a-z][a-z0-9]*'})(?=[\s>/])"
    if css_class:
        pattern += rf"(?=[^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?{css_class}[\s\"'])"
    if name:
        pattern += rf"(?=[^>]*\s{name}\s*=\s*[\"']?{value}[\s\"'>])"
    return pattern + "[^>]*>"


def element(shown: Column, pattern: Column) -> Column:
    """The first element whose opening tag a pattern takes, from that tag to its end; null without one.

    Its end is where as many tags of its name have closed as opened: one walk
    over the parts between such tags.  One never closed runs to the page's end.
    """

    def whole(rest: Column) -> Column:
        name = F.regexp_extract(rest, r"^<([A-Za-z][A-Za-z0-9]*)", 1)
        parts = F.split(rest, F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"[\s>/])")))
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

        def step(s: Column, part: Column) -> Column:
            depth = s["depth"] + F.when(part.startswith("</"), -1).otherwise(1)
            ends = (depth == 0) & (s["end"] == 0)
            return F.struct((s["at"] + 1).alias("at"), depth.alias("depth"), F.when(ends, s["at"]).otherwise(s["end"]).alias("end"))

        def taken(p: Column) -> Column:
            end = F.aggregate(p, start, step, lambda s: F.when(s["end"] > 0, s["end"]).otherwise(s["at"]))
            return F.array_join(F.slice(p, F.lit(1), end), "")

        return X.bind(parts, taken)

    at = F.regexp_instr(shown, pattern)
    return X.bind(at, lambda a: F.when(a > 0, X.bind(F.substring(shown, a, F.length(shown)), whole)))


def site_element(shown: Column, host: Column, rule: str, holds: str) -> Column:
    """Element of the first selector of the host's site whose element holds a pattern; null on other hosts.

    The selectors are data, so that the expression stays as small as that of one.
    """
    patterns = F.lit(None).cast("array<string>")
    for site, rules in SITE_SELECTORS.items():
        here = (host == site) | host.endswith(f".{site}")
        patterns = F.when(here, F.array(*[F.lit(open_tag(s)) for s in rules[rule]]).cast("array<string>")).otherwise(patterns)

    def tried(found: Column, pattern: Column) -> Column:
        return F.coalesce(found, X.bind(element(shown, pattern), lambda e: F.when(e.rlike(holds), e)))

    return F.aggregate(patterns, F.lit(None).cast("string"), tried)


def paragraphs(shown: Column) -> Column:
    """Texts of the paragraphs; an unclosed one ends where the next one starts."""
    pieces = F.regexp_extract_all(
        F.regexp_replace(shown, r"(?is)<p(?:\s[^>]*)?>", "</p><p>"), F.lit(r"(?is)<p>(.*?)(?:</p>|$)"), F.lit(1)
    )
    return F.transform(pieces, inner_text)


def _joined(texts: Column, min_chars: int = 0) -> Column:
    """Texts longer than ``min_chars``, joined by blank lines; null without one."""
    return X.bind(F.filter(texts, lambda p: F.length(p) > min_chars), lambda kept: F.when(F.size(kept) > 0, F.array_join(kept, "\n\n")))


def element_body(fragment: Column, min_chars: int = 40) -> Column:
    """Paragraphs of an element longer than ``min_chars``, else all of them, else its text; null if that is empty."""
    return X.bind(
        paragraphs(fragment),
        lambda texts: F.coalesce(_joined(texts, min_chars), _joined(texts), F.nullif(inner_text(fragment), F.lit(""))),
    )


def page_body(html: Column, host: Column | None = None, min_chars: int = 50) -> Column:
    """Body of a page: by the selectors of its site, else paragraphs longer than ``min_chars``, joined by blank lines.

    Without one, the text of the largest block; without a block, all paragraphs.
    """

    def generic(shown: Column) -> Column:
        return X.bind(
            paragraphs(shown),
            lambda texts: F.coalesce(_joined(texts, min_chars), F.nullif(largest_block(shown), F.lit("")), _joined(texts), F.lit("")),
        )

    def body(shown: Column) -> Column:
        if host is None:
            return generic(shown)
        own = X.bind(site_element(shown, host, "body", TEXT), lambda e: F.when(e.isNotNull(), element_body(e)))
        return F.coalesce(own, generic(shown))

    return X.bind(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " "), body)


def source_of(tag: Column, names: Sequence[str]) -> Column:
    """The first of the named attributes that is filled; null without one."""
    return F.coalesce(*[F.nullif(F.trim(attribute(tag, n)), F.lit("")) for n in names])


def largest_in_srcset(tag: Column) -> Column:
    """Address of the widest entry of an image tag's srcset."""
    parts = F.filter(F.transform(F.split(attribute(tag, "(?:data-)?srcset"), ","), lambda p: F.trim(p)), lambda p: p != "")
    sized = F.transform(
        parts,
        lambda p: F.struct(
            F.coalesce(F.nullif(F.regexp_extract(p, r"\s(\d{1,9})[wWx]$", 1), F.lit("")).cast("int"), F.lit(0)).alias("n"),
            F.substring_index(p, " ", 1).alias("u"),
        ),
    )
    return F.array_max(sized)["u"]


def good_image(address: Column) -> Column:
    """An address that names a picture and no logo, banner or other small part of a page."""
    low = F.lower(address)
    path = U.part(low, U.PATH)
    named = path.rlike(IMAGE_ENDINGS) | path.contains("images") | path.contains("img")
    return ~low.startswith("data:") & ~X.contains_any(low, BAD_IMAGE_WORDS) & named


def large_image(html: Column, url: Column) -> Column:
    """First good image in order of trust: srcset entries, sources not small, then any source; null without one."""
    tags = all_matches(html, IMAGE_TAG)

    def absolute(address: Column) -> Column:
        return F.regexp_replace(join_url(url, address), r"[?#].*$", "")

    def good(addresses: Column) -> Column:
        return F.get(F.filter(F.transform(F.array_compact(addresses), absolute), good_image), F.lit(0))

    def large(tag: Column) -> Column:
        width = F.coalesce(*[F.nullif(F.regexp_extract(tag, rf"(?is)\s{n}\s*=\s*[\"']?(\d{{1,9}})[\s\"'/>]", 1), F.lit("")) for n in ("width", "data-width")])
        return F.coalesce(width.cast("int") >= MIN_IMAGE_WIDTH, F.lit(True))

    def first(found: Column) -> Column:
        sources = F.transform(F.filter(found, large), lambda t: source_of(t, ("src", "data-src", "data-lazy-src")))
        plain = F.filter(F.array_compact(sources), lambda u: ~X.contains_any(F.lower(u), SMALL_IMAGE_WORDS))
        return F.coalesce(
            good(F.transform(found, largest_in_srcset)), good(plain), good(F.transform(found, lambda t: source_of(t, ("src", "data-src"))))
        )

    return X.bind(tags, lambda found: F.when(F.size(found) > 0, first(found)))


def page_image(html: Column, url: Column, host: Column) -> Column:
    """Image named in the head, else the first in the site's image blocks, else the first large one."""
    link = F.get(F.filter(all_matches(html, r"(?is)<link\s[^>]*>"), lambda m: attribute(m, "rel") == "image_src"), F.lit(0))
    named = F.coalesce(
        meta_content(html, ["og:image"]), meta_content(html, ["twitter:image"]), F.nullif(F.trim(attribute(link, "href")), F.lit(""))
    )
    own = source_of(F.regexp_extract(site_element(html, host, "image", IMAGE_TAG), IMAGE_TAG, 0), ("src", "data-src"))
    head = F.coalesce(named, own)
    return F.coalesce(X.bind(head, lambda h: F.regexp_replace(join_url(url, h), r"[?#].*$", "")), large_image(html, url))


def origin(url: Column) -> Column:
    return F.concat(U.part(url, U.SCHEME), F.lit("://"), U.part(url, U.AUTHORITY))


def join_url(base: Column, ref: Column) -> Column:
    """Absolute form of a reference found on the page ``base``."""
    path = U.part(base, U.PATH)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), r"[^/]*$", "")
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(ref.startswith("//"), F.concat(U.part(base, U.SCHEME), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin(base), ref))
        .when(ref.startswith("?"), F.concat(origin(base), path, ref))
        .when(ref.startswith("#") | (ref == ""), F.concat(F.regexp_replace(base, "#.*$", ""), ref))
        .otherwise(F.concat(origin(base), folder, F.regexp_replace(ref, r"^\./", "")))
    )


def bare_host(url: Column) -> Column:
    """Lower-case authority without a leading www."""
    return F.regexp_replace(F.lower(U.part(url, U.AUTHORITY)), r"^www\.", "")
