"""Jobs over tables of landed pages.

All fields come from one pass of column expressions over the page row; only
the reason counts of the funnel shuffle, after partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import html as H
from newsloom.functions import images as I
from newsloom.functions import texts as X
from newsloom.functions import urls as U

# Page rules, phrases, thresholds.
NON_ARTICLE_HREF = r"(?i)(mailto:|tel:|#|/tag/|/category/|/authors?/|/search|/subscribe|/rss|/wp-content/|javascript:)"
DATE_PATH = r"/\d{4}/\d{2}/\d{2}/"
LISTING_PATH = (
    r"(?i)/(list|tag|category|categories|archive|auth|login|register|contacts?|contact|about|reklama|ads|photo|photos|video|"
    r"videos|gallery|catalog|section|page)(/|$|\?)"
)
SITE_RULES = {
    "daryo.uz": {"positive": (DATE_PATH,), "negative": ()},
    "kun.uz": {
        "positive": (r"^/news/", r"/news/\d{4}/\d{2}/\d{2}/"),
        "negative": (r"/news/list", r"/news/audio", r"/news/editors-choice", r"/news/time/"),
    },
    "gazeta.uz": {"positive": (DATE_PATH,), "negative": (r"/ru/$", r"/ru/list", r"/list")},
    "podrobno.uz": {"positive": (DATE_PATH,), "negative": (r"^/$", r"/cat/", r"/project/")},
    "uznews.uz": {"positive": (r"/ru/news/\d+", r"/ru/articles/", DATE_PATH), "negative": ()},
}
BAD_URL_PARTS = ("editors-choice", "/time/", "/list", "/category", "/tag", "/tags")
LONG_PAGE_CHARS, ARTICLE_SCORE, MIN_BODY_CHARS = 1000, 2, 300
UI_PHRASES = (
    "Izoh qoldirish", "ro‘yxatdan", "Xato topdingizmi", "Daryo internet-nashri", "cookies", "cookie", "Guvohnoma",
    "Elektron manzil", "Matnli materiallarni", "kabinet", "ctrl+enter", "18+", "chop etiladigan", "muallif", "muallifligini",
)
REMOVED_PHRASES = (
    "Izoh qoldirish", "Izoh qoldirish uchun", "ro‘yxatdan o‘ting", "ro‘yxatdan oting", "ro‘yxatdan", "Xato topdingizmi",
    "internet-nashrining", "Daryo internet-nashrining", "Matnli materiallarni to‘liq ko‘chirish", "Biz sayt ishlashini",
    "cookies-fayllardan", "cookies", "Maxfiylik siyosati", "Tungi ko‘rinish", "Guvohnoma", "Kabinet", "Ctrl+Enter",
    "Ctrl+Enter’ni bosing", "18+", "Chop etiladigan", "Muassis", "Ishlab chiquvchi", "Elektron manzil",
    "Saytda e’lon qilingan", "Saytda e'lon qilingan", "Saytda eʼlon qilingan",
)
CUT_MARKERS = (
    "©", "Elektron manzil:", "Guvohnoma:", "Saytda e’lon qilingan", "Saytda e'lon qilingan", "Maxfiylik siyosati", "cookies",
)
# One published phrase is a pattern that plain text never equals and is left out.
LEGAL_PHRASES = (
    "guvohnoma", "axborot va ommaviy kommunikatsiyalar agentligi", "o'zmaa", "o‘zmaa",
    "o‘zbekiston matbuot va axborot agentligi",
)
LEGAL_SEPARATORS = ("\n\n", "\r\n\r\n", ". ", "? ", "! ", "\n")
LEGAL_HEAD_CHARS = 200
BAD_PARAGRAPH_PHRASES = (
    "izoh qoldirish", "ro‘yxatdan", "xato topdingizmi", "daryo internet-nashri", "daryo internet nashr", "internet-nashr",
    "cookie", "guvohnoma", "elektron manzil", "matnli materiallarni to‘liq ko‘chirish", "©", "o‘zmaa",
    "axborot va ommaviy kommunikatsiyalar agentligi",
)
LICENSE_NUMBER = r"\d{3,6}-sonli"
AD_KEYWORDS = (
    "reklama", "aksiya", "chegirma", "hamkorlik", "maxsus taklif", "promo", "sponsor", "sponsorlik", "реклама", "акция",
    "скидка", "партн", "партнёр", "партнер", "партнерство", "advertisement", "promotion", "trade-in", "trade in",
)
# Each published marker once.
NAV_MARKERS = ("kabinet", "bosh sahifa", "tasma", "menyu", "videolar")
COMMENT_MARKERS, MAKER_MARKERS = ("izoh", "ro'yxatdan", "ro‘yxatdan"), ("ishlab chiquvchi", "ishlab chiqaruvchi")
RIGHTS_MARKERS, FOOTER_MARKERS = ("©", "copyright"), ("ishlab", "izoh")
DATE_META = ("article:published_time", "date", "datePublished", "pubdate")
TODAY_WORDS, YESTERDAY_WORDS = ("today", "сегодня", "bugun"), ("yesterday", "вчера", "kecha")
HOURS_AGO = r"(\d+)\s*(?:hours|hour|час|часа|soat|soat oldin|oldin)"
MINUTES_AGO = r"(\d+)\s*(?:minutes|min|минут|daqiqa)"
LOCAL_ZONE = "Asia/Tashkent"
# Month names as dates use them; the first three letters of those of a list in ABBREVIATED stand for them too.
MONTHS_EN = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTHS_RU = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
MONTHS_UZ = ("yanvar", "fevral", "mart", "aprel", "may", "iyun", "iyul", "avgust", "sentabr", "oktabr", "noyabr", "dekabr")
ABBREVIATED = (MONTHS_EN, MONTHS_RU)
SAMPLE_RATE = 0.2


def page_links(pages: DataFrame, max_links: int | None = None) -> DataFrame:
    """(page_id, pos, link): distinct same-site links in page order, the first ``max_links`` of each page if given."""
    base = F.col("url")
    hrefs = F.filter(F.transform(H.all_matches(F.col("html"), H.HREF, 1), X.strip), lambda h: (h != "") & ~h.rlike(NON_ARTICLE_HREF))
    full = F.transform(hrefs, lambda h: H.join_url(base, h))
    same = F.filter(full, lambda u: H.bare_host(u).isin("") | (H.bare_host(u) == H.bare_host(base)))
    links = F.array_distinct(F.transform(same, lambda u: F.regexp_replace(u, "#.*$", "")))
    if max_links is not None:
        links = F.slice(links, 1, max_links)
    return pages.select("page_id", F.posexplode(links).alias("pos", "link"))


def article_url_flag(url: Column) -> Column:
    """Whether an address looks like an article: date path, site rules, listings, deep slug, .html."""
    path = F.coalesce(F.nullif(U.part(url, U.PATH), F.lit("")), F.lit("/"))
    host = H.bare_host(url)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    last = F.element_at(segments, -1)
    deep = F.when(F.size(segments) >= 3, last.contains("-") | last.rlike(r"\d") | (F.length(last) > 20)).otherwise(False)
    rule = F.when(path.rlike(DATE_PATH), True)
    for site, patterns in SITE_RULES.items():
        here = host.endswith(site)
        for p in patterns["negative"]:
            rule = rule.when(here & path.rlike(p), False)
        for p in patterns["positive"]:
            rule = rule.when(here & path.rlike(p), True)
        rule = rule.when(here, deep)
    rule = rule.when(path.rlike(LISTING_PATH), False)
    return F.when(F.coalesce(url, F.lit("")) == "", False).otherwise(
        rule.otherwise(deep | path.endswith(".html") | path.endswith(".htm"))
    )


def bad_url(url: Column) -> Column:
    return F.coalesce(X.contains_any(F.lower(url), BAD_URL_PARTS), F.lit(False))


def article_page_score(pages: DataFrame) -> DataFrame:
    """Add the page signals, ``score`` and ``is_article``."""
    types = F.exists(H.json_ld_blocks(F.col("html")), lambda b: b.rlike(H.ARTICLE_TYPES))
    out = pages.withColumns(
        {
            "text_len": F.length(H.visible_text(F.col("html"))),
            "has_json_ld": types,
            "og_type": F.lower(F.coalesce(H.meta_content(F.col("html"), ["og:type"]), F.lit(""))),
            "is_bad_url": bad_url(F.col("url")),
        }
    )
    score = (
        F.when(F.col("has_json_ld"), 2).otherwise(0)
        + F.when(F.col("og_type") == "article", 2).otherwise(0)
        + F.when(F.col("text_len") > LONG_PAGE_CHARS, 1).otherwise(0)
        - F.when(F.col("is_bad_url"), 2).otherwise(0)
    )
    return out.withColumn("score", score).withColumn("is_article", F.col("score") >= ARTICLE_SCORE)


def page_fields(pages: DataFrame) -> DataFrame:
    """Add ``title``, ``h1``, ``body`` and ``image_url``: by the selectors of known sites, else by general rules."""
    html, url = F.col("html"), F.col("url")
    host = H.bare_host(url)
    return pages.withColumns(
        {
            "title": H.page_title(html, host),
            "h1": H.page_h1(html),
            "body": H.page_body(html, host),
            "image_url": H.page_image(html, url, host),
        }
    )


def _drop_legal_block(text: Column) -> Column:
    """Cut legal notices: a leading one with its sentence, a trailing one to the end."""
    lowered = F.lower(text)
    starts = F.filter(
        F.array(*[F.struct(F.locate(p, lowered).alias("at"), F.lit(len(p)).alias("n")) for p in LEGAL_PHRASES]),
        lambda e: e["at"] > 0,
    )

    def cut(first: Column) -> Column:
        rest = F.substring(text, first["at"] + first["n"], F.length(text))
        after = [
            F.when(F.instr(rest, s) > 0, F.substring(rest, F.instr(rest, s) + len(s), F.length(rest))) for s in LEGAL_SEPARATORS
        ]
        leading = X.strip(F.coalesce(*after, rest))
        trailing = X.strip(F.substring(text, F.lit(1), first["at"] - 1))
        return F.when(first["at"] - 1 <= LEGAL_HEAD_CHARS, leading).otherwise(trailing)

    return F.coalesce(X.bind(F.array_min(starts), lambda m: F.when(m.isNotNull(), cut(m))), text)


def clean_boilerplate(text: Column) -> Column:
    """Text without mail addresses, legal blocks and interface phrases."""

    def finish(t: Column) -> Column:
        for marker in CUT_MARKERS:
            t = F.substring_index(t, marker, 1)
        for phrase in REMOVED_PHRASES:
            t = F.replace(t, F.lit(phrase), F.lit(""))
        return X.strip(X.collapse_space(t))

    def rescue(t: Column) -> Column:
        segments = F.filter(F.transform(F.split(text, r"[\n.!?]+"), X.strip), lambda s: s != "")
        ranked = F.transform(segments, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("i"), s.alias("s")))
        longest = F.array_max(ranked)
        better = (t != "") & (F.length(t) < 120) & (longest["n"] > F.length(t))
        return F.when(better, X.collapse_space(longest["s"])).otherwise(t)

    without_mail = F.regexp_replace(text, r"\S+@\S+", "")
    return X.bind(X.bind(without_mail, lambda t: finish(_drop_legal_block(t))), rescue)


def boilerplate_filter(text: Column, min_chars: int = 200) -> Column:
    """Article part of a page text: no interface paragraphs, at most six, cut at legal marks.

    Falls back to the first plain paragraphs, then to the whole text; empty when
    less than ``min_chars`` remain.
    """

    def interface(p: Column) -> Column:
        return X.contains_any(F.lower(p), [ph.lower() for ph in UI_PHRASES])

    def enough(cleaned: Column) -> Column:
        return X.bind(cleaned, lambda c: F.when(F.length(c) >= min_chars, c))

    def choose(paras: Column) -> Column:
        marked = F.transform(paras, lambda p, i: F.struct(p.alias("p"), i.alias("i"), interface(p).alias("ui")))

        def pick(m: Column) -> Column:
            first = F.get(F.filter(m, lambda e: ~e["ui"] & (F.length(e["p"]) > 100)), F.lit(0))["i"]
            plain = F.filter(m, lambda e: ~e["ui"])
            content = F.filter(plain, lambda e: e["i"] >= F.coalesce(first, F.lit(0)))

            def joined(rows: Column) -> Column:
                return F.array_join(F.transform(F.slice(rows, 1, 6), lambda e: e["p"]), " ")

            return F.coalesce(enough(clean_boilerplate(joined(content))), enough(clean_boilerplate(joined(plain))))

        return X.bind(marked, pick)

    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.transform(F.split(body, r"\r\n|\r|\n"), X.strip), lambda p: p != "")
    parts = X.bind(lines, lambda ls: F.when(F.size(ls) > 1, ls).otherwise(X.sentences(body)))
    return F.coalesce(X.bind(parts, choose), enough(clean_boilerplate(body)), F.lit(""))


def good_paragraph(text: Column) -> Column:
    """A paragraph of 50 or more characters without interface or legal phrases."""
    low = F.lower(X.strip(F.coalesce(text, F.lit(""))))
    return (F.length(low) >= 50) & ~X.contains_any(low, BAD_PARAGRAPH_PHRASES) & ~low.rlike(LICENSE_NUMBER)


def _month_numbers() -> dict[str, int]:
    """Number of each month name and abbreviation."""
    found = {"sept": 9}
    for names in (MONTHS_EN, MONTHS_RU, MONTHS_UZ):
        for i, name in enumerate(names, 1):
            found[name] = i
            if names in ABBREVIATED:
                found[name[:3]] = i
    return found


def _named_day(text: Column) -> Column:
    """Day of the first date with a month name, day first or month first, with a year of four digits; null without one."""
    months = _month_numbers()
    name = "|".join(sorted(months, key=len, reverse=True))
    day, year, after = r"(\d{1,2})(?:st|nd|rd|th)?", r"(\d{4})(?!\d)", r"\.?(?!\p{L})"
    day_first = rf"(?<!\d){day}[\s.\-]+(?:of\s+)?({name}){after}[\s.,\-]*{year}"
    month_first = rf"(?<!\p{{L}})({name}){after}[\s.\-]*{day}[\s.,\-]+{year}"
    numbers = F.create_map(*[F.lit(x) for pair in months.items() for x in pair])

    def dated(pattern: str, d: int, m: int) -> Column:
        def read(match: Column) -> Column:
            month = F.try_element_at(numbers, F.regexp_extract(match, pattern, m)).cast("string")
            return F.try_to_timestamp(
                F.concat_ws("-", F.regexp_extract(match, pattern, 3), month, F.regexp_extract(match, pattern, d)), F.lit("yyyy-M-d")
            )

        return X.bind(F.regexp_extract(low, pattern, 0), lambda match: F.when(match != "", read(match)))

    low = F.lower(text)
    return F.coalesce(dated(day_first, 1, 2), dated(month_first, 2, 1))


def _absolute(text: Column, zone: str) -> Column:
    """Instant of an ISO, day-first, mail-style or month-name date anywhere in the text; local unless it names an offset."""
    iso = F.regexp_extract(text, r"(\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:[T ]\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:\s*(?:Z|[+-]\d{2}:?\d{2}))?)?)", 1)
    zoned = iso.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$") & iso.rlike(r"\d:\d{2}")
    iso_text = F.regexp_replace(F.replace(F.replace(iso, F.lit("/"), F.lit("-")), F.lit("T"), F.lit(" ")), r"\s+([+-])", "$1")
    iso_ts = F.try_to_timestamp(iso_text)
    # no part of a longer run of numbers, such as a network address
    dmy = r"(?<!\d)(?<!\d[./])(\d{1,2})[./](\d{1,2})[./](\d{4}|\d{2})(?![./]?\d)"
    year = F.regexp_extract(text, dmy, 3)
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    dmy_ts = F.try_to_timestamp(
        F.concat_ws("-", year, F.regexp_extract(text, dmy, 2), F.regexp_extract(text, dmy, 1)), F.lit("yyyy-M-d")
    )
    mail = r"(\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}) (?:([+-]\d{4})|GMT|UTC|Z)"
    mail_ts = F.try_to_timestamp(
        F.concat(F.regexp_extract(text, mail, 1), F.lit(" "), F.coalesce(F.nullif(F.regexp_extract(text, mail, 2), F.lit("")), F.lit("+0000"))),
        F.lit("d MMM yyyy HH:mm:ss Z"),
    )
    return F.coalesce(
        F.when(iso != "", F.when(zoned, iso_ts).otherwise(F.to_utc_timestamp(iso_ts, zone))),
        F.when(text.rlike(mail), mail_ts),
        F.when(year != "", F.to_utc_timestamp(dmy_ts, zone)),
        F.to_utc_timestamp(_named_day(text), zone),
    )


def _relative(text: Column, as_of: Column, zone: str) -> Column:
    """Instant of a clock time, today, yesterday or N hours/minutes ago; null for dated text."""
    t = F.lower(F.trim(text))
    today = F.date_trunc("day", F.from_utc_timestamp(as_of, zone))
    clock = r"(\d{1,2}):(\d{2})"

    def number(pattern: str, group: int = 1) -> Column:
        return F.try_to_number(F.nullif(F.regexp_extract(t, pattern, group), F.lit("")), F.lit("9999999")).cast("int")

    at_clock = today + F.make_interval(hours=F.coalesce(number(clock, 1), F.lit(0)), mins=F.coalesce(number(clock, 2), F.lit(0)))
    ago_h = as_of - F.make_interval(hours=F.coalesce(number(HOURS_AGO), F.lit(0)))
    ago_m = as_of - F.make_interval(mins=F.coalesce(number(MINUTES_AGO), F.lit(0)))
    return (
        F.when(t.rlike(r"\d{4}[-/]\d{1,2}[-/]\d{1,2}"), None)
        .when(t.rlike(clock), F.to_utc_timestamp(at_clock, zone))
        .when(X.contains_any(t, TODAY_WORDS), F.to_utc_timestamp(today, zone))
        .when(X.contains_any(t, YESTERDAY_WORDS), F.to_utc_timestamp(today - F.expr("INTERVAL 1 DAY"), zone))
        .when(t.rlike(HOURS_AGO), ago_h)
        .when(t.rlike(MINUTES_AGO), ago_m)
    )


def publish_date(html: Column, as_of: Column, zone: str = LOCAL_ZONE, head_chars: int | None = None) -> Column:
    """Publication instant: JSON-LD, meta tag, time tag, date element, then the text.

    ``head_chars`` limits the last resort to the beginning of the text.
    """
    ld_pattern = r'"(?:datePublished|dateCreated|uploadDate)"\s*:\s*"([^"]+)"'
    ld = F.get(F.filter(F.transform(H.json_ld_blocks(html), lambda b: F.regexp_extract(b, ld_pattern, 1)), lambda d: d != ""), F.lit(0))
    time_tag = F.regexp_extract(html, r"(?is)<time\b[^>]*>.*?</time>", 0)
    time_text = F.coalesce(F.nullif(H.attribute(time_tag, "datetime"), F.lit("")), H.inner_text(time_tag))
    element = H.inner_text(
        F.regexp_extract(html, r"(?is)<(?:div|span|p)\s[^>]*class\s*=\s*[\"'](?:[^\"']*\s)?(?:post-meta|article-meta|datetime|date)(?:\s[^\"']*)?[\"'][^>]*>(.*?)</", 1)
    )
    head = H.visible_text(html)
    head = head if head_chars is None else F.substring(head, 1, head_chars)
    sources = [ld, H.meta_content(html, DATE_META), time_text, element, head]

    def instant(text: Column) -> Column:
        return F.when(text != "", F.coalesce(_relative(text, as_of, zone), _absolute(text, zone)))

    return F.coalesce(*[X.bind(F.coalesce(s, F.lit("")), instant) for s in sources])


def published_on_day(df: DataFrame, as_of: Column, column: str = "created_at", zone: str = LOCAL_ZONE) -> DataFrame:
    """Rows whose local date is the run date, as a half-open UTC range that scans can prune by."""
    start_local = F.date_trunc("day", F.from_utc_timestamp(as_of, zone))
    start = F.to_utc_timestamp(start_local, zone)
    end = F.to_utc_timestamp(start_local + F.expr("INTERVAL 1 DAY"), zone)
    return df.where((F.col(column) >= start) & (F.col(column) < end))


def hash_sample(df: DataFrame, column: str, rate: float = SAMPLE_RATE) -> DataFrame:
    """Repeatable sample: first sha256 byte of the value below ``rate``."""
    first_byte = F.conv(F.substring(F.sha2(F.col(column), 256), 1, 2), 16, 10).cast("int")
    return df.where(first_byte / 255.0 < rate)


def ad_flag(text: Column, title: Column) -> Column:
    """Promotional or navigation page by keyword rules."""
    both = F.lower(F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(title, F.lit(""))))
    nav = X.contains_any(both, NAV_MARKERS)
    comments = X.contains_any(both, COMMENT_MARKERS)
    maker = X.contains_any(both, MAKER_MARKERS)
    rights = X.contains_any(both, RIGHTS_MARKERS)
    return X.contains_any(both, AD_KEYWORDS) | (nav & comments) | maker | (rights & (X.contains_any(both, FOOTER_MARKERS) | nav))


def js_rendered_flag(html: Column) -> Column:
    """Page that scripts seem to fill: many scripts per link, or few links and little text."""
    scripts, anchors = H.tag_count(html, "script"), H.tag_count(html, "a")
    return (scripts > anchors * 3) | ((anchors < 5) & (F.length(H.visible_text(html)) < 200))


def redirect_flags(pages: DataFrame, final_url: str) -> DataFrame:
    """Add ``to_home``, ``shortened`` and ``looks_home`` for an original and a final address."""
    original, final = F.col("url"), F.col(final_url)
    path, final_path = U.part(original, U.PATH), U.part(final, U.PATH)
    blocks = H.all_matches(F.col("html"), r"(?is)<p(?:\s[^>]*)?>([^<]*)", 1)
    filled = F.size(F.filter(blocks, lambda p: F.trim(p) != ""))
    known = F.coalesce(final, F.lit("")) != ""
    return pages.withColumns(
        {
            "to_home": known & (H.bare_host(original) == H.bare_host(final)) & (F.regexp_replace(final_path, "/+$", "") == ""),
            "shortened": known & (F.length(final_path) < F.length(path)),
            "looks_home": (H.tag_count(F.col("html"), "a") > 100) & (filled < 10),
        }
    )


def page_funnel(pages: DataFrame, as_of: Column, zone: str = LOCAL_ZONE) -> DataFrame:
    """Every page with its fields and one ``reason``: the first check it fails, or ok."""
    fields = page_fields(article_page_score(pages))
    dated = fields.withColumn("published_at", publish_date(F.col("html"), as_of, zone))
    local_day = F.to_date(F.from_utc_timestamp("published_at", zone))
    today = F.to_date(F.from_utc_timestamp(as_of, zone))
    reason = (
        F.when(F.coalesce("html", F.lit("")) == "", "no_html")
        .when(~F.col("is_article"), "not_article")
        .when(F.length("body") < MIN_BODY_CHARS, "short")
        .when(ad_flag(F.col("body"), F.col("title")), "ad")
        .when(F.col("published_at").isNull(), "no_date")
        .when(local_day != today, "not_today")
        .otherwise("ok")
    )
    return dated.withColumn("reason", reason)


def funnel_counts(funnel: DataFrame) -> DataFrame:
    return funnel.groupBy("reason").agg(F.count(F.lit(1)).alias("pages"))


BLOB_IMAGE = r"(?i)(https?://[^\s\"'<>]+?\.(?:jpg|jpeg|png|webp|avif)(?:\?[^\s\"'<>]*)?)"
MIN_TAG_WIDTH, MIN_TAG_HEIGHT = 200, 150


def page_images(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, image_url, chosen): image candidates in order of trust.

    Kinds: meta and link tags, the largest ``srcset`` entry, ``img`` sources not
    marked as small, then photo addresses anywhere in the page.  ``chosen``
    marks the first one that no rejection rule hits; without one the page has
    no image (a stock picture is not made up).
    """
    html, base = F.col("html"), F.col("url")

    def candidate(kind: str):
        return lambda u: F.struct(F.lit(kind).alias("kind"), I.normalize_candidate_url(u, base).alias("image_url"))

    link = F.get(F.filter(H.all_matches(html, r"(?is)<link\s[^>]*>"), lambda m: H.attribute(m, "rel").contains("image")), F.lit(0))
    metas = F.array_compact(F.array(
        H.meta_content(html, ["og:image"]), H.meta_content(html, ["twitter:image"]), F.nullif(H.attribute(link, "href"), F.lit(""))
    ))
    imgs = H.all_matches(html, H.IMAGE_TAG)

    def big_enough(tag: Column) -> Column:
        def size(name: str) -> Column:
            return F.nullif(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*[\"']?(\d{{1,9}})\b", 1), F.lit("")).cast("int")

        return (F.coalesce(size("width"), F.lit(MIN_TAG_WIDTH)) >= MIN_TAG_WIDTH) & (
            F.coalesce(size("height"), F.lit(MIN_TAG_HEIGHT)) >= MIN_TAG_HEIGHT
        )

    def source(tag: Column) -> Column:
        return H.source_of(tag, ("src", "data-src", "data-original", "data-lazy-src", "data-image"))

    groups = [
        F.transform(metas, candidate("meta")),
        F.transform(F.array_compact(F.transform(imgs, H.largest_in_srcset)), candidate("srcset")),
        F.transform(F.array_compact(F.transform(F.filter(imgs, big_enough), source)), candidate("img")),
        F.transform(F.filter(H.all_matches(html, BLOB_IMAGE, 1), I.news_photo), candidate("blob")),
    ]
    listed = pages.select("page_id", F.filter(F.concat(*groups), lambda c: c["image_url"].isNotNull()).alias("found"))
    usable = F.transform("found", lambda c, i: F.when(~I.rejected(c["image_url"]), i))
    best = F.array_min(F.array_compact(usable))
    exploded = listed.withColumn("_best", best).select("page_id", "_best", F.posexplode("found").alias("pos", "c"))
    return exploded.select(
        "page_id", "pos", "c.kind", "c.image_url", F.coalesce(F.col("pos") == F.col("_best"), F.lit(False)).alias("chosen")
    )
