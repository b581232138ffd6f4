"""Word lists, marker lists and weights the results depend on.

Everything here is data that has to equal the published behaviour; the logic
that uses it is elsewhere.
"""

from __future__ import annotations

# --- character classes -------------------------------------------------------
# Unicode white space as Python's str.split sees it, as a portable class body.
SPACE = "[\\s\u000b\u001c-\u001f\u0085   -     　]"
WORD = r"[\p{L}\p{N}_]"
NONWORD = r"[^\p{L}\p{N}_]"
APOSTROPHES = "’`ʻʼʹʽˈ＇"
CYRILLIC = "[Ѐ-ӿ]"
UZBEK_CYRILLIC = "[қғҳўҚҒҲЎ]"
KEYWORD_STRIP = ".,!?;:\"'()"

# --- vectors -----------------------------------------------------------------
VECTOR_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "before", "by", "for", "from", "has", "have", "he", "her", "his", "i",
    "in", "into", "is", "it", "its", "of", "on", "or", "she", "that", "the", "their", "there", "these", "this", "to",
    "was", "were", "will", "with", "yangilik", "yangiliklar", "news", "novost", "новость", "today", "update", "latest",
    "report", "story",
)

# --- languages ---------------------------------------------------------------
ENGLISH_TITLE_STOPWORDS = (
    "the", "and", "of", "to", "in", "for", "with", "on", "from", "by", "is", "are", "was", "were", "after", "before",
    "warning", "adds", "uncertainty",
)
ENGLISH_TEXT_STOPWORDS = ENGLISH_TITLE_STOPWORDS + (
    "today", "breaking", "report", "story", "latest", "update", "video", "watch", "more",
)
NOT_UZBEK_WORDS = ("the", "and", "is", "of", "this", "that", "with", "from", "a", "an", "or", "but")
UZBEK_MARKERS = (
    "yangilik", "o'zbekiston", "ozbekiston", "shuningdek", "bo'yicha", "foydalanuvchi", "jamoa", "g'alaba", "mag'lub",
)
UZBEK_COMMON_WORDS = (
    "va", "ham", "uchun", "bilan", "bo'yicha", "bu", "yangi", "hamda", "deb", "etadi", "bo'ldi", "qildi", "loyiha",
    "hudud", "davlat", "yoshlar",
)
UZBEK_LATIN_PATTERN = "(?:o'|g'|sh|ch|ng|yo|ya|yu)"

# --- artifacts and validation --------------------------------------------------
ARTIFACT_REPLACEMENTS = (
    ("â€™", "'"), ("â€\x9c", '"'), ("â€\x9d", '"'), ("â€“", "-"), ("â€”", "-"), ("â€¦", "..."), ("Ã", ""), ("Â", ""),
)
TRUNCATION_MARK = r"\[\+[0-9]+\s+chars\]"
LABEL_WORDS = "lid|yanglik|yangilik|headline|sarlavha"
LINE_LABELS = (
    r"lid|yanglik|yangilik|headline|sarlavha|novost|news|asosiy\s+yangilik|foydalanuvchiga\s+ta'siri|"
    r"kasbiy\s+nuqtai\s+nazar|amaliy\s+qadamlar"
)
TITLE_LABELS = "yangilik|yanglik|news|novost|headline|sarlavha"
TEXT_MOJIBAKE = ("Ã¢€œ", "Ã¢€\x9d", "â€™", "â€")
TITLE_MOJIBAKE = ("Ã",)
FORBIDDEN_PHRASES = (
    "Additional emphasis", "In Tashkent", "For a general profile", "Siz uchun ahamiyati", "Asosiy fakt va raqamlar",
    "Key facts", "Why this matters", "What to watch next", "emotional signal", "Bu juda muhim", "Zamonaviy dunyoda",
    "Foydalanuvchilar uchun",
)
DEFAULT_HEADLINES = {"ru": "Top story", "uz": "Dolzarb xabar", "en": "Top story"}
GENERIC_TITLES = ("top story", "dolzarb xabar", "news", "headline")
WIN_SPLIT = r"(?:won|wins|beats?|defeats?|victory|champion(?:s)?|pobeda|vyigral|yutdi|g'olib)"
WORLD_CUP_MARKERS = ("world cup", "чемпионат мира", "чм", "jahon chempionati")
WIN_MARKERS = (
    "won", "wins", "victory", "champion", "champions", "pobeda", "vyigral", "g'olib", "g'alaba", "yutdi",
)

# --- tone and quality ----------------------------------------------------------
POSITIVE_MARKERS = (
    "win", "won", "victory", "champion", "champions", "title", "qualified", "passed", "success", "rekord", "g'alaba",
    "zafar", "yutdi", "golib", "pobed", "vyigral", "chempion",
)
NEGATIVE_MARKERS = (
    "lost", "defeat", "eliminated", "suspended", "ban", "failed", "injury", "crisis", "jarohat", "maglub", "yutqaz",
    "afsus", "neudach", "porazhen", "proigral", "travm",
)
CONGRATULATIONS = ("tabrik", "zafar", "golib", "g'alaba", "great news", "congrat")
CONDOLENCES = ("afsus", "hamdard", "qiyin xabar", "tough development", "disappoint")
USER_FACT_PHRASES = ("siz uchun muhim fakt", "sizga tegishli fakt", "relevant fact for you")
MIN_QUALITY_WORDS = 200

# --- categories ----------------------------------------------------------------
CATEGORY_KEYWORDS = {
    "politics": ("prezident", "hukumat", "siyosat", "saylov", "ministr", "parlament", "politik", "президент", "ҳукумат"),
    "sports": ("futbol", "liga", "superliga", "chempionat", "gol", "sport", "jamoa", "мусобақа"),
    "economy": ("dollar", "bank", "iqtisod", "narx", "invest", "inflation", "iqtisodiyot"),
    "tech": ("robot", "texnolog", "ai", "chatgpt", "sun'iy", "texnologiya", "gadjet"),
    "health": ("sog'liq", "tibbiyot", "virus", "vakcin", "вакцин", "kasal", "эпидem"),
    "culture": ("kino", "film", "san'at", "madaniyat", "konsert", "muzey", "foto"),
}

# --- summaries, facts, snippets --------------------------------------------------
SUMMARY_STOPWORDS = (
    "the", "and", "or", "but", "is", "are", "a", "an", "va", "ham", "lekin", "bu", "shu", "и", "в", "на", "с", "это",
)
QUANTITY_TOKENS = ("%", "ming", "million", "mlrd", "foiz", "ta ")
PROMO_PHRASES = (
    "reklama", "реклама", "подписывайтесь", "obuna", "batafsil", "batafsil o‘qish", "telegram", "instagram", "youtube",
)
TITLE_KEY_STOPWORDS = ("the", "a", "an", "and", "or", "of", "in", "on", "это", "как", "что", "в", "на", "по")
PERSONA_STOPWORDS = ("and", "the", "for", "with", "news", "general")
FACT_PREFIXES = {
    "ru": ("Relevant fact for your profile", "this story can influence decisions in the next 24-48 hours."),
    "uz": ("Siz uchun muhim fakt", "bu voqea yaqin 24-48 soat ichidagi qarorlarga ta'sir qiladi."),
    "en": ("Relevant fact for you", "this development can affect near-term decisions in the next 24-48 hours."),
}
