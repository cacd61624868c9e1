"""Text expressions: keys, folds, pages, labels. All run as Spark expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ratio import weighted_ratio

# Letters and their base letters, word lists of name keys, decoys, and typographic signs.
ACCENTS = {
    "a": "àáâãäåāăą", "c": "çćčĉċ", "d": "ď", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥ", "i": "ìíîïĩīĭį", "j": "ĵ", "k": "ķ", "l": "ĺļľ", "n": "ñńņň",
    "o": "òóôõöōŏő", "r": "ŕŗř", "s": "śŝşšș", "t": "ţťț", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}
BUILDING_WORDS = "refuge|rifugio|refugio|hutte|cabane|capanna|bivouac|bivacco|du|de|des|la|le|les|del|della|di|d|l"
LOOSE_WORDS = (
    "refuge|rifugio|refugio|hutte|cabane|bivouac|bivacco|voie|route|via|arete|cresta|couloir|glacier|ghiacciaio|"
    "aiguille|mont|monte|pointe|punta|du|de|des|la|le|les|del|della|di|d|l"
)
TRANSLATED = {"rifugio": "refuge", "refugio": "refuge", "bivacco": "bivouac", "biwak": "bivouac", "capanna": "cabane", "riparo": "abri"}
DECOYS = r"\b(ancien|ancienne|ruine|ruines|ex|vestiges?|projet|vecchio|vecchia|ruderi|rudere|diroccat[oa]|alte|alter|altes|ehemalig\w*)\b"
MACHINE_WORDS = "tph|tc|tcd|tsd|ts|tk|funi|telepherique|telecabine|telesiege|teleski|du|de|des|le|la|les|d"
TYPOGRAPHIC = ("‘’ʼ‛“”‐‑‒–—−   ", "''''\"\"------   ")
APPROACH = r"\b(acces|itineraire|sentier|chemin|voie|route|passage|approche|montee)\b"
ELSEWHERE = r"\bbuet\b|aiguilles rouges|belledonne|vanoise|ecrins"
WEEKDAYS = r"\b(lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche|lunedi|martedi|mercoledi|giovedi|venerdi|sabato|domenica)\b"
OPENING_WORDS = r"reouvert|reouverture|rouvre|levee de l'interdiction|levee de l'arrete|retabli|de nouveau accessible|reprise"
CLOSURE_WORDS = r"fermeture|fermes?\b|interdiction|interdit|interdite|suspendu|inaccessible|non accessible|demontage"


def fold(text: Column) -> Column:
    """Lower case, accents off, combining marks off, sharp s as two letters."""
    accented, base = "".join(ACCENTS.values()), "".join(k * len(v) for k, v in ACCENTS.items())
    return F.replace(F.regexp_replace(F.translate(F.lower(text), accented, base), r"\p{M}", ""), F.lit("ß"), F.lit("ss"))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def key_exact(text: Column) -> Column:
    return collapse_space(F.regexp_replace(fold(text), r"[^a-z0-9\s]", " "))


def _without(text: Column, words: str) -> Column:
    return collapse_space(F.regexp_replace(key_exact(text), rf"\b({words})\b", " "))


def key_tight(text: Column) -> Column:
    """The exact key without building words and articles."""
    return _without(text, BUILDING_WORDS)


def key_loose(text: Column) -> Column:
    """The exact key without building, terrain and article words."""
    return _without(text, LOOSE_WORDS)


def key_translated(text: Column) -> Column:
    """The exact key with Italian building words in French; never one type for another."""
    words = F.create_map(*(F.lit(x) for pair in TRANSLATED.items() for x in pair))
    return F.array_join(F.transform(F.split(key_exact(text), " "), lambda w: F.coalesce(words[w], w)), " ")


def key_machine(text: Column) -> Column:
    """A lift's name without type words and articles, and without a number at its end."""
    return F.trim(F.regexp_replace(_without(text, MACHINE_WORDS), r"\s*\d+$", ""))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def fold_typography(text: Column) -> Column:
    """Folded text with plain quotes, dashes and spaces and without weekday names."""
    plain = F.translate(fold(text), *TYPOGRAPHIC)
    return collapse_space(F.regexp_replace(plain, WEEKDAYS, " "))


def is_decoy(name: Column) -> Column:
    """Whether a name, as written, is that of a building that another has replaced."""
    return key_exact(name).rlike(DECOYS)


def names_an_approach(mention: Column) -> Column:
    """Whether a mention is of a path or route to a place, not of the place."""
    return fold(mention).rlike(APPROACH)


def named_elsewhere(text: Column) -> Column:
    """Whether a text names a place outside the region, so that none of its names is taken for one inside."""
    return fold(text).rlike(ELSEWHERE)


def classify_title(title: Column) -> Column:
    """closure, opening or null: the earlier of the opening and closure words of a title decides."""
    flat = collapse_space(F.translate(fold(title), *TYPOGRAPHIC))
    opening, closure = (F.regexp_instr(flat, F.lit(f"({x})")) for x in (OPENING_WORDS, CLOSURE_WORDS))
    return F.when((opening > 0) & ((closure == 0) | (opening < closure)), "opening").when(closure > 0, "closure")


def classify_sentence(text: Column) -> Column:
    """restriction, opening or null for one sentence: words for bad conditions come first."""
    flat = fold(text)
    return F.when(flat.rlike(r"deconseill|impraticable|dangereux|pas en conditions|non praticable|delicat"), "restriction").when(
        flat.rlike(r"reouvert|rouvert|de nouveau|praticable|ouverte?s?\b"), "opening"
    )


def split_sentences(text: Column, least: int = 12) -> Column:
    """Pieces between full stops, marks, line ends, bullets and semicolons, those that are too short left out."""
    return F.filter(F.transform(F.split(text, r"[.!?\n•;]+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


# Parts of a page that are not its text, and signs written as entities.
FURNITURE = "script|style|nav|header|footer|aside|form|noscript|iframe|svg"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&rsquo;": "’", "&amp;": "&"}


def unescape(text: Column) -> Column:
    for entity, sign in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def without_furniture(html: Column) -> Column:
    """Comments and furniture blocks off; a block nested in one of its own kind ends at the first end tag."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in FURNITURE.split("|"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return out


def container(html: Column) -> Column:
    """The first article, else main, else body, else all."""
    found = [F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1) for tag in ("article", "main", "body")]
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in found), html)


def page_prose(html: Column) -> Column:
    return collapse_space(unescape(F.regexp_replace(container(without_furniture(html)), r"(?s)<[^>]*>", " ")))


def page_title(html: Column) -> Column:
    return collapse_space(unescape(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1), r"(?s)<[^>]*>", " ")))


def page_links(html: Column) -> Column:
    """Addresses of links in order, without query and fragment, each once."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*\bhref=\"([^\"]*)\""), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[?#].*$", "")))


def page_published_at(html: Column, zone: str = "Europe/Paris") -> Column:
    """First datePublished in the page's JSON-LD blocks that is a time; one without a zone is local."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"""), F.lit(1))
    found = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r'"datePublished"\s*:\s*"([^"]+)"'), F.lit(1))))

    def read(raw: Column) -> Column:
        at = F.try_to_timestamp(raw)
        return F.when(raw.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), at).otherwise(F.to_utc_timestamp(at, zone))

    return F.get(F.filter(F.transform(found, read), lambda t: t.isNotNull()), F.lit(0))


def quote_body(title: Column, body: Column, most: int = 2000) -> Column:
    """The body without a repeat of the title at its start; the title if nothing is left."""
    rest = F.when(F.startswith(body, title), F.ltrim(F.substring(body, F.length(title) + 1, F.length(body)))).otherwise(body)
    return F.substring(F.coalesce(F.nullif(F.trim(rest), F.lit("")), title), 1, most)


def content_identity(text: Column) -> Column:
    return F.sha2(text, 256)


def phone_from_text(text: Column) -> Column:
    found = F.regexp_extract(text, r"((?:\+33\s?|0)[1-9](?:[\s.-]?\d{2}){4})", 1)
    return F.nullif(F.trim(F.regexp_replace(found, r"[\s.-]+", " ")), F.lit(""))


def host_of(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def website_from_tags(tags: Column, keys: tuple[str, ...] = ("website", "contact:website")) -> Column:
    return F.coalesce(*(F.when(F.try_element_at(tags, F.lit(k)).rlike(r"^https?://"), F.try_element_at(tags, F.lit(k))) for k in keys))


def parse_metres(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")[0].try_cast("double").cast("int")


def header_numbers(text: Column) -> Column:
    """(capacity, altitude) out of the first 4000 characters of a page."""
    head = F.substring(text, 1, 4000)
    capacity = F.regexp_extract(head, r"(?i)(\d{1,3})\s*pers", 1).try_cast("int")
    altitude = F.regexp_extract(head, r"(?i)alt\.?\s*:?\s*(\d{3,4})\s*m", 1).try_cast("int")
    return F.struct(capacity.alias("capacity"), altitude.alias("altitude"))


def clean_title(title: Column) -> Column:
    """(title, caveat): a closing asterisk is a caveat, a closing bracket is an operator's name."""
    bare = F.regexp_replace(F.trim(title), r"\s*\([^)]*\)$", "")
    return F.struct(F.trim(F.regexp_replace(bare, r"\*+$", "")).alias("title"), F.endswith(bare, F.lit("*")).alias("caveat"))


def posted_date(heading: Column) -> Column:
    """(day, rest) of a heading like `... poste le dd/mm/yyyy`; null without it."""
    flat = fold(heading)
    d, m, y = (F.regexp_extract(flat, r"poste le (\d{1,2})/(\d{1,2})/(\d{4})", k) for k in (1, 2, 3))
    posted = F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))
    rest = collapse_space(F.regexp_replace(heading, r"(?i)post[eé] le \d{1,2}/\d{1,2}/\d{4}", " "))
    return F.when(posted.isNotNull(), F.struct(posted.alias("day"), rest.alias("title")))


def parse_json_array(text: Column, fields: str) -> Column:
    """(items, error) of the outermost JSON array in a text with noise around it: its objects, read by `fields`, and else
    the reason why there are none; what isn't an object is dropped."""
    raw = F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit(""))
    parts = F.from_json(raw, "array<string>", {"mode": "PERMISSIVE"})
    good = raw.isNotNull() & F.try_parse_json(raw).isNotNull() & parts.isNotNull()
    items = F.transform(F.filter(parts, lambda x: F.ltrim(x).startswith("{")), lambda x: F.from_json(x, fields))
    return F.struct(F.when(good, items).alias("items"), F.when(raw.isNull(), "no array").when(~good, "not JSON").alias("error"))


def lift_counts(text: Column) -> Column:
    """Map of category to (open, total) out of texts like `Remontees ( 0 / 4 ) Pistes ( 2 / 9 )`."""
    names = F.regexp_extract_all(text, F.lit(r"(\p{L}+)\s*\(\s*(\d+)\s*/\s*(\d+)\s*\)"), F.lit(1))
    opened = F.regexp_extract_all(text, F.lit(r"(\p{L}+)\s*\(\s*(\d+)\s*/\s*(\d+)\s*\)"), F.lit(2))
    total = F.regexp_extract_all(text, F.lit(r"(\p{L}+)\s*\(\s*(\d+)\s*/\s*(\d+)\s*\)"), F.lit(3))
    return F.map_from_arrays(F.transform(names, lambda n: fold(n)), F.transform(F.arrays_zip(opened.alias("o"), total.alias("t")), lambda x: F.struct(x["o"].cast("int").alias("open"), x["t"].cast("int").alias("total"))))


def glosses(text: Column, lexicon: list[tuple[str, str]]) -> Column:
    """English terms of the lexicon whose pattern the folded text holds, in lexicon order, each once."""
    flat = fold(text)
    return F.array_distinct(F.array_compact(F.array(*(F.when(flat.rlike(p), F.lit(t)) for p, t in lexicon))))


def tri_state(value: Column) -> Column:
    return F.when(value, "Yes").when(~value, "No")


def similarity(a: Column, b: Column) -> Column:
    """0 to 100 for two keys: their weighted ratio."""
    return weighted_ratio(a, b)
