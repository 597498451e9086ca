"""Scalar expressions over product texts, urls and numbers (Column to Column, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space when a value is trimmed.
BLANKS = " \t\n\r\f\x0b"
#: Image sizes in file names, image types, header words and script marks that are no color names.
SIZE_SUFFIXES = ("150x150", "300x300", "600x600", "768x768", "1024x1024")
IMAGE_TYPES = (".jpg", ".jpeg", ".png", ".webp", ".gif")
MIME_TYPES = {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/gif": ".gif"}
HEADER_WORDS = ("color", "colour", "colores", "seleccionar color", "choose an option")
SCRIPT_MARKS = ("var acss", "sourceurl=", "sourceurl:", "javascript", "color_mode", "enable_client_color_preference")
CODE_MARKS = ("{", "}", ";", "//", "=>")
EMPTY = "—"


def trimmed(c: Column) -> Column:
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return trimmed(c) == ""


def collapse(c: Column) -> Column:
    """Runs of white space as one space, then edge punctuation off."""
    return F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" .:-|"))


def clean_price(c: Column) -> Column:
    """The first number of a price text without currency and thousands commas, else 0."""
    bare = F.replace(F.replace(c, F.lit("S/"), F.lit("")), F.lit(","), F.lit(""))
    return F.coalesce(F.regexp_extract(bare, r"\d+\.?\d*", 0).try_cast("double"), F.lit(0.0))


def first_price(*candidates: Column) -> Column:
    """The first candidate text with a number in it, as a price; null if none has."""
    found = [F.regexp_extract(F.regexp_replace(c, r"(?i)s/\.?|,|pen|soles", ""), r"\d+(?:\.\d+)?", 0).try_cast("double") for c in candidates]
    return F.coalesce(*found)


def price_by_label(text: Column, label: str) -> Column:
    """The number that follows a label such as Muestra, Ciento or Millar."""
    return clean_price(F.regexp_extract(text, rf"(?i){label}\s*:?\s*((?:S/\s*)?[\d,]+(?:\.\d+)?)", 1))


def resolve_price(sample: Column, price: Column) -> Column:
    return F.when(sample > 0, sample).otherwise(price)


def numbers_after(text: Column, markers: tuple[str, ...] = ("stock disponible", "stock")) -> Column:
    """Whole numbers of the list behind the first marker that has one; thousands commas go."""
    lists = []
    for m in markers:
        run = F.regexp_extract(text, rf"(?i){m.replace(' ', r'\s+')}\s*:?\s*((?:\d[\d,.]*\s*)+)", 1)
        found = F.transform(F.regexp_extract_all(run, F.lit(r"\d[\d,.]*"), 0), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double").try_cast("int"))
        lists.append(F.filter(found, lambda x: x.isNotNull()))
    out = lists[-1]
    for found in reversed(lists[:-1]):
        out = F.when(F.size(found) > 0, found).otherwise(out)
    return out


def iso_text(c: Column) -> Column:
    """A time as ISO 8601 with microseconds; null stays."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def iso_time(c: Column) -> Column:
    """A time from ISO 8601 with or without a fraction, a zone and the T; anything else is null."""
    return F.coalesce(*[F.try_to_timestamp(F.replace(c, F.lit(" "), F.lit("T")), F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd")])


def all_numbers(text: Column) -> Column:
    found = F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"\d+"), 0)
    return F.filter(F.transform(found, lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def color_list(text: Column) -> Column:
    """Names of a list such as "colores: a, b y c": bracketed notes off, each name once (first spelling)."""
    run = F.regexp_extract(text, r"(?i)colou?r(?:es)?\s*:\s*([^\n]+)", 1)
    run = F.regexp_replace(F.regexp_replace(run, r"\([^)]*\)\s*$", ""), r"(?i)(?:,\s*|\s+)[ye]\s+", ", ")
    names = F.filter(F.transform(F.split(run, ","), lambda x: F.btrim(x, F.lit(BLANKS + ".;"))), lambda x: x != "")
    return distinct_folded(names)


def distinct_folded(names: Column) -> Column:
    """An array without later spellings of what it has, case aside; order kept."""
    empty = F.array().cast("array<string>")
    return F.aggregate(names, empty, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def is_color_name(name: Column, commas: bool = True) -> Column:
    """Whether a map key can be a color: not empty, at most 80 long, no header word, no script, no code, not only digits
    and signs; ``commas`` may be allowed. One pattern, so that the name is worked out once."""
    literal = lambda words: "|".join(rf"\Q{w}\E" for w in words)
    bad = rf"(?isu)^(?:{literal(HEADER_WORDS)})?$|^[\d\s.,:+-]+$|^.{{81,}}|{literal(SCRIPT_MARKS)}|{literal(CODE_MARKS)}"
    return ~F.coalesce(name.rlike(bad if commas else f"{bad}|,"), F.lit(True))


def clean_map(m: Column) -> Column:
    """Keys trimmed and not blank, values at least 0; of keys that become equal the largest value stays."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct(trimmed(e["key"]).alias("key"), F.greatest(F.coalesce(e["value"].try_cast("int"), F.lit(0)), F.lit(0)).alias("value")))
    entries = F.filter(entries, lambda e: e["key"] != "")
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    largest = lambda k: F.array_max(F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["value"]))
    return F.map_from_arrays(keys, F.transform(keys, largest))


def map_text(m: Column) -> Column:
    """Canonical text of a map: k=v sorted by key. Maps themselves cannot be compared."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def map_total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, v: a + v)


def map_from_json(c: Column) -> Column:
    """A map column stored as JSON; malformed text is empty. Names are collapsed and stripped of edge signs, those that are
    no colors go; values must be whole numbers (a number's fraction is cut, a text must have none) and are at least 0. Of
    names that become equal the last stays."""
    raw = F.map_entries(F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")))
    quoted = lambda e: F.contains(F.regexp_replace(c, r"\s*:\s*", ":"), F.concat(F.lit('":"'), e["value"], F.lit('"')))
    whole = lambda e: F.when(quoted(e), F.when(F.btrim(e["value"], F.lit(BLANKS)).rlike(r"^[+-]?\d+$"), F.btrim(e["value"], F.lit(BLANKS)).try_cast("int"))).otherwise(e["value"].try_cast("double").try_cast("int"))
    entries = F.transform(raw, lambda e: F.struct(collapse(e["key"]).alias("key"), F.greatest(whole(e), F.lit(0)).alias("value"), whole(e).isNotNull().alias("ok")))
    entries = F.filter(entries, lambda e: e["ok"] & is_color_name(e["key"]))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["value"]), -1)
    return F.map_from_arrays(keys, F.transform(keys, last))


def map_to_json(m: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def slug_title(url: Column) -> Column:
    return F.initcap(F.replace(F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1), F.lit("-"), F.lit(" ")))


def resolve_url(base: Column, href: Column) -> Column:
    """An absolute address for a link found on the page ``base``."""
    scheme, site = F.regexp_extract(base, r"^([a-z]+):", 1), F.regexp_extract(base, r"^[a-z]+://[^/?#]*", 0)
    return (
        F.when(href.rlike("^[a-z]+://"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .otherwise(F.concat(F.regexp_replace(base, r"[^/]*$", ""), href))
    )


def full_size_image(url: Column) -> Column:
    return F.regexp_replace(url, rf"-({'|'.join(SIZE_SUFFIXES)})", "")


def extension(url: Column, mime: Column | None = None) -> Column:
    own = F.lower(F.regexp_extract(F.split(url, r"\?")[0], r"(\.[^./]+)$", 1))
    if mime is None:
        return F.when(own != "", own).otherwise(".jpg")
    known = F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv])
    return F.when(own != "", own).otherwise(F.coalesce(F.element_at(known, mime), F.lit(".jpg")))


def safe_file_name(code: Column) -> Column:
    return F.regexp_replace(code, r"[^\p{L}\p{N}_-]", "_")


def content_hash(columns: list[Column]) -> Column:
    """SHA-256 of the values in order; numbers with two decimals, so that other engines get the same text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in columns]), 256)


def number_text(c: Column) -> Column:
    return F.format_string("%.2f", c)


def is_image_content(content: Column) -> Column:
    """By magic bytes; an empty file is none."""
    head = F.hex(F.substring(content, 1, 4))
    return (F.length(content) > 0) & (head.startswith("FFD8") | (head == "89504E47") | (head == "52494646"))


def is_image_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*IMAGE_TYPES)


def money(c: Column) -> Column:
    return F.concat(F.lit("S/ "), F.format_number(c, 2))


def or_dash(c: Column) -> Column:
    return F.when(is_blank(c), EMPTY).otherwise(c)


def elapsed(seconds: Column) -> Column:
    s = seconds.cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s / 60) % 60), two(s % 60))


def percent(current: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.floor(current * 100 / total))).otherwise(0).cast("int")


def to_number(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def to_count(c: Column) -> Column:
    return F.coalesce(c.try_cast("double").try_cast("int"), F.lit(0))


def strip_tags(html: Column) -> Column:
    """Text of markup: tags off, basic entities decoded, white space collapsed."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]+>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def element_text(html: Column, *tags: str) -> Column:
    """Text of the first of these elements that has any."""
    found = [F.nullif(strip_tags(F.regexp_extract(html, rf"(?is)<{t}[^>]*>(.*?)</{t}>", 1)), F.lit("")) for t in tags]
    return F.coalesce(*found, F.lit(""))


def description_lines(text: Column, name: Column, code: Column) -> Column:
    """Lines of a card without its name, its code, the read-more link and price or stock lines."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    kept = F.filter(lines, lambda x: (x != "") & (x != name) & (x != code) & (F.lower(x) != "leer más") & ~F.contains(x, F.lit("Precio")) & ~F.contains(x, F.lit("Stock")))
    return F.array_join(kept, " ")


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def element_lines(html: Column) -> Column:
    """Text of markup with a line for each element, so that lists of names end where their element ends."""
    text = F.regexp_replace(html, r"<[^>]+>", "\n")
    return F.regexp_replace(F.replace(text, F.lit("&amp;"), F.lit("&")), r"\n\s*\n+", "\n")
