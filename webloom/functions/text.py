"""Strings: slugs, file names, descriptions, dates, Markdown clean-up; Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Title words that are no names.
TITLE_WORDS = [
    "about", "gallery", "recipe", "the", "and", "home", "page", "post", "blog", "studio", "contact", "portfolio", "photography", "photo", "work", "works", "series",
    "for", "with", "from", "this", "that", "your", "our", "new", "old",
]
# What slugs write signs and letters without a base letter as.
SIGNS = {"$": "dollar", "%": "percent", "&": "and", "<": "less", ">": "greater", "|": "or", "ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "TH", "þ": "th", "€": "euro", "£": "pound", "©": "(c)", "™": "tm"}
SINGLE = {"Ø": "O", "ø": "o", "Đ": "DJ", "đ": "dj", "Ł": "L", "ł": "l", "Ð": "D", "ð": "d", "ı": "i"}
NO_DATE = "1970-01-01"


def squeeze(c: Column) -> Column:
    """Any white space, no-break and Unicode spaces too, becomes one space."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s﻿]+", " "))


def _base_letters() -> dict[str, str]:
    """Latin letters with marks and their base letters, by their canonical decomposition."""
    import unicodedata

    letters = (chr(x) for x in (*range(0xC0, 0x180), *range(0x1E00, 0x1F00)))
    return {x: base for x in letters if len(d := unicodedata.normalize("NFD", x)) > 1 and (base := d[0]).isascii()}


def transliterate(c: Column) -> Column:
    """Letters with marks as their base letters, signs that have names as these."""
    one = _base_letters() | {k: v for k, v in SINGLE.items() if len(v) == 1}
    out = F.translate(c, "".join(one), "".join(one.values()))
    for sign, name in (SIGNS | {k: v for k, v in SINGLE.items() if len(v) > 1}).items():
        out = F.replace(out, F.lit(sign), F.lit(name))
    return F.when(c.rlike(r"[^A-Za-z0-9\s_./-]"), out).otherwise(c)


def slug(c: Column, fallback: str = "page") -> Column:
    """Without a final extension; transliterated to letters and digits of ASCII, words joined by -; path separators vanish."""
    base = F.trim(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"\.[A-Za-z0-9]+$", ""))
    kept = F.trim(F.regexp_replace(F.regexp_replace(transliterate(base), "-", " "), r"[^A-Za-z0-9\s]", ""))
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(kept, r"\s+", "-")), F.lit("")), F.lit(fallback))


def file_name(c: Column, fallback: str = "file") -> Column:
    base = F.regexp_extract(c, r"([^/\\]*)$", 1)
    base = F.when(base.rlike(r"[?&][^=\s]+="), F.regexp_extract(base, r"^([^?]*)", 1)).otherwise(base)
    base = F.regexp_extract(base, "^([^#]*)", 1)
    for pattern, by in ((r'[<>:"|?*\x00-\x1f]', "-"), (r"\s+", "-"), ("-+", "-"), (r"^\.+", ""), ("-+$", "")):
        base = F.regexp_replace(base, pattern, by)
    return F.coalesce(F.nullif(F.substring(base, 1, 180), F.lit("")), F.lit(fallback))


def title_names(title: Column) -> Column:
    """Words of a title that look like names."""
    words = F.transform(F.split(title, r"[\s,:;/|–—-]+"), F.trim)
    return F.filter(words, lambda w: w.rlike(r"^[A-Z][A-Za-zÀ-ÿ'-]{2,}$") & ~F.lower(w).isin(TITLE_WORDS))


def description(given: Column, text: Column, title: Column) -> Column:
    some = lambda c: F.nullif(squeeze(c), F.lit(""))
    return F.coalesce(some(given), F.nullif(F.trim(F.substring(squeeze(text), 1, 180)), F.lit("")), some(title), F.lit("Untitled"))


#: Forms of dates beside ISO's; a weekday before them is cut off.
DATES = ["MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "d MMMM yyyy", "yyyy/M/d", "M/d/yyyy"]


def front_date(date: Column) -> Column:
    """The day in UTC, from ISO dates and times, mail dates, and dates with the month's name; a fixed day where there is none."""
    plain = F.regexp_replace(F.trim(date), r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    at = F.coalesce(F.try_to_timestamp(plain), *[F.try_to_timestamp(plain, F.lit(x)) for x in DATES])
    return F.coalesce(F.date_format(at, "yyyy-MM-dd"), F.lit(NO_DATE))


def clean_markdown(md: Column) -> Column:
    for pattern, by in (("\r\n", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"!\[[^\]]*\]\(data:[^)]+\)", "")):
        md = F.regexp_replace(md, pattern, by)
    return F.concat(F.btrim(md, F.lit(" \t\n\r\x0b\x0c\xa0")), F.lit("\n"))


def markdown_images(md: Column) -> Column:
    """Targets of images, in order."""
    return F.transform(F.regexp_extract_all(md, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1)), lambda x: F.regexp_extract(F.trim(x), r"^(\S*)", 1))


def decode_xml(c: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def extension(content: Column, content_type: Column) -> Column:
    """Of an image, from its content type or else its first bytes."""
    ct, head = F.lower(F.coalesce(content_type, F.lit(""))), F.hex(F.substring(content, 1, 12))
    by_type = F.lit(None).cast("string")
    for part, ext in (("svg", "svg"), ("avif", "avif"), ("webp", "webp"), ("gif", "gif"), ("png", "png"), ("jpeg", "jpg")):
        by_type = F.when(ct.contains(part), ext).otherwise(by_type)
    some = F.decode(F.substring(content, 1, 100), "ISO-8859-1")
    sniffed = F.when(F.length(content) < 4, F.lit("bin")).when(head.startswith("FFD8"), "jpg").when(head.startswith("89504E47"), "png").when(head.startswith("474946"), "gif").when(head.rlike("^52494646.{8}57454250"), "webp").when(some.contains("<svg"), "svg")
    return F.coalesce(by_type, sniffed, F.lit("bin"))
