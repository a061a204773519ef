"""URL algebra as Column expressions, so that Catalyst can push and fold it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that only track, extensions of assets and of images, keys that only size an image, hosts of platform CDNs.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid"]
ASSET = r"\.(pdf|zip|docx?|xlsx?|pptx?|csv|txt|mp3|mp4|webm|mov|avi|css|js|map|woff2?|ttf|eot)$"
IMAGE = r"\.(jpe?g|png|gif|webp|avif|svg|bmp|tiff?)$"
SIZING = ["w", "h", "crop", "resize", "fit", "quality", "q", "ssl", "strip"]
CDN_EXACT = ["static.wixstatic.com"]
CDN_SUFFIX = [".wixstatic.com", ".wp.com", ".wordpress.com", ".filesusr.com", ".sqspcdn.com", ".squarespace.com"]
ICONS = ["ce6ec7c11b174c0581e20f42bb865ce3.png", "fdcfaba150fc427da298a00cb09d91c1.png"]
MEDIA_ID = r"(?i)([a-z0-9]+_[a-z0-9]+~mv2(?:_d_\d+_\d+_s_\d+)?\.(?:jpg|jpeg|png|webp))"
FIT = "/v1/fit/w_1800,h_1800,al_c,q_85,enc_jpg/"

# Archives, feeds and administration; icons' marks in addresses.
LOW_NAMED = ["^/(tag|category|author|comments)(/|$)", "/feed$", "/feed/atom$", "^/wp-(admin|login|json)"]
LOW_DATED = [r"^/+\d{4}(/+\d{2})?$", r"^/+\d{4}/+\d{2}/+\d{2}(/+[^/]+){2,}$"]
SKIPPED = ["/v1/fill/w_1[0-9],h_1[0-9]", "(?i)favicon|pfavico"]
ICON_SVG, ICON_HOSTS = r"(?i)\.svg(?:$|\?)", "wixstatic|parastorage"

_WHOLE = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), _WHOLE, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Host and port, lower case, without the scheme's own port; null where the URL is not absolute."""
    raw = F.lower(_part(url, 2))
    own = F.when(scheme(url) == "https", F.regexp_replace(raw, ":443$", "")).otherwise(F.regexp_replace(raw, ":80$", ""))
    return F.nullif(own, F.lit(""))


def hostname(url: Column) -> Column:
    return F.regexp_replace(host(url), r":\d+$", "")


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url))


def path(url: Column) -> Column:
    """The path, percent-encoded where it is not ASCII; / if empty."""
    raw = F.coalesce(F.nullif(_part(url, 3), F.lit("")), F.lit("/"))
    spelled = F.array_join(F.transform(F.split(raw, ""), lambda c: F.when(c.rlike(r"[^\x21-\x7e]"), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)), "")
    return F.when(raw.rlike(r"[^\x21-\x7e]"), spelled).otherwise(raw)


def decode(c: Column) -> Column:
    """Percent-decoded form data; a % that begins no escape stands for itself."""
    return F.coalesce(F.try_url_decode(c), F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")), F.replace(c, F.lit("+"), F.lit(" ")))


def parameters(url: Column) -> Column:
    """Query parameters in order, as structs of key, place and value."""
    pairs = F.filter(F.split(_part(url, 4), "&"), lambda p: p != "")
    return F.transform(pairs, lambda p, i: F.struct(decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("key"), i.alias("place"), decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("value")))


def _query(params: Column) -> Column:
    text = F.array_join(F.transform(params, lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"]))), "&")
    return F.when(F.size(params) > 0, F.concat(F.lit("?"), text)).otherwise(F.lit(""))


def normalize(url: Column) -> Column:
    """Without fragment, one trailing slash and tracking parameters; the other parameters sorted by key, alike keys in order."""
    p = path(url)
    p = F.when((p != "/") & p.endswith("/"), F.regexp_replace(p, "/$", "")).otherwise(p)
    left = F.array_sort(F.filter(parameters(url), lambda x: ~x["key"].isin(TRACKING)))
    return F.concat(origin(url), p, _query(left))


def is_at(url: Column, seed: Column) -> Column:
    """Whether an absolute address has the seed's origin."""
    other = F.lower(url).rlike("^(mailto|tel|javascript|data):")
    return F.coalesce(~other & (origin(url) == origin(seed)), F.lit(False))


def is_internal(href: Column, seed: Column) -> Column:
    """Whether href, resolved against the seed, has the seed's origin."""
    other = F.lower(href).rlike("^(mailto|tel|javascript|data):")
    return F.coalesce(~other & (origin(resolve(href, seed)) == origin(seed)), F.lit(False))


def without_dots(p: Column) -> Column:
    """A path without . and .. segments."""
    step = lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(s == ".", acc).otherwise(F.array_append(acc, s))
    segments = F.split(p, "/")
    kept = F.aggregate(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), F.array(F.lit("")), step)
    ends = F.when(p.rlike(r"(^|/)\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.array_join(kept, "/"), ends)
    return F.when(p.rlike(r"(^|/)\.\.?(/|$)"), F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))).otherwise(p)


def resolve(href: Column, base: Column) -> Column:
    """href against an absolute base, as a browser does: absolute, scheme-relative, root-relative, query, fragment and relative forms, without
    dot segments; hosts in lower case, an empty path is /. Addresses of other schemes (mailto:) stay as they are; null where href is null or the base is
    not absolute and needed."""
    h = F.regexp_replace(F.trim(href), r"[\t\r\n]", "")
    tail = F.regexp_extract(h, r"(\?[^#]*)?(#.*)?$", 0)
    own = F.regexp_extract(h, r"^[^?#]*", 0)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    clean = lambda url: F.concat(origin(url), without_dots(path(url)), tail)
    here = F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    return (
        F.when(h.rlike("(?i)^https?://"), F.coalesce(clean(h), h))
        .when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), clean(F.concat(scheme(base), F.lit(":"), h)))
        .when(h == "", F.concat(origin(base), path(base), F.regexp_extract(base, r"(\?[^#]*)", 0)))
        .when(h.startswith("#"), F.concat(origin(base), path(base), F.regexp_extract(base, r"(\?[^#]*)", 0), h))
        .when(h.startswith("?"), F.concat(origin(base), path(base), h))
        .otherwise(F.concat(origin(base), without_dots(path(F.concat(origin(base), here))), tail))
    )


def path_name(url: Column) -> Column:
    trimmed = F.regexp_replace(path(url), "^/+|/+$", "")
    return F.when(trimmed == "", "home").otherwise(trimmed)


def is_asset(url: Column) -> Column:
    return F.lower(path(url)).rlike(ASSET)


def is_image(url: Column) -> Column:
    return F.lower(path(url)).rlike(IMAGE)


def is_low_value(url: Column) -> Column:
    """Archives, feeds, administration and share links."""
    p = F.regexp_replace(F.lower(path(url)), "/+$", "")
    hit = F.lit(False)
    for pattern in (*LOW_NAMED, *LOW_DATED):
        hit = hit | p.rlike(pattern)
    return F.coalesce(hit | F.exists(parameters(url), lambda x: x["key"].isin("share", "replytocom")), F.lit(False))


def wix_media_id(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, MEDIA_ID, 1)), F.lit(""))


def upgrade_wix(url: Column) -> Column:
    mid = wix_media_id(url)
    whole = F.concat(F.lit("https://static.wixstatic.com/media/"), mid, F.lit(FIT), F.regexp_replace(mid, r"[^\w.~-]+", "-"))
    cropped = url.rlike("/v1/fill/") & url.rlike("(?i)wixstatic|filesusr\\.com")
    return F.when(mid.isNotNull(), whole).when(cropped, F.regexp_replace(url, "^(.*?)/v1/fill/[^/]+/", f"$1{FIT}")).otherwise(url)


def wordpress_original(url: Column) -> Column:
    sized = F.exists(parameters(url), lambda x: x["key"].isin(SIZING))
    left = F.filter(parameters(url), lambda x: ~x["key"].isin(SIZING))
    return F.when(sized, F.concat(origin(url), path(url), _query(left))).otherwise(url)


def upgrade_media(url: Column) -> Column:
    wix = upgrade_wix(url)
    return F.when(wix != url, wix).otherwise(wordpress_original(url))


def is_skippable(url: Column) -> Column:
    hit = (F.coalesce(url, F.lit("")) == "") | url.startswith("data:") | (url.rlike(ICON_SVG) & url.rlike(ICON_HOSTS))
    for name in ICONS:
        hit = hit | url.contains(name)
    for pattern in SKIPPED:
        hit = hit | url.rlike(pattern)
    return hit


def is_cdn(name: Column) -> Column:
    hit = F.lower(name).isin(CDN_EXACT)
    for suffix in CDN_SUFFIX:
        hit = hit | F.lower(name).endswith(suffix)
    return hit


def is_other_host(image: Column, seed: Column) -> Column:
    a, b = hostname(image), hostname(seed)
    same = (a == b) | (a == F.concat(F.lit("www."), b)) | (b == F.concat(F.lit("www."), a))
    return F.coalesce(~same & ~is_cdn(a), F.lit(False))


def is_same_origin(a: Column, b: Column) -> Column:
    return F.coalesce(origin(a) == origin(b), F.lit(False))


def looks_like_image(url: Column) -> Column:
    """By its path's extension, or as media of a platform."""
    return F.coalesce(is_image(url) | wix_media_id(url).isNotNull(), F.lit(False))


def collect_internal(hrefs: Column, seed: Column) -> Column:
    """The normalised addresses of hrefs that lead to pages of the seed's origin, each once, in order."""
    absolute = F.transform(hrefs, lambda h: resolve(h, seed))
    kept = F.filter(absolute, lambda u: is_at(u, seed) & ~F.coalesce(is_asset(u), F.lit(False)))
    return F.array_distinct(F.transform(kept, normalize))


def file_part(url: Column) -> Column:
    """The last part of the path, decoded; download where there is none."""
    raw = F.regexp_extract(path(url), "([^/]*)$", 1)
    return F.coalesce(F.nullif(F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw), F.lit("")), F.lit("download"))
