"""The URL algebra of urls.py for single values, for functions that hold a whole page: many links at once are no place for column expressions."""

from __future__ import annotations

import functools
import re
from urllib.parse import parse_qsl, quote, unquote, urlencode, urljoin, urlsplit

from webloom.functions import urls as U

_MEDIA_ID = re.compile(U.MEDIA_ID)
_FILL = re.compile(r"^(.*?)/v1/fill/[^/]+/")
_ICON_SVG, _ICON_HOSTS = re.compile(U.ICON_SVG), re.compile(U.ICON_HOSTS)
_SKIPPED = [re.compile(p) for p in U.SKIPPED]
_IMAGE = re.compile(U.IMAGE)
_PORTS = {"http": ":80", "https": ":443"}


@functools.lru_cache(4096)
def absolute(href: str | None, base: str) -> str | None:
    """href against an absolute base, as urls.resolve does; None where that gives no address."""
    if href is None:
        return None
    h = re.sub(r"[\t\r\n]", "", href.strip(" "))
    try:
        joined = urljoin(base, h)
        parts = urlsplit(joined)
        if parts.scheme not in _PORTS:
            return joined if parts.scheme else None
        if not parts.netloc:
            return None
        host = parts.netloc.rsplit("@", 1)[-1].lower().removesuffix(_PORTS[parts.scheme])
    except ValueError:
        return None
    path = quote(parts.path or "/", safe="/%:@!$&'()*+,;=~-._|[]^{}\\`\"<>")
    tail = re.search(r"(\?[^#]*)?(#.*)?$", joined)[0]
    return f"{parts.scheme}://{host}{path}{tail}"


def origin(url: str) -> str:
    return re.sub(r"^([^:]+://[^/?#]*).*", r"\1", absolute(url, url) or url, flags=re.S)


def path(url: str) -> str:
    return re.sub(r"^[^:]+://[^/?#]*([^?#]*).*", r"\1", url, flags=re.S) or "/"


def is_at(url: str, seed: str) -> bool:
    return url.startswith(("http://", "https://")) and origin(url) == origin(seed)


def is_image(url: str) -> bool:
    return bool(_IMAGE.search(path(url).lower()))


def is_skippable(url: str | None) -> bool:
    return not url or url.startswith("data:") or bool(_ICON_SVG.search(url) and _ICON_HOSTS.search(url)) or any(x in url for x in U.ICONS) or any(p.search(url) for p in _SKIPPED)


def upgraded(url: str) -> str:
    """An image's address at full size."""
    if hit := _MEDIA_ID.search(url):
        name = hit[1].lower()
        return f"https://static.wixstatic.com/media/{name}{U.FIT}{re.sub(r'[^\w.~-]+', '-', name)}"
    if "/v1/fill/" in url and re.search(r"(?i)wixstatic|filesusr\.com", url):
        return _FILL.sub(rf"\g<1>{U.FIT}", url)
    pairs = parse_qsl(urlsplit(url).query, keep_blank_values=True)
    if any(k in U.SIZING for k, _ in pairs):
        left = urlencode([x for x in pairs if x[0] not in U.SIZING], safe="*")
        return re.sub(r"[?#].*$", "", url, flags=re.S) + (f"?{left}" if left else "")
    return url


def image(src: str | None, base: str) -> str | None:
    """An image's address, absolute and upgraded; None if it is one to skip."""
    found = absolute(src, base)
    return None if is_skippable(found) else upgraded(found)


def file_part(url: str) -> str:
    return unquote(path(url).rsplit("/", 1)[-1]) or "download"


def social_platform(url: str, hosts: dict[str, str]) -> str | None:
    host = re.sub(r":\d+$", "", origin(url).split("://", 1)[-1])
    return hosts.get(host.removeprefix("www."))
