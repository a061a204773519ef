"""Captured web pages to structured content, on Spark. The library's main entries; modules have the rest."""

from webloom.operators.pages import crawl, detect, extract, validate
from webloom.operators.site import Extractor, Options, extractor, migrate, register, resolved, transformed
from webloom.session import session

__all__ = ["Extractor", "Options", "crawl", "detect", "extract", "extractor", "migrate", "register", "resolved", "session", "transformed", "validate"]
