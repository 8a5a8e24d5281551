"""Plain words out of running text."""

from __future__ import annotations

import html
import re
import unicodedata

_TAG = re.compile(r"<[^<>]*>")
_BROKEN = re.compile(r"(?<=\w)[-­‐]\s*\n\s*(?=\w)")
_WORD = re.compile(r"[^\W_]+")
_ASCII = re.compile(r"[^\x00-\x7f]")


def plain(text: str) -> str:
    """Lower case without markup, accents, invisible characters and words broken at line ends."""
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", html.unescape(text))
    if "\n" in text:
        text = _BROKEN.sub("", text)
    text = text.lower()
    if _ASCII.search(text):
        text = "".join(c for c in unicodedata.normalize("NFKD", text.replace("ß", "ss")) if unicodedata.category(c) not in ("Mn", "Cf"))
    return text


def words(text: str | None) -> list[str]:
    """The words of a text; none of NULL."""
    return _WORD.findall(plain(text)) if text else []
