"""Words of a text: runs of letters or digits, lower case, without tags, with entities decoded, in NFKC."""

from __future__ import annotations

import html
import re
import unicodedata

TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """The text without tags, entities decoded, NFKC; case is kept."""
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(plain(text))]
