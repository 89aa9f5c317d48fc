"""Text as its words: without markup, case, punctuation, invisible characters and differences of encoding."""

from __future__ import annotations

import html
import re
import unicodedata

_INLINE = re.compile(r"</?(?:a|abbr|b|code|em|font|i|mark|small|span|strong|sub|sup|u)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[a-z][^<>]*>", re.I | re.S)
_WORD = re.compile(r"[^\W_]+")
#: Formatting characters and marks left over after composition: they don't count.
_DROP = re.compile("[" + "".join(re.escape(chr(i)) for i in range(0x10000) if unicodedata.category(chr(i)) in ("Cf", "Mn")) + "]")


def words(text: str | None) -> list[str]:
    """The words of a text, folded; none for null. Tags inside a word don't part it, other tags do."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _DROP.sub("", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()))
    return _WORD.findall(text.casefold())
