"""The words of a post's prose: without code, markup, links, bracketed references and names with digits."""

from __future__ import annotations

import html
import re
import unicodedata

_CODE = re.compile(r"<pre\b.*?(?:</pre>|\Z)|<code\b.*?(?:</code>|\Z)|```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.I | re.S)
_LINE = re.compile(r"^(?: {4}|\t).*$", re.M)
_INLINE = re.compile(r"`[^`\n]*`")
_ANCHOR = re.compile(r"<a\b[^<>]*>.*?</a>", re.I | re.S)
_TAG = re.compile(r"<!--.*?-->|</?[a-z][^<>]*>", re.I | re.S)
_LINK = re.compile(r"\b(?:https?|ftp)://\S+|\bwww\.\S+", re.I)
_ASIDE = re.compile(r"[(\[](?:no\. ?)?#?[\w.]+(?: bp)?[)\]]")
_DROP = re.compile("[" + "".join(re.escape(chr(i)) for i in range(0x3000) if unicodedata.category(chr(i)) == "Cf") + "]")
_TOKEN = re.compile(r"[\w'’]+")


def prose_words(text: str | None) -> list[str]:
    """Lower-case words made of letters (apostrophes inside stay), in order; none for null or a post of code only."""
    if not text:
        return []
    text = _LINE.sub(" ", _CODE.sub(" \n", text))
    text = _TAG.sub(" ", _ANCHOR.sub(" ", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _DROP.sub("", text))
    text = _ASIDE.sub(" ", _LINK.sub(" ", _INLINE.sub(" ", text)))
    out = []
    for t in _TOKEN.findall(text.lower()):
        t = t.strip("'’_").replace("’", "'")
        if t and not any(c.isdigit() or c == "_" for c in t):
            out.append(t)
    return out
