"""Words of a text, compared without regard to writing."""

from __future__ import annotations

import html
import re
import unicodedata

import regex

# Tags that end a word; any other tag may stand within one.
_BLOCK_TAG = regex.compile(r"</?(?:p|br|div|li|ul|ol|tr|td|th|table|thead|tbody|h[1-6]|hr|pre|blockquote|section|article|title|body|head|html)\b[^<>]*>", regex.I)
_TAG = regex.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", regex.S)
_BROKEN = regex.compile(r"(?<=[^\W_])(?:-|\u2010|\u2011|\u00ad)[^\S\n]*\r?[\n\u2028\u2029\r]\s*(?=[^\W_])")
#: What every text with a broken word matches, also before its entities and tags are resolved.
HYPHEN_AT_END = "[-\u2010\u2011\u00ad&]"
_UNSEEN = regex.compile(r"[\p{M}\p{Cf}\ufe00-\ufe0f]+")
_WORD = regex.compile(r"[^\W_]+(?:\x01[^\W_]+)*")
_PLAIN_WORD = re.compile(r"[a-z0-9]+(?:\x01[a-z0-9]+)*")


def _runs(text: str | None) -> tuple[list[str], bool]:
    """(words, whether some are broken at a line's end; these hold a mark)."""
    if not text:
        return [], False
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    text = _BROKEN.sub("\x01", text)
    if text.isascii():
        return _PLAIN_WORD.findall(text.lower()), "\x01" in text
    text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.casefold()), "\x01" in text


def words(text: str | None, known=frozenset()) -> list[str]:
    """Runs of letters and digits without regard to case, accents, width, markup and invisible characters.

    A word broken by a hyphen at a line's end counts as one word if ``known`` has the joined word, else as two.
    Null and empty texts have no words.
    """
    found, broken = _runs(text)
    if not broken:
        return found
    out: list[str] = []
    for w in found:
        if "\x01" in w and (joined := w.replace("\x01", "")) in known:
            out.append(joined)
        else:
            out += w.split("\x01")
    return out


def broken_words(text: str | None) -> list[str]:
    """The words that stand broken at a line's end, joined."""
    found, broken = _runs(text)
    return [w.replace("\x01", "") for w in found if "\x01" in w] if broken else []
