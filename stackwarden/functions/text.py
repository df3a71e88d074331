"""Text expressions. All of them stay on the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .paths import _c, once

# White space as Python's str.strip() and re see it.
_WS = r"[\s\x1c-\x1f]"


def trim_unicode(s) -> Column:
    return F.regexp_replace(_c(s), f"(?U)^{_WS}+|{_WS}+$", "")


def has_text(s, at_least: int = 1) -> Column:
    """Long enough after stripping both ends; null is too short."""
    return F.coalesce(F.length(trim_unicode(s)) >= at_least, F.lit(False))


# --- accents ------------------------------------------------------------------------------------
_HANGUL_FIRST, _HANGUL_LAST = 0xAC00, 0xD7A3
# Anything but ASCII and the accented Latin letters that decompose one to one.
_BEYOND_LATIN = r"[^\x00-\x7f\xbf-\x{131}]"


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, str, list[tuple[str, str]]]:
    """Compatibility decomposition without combining marks, read off the Unicode database.

    Returns what `translate` needs for one-to-one changes (from, to, dropped) and the list of
    characters that turn into several. Hangul syllables follow a formula and are left out.
    """
    src, dst, dropped, many = [], [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or _HANGUL_FIRST <= cp <= _HANGUL_LAST:
            continue
        ch = chr(cp)
        out = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if out == ch:
            continue
        if not out:
            dropped.append(ch)
        elif len(out) == 1:
            src.append(ch)
            dst.append(out)
        else:
            many.append((ch, out))
    return "".join(src), "".join(dst), "".join(dropped), many


@lru_cache(maxsize=1)
def _expanding_class() -> str:
    """A character class of everything that decomposes into more than one character."""
    points = sorted(ord(a) for a, _ in _decompositions()[3])
    spans: list[list[int]] = [[_HANGUL_FIRST, _HANGUL_LAST]]
    for p in points:
        if spans[-1][1] == p - 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


def _hangul_parts(ch: Column) -> Column:
    """The two or three letters of a Hangul syllable, by the arithmetic of the Unicode standard."""
    i = F.ascii(ch) - F.lit(_HANGUL_FIRST)

    def letter(code: Column) -> Column:
        return F.lpad(F.hex(code.cast("long")), 4, "0")

    lead = letter(F.lit(0x1100) + F.floor(i / 588))
    vowel = letter(F.lit(0x1161) + F.floor((i % 588) / 28))
    tail = F.when(i % 28 > 0, letter(F.lit(0x11A7) + i % 28)).otherwise(F.lit(""))
    return F.decode(F.unhex(F.concat(lead, vowel, tail)), "UTF-16BE")


def strip_accents_lower(s) -> Column:
    """NFKD, combining marks dropped, lower case. Spaces and punctuation stay."""
    s = _c(s)
    src, dst, dropped, many = _decompositions()

    def plain(x: Column) -> Column:
        return F.lower(F.translate(x, src + dropped, dst))

    table = F.str_to_map(F.lit("\x01".join(f"{a}\x02{b}" for a, b in many)), F.lit("\x01"), F.lit("\x02"))
    cls = _expanding_class()

    def expand(ch: Column) -> Column:
        return (
            F.when(ch.between(F.lit(chr(_HANGUL_FIRST)), F.lit(chr(_HANGUL_LAST))), _hangul_parts(ch))
            .when(ch.rlike(cls), F.coalesce(F.try_element_at(table, ch), ch))
            .otherwise(ch)
        )

    expanded = F.array_join(F.transform(F.regexp_extract_all(s, F.lit("(?s)(.)"), 1), expand), "")
    return (
        F.when(F.octet_length(s) == F.length(s), F.lower(s))
        .when(~s.rlike(_BEYOND_LATIN) | ~s.rlike(cls), plain(s))
        .otherwise(plain(expanded))
    )


def compact(s) -> Column:
    """Letters a-z and digits only."""
    return F.regexp_replace(strip_accents_lower(s), "[^a-z0-9]+", "")


def tokens(s, min_len: int = 3) -> Column:
    return F.filter(F.split(strip_accents_lower(s), "[^a-z0-9]+"), lambda t: F.length(t) >= min_len)


def bigrams(toks) -> Column:
    """Neighbouring tokens written together."""
    t = _c(toks)
    n = F.size(t)
    pairs = F.zip_with(F.slice(t, 1, F.greatest(n - 1, F.lit(0))), F.slice(t, 2, F.greatest(n - 1, F.lit(0))),
                       lambda a, b: F.concat(a, b))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))


# --- fingerprints and model input ---------------------------------------------------------------
def normalized_text(text) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(text)), f"(?U){_WS}+", " "))


def text_fingerprint(text, max_chars: int | None = None) -> Column:
    """SHA-256 of the lower-cased text with white space collapsed; null under 50 characters."""
    t = _c(text) if max_chars is None else F.substring(_c(text), 1, max_chars)
    return once(normalized_text(t), lambda n: F.when(F.length(n) >= K.FINGERPRINT_MIN_CHARS, F.sha2(n, 256)))


def passage_input(text) -> Column:
    """The string a text encoder is given for a short text, uncut; null when there is nothing to encode."""
    t = trim_unicode(text)
    return F.when(F.length(t) > 0, F.concat(F.lit("passage: "), t))


def passage_inputs(text, max_chars: int = K.ENCODER_MAX_CHARS) -> Column:
    """The whole text as an array of such strings, each of a passage of at most max_chars characters; empty when there
    is nothing to encode. The vectors of a text's passages are pooled by operators.exemplars.pooled."""
    t = trim_unicode(text)
    starts = F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t), F.lit(max_chars))).otherwise(F.array().cast("array<int>"))
    return F.transform(F.coalesce(starts, F.array().cast("array<int>")),
                       lambda i: F.concat(F.lit("passage: "), F.substring(t, i, F.lit(max_chars))))


def tag_input(tag) -> Column:
    return F.concat(F.lit("a photo of "), _c(tag))


def label_key(name) -> Column:
    """The key under which names of groups count as the same."""
    return trim_unicode(strip_accents_lower(name))


def keyword_tokens(text) -> Column:
    """Words of a text that may serve as keywords, in reading order."""
    words = F.regexp_extract_all(strip_accents_lower(text), F.lit("[a-zA-Z][a-zA-Z']{2,}"), 0)
    stop = [w for w in K.STOPWORDS if len(w) >= 4]
    return F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(stop))
