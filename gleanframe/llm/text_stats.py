"""Statistics of one text that tell prose from lists, tables and junk."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import lru_cache
from itertools import chain

#: The statistics in order. The first five are those a reader asks for; the others describe lines, fields and repetition.
STATISTICS = (
    "word_count", "mean_word_length", "symbol_ratio", "punctuated_line_share", "common_word_share",
    "digit_ratio", "upper_ratio", "space_ratio", "control_ratio", "garbled_ratio", "bracket_ratio", "line_count",
    "mean_line_length", "line_spread", "sentence_share", "item_share", "field_share", "pair_share", "noise_share",
    "bullet_share", "file_share", "even_fields", "separator_rate", "segment_length", "repeated_share", "distinct_words",
    "top_word_share", "packed_ratio", "hex_share", "mixed_share", "entropy", "long_word_share", "common_runs", "terminal_rate",
    "gap_rate", "case_mix", "top_segment_share", "distinct_segments",
)

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+(?:[.,]\d+)*")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_KANA = re.compile(r"[぀-ヿ]")
_SEGMENT = re.compile(r"[.!?。！？;；,，、|#\n·•]+")
_BULLET = re.compile(r"^\s*(?:[-*•◦·–—▪‣+]|\d{1,3}[.)、]|\(\d{1,3}\)|#\d{1,3}|\[[ xX✓]?\]|[a-zA-Z][.)])\s*\S")
_FILE = re.compile(r"^\S+\.(?:jpe?g|png|tiff?|webp|bmp|heic|raw|dng|xmp|gif)$", re.I)
_PAIR = re.compile(r"^\W{0,3}[^\W\d][\w ./-]{0,28}?\s*(?:[:=：]|\t)\s*\S")
_GAP = re.compile(r"\S(?: {2,}|\t)\s*\S")
_RULE = re.compile(r"^[\s|:+─━┼│=-]{4,}$")
_HEX = re.compile(r"(?<!\w)(?:(?:0x)?(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{6,}|[0-9a-f]{2})(?!\w)")
_MIXED = re.compile(r"(?<!\w)(?=\w*\d)(?=\w*[^\W\d_])\w{3,}")
_GARBLED = re.compile(r"[ÂÃÄÅâãäåæçèéïðÐÑ][\u0080-¿ŒœŠšŽžŸƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]")
_LEADS = frozenset("ÂÃÄÅâãäåæçèéïðÐÑ")
_END = frozenset(".!?。！？…:;”\"»）)")


def words_of(text: str) -> list[str]:
    """Words, numbers, and wide characters one by one."""
    words = _WORD.findall(text)
    if not _WIDE.search(text):
        return words
    found = []
    for w in words:
        if _WIDE.search(w):
            found.extend(w)
        else:
            found.append(w)
    return found


def lowered(words: list[str]) -> list[str]:
    """The words in lower case, all at once."""
    return "\0".join(words).lower().split("\0") if words else []


@lru_cache(maxsize=64)
def _is_wide(words: frozenset[str]) -> bool:
    return any(_WIDE.search(w) for w in words)


def language_of(text: str, words: list[str], declared: str | None, common: dict[str, frozenset[str]], frequency: Counter | None = None) -> str:
    """The language of ``common`` that fits best: by script, else by common words, else as declared, else the first."""
    wide = len(_WIDE.findall(text))
    if wide and wide * 3 > len(words):
        kana = len(_KANA.findall(text))
        pick = "ja" if kana * 10 > wide else "zh-CN"
        if pick in common:
            return pick
    frequency = Counter(lowered(words)) if frequency is None else frequency
    hits = {k: sum(frequency[w] for w in frequency.keys() & c) for k, c in common.items() if not _is_wide(c)}
    named = (declared or "").strip().lower()
    known = next((k for k in common if named and k.lower()[:2] == named[:2]), None)
    if hits:
        best = max(hits, key=lambda k: (hits[k], k == known))
        if hits[best] >= 2:
            return best
    return known or (min(common) if common else "und")


def _line_kind(text: str, hits: int, count: int, listed: bool) -> tuple[str, int]:
    """What a line without blanks around it looks like, and its number of fields. It has ``count`` words, ``hits`` of them
    common; ``listed``: it begins as an item does."""
    bars = text.count("|") + text.count("│") + text.count("\t")
    gaps = len(_GAP.findall(text)) if "  " in text or "\t" in text else 0
    fields = max(bars, gaps) + 1
    if _RULE.match(text):
        return "field", 0
    commas = max(text.count(","), text.count(";"))
    if bars >= 2 or gaps >= 2:
        return "field", fields
    if commas >= 2 and hits * 6 < count and len(text) / (commas + 1) < 26 and ", " not in text and "; " not in text:
        return "field", commas + 1
    if listed:
        return "item", 1
    if hits * 5 < count + 2 and count < 12 and _PAIR.match(text):
        return "pair", 2
    if count >= 4 and hits * 7 >= count:
        return "sentence", 1
    if 0 < count <= 6 and not any(c.isdigit() for c in text):
        return "item", 1
    if gaps == 1 or bars == 1:
        return "pair", 2
    return "noise", 1


_DIGIT, _UPPER, _LETTER, _SPACE, _SYMBOL, _BRACKET, _CONTROL = (1 << i for i in range(7))


@lru_cache(maxsize=1 << 16)
def _character(c: str) -> int:
    """The kinds of a character."""
    if c.isdigit():
        return _DIGIT
    if c.isalpha():
        return _LETTER | (_UPPER if c.isupper() else 0)
    if c.isspace():
        return _SPACE
    return _SYMBOL | (_BRACKET if c in "{}[]<>\"=" else 0) | (_CONTROL if not c.isprintable() or c == "�" else 0)


def describe(text: str, declared: str | None, common: dict[str, frozenset[str]]) -> tuple[str | None, list[float]]:
    """The language of a text and the values of ``STATISTICS``; a blank text has no language and zeros. Its words are found once."""
    if not text.strip():
        return None, [0.0] * len(STATISTICS)
    lines = [x for x in text.splitlines() if x.strip()]
    by_line = [words_of(x) for x in lines]
    words = list(chain.from_iterable(by_line))  # no word goes over the end of a line
    lower = lowered(words)
    frequency = Counter(lower)
    language = language_of(text, words, declared, common, frequency)
    return language, _values(text, lines, by_line, words, lower, frequency, common.get(language, frozenset()))


def statistics(text: str, language: str, words: list[str], common: frozenset[str]) -> list[float]:
    """The values of ``STATISTICS``; every one is finite, whatever the text. A blank text has zeros."""
    if not text.strip():
        return [0.0] * len(STATISTICS)
    lines = [x for x in text.splitlines() if x.strip()]
    lower = lowered(words)
    return _values(text, lines, [words_of(x) for x in lines], words, lower, Counter(lower), common)


def _values(text: str, lines: list[str], by_line: list[list[str]], words: list[str], lower: list[str], frequency: Counter, common: frozenset[str]) -> list[float]:
    n = len(text)
    solid = sum(len(x.strip()) for x in lines) or 1
    count = len(words) or 1
    hit = [*map(common.__contains__, lower)]
    chars = Counter(text)
    entropy = -sum(c / n * math.log2(c / n) for c in chars.values())
    of = dict.fromkeys((_DIGIT, _UPPER, _LETTER, _SPACE, _SYMBOL, _BRACKET, _CONTROL), 0)
    for c, k in chars.items():
        kinds = _character(c)
        for kind in of:
            if kinds & kind:
                of[kind] += k
    digits, upper, letters, space, symbol, bracket, control = of.values()
    share = dict.fromkeys(("sentence", "item", "field", "pair", "noise"), 0)
    fields: Counter = Counter()
    bullets = files = 0
    at = 0
    for line, own in zip(lines, by_line):
        stripped = line.strip()
        bullet, file = bool(_BULLET.match(line)), bool(_FILE.match(stripped))
        kind, k = _line_kind(stripped, sum(hit[at : at + len(own)]), len(own), bullet or file)
        at += len(own)
        share[kind] += len(stripped)
        if k:
            fields[k] += 1
        bullets += bullet
        files += file
    even = max((c for k, c in fields.items() if k > 1), default=0) / len(lines)
    lengths = [len(x) for x in lines]
    mean_length = sum(lengths) / len(lines)
    spread = math.sqrt(sum((x - mean_length) ** 2 for x in lengths) / len(lines)) / mean_length
    segments = Counter(s for x in _SEGMENT.split(text) if (s := x.strip().lower()))
    total = sum(len(s) * k for s, k in segments.items()) or 1
    repeated = sum(len(s) * (k - 1) for s, k in segments.items()) / total
    pieces = sum(segments.values()) or 1
    raw = text.encode("utf-8", "replace")
    separators = sum(chars.get(c, 0) for c in "|│;；、,，·•#\t")
    runs = sum(a and b for a, b in zip(hit, hit[1:]))
    ended = sum(chars.get(c, 0) for c in ".!?。！？")
    changes = sum(k for w, k in Counter(words).items() if len(w) > 2 and not w.islower() and not w.isupper() and not w.istitle() and w.isalpha())
    return [
        math.log1p(len(words)),
        sum(map(len, words)) / count,
        symbol / n,
        sum(x.rstrip()[-1:] in _END for x in lines) / len(lines),
        sum(hit) / count,
        digits / n,
        upper / max(letters, 1),
        space / n,
        control / n,
        (len(_GARBLED.findall(text)) if not chars.keys().isdisjoint(_LEADS) else 0) / n,
        bracket / n,
        math.log1p(len(lines)),
        math.log1p(mean_length),
        spread,
        share["sentence"] / solid,
        share["item"] / solid,
        share["field"] / solid,
        share["pair"] / solid,
        share["noise"] / solid,
        bullets / len(lines),
        files / len(lines),
        even,
        separators / count,
        math.log1p(total / pieces),
        repeated,
        len(frequency) / math.sqrt(2 * count),
        max(frequency.values(), default=0) / count,
        math.log(len(zlib.compress(raw, 1)) / len(raw)),
        len(_HEX.findall(text)) / count,
        (len(_MIXED.findall(text)) if digits else 0) / count,
        entropy,
        sum(len(w) > 15 for w in words) / count,
        runs / count,
        ended / count,
        (len(_GAP.findall(text)) if "  " in text or "\t" in text else 0) / count,
        changes / count,
        max((len(x) * k for x, k in segments.items()), default=0) / total,
        math.log1p(len(segments)),
    ]
