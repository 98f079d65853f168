"""Column functions around log templates: masks, tokens, parameters and how much a template says."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Recommended masks, applied in this order.
MASKS = (
    ("IP", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("UUID", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("NUM", r"\b\d+\b"),
    ("HEX", r"\b[0-9a-fA-F]{8,}\b"),
)
PARAM, TRUNCATED = "<*>", "<TRUNCATED>"
MAX_TOKENS, MIN_LITERALS, MAX_PLACEHOLDER_RATIO = 32, 8, 0.6
_WORD = "[A-Za-z0-9_]"
#: ``\b`` between ASCII word characters and others, as it is in most regular expressions of log tools.
ASCII_BORDER = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


#: What a text has if any of MASKS fits it: a digit, an address's sign, or a run of hexadecimal letters.
MASKABLE = r"[0-9@]|[a-fA-F]{8}"


def _bordered(pattern: str) -> str:
    """``pattern`` with ASCII borders, which need look only one way beside a class of word characters."""
    word = (r"\d", "[0-9a-fA-F]")
    if pattern.startswith(tuple(rf"\b{w}" for w in word)):
        pattern = f"(?<!{_WORD})" + pattern[2:]
    if re.search(r"(?:\\d|\[0-9a-fA-F\]|\[A-Za-z\])(?:\+|\{[\d,]+\})\\b$", pattern):
        pattern = pattern[:-2] + f"(?!{_WORD})"
    return pattern.replace(r"\b", ASCII_BORDER)


def mask(text: Column, masks: Sequence[tuple[str, str]] = MASKS) -> Column:
    out = text
    for name, pattern in masks:
        replacement = re.sub(r"([\\$])", r"\\\1", f"<{name}>")
        out = F.regexp_replace(out, _bordered(pattern), replacement)
    if {p for _, p in masks} <= {p for _, p in MASKS}:
        return F.when(text.rlike(MASKABLE), out).otherwise(text)
    return out


def tokens(text: Column, max_tokens: int = MAX_TOKENS, delimiters: Sequence[str] = ()) -> Column:
    """Words of ``text``; of too many, the first ``max_tokens - 1`` and a mark."""
    for d in delimiters:
        text = F.replace(text, F.lit(d), F.lit(" "))
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    if max_tokens <= 0:
        return words
    return F.when(F.size(words) > max_tokens, F.concat(F.slice(words, 1, max_tokens - 1), F.array(F.lit(TRUNCATED)))).otherwise(words)


def parameters(template: Column, words: Column, masks: Sequence[str] = tuple(n for n, _ in MASKS)) -> Column:
    """The words that stand where the template has a placeholder of its own; null if lengths differ."""
    holes = F.array(*[F.lit(x) for x in (PARAM, *(f"<{m}>" for m in masks))])
    pairs = F.filter(F.arrays_zip(template.alias("t"), words.alias("w")), lambda p: F.array_contains(holes, p["t"]))
    return F.when(F.size(template) == F.size(words), F.transform(pairs, lambda p: p["w"]))


def literals(template: Column) -> Column:
    """ASCII letters and digits outside of short ``<...>``."""
    return F.length(F.regexp_replace(F.regexp_replace(template, "<[^>]{0,7}>", ""), "[^A-Za-z0-9]", ""))


def placeholder_ratio(template: Column) -> Column:
    words = tokens(template, 0)
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: w.rlike("^<[^<>]+>$"))) / F.size(words)).otherwise(F.lit(0.0))


def informative(template: Column, min_literals: int = MIN_LITERALS, max_ratio: float = MAX_PLACEHOLDER_RATIO) -> Column:
    enough = (literals(template) >= min_literals) if min_literals > 0 else F.lit(True)
    return enough & ((placeholder_ratio(template) <= max_ratio) if max_ratio > 0 else F.lit(True))


def merged(template: Column, words: Column) -> Column:
    """``template`` with placeholders where ``words`` differ."""
    return F.zip_with(template, words, lambda a, b: F.when(a == b, a).otherwise(PARAM))


def text_glob(value: Column, pattern: str) -> Column:
    """Whether the whole of ``value`` fits; ``*`` stands for anything, the rest for itself."""
    return value.rlike("(?s)^" + ".*".join(re.escape(p) for p in pattern.split("*")) + r"\z")


def path_glob(value: Column, pattern: str) -> Column:
    """Shell globs: ``*`` and ``?`` stay within a path's part, ``[...]`` is a class."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif end > 0:
            out += "[" + pattern[i + 1 : end].replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return value.rlike("(?s)^" + out + r"\z")


def best_marking(template: Column, exact: dict[str, str], patterns: dict[str, str]) -> Column:
    """The marking of a template: its own, else of the longest pattern that fits, ties by text; null without any."""
    out = F.lit(None).cast("string")
    for pattern in sorted(patterns, key=lambda p: (-len(p.encode()), p), reverse=True):
        out = F.when(text_glob(template, pattern), patterns[pattern]).otherwise(out)
    for text, marking in exact.items():
        out = F.when(template == text, marking).otherwise(out)
    return out
