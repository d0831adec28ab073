"""The rules of ``text`` as DuckDB expressions: str -> str."""

from __future__ import annotations

from .text import ATTITUDE, COMMON_LOW_INFORMATION, LOW_INFORMATION, PATTERNS, PROFILE_PATTERNS, W

_IN = r"\s\x0b\x1c-\x1f\x85\p{Z}"


def replace(x: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', '{flags}')"


def plain(x: str) -> str:
    return f"coalesce({x}, '')"


def squash(x: str) -> str:
    return f"trim({replace(plain(x), f'[{_IN}]+', ' ')})"


def compact(x: str) -> str:
    return replace(plain(x), f"[{_IN}]+")


def normalize(x: str) -> str:
    out = replace(plain(x), f"https?://[^{_IN}]+")
    out = replace(replace(out, "<[^>]+>"), f"@[^{_IN}]+")
    return squash(replace(out, "#([^#]+)#", r"\1"))


def _letters(x: str) -> str:
    return f"length({replace(x, r'[^\p{L}\p{N}]+')})"


def info_length(x: str) -> str:
    return _letters(replace(plain(x), r"\[[^\]]+\]"))


def info_length_profile(x: str) -> str:
    out = replace(replace(plain(x), r"\[[^\]]+\]"), rf"https?://[^{_IN}]+|www\.[^{_IN}]+", "", "gi")
    return _letters(replace(out, f"@[^{_IN}]+"))


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def bracket_only(x: str, limit: int = 12) -> str:
    return matches(compact(x), rf"^(?:\[[^\]]{{1,{limit}}}\])+$")


def emoji_only(x: str) -> str:
    own = compact(x)
    return f"({own} <> '' AND ({matches(own, r'^(?:\[[^\]]{1,8}\])+$')} OR {info_length(own)} = 0))"


def symbol_only(x: str) -> str:
    own = compact(x)
    return f"({own} <> '' AND ({bracket_only(x)} OR {info_length_profile(own)} = 0))"


def attitude(x: str) -> str:
    return f"(NOT {emoji_only(x)} AND {matches(plain(x), ATTITUDE)})"


def _in(x: str, words: list[str]) -> str:
    return f"{x} IN ({', '.join(repr(w) for w in words)})"


def low_information(x: str) -> str:
    return f"({_in(compact(x), LOW_INFORMATION)} OR {emoji_only(x)})"


def common_low_information(x: str) -> str:
    return f"({_in(plain(x), COMMON_LOW_INFORMATION)})"


def profile_flag(x: str, name: str) -> str:
    pattern = {
        "contains_mention": f"@[^{_IN}]",
        "contains_phone_or_long_number": r"(^|[^\d])((\+?86[-\s]?)?1[3-9]\d{9}|\d{7,12})([^\d]|$)",
        "question_like": rf"[?？]|[吗么]([^{W}]|$)|是不是|难道|哪里|怎么|为什么",
    }.get(name, PROFILE_PATTERNS[name])
    return matches(plain(x), pattern)


def pattern_hit(x: str, name: str) -> str:
    return matches(plain(x), {"phone_or_long_id": r"(^|[^\d])\+?\d[\d\-\s()]{7,}\d([^\d]|$)"}.get(name, PATTERNS[name]))


def length_bucket(x: str) -> str:
    n = f"length({plain(x)})"
    return f"CASE WHEN {n} <= 10 THEN 'very_short' WHEN {n} <= 30 THEN 'short' WHEN {n} <= 80 THEN 'medium' WHEN {n} <= 200 THEN 'long' ELSE 'very_long' END"


def grams(x: str, low: int, high: int) -> str:
    """A list; x is an expression of modest size, as it is repeated."""
    parts = [f"list_transform(range(1, greatest(1, length({x}) - {n - 2})), lambda i: substr({x}, i, {n}))" for n in range(low, high + 1)]
    return " || ".join(parts)


def mask(x: str) -> str:
    out = replace(plain(x), rf"https?://[^{_IN}]+|www\.[^{_IN}]+", "[URL]", "gi")
    return replace(replace(out, PATTERNS["email"], "[EMAIL]"), f"@[{W}-]+", "[@USER]")


def mask_audit(x: str) -> str:
    """Without the mask of numbers, which RE2 can't express."""
    out = replace(plain(x), rf"https?://[^{_IN}]+|www\.[^{_IN}]+", "[URL]", "gi")
    return replace(replace(out, f"@[{W}-]+", "[MENTION]"), PATTERNS["email"], "[EMAIL]")
