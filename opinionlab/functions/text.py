"""Text rules (F1-F14, P7-P9) as Spark expressions.

Every function takes and gives a Column; a null text counts as an empty one.
The patterns are Java's; ``text_sql`` holds the same rules for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]"
_NON = r"[^\s\x1c-\x1f]"
BRACKET_WORDS = sorted("心 爱心 比心 赞 强 弱 怒 支持 反对 鼓掌 加油 鄙视 吐槽 裂开".split())
ATTITUDE_WORDS = sorted("顶 强 赞 点赞 赞成 支持 同意 不同意 不支持 好评 差评 反对 反感 不满 无语 离谱 荒唐".split(), reverse=True)
ATTITUDE_SIGNS = "✅❌❤️👍👎👏💔💪🙌🤬😡"
LOW_INFORMATION = sorted("666 888 999 嗯 嗯嗯 哦 啊 呵呵 哈哈 哈哈哈 早安 晚安 分享 转发 转发了 收到 了解 好的 知道了".split(), reverse=True)
COMMON_LOW_INFORMATION = sorted("666 888 呵呵 哈哈 早安 晚安 分享 感谢分享 转发 收到 了解 好的 知道了 谢谢".split(), reverse=True)
ATTITUDE = rf"\[(?:{'|'.join(BRACKET_WORDS)})\]|[{ATTITUDE_SIGNS}]|{'|'.join(ATTITUDE_WORDS)}"

W = r"\p{L}\p{N}_"
#: Detectors of personal data in exported text (P7) and of the quality profile.
PATTERNS = {
    "url": r"(?i)https?://\S|www\.\S",
    "mention": f"@[{W}-]",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone_or_long_id": r"(?U)(?<!\d)(?:\+?\d[\d\-\s()]{7,}\d)(?!\d)",
}
PROFILE_PATTERNS = {
    "contains_url": r"(?i)https?://|www\.",
    "contains_mention": rf"(?U)@{_NON}",
    "contains_email": rf"[{W}][{W}.+-]*@[{W}-]+(?:\.[{W}-]+)*\.[{W}-]*[{W}]",
    "contains_phone_or_long_number": r"(?U)(?<!\d)(?:\+?86[-\s]?)?1[3-9]\d{9}(?!\d)|(?<!\d)\d{7,12}(?!\d)",
    "question_like": rf"[?？]|[吗么](?![{W}])|是不是|难道|哪里|怎么|为什么",
}


#: What a text must hold for a pattern to occur in it.
_NEEDS = {
    "contains_mention": "@",
    "contains_email": "@",
    "contains_phone_or_long_number": r"(?U)\d{7}",
    "question_like": r"[\x{4E00}-\x{10FFFF}]",
}
_LETTER = r"[\p{L}\p{N}]"


def plain(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def squash(text: Column) -> Column:
    """white space (U+3000 too) collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(plain(text), f"{SPACE}+", " "))


def compact(text: Column) -> Column:
    return F.regexp_replace(plain(text), f"{SPACE}+", "")


def normalize(text: Column) -> Column:
    """links, tags and mentions dropped, #topic# unwrapped, white space squashed."""
    out = F.regexp_replace(plain(text), rf"(?U)https?://{_NON}+", "")
    out = F.regexp_replace(out, "<[^>]+>", "")
    out = F.regexp_replace(out, rf"(?U)@{_NON}+", "")
    return squash(F.regexp_replace(out, "#([^#]+)#", "$1"))


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")).cast("long")


def info_length(text: Column) -> Column:
    """letters and digits outside [brackets]."""
    return _letters(F.regexp_replace(plain(text), r"\[[^\]]+\]", ""))


def _plain_profile(text: Column) -> Column:
    """Without [brackets], links and mentions."""
    out = F.regexp_replace(plain(text), r"\[[^\]]+\]", "")
    maybe = F.contains(out, F.lit("://")) | F.contains(F.lower(out), F.lit("www."))
    out = F.when(maybe, F.regexp_replace(out, rf"(?iU)https?://{_NON}+|www\.{_NON}+", "")).otherwise(out)
    return F.regexp_replace(out, rf"(?U)@{_NON}+", "")


def info_length_profile(text: Column) -> Column:
    """as F4, without links and mentions."""
    return _letters(_plain_profile(text))


# The rules below ask of each text what only few long texts can be, so a look at its start, or for one
# character, comes first; WHEN and not AND, whose sides Spark may compute ahead of their turn.


def bracket_only(text: Column, limit: int = 12) -> Column:
    """nothing but [tokens] of up to limit characters."""
    return F.when(plain(text).rlike(rf"^{SPACE}*\["), compact(text).rlike(rf"^(?:\[[^\]]{{1,{limit}}}\])+$")).otherwise(False)


def emoji_only(text: Column) -> Column:
    """not blank, and bracket tokens or no letters and digits at all."""
    own = compact(text)
    none = plain(text).rlike(rf"(?U){_NON}") & ~plain(text).rlike(_LETTER)
    return F.when(~F.contains(plain(text), F.lit("[")), none).otherwise((own != "") & (own.rlike(r"^(?:\[[^\]]{1,8}\])+$") | ~F.regexp_replace(own, r"\[[^\]]+\]", "").rlike(_LETTER)))


def symbol_only(text: Column) -> Column:
    """the profile's own form of emoji_only."""
    own = compact(text)
    # what starts with a letter that starts no link
    return F.when(plain(text).rlike(rf"^{SPACE}*[\p{{L}}\p{{N}}&&[^hHwW]]"), False).otherwise((own != "") & (bracket_only(text) | ~_plain_profile(own).rlike(_LETTER)))


def attitude(text: Column) -> Column:
    """F8: a short sign of attitude, in a text that isn't emoji-only."""
    # every sign and word of ATTITUDE has a character from U+2705 on
    return F.when(plain(text).rlike(r"[\x{2705}-\x{10FFFF}]"), ~emoji_only(text) & plain(text).rlike(ATTITUDE)).otherwise(False)


def low_information(text: Column) -> Column:
    """F9."""
    longest = max(map(len, LOW_INFORMATION))
    return F.when(plain(text).rlike(rf"^(?U)[\s\x1c-\x1f]*(?:{_NON}[\s\x1c-\x1f]*){{0,{longest}}}$"), compact(text).isin(LOW_INFORMATION)).otherwise(False) | emoji_only(text)


def common_low_information(text: Column) -> Column:
    """F10."""
    return plain(text).isin(COMMON_LOW_INFORMATION)


def profile_flag(text: Column, name: str) -> Column:
    """one of PROFILE_PATTERNS."""
    found = plain(text).rlike(PROFILE_PATTERNS[name])
    own = F.when(plain(text).rlike(_NEEDS[name]), found).otherwise(False) if name in _NEEDS else found
    return F.when(F.contains(plain(text), F.lit("?")), True).otherwise(own) if name == "question_like" else own


def digest(text: Column) -> Column:
    """What texts are compared by where they are moved: sha256, as bytes; no two texts with the same are known."""
    return F.unhex(F.sha2(plain(text), 256))


def length_bucket(text: Column) -> Column:
    """F12."""
    n = F.length(plain(text))
    return F.when(n <= 10, "very_short").when(n <= 30, "short").when(n <= 80, "medium").when(n <= 200, "long").otherwise("very_long")


def _grams(text: Column, low: int, high: int) -> Column:
    none = F.array().cast("array<string>")

    def of(own: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(own) - (n - 1))
        return F.when(F.size(own) >= n, F.transform(starts, lambda i: F.array_join(F.slice(own, i, F.lit(n)), ""))).otherwise(none)

    # split once, as a substring is sought from the text's start; bound to a variable of its own: an expression within a lambda is computed for each element
    characters = F.when(F.length(text) > 0, F.split(text, "")).otherwise(none)
    return F.element_at(F.transform(F.array(characters), lambda own: F.concat(*(of(own, n) for n in range(low, high + 1)))), 1)


def topic_text(text: Column) -> Column:
    """What topic_grams are taken from."""
    return compact(F.regexp_replace(plain(text), rf"(?U)https?://{_NON}+", ""))


def topic_grams(text: Column) -> Column:
    """character 2- to 4-grams without links and white space."""
    return _grams(topic_text(text), 2, 4)


def classifier_text(text: Column, max_chars: int | None = None) -> Column:
    """What classifier_grams are taken from."""
    own = compact(text)
    return own if max_chars is None else F.substring(own, 1, max_chars)


def classifier_grams(text: Column, max_chars: int | None = None) -> Column:
    """character 1- and 2-grams without white space; of the first max_chars characters, if given."""
    return _grams(classifier_text(text, max_chars), 1, 2)


def mask_audit(text: Column) -> Column:
    """Masks for an audit's examples: link, mention, e-mail, number, in that order; 80 characters."""
    out = F.regexp_replace(plain(text), rf"(?iU)https?://{_NON}+|www\.{_NON}+", "[URL]")
    out = F.regexp_replace(out, f"@[{W}-]+", "[MENTION]")
    out = F.regexp_replace(out, PATTERNS["email"], "[EMAIL]")
    out = F.regexp_replace(out, PATTERNS["phone_or_long_id"], "[PHONE_OR_LONG_ID]")
    return F.substring(squash(out), 1, 80)


def mask(text: Column, numbers: bool = True) -> Column:
    """Masks for exported text; e-mail before mention, so that addresses go whole."""
    out = F.regexp_replace(plain(text), rf"(?iU)https?://{_NON}+|www\.{_NON}+", "[URL]")
    out = F.regexp_replace(out, PATTERNS["email"], "[EMAIL]")
    out = F.regexp_replace(out, f"@[{W}-]+", "[@USER]")
    return F.regexp_replace(out, PATTERNS["phone_or_long_id"], "[PHONE_OR_ID]") if numbers else out
