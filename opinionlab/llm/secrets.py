"""Operator 3, secret scans by dictionary-primed zstandard novelty.

Candidates are strings in a sensitive context: values assigned to names such as
password, token or api_key, strings of providers' key formats, private-key
blocks, and long mixed strings soon after a sensitive word.  Each one's novelty
is its marginal compressed size: the bytes that zstandard needs for the
surrounding text with the candidate in it, less those without it, the
compressor being primed with a dictionary of code and identifiers: those that
the corpus itself uses, counted over all its documents, the ``NAMES`` commonest
of at least ``LEAST_USES`` (``identifiers``), and words of code.  Identifiers are
of letters alone, several words joined by underscores or capitals, so that a key
that many documents repeat doesn't become familiar.  Words, names and
placeholders are in the dictionary or the surroundings and cost little; keys and
tokens cost nearly their entropy.  A candidate is reported if its novelty is
at least ``least_bytes`` and at least ``least_share`` of its length, or if that
holds of its first HEAD characters; candidates have no greatest length.

Positions count code points.  A candidate that overlaps an earlier reported one
is left out.  The whole text is searched; surroundings are ``window`` characters
on either side.

Defined results: null and empty texts have no candidates; a null doc_id stays
null; repeated rows are reported each; of identifiers that are equally common
the first by name is taken; an empty table gives an empty result;
``redact`` passes other columns on, sets n_chars (where there is one) to the new
length of the texts it changed, and leaves texts without findings as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth(?:orization)?|bearer|credentials?|signing[_-]?key|encryption[_-]?key|connection[_-]?string)"
_VALUE = r"[A-Za-z0-9+/=_\-.~!@#$%^&*]"
#: kind -> pattern with the candidate in group "s".
GENERATORS = {
    "private_key": r"(?P<s>-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]{0,30}PRIVATE KEY-----|\Z))",
    "provider_key": r"(?<![A-Za-z0-9])(?P<s>(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[\w-]{35}|sk-[A-Za-z0-9_-]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}|glpat-[\w-]{20,}|npm_[A-Za-z0-9]{30,})(?![A-Za-z0-9])",
    "assigned": rf"(?i:{_NAME})[\w\-]{{0,20}}[\"']?\s{{0,3}}(?:=>|:=|=|:)\s{{0,3}}[\"'`]?(?P<s>{_VALUE}{{8,}})",
    "near_word": rf"(?i:\b{_NAME})\b[^\n]{{0,40}}?(?<![A-Za-z0-9+/_\-])(?P<s>(?=[A-Za-z0-9+/_\-]*[0-9])(?=[A-Za-z0-9+/_\-]*[A-Za-z])[A-Za-z0-9+/_\-]{{20,}}={{0,2}})",
}
HEAD = 512
_COMPILED = {k: re.compile(p) for k, p in GENERATORS.items()}
#: Java's pattern for texts that can hold a candidate at all.
SUSPECT = r"(?i:pass|pwd|secret|token|key|auth|bearer|credential|connection[_-]?string)|A(?:KI|SI|GP|ID|RO)A[A-Z0-9]{16}|gh[pousr]_|github_pat_|xox[abprs]-|AIza|sk-|[sr]k_|eyJ|glpat-|npm_"
#: An identifier of several words, and the longest, in characters, that enters the dictionary.
IDENTIFIER, LONGEST = r"(?<![A-Za-z0-9_])([A-Za-z]+(?:_[A-Za-z]+)+|[a-z]+(?:[A-Z][a-z]+)+)(?![A-Za-z0-9_])", 40
#: Identifiers in the dictionary, at most 80 kilobytes in all, and how often each must occur.
NAMES, LEAST_USES = 2000, 3
#: What code usually holds; novelty is measured against it and the corpus's identifiers.
DICTIONARY = (
    "import os sys json from return class function const let var def self this public private static void string null none true false undefined "
    "password passwd passphrase passcode secret token api_key apikey access_key secret_key private_key client_id client_secret auth authorization bearer credential credentials "
    "username user_name email login host hostname port database db_password db_user connection string url endpoint http https localhost example.com config settings environment "
    "process.env os.environ getenv secrets vault changeme change_me placeholder example sample dummy test testing default your_api_key_here your-token-here xxxxxxxxxxxxxxxx "
    "000000000000 123456789 1234567890 0123456789abcdef abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ qwertyuiop letmein welcome admin administrator root user guest "
    "request response session cookie csrf header content-type application/json encoding utf-8 base64 sha256 md5 hash encrypt decrypt signature verify validate "
    "index value values key keys items list dict map array object length size count name title description type status message error exception result data file path "
    "get_password set_password reset_password password_reset password_hash password_confirmation forgot_password hashed_password token_type access_token refresh_token id_token token_expiry "
    "max_tokens num_tokens tokenizer tokenize token_ids next_token authenticate authentication authorize author authority keyboard keyword keywords primary_key foreign_key public_key sort_key "
).encode()
_tools: dict = {}


def identifiers(docs: DataFrame) -> bytes:
    """The dictionary: the commonest identifiers of docs, the commonest last, where matches cost least, after DICTIONARY."""
    names = docs.select(F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(1))).alias("name")).filter(F.length("name") <= LONGEST)
    top = names.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_USES).orderBy(F.desc("n"), "name").limit(NAMES).collect()
    return DICTIONARY + " ".join(r["name"] for r in reversed(top)).encode()


def _size(dictionary: bytes) -> Callable[[bytes], int]:
    """Compressed sizes by a compressor primed with the dictionary, made once for each worker."""
    if _tools.get("dictionary") != dictionary:
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=3)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
        _tools.update(dictionary=dictionary, size=lambda b: len(compressor.compress(b)))
    return _tools["size"]


def novelty(text: str, start: int, end: int, window: int = 256, dictionary: bytes = DICTIONARY) -> int:
    """Marginal compressed bytes of text[start:end] in its surroundings."""
    size = _size(dictionary)
    # the candidate's own repeats nearby would make it look familiar
    own, before, after = (x.encode("utf-8", "replace") for x in (text[start:end], text[max(0, start - window) : start], text[end : end + window]))
    before, after = before.replace(own, b""), after.replace(own, b"")
    return size(before + own + after) - size(before + after)


def scan(text: str | None, least_bytes: int = 8, least_share: float = 0.42, window: int = 256, dictionary: bytes = DICTIONARY) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, novelty) of the reported candidates, in order."""
    if not text:
        return []
    found: list[tuple[int, int, str, int]] = []
    for kind, pattern in _COMPILED.items():
        for m in pattern.finditer(text):
            start, end = m.span("s")
            if kind != "private_key":
                end -= len(text[start:end]) - len(text[start:end].rstrip(".,;:!*&#$%@"))
            if end - start >= 8 and all(end <= a or start >= b for a, b, _, _ in found):
                enough = lambda new, end: new >= least_bytes and new >= least_share * len(text[start:end].encode("utf-8", "replace"))  # noqa: B023, E731
                new, head = novelty(text, start, end, window, dictionary), start + HEAD
                # a dull end doesn't hide a long candidate
                if enough(new, end) or end > head and enough(novelty(text, start, head, window, dictionary), head):
                    found.append((start, end, kind, new))
    return sorted(found)


def suspects(text: Column) -> Column:
    return text.rlike(SUSPECT)


def scan_secrets(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, start, end, kind, length, novelty, share, digest) of each secret; digest: the first 16 hexadecimal digits of its sha256."""
    how.setdefault("dictionary", identifiers(docs))
    schema = "doc_id long, start long, end long, kind string, length long, novelty long, share double, digest string"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (i, a, b, kind, b - a, new, round(new / len(t[a:b].encode("utf-8", "replace")), 4), hashlib.sha256(t[a:b].encode("utf-8", "replace")).hexdigest()[:16])
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for a, b, kind, new in scan(t, **how)
            ]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
            names = ["doc_id", "start", "end", "kind", "length", "novelty", "share", "digest"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 8, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(suspects(F.col("text"))).mapInArrow(apply, schema)


def redact(docs: DataFrame, mask: str = "[SECRET]", **how) -> DataFrame:
    """docs with each secret in text replaced by mask."""
    how.setdefault("dictionary", identifiers(docs))

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            found = scan(text, **how)
            parts, at = [], 0
            for a, b, _, _ in found:
                parts += [text[at:a], mask]
                at = b
            out.append("".join([*parts, text[at:]]) if found else None)
        return pa.array(out, pa.string())

    new = masked(F.when(suspects(docs["text"]), docs["text"]))  # other texts aren't sent to Python
    columns = {"text": F.coalesce(new, docs["text"])}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(new.isNotNull(), F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"])
    return docs.withColumns(columns)
