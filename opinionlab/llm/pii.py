"""Operator 6, personal data by candidate gradient boosting.

High-recall generators propose spans, which may overlap: anything with an @
between non-blanks, dotted and colon-separated number groups, runs of digits
with separators, national and account number shapes.  Boosted trees score each
span from its format (lengths, digit groups, check digits, valid octets and
domains) and its context (neighbouring characters and words).  Scores are
calibrated by isotonic regression on the spans of texts of another kind, and a
span is selected if its probability reaches its kind's threshold, the least at
which precision there is at least ``precision``.  Of overlapping selected spans the likelier
stays, then the longer, then the earlier.

The trees are fitted here, on ``TRAINED`` spans that a seeded generator writes
(``written``): personal data in the usual formats, plain runs of digits that only
their context makes personal, and look-alikes such as versions, dates, amounts,
measures, identifiers and decimals, in neutral, helpful and misleading contexts.
Calibration and thresholds come from a generator of its own (``varied``: records,
logs, tables and prose, several spans a line).  The trained model is a few
kilobytes and goes with the tasks.

Positions count code points; a text is searched whole, and addresses and runs of
any length are proposed whole.  Phone numbers have at most 15 digits (after a
leading 00) and 25 characters, cards 19 digits, accounts 34, as their formats say; of longer runs the parts of such a
format are proposed.

Defined results: of overlapping spans that are equally likely, long and early the
kind last by name stays; null and empty texts have no spans; a null doc_id stays null;
repeated rows are reported each; an empty table gives an empty result; columns
besides doc_id and text are ignored by ``find_pii`` and passed on by ``redact``.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINED, SEED, PRECISION = 24_000, 5, 0.98
KINDS = ["email", "ip", "phone", "card", "national", "account"]
_GENERATORS = {
    "email": re.compile(r"(?<![\w.+\-%])[\w.+\-%]+@[\w.\-]+"),
    "ip": re.compile(r"(?<![\w.])\d{1,4}(?:\.\d{1,4}){3}(?![\w]|\.\d)|(?<![\w:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![\w:])"),
    "phone": re.compile(r"(?<![\w.+])(?:\+|\(|00)?\d[\d\s().\-/]{5,22}\d(?![\w])"),
    "card": re.compile(r"(?<![\w.\-])\d(?:[ \-]?\d){11,18}(?![\w\-])"),
    "national": re.compile(r"(?<![\w\-])\d{3}[- ]?\d{2}[- ]?\d{4}(?![\w\-])"),
    "account": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)"),
}
#: Java's pattern for texts that can hold a span at all: nothing narrower than what the generators match, so Unicode's digits and white space.
SUSPECT = r"(?U)@|\d[\d\s\x1c-\x1f().\-/]{5}|\d{1,4}\.\d{1,4}\.|:[0-9A-Fa-f]{0,4}:|[A-Z]{2}\d{2}"
_WORDS = {
    "email": r"e-?mail|mail|contact|write|reach|address|correo|courriel|kontakt",
    "ip": r"\bip\b|address|host|server|client|login|network|connect|from",
    "phone": r"phone|tel|call|mobile|cell|fax|dial|sms|whatsapp|reach|contact|handy|móvil|appel",
    "card": r"card|visa|master|amex|credit|debit|payment|pay|cc\b|karte|carte|tarjeta",
    "national": r"ssn|social|security|national|tax\b|taxpayer|insurance",
    "account": r"iban|account|bank|transfer|konto|compte|cuenta|swift",
    "against": r"version|release|order|invoice|isbn|serial|part|page|figure|section|chapter|build|ticket|issue|error|code|price|total|sum|amount|km|kg|eur|usd|percent|score|population|date|year|model|sku|item|id\b",
}
#: The same as the last word before a span, or with a short one between.
_LAST = {k: re.compile(rf"(?i:(?<!\w)(?:{p})\w{{0,3}}\W{{0,3}}(?:(?:me|us|him|her|on|at|to|is|no|number|account)\W{{1,3}})?)$") for k, p in _WORDS.items()}
_WORDS = {k: re.compile(rf"(?i:{p})") for k, p in _WORDS.items()}
_TLD = re.compile(r"\.[A-Za-z]{2,24}$")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban(text: str) -> bool:
    text = text.replace(" ", "")
    turned = text[4:] + text[:4]
    return turned.isalnum() and turned.isascii() and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _shape(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in ".,;:!?" else 4 if c in "\"'()[]<>" else 5


FEATURES = ["kind", "length", "digits", "groups", "longest", "shortest", "luhn", "octets", "iban", "tld", "local_letters", "dots", "plus", "brackets", "spaces", "dashes", "slashes", "same", "lead", "year", "before", "after", "own_word", "against", "valid_plan", "colons", "hex_letters", "first_group", "domain_labels", "own_last", "against_last"]


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    own = text[start:end]
    digits = "".join(c for c in own if c.isascii() and c.isdigit())
    groups = re.findall(r"[0-9]+", own)
    near = text[max(0, start - 40) : start] + " " + text[end : end + 15]
    local, _, domain = own.partition("@")
    octets = kind == "ip" and len(groups) == 4 and own.count(".") == 3 and all(len(g) <= 3 and int(g) < 256 and (g == "0" or g[0] != "0") for g in groups)
    sizes = [len(g) for g in groups] or [0]
    plan = (own.startswith("+") and 8 <= len(digits) <= 15) or bool(re.fullmatch(r"(?:\+?1[ .\-]?)?\(?[2-9]\d{2}\)?[ .\-]?\d{3}[ .\-]\d{4}", own)) or bool(re.fullmatch(r"0\d{1,4}[ /\-]\d[\d \-]{4,10}", own))
    return [
        KINDS.index(kind), len(own), len(digits), len(groups), max(sizes), min(sizes), len(digits) >= 12 and _luhn(digits), octets, kind == "account" and _iban(own), bool(_TLD.search(domain)),
        sum(c.isalpha() for c in local), own.count("."), own.startswith("+") or own.startswith("00"), own.count("(") - 2 * (own.count("(") != own.count(")")), own.count(" "), own.count("-"), own.count("/"), len(set(digits)) <= 2, int(digits[:1] or 0),
        any(len(g) == 4 and g[:2] in ("19", "20") for g in groups), _shape(text[start - 1 : start]), _shape(text[end : end + 1]), bool(_WORDS[kind].search(near)), bool(_WORDS["against"].search(near)), plan, own.count(":"), sum(c in "abcdefABCDEF" for c in own), sizes[0], domain.count(".") + 1,
        bool(_LAST[kind].search(text[max(0, start - 40) : start])), bool(_LAST["against"].search(text[max(0, start - 40) : start])),
    ]


def candidates(text: str | None) -> list[tuple[str, int, int]]:
    """Every proposed span, in order; the ends' punctuation is left out."""
    if not text:
        return []
    out = set()
    for kind, pattern in _GENERATORS.items():
        for m in pattern.finditer(text):
            own = m.group()
            tail = len(own) - len(own.rstrip(".-_/ :" if kind == "email" else ".-/ (\n\t"))
            lines = re.split("[\n\t]", own[: len(own) - tail])  # no span runs over a line's or a column's end
            at = m.start()
            for line in lines:
                if line.startswith("(") and ")" not in line:
                    line, at = line[1:], at + 1
                size = len(line.rstrip())
                digits = sum(c.isdigit() for c in line)
                if size >= 5 and (kind != "phone" or digits >= 7):
                    if kind != "phone" or digits <= (17 if line.startswith("00") else 15):  # the longest number with its country, after 00
                        out.add((kind, at, at + size))
                    if kind in ("phone", "card") and " " in line.strip():  # numbers side by side look like one
                        for part in re.finditer(r"(?:\+\d{1,3} )?\(?\d{2,4}\) ?\d{3}[ \-]?\d{3,4}|\d{3}[ .\-]\d{3}[ .\-]\d{4}|\+\d[\d()\-]+(?: [\d()\-]+)*|\d{12,19}|\d{4} \d{4} \d{4} \d{4}", line):
                            if sum(c.isdigit() for c in part.group()) >= 7:
                                out.add((kind if len(part.group()) < 12 or not part.group().isdigit() else "card", at + part.start(), at + part.end()))
                at += len(line) + 1
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


class Trees:
    """Boosted regression trees on binned features: logistic loss, leaf-wise Newton steps, depth-limited."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 150, depth: int = 5, rate: float = 0.2, least: float = 4.0) -> None:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        b = self._bins(x)
        self.base, self.rate, self.depth = float(np.log(y.mean() / (1 - y.mean()))), rate, depth
        g = np.full(len(y), self.base)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-g))
            tree = self._tree(b, y - p, p * (1 - p), least)
            self.trees.append(tree)
            g += rate * self._leaf(tree, b)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)

    def _tree(self, b: np.ndarray, grad: np.ndarray, hess: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes = (1 << self.depth) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(2 * nodes + 1)
        at = np.zeros(len(b), np.int64)
        for level in range(self.depth):
            first, n = (1 << level) - 1, 1 << level
            own = at - first
            best = np.full(n, 1e-6)
            for f in range(b.shape[1]):
                k = len(self.cuts[f]) + 1
                if k == 1:
                    continue
                key = own * k + b[:, f]
                gs = np.bincount(key, grad, n * k).reshape(n, k).cumsum(1)
                hs = np.bincount(key, hess, n * k).reshape(n, k).cumsum(1)
                total_g, total_h = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                gain[(hs < least) | (total_h - hs < least)] = 0
                j = gain[:, :-1].argmax(1)
                top = gain[np.arange(n), j]
                won = top > best
                best[won] = top[won]
                feature[first : first + n][won], cut[first : first + n][won] = f, j[won]
            f = feature[at]
            right = (f >= 0) & (b[np.arange(len(b)), np.maximum(f, 0)] > cut[at])
            at = 2 * at + 1 + right
        gs, hs = np.bincount(at, grad, len(value)), np.bincount(at, hess, len(value))
        return feature, cut, gs / (hs + 1)

    def _leaf(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(b), np.int64)
        for _ in range(self.depth):
            f = feature[at]
            at = 2 * at + 1 + ((f >= 0) & (b[np.arange(len(b)), np.maximum(f, 0)] > cut[at]))
        return value[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._bins(x)
        return self.base + self.rate * sum((self._leaf(t, b) for t in self.trees), np.zeros(len(b)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, probabilities) of the pool-adjacent-violators fit, to interpolate in."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, number, last score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v, n, s = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v, blocks[-1][1] + n, s]
    return np.array([b[2] for b in blocks]), np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks])


def written(n: int, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """n sentences with at most one number or address each, and the spans in them that are personal data."""
    rng = random.Random(seed)
    digit = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda a=3, b=9: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))

    def card() -> str:
        own = rng.choice("3456") + digit(rng.choice([13, 14, 14, 14]))
        return own + next(c for c in "0123456789" if _luhn(own + c))

    def iban() -> str:
        body = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" if rng.random() < 0.2 else "0123456789") for _ in range(rng.choice([14, 16, 18, 20])))
        land = rng.choice(["DE", "FR", "ES", "GB", "NL", "IT"])
        return land + f"{98 - int(''.join(str(int(c, 36)) for c in body + land + '00')) % 97:02d}" + body

    spaced = lambda s, k=4, sep=" ": sep.join(s[i : i + k] for i in range(0, len(s), k))
    octet = lambda: str(rng.randint(0, 255))
    good = {
        "email": [lambda: f"{name()}{rng.choice(['.', '_', '', '-'])}{rng.choice([name(), digit(2), ''])}".rstrip("._-") + f"@{rng.choice([name(), 'mail' + digit(1) + '.' + name(), name() + '.' + name(2, 3)])}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io', 'co.uk', 'edu'])}"],
        "ip": [lambda: ".".join(octet() for _ in range(4)), lambda: ".".join(octet() for _ in range(4)), lambda: ":".join(f"{rng.randint(0, 65535):x}" for _ in range(8))],
        "phone": [
            lambda: f"+{rng.randint(1, 99)} ({digit(3)}) {digit(3)}-{digit(4)}", lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{digit(4)}", lambda: f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{digit(4)}", lambda: f"{rng.randint(200, 999)}.{rng.randint(200, 999)}.{digit(4)}",
            lambda: f"+{rng.choice(['33', '49', '34', '44'])} {digit(1)} {digit(2)} {digit(2)} {digit(2)} {digit(2)}", lambda: f"+{rng.choice(['33', '49', '34', '44', '1'])}{digit(10)}", lambda: f"0{digit(3)} {digit(7)}", lambda: f"0{digit(2)}/{digit(7)}", lambda: f"+{rng.randint(1, 99)} {digit(3)} {digit(3)} {digit(4)}",
        ],
        "card": [card, card, lambda: spaced(card()), lambda: spaced(card(), 4, "-")],
        "national": [lambda: f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"],
        "account": [iban, lambda: spaced(iban())],
    }
    bad = {
        "email": [lambda: f"@{name()}", lambda: f"{name()}@{digit(2)}", lambda: f"{name()}@{name()}", lambda: f"{digit(2)}@{digit(1)}.{digit(2)}", lambda: f"{name()}@v{digit(1)}.{digit(1)}.{digit(1)}", lambda: f"@{name()}.{name()}@"],
        "ip": [lambda: f"{digit(1)}.{digit(1)}.{rng.randint(256, 9999)}.{digit(1)}", lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)), lambda: f"0{digit(1)}.0{digit(1)}.{rng.randint(1900, 2030)}.{digit(1)}", lambda: f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}:{digit(2)}"],
        "phone": [
            lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda: f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.{rng.randint(1900, 2030)}", lambda: f"{rng.randint(1, 28):02d}/{rng.randint(1, 12):02d}/{rng.randint(1900, 2030)}", lambda: digit(rng.randint(7, 11)).lstrip("0") or "7000000", lambda: f"{rng.randint(1, 9)} {digit(3)} {digit(3)}",
            lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}", lambda: f"{digit(3)}.{digit(6)}", lambda: f"978-{digit(1)}-{digit(4)}-{digit(4)}-{digit(1)}", lambda: f"{rng.randint(1900, 2030)}{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}", lambda: f"{digit(2)} {digit(2)} {digit(2)} {digit(2)}", lambda: f"{rng.randint(1, 99)}.{digit(3)}.{digit(3)}", lambda: f"{digit(4)}-{digit(4)}", lambda: f"{digit(4)}/{digit(4)}",
        ],
        "card": [lambda: next(s for s in iter(lambda: digit(rng.randint(12, 19)), None) if not _luhn(s)), lambda: next(s for s in iter(lambda: digit(16), None) if not _luhn(s)), lambda: spaced(next(s for s in iter(lambda: digit(16), None) if not _luhn(s)))],
        "national": [lambda: f"{digit(2)}-{digit(3)}-{digit(4)}", lambda: f"000-{digit(2)}-{digit(4)}", lambda: f"{rng.randint(900, 999)}-{digit(2)}-{digit(4)}"],
        "account": [lambda: rng.choice(["AB", "XK", "SN", "PN"]) + digit(rng.choice([10, 14, 18])), lambda: rng.choice(["DE", "GB"]) + digit(16)],
    }
    # personal or not by what stands before them
    bare = {
        "phone": [lambda: f"{rng.randint(200, 999)} {rng.randint(200, 999)} {digit(4)}", lambda: f"{rng.randint(200, 999)}{rng.randint(200, 999)}{digit(4)}", lambda: f"0{digit(1)} {digit(2)} {digit(2)} {digit(2)} {digit(2)}", lambda: f"{rng.randint(200, 999)}-{digit(4)}", lambda: f"{rng.randint(2000000, 9999999)}", lambda: f"0{digit(9)}", lambda: f"1 {rng.randint(200, 999)} {digit(3)} {digit(4)}"],
        "national": [lambda: f"{rng.randint(100, 665)}{digit(2)}{rng.randint(1000, 9999)}"],
    }
    lead = {"email": ["write to", "email:", "contact"], "ip": ["from", "host", "ip address"], "phone": ["call", "tel:", "phone", "mobile", "call me on", "fax:", "text"], "card": ["card", "visa", "paid with"], "national": ["ssn", "social security number", "ssn:"], "account": ["iban", "account", "transfer to"]}
    against = ["version", "order", "invoice no.", "isbn", "page", "build", "ticket", "serial", "total", "model", "item", "section"]
    out = []
    while len(out) < n:
        kind, personal = rng.choice(KINDS), rng.random() < 0.5
        plain = kind in bare and rng.random() < 0.4
        own = rng.choice((bare if plain else good if personal else bad)[kind])()
        r = (0.0 if personal else rng.choice([0.99, 0.5 if own.isdigit() else 0.99])) if plain else rng.random()
        before = " ".join([name(2, 8).capitalize(), *(name(2, 8) for _ in range(rng.randint(0, 6)))]) if rng.random() < 0.9 else ""
        word = rng.choice(lead[kind]) if r < (0.25 if personal else 0.08) else rng.choice(against) if r > (0.97 if personal else 0.7) else ""
        text = " ".join(x for x in (before, word) if x)
        text += rng.choice([" ", " ", " ", ": ", " (", "\n"]) if text else ""
        start = len(text)
        text += own + rng.choice([" ", " ", ". ", ", ", "; ", "\n", ") ", "."])
        text += " ".join(name(2, 8) for _ in range(rng.randint(0, 5) if text[-1].isspace() else 0))
        out.append((text, [(start, start + len(own))] if personal else []))
    return out


def varied(n: int, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """n lines of records, logs, tables, lists and prose with personal data and other numbers side by side, and the personal spans."""
    rng = random.Random(seed)
    pick, num = rng.choice, rng.randint
    names, towns = ["Ana Ruiz", "J. Smith", "Marie Dubois", "K. Weber", "Li Na", "Tom O'Neil"], ["Lyon", "Bonn", "Sevilla", "Leeds", "Austin"]
    card = lambda: next(x for x in iter(lambda: f"{pick('345')}{num(0, 10**15 - 1):015d}", None) if _luhn(x))

    def account() -> str:
        land, body = pick(["DE", "ES", "FR"]), f"{num(0, 10**18 - 1):018d}"
        return next(x for x in (f"{land}{k:02d}{body}" for k in range(2, 99)) if _iban(x))

    yes = {
        "mail": lambda: f"{pick(['ana', 'tom.k', 'marie_d', 'li-na', 'x9', 'info'])}{pick(['', num(1, 99)])}@{pick(['mail', 'post', 'uni', 'web'])}{pick(['', '.co', '-box'])}.{pick(['com', 'de', 'fr', 'es', 'org', 'net'])}",
        "host": lambda: f"{num(1, 223)}.{num(0, 255)}.{num(0, 255)}.{num(1, 254)}",
        "phone": lambda: pick([f"+{pick([33, 34, 49, 44, 1])} {num(100, 999)} {num(100, 999)} {num(100, 9999)}", f"({num(201, 989)}) {num(200, 999)}-{num(1000, 9999)}", f"{num(201, 989)}-{num(200, 999)}-{num(1000, 9999)}", f"+{num(1, 98)}{num(10**8, 10**10)}"]),
        "dial": lambda: pick([f"{num(201, 989)} {num(200, 999)} {num(1000, 9999)}", f"0{num(1, 7)} {num(10, 99)} {num(10, 99)} {num(10, 99)} {num(10, 99)}", f"{num(2010000000, 9899999999)}", f"{num(200, 999)}-{num(1000, 9999)}"]),
        "card": lambda: pick([card, lambda: " ".join(re.findall("....", card()))])(),
        "ssn": lambda: f"{num(100, 665)}-{num(10, 99)}-{num(1000, 9999)}",
        "iban": lambda: pick([account, lambda: " ".join(re.findall(".{1,4}", account()))])(),
    }
    no = {
        "day": lambda: pick([f"{num(1990, 2029)}-{num(1, 12):02d}-{num(1, 28):02d}", f"{num(1, 28):02d}.{num(1, 12):02d}.{num(1990, 2029)}"]), "time": lambda: f"{num(0, 23):02d}:{num(0, 59):02d}:{num(0, 59):02d}", "sum": lambda: pick([f"{num(1, 999)},{num(0, 999):03d}.{num(0, 99):02d}", f"{num(1, 99)} {num(100, 999)} {num(100, 999)}", f"{num(1000000, 99999999)}"]),
        "order": lambda: pick([f"{num(10**7, 10**9)}", f"{num(1000, 9999)}-{num(100000, 999999)}", f"{pick(['AB', 'INV', 'SN'])}{num(10**9, 10**11)}"]), "version": lambda: pick([f"{num(0, 20)}.{num(0, 40)}.{num(256, 9000)}.{num(0, 9)}", f"{num(0, 20)}.{num(0, 40)}.{num(0, 99)}"]), "tag": lambda: pick([f"@{pick(['news', 'team', 'dev'])}", f"pkg@{num(1, 9)}.{num(0, 9)}.{num(0, 9)}", f"a @ {num(1, 99)}"]),
        "long": lambda: next(x for x in iter(lambda: f"{num(10**15, 10**16 - 1)}", None) if not _luhn(x)), "isbn": lambda: f"978-{num(0, 9)}-{num(1000, 9999)}-{num(1000, 9999)}-{num(0, 9)}", "size": lambda: f"{num(100, 999999)}", "who": lambda: pick(names), "town": lambda: pick(towns),
    }
    lines = [
        "{who};{town};{mail};{phone}", "Tel.: {dial} | E-Mail: {mail}", "Please call {who} on {dial} before {time}.", "{day}T{time}Z {host} GET /index.html 200 {size}", "Order no. {order} of {day}, total {sum} EUR, paid with card {card}", "version {version} of {day} mends issue {order}",
        "{who} ({town}) - mobile {dial} - fax {phone}", "IBAN {iban}, {who}", "SSN: {ssn}; born {day}", "ISBN {isbn}, {sum} copies sold, see page {order}", "ping from {host} at {time}, build {version}", "{sum} people live in {town}; in {day} there were {sum}", "invoice {order}\t{day}\t{sum}\t{long}", "ask {tag} or {mail}, release {version}",
        "transfer to account {iban} by {day}", "serial {long}, model {order}, {tag}", "phone {dial}, ticket {order}", "{town} {day} {time}: {sum}", "\"{who}\",\"{card}\",\"{ssn}\"", "{tag} said {sum} of {sum}, item {order}",
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        for part in re.split(r"(\{\w+\})", rng.choice(lines)):
            own = part
            if part.startswith("{"):
                own = str((yes.get(part[1:-1]) or no[part[1:-1]])())
                if part[1:-1] in yes:
                    spans.append((len(text), len(text) + len(own)))
            text += own
        out.append((text, spans))
    return out


def _spans(texts: list[tuple[str, list[tuple[int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """(features, truth) of every proposed span."""
    x, y = [], []
    for text, spans in texts:
        for kind, a, b in candidates(text):
            x.append(features(kind, text, a, b))
            y.append((a, b) in spans)
    return np.array(x, np.float64), np.array(y, np.float64)


@lru_cache(maxsize=2)
def model(n: int = TRAINED, seed: int = SEED, precision: float = PRECISION) -> tuple[Trees, np.ndarray, np.ndarray, dict[str, float]]:
    """(trees, calibration scores, calibrated probabilities, threshold by kind)."""
    trees = Trees(*_spans(written(n, seed)))
    x, truth = _spans(varied(n // 3, seed + 1))
    score, kind_of = trees.score(x), x[:, 0]
    at, value = isotonic(score, truth)
    p = np.interp(score, at, value)
    thresholds = {}
    for k, kind in enumerate(KINDS):
        own = kind_of == k
        good = [float(t) for t in np.unique(p[own]) if truth[own & (p >= t)].mean() >= precision]
        # between the least probability that is precise enough and the next below it
        below = p[own & (p < good[0])] if good else p[:0]
        thresholds[kind] = (good[0] + float(below.max(initial=0.0))) / 2 if good else 1.0
    return trees, at, value, thresholds


def select(texts: list[str | None], fitted: tuple) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, kind, probability) of each text's selected spans."""
    trees, at, value, thresholds = fitted
    spans = [candidates(t) for t in texts]
    x = np.array([features(k, t, a, b) for t, own in zip(texts, spans, strict=True) for k, a, b in own], np.float64).reshape(-1, len(FEATURES))
    p = np.round(np.interp(trees.score(x), at, value), 6).tolist() if len(x) else []
    out, i = [], 0
    for own in spans:
        good = sorted(((q, b - a, -a, b, k) for q, (k, a, b) in zip(p[i : i + len(own)], own, strict=True) if q >= thresholds[k]), reverse=True)
        i += len(own)
        chosen: list[tuple[int, int, str, float]] = []
        for q, _, a, b, k in good:
            if all(b <= c or -a >= d for c, d, _, _ in chosen):
                chosen.append((-a, b, k, q))
        out.append(sorted(chosen))
    return out


def find_pii(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, start, end, kind, probability) of each span to redact."""
    fitted = model(**how)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = select(batch.column(1).to_pylist(), fitted)
            rows = [(i, *s) for i, own in zip(batch.column(0).to_pylist(), found, strict=True) for s in own]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], names=["doc_id", "start", "end", "kind", "probability"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").rlike(SUSPECT)).mapInArrow(apply, "doc_id long, start long, end long, kind string, probability double")


def redact(docs: DataFrame, **how) -> DataFrame:
    """docs with each span in text replaced by its kind, as [EMAIL]."""
    fitted = model(**how)

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        own = texts.to_pylist()
        out = []
        for text, spans in zip(own, select(own, fitted), strict=True):
            parts, at = [], 0
            for a, b, kind, _ in spans:
                parts += [text[at:a], f"[{kind.upper()}]"]
                at = b
            out.append("".join([*parts, text[at:]]) if spans else None)
        return pa.array(out, pa.string())

    return docs.withColumn("text", F.coalesce(masked(F.when(docs["text"].rlike(SUSPECT), docs["text"])), docs["text"]))
