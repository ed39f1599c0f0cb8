"""Personal data: fixed patterns, and looser candidates judged by boosted trees.

The base finds e-mail addresses, IP numbers, card numbers and telephone numbers
by exact patterns; those spans always stay. Beside it, generators of high
recall propose spans that the patterns miss and that may overlap: addresses
written with "(at)" and "[dot]" or "at" and "dot", numbers with other
separators or without a plus sign, card numbers of other lengths, IP numbers in
IPv6, whole or compressed. A fifth kind, secret, has no pattern: what is
assigned to a name such as "password" and every long run of letters and digits
is proposed (keys, tokens, passwords). Of numbers side by side every run of neighbouring
groups of digits is proposed, as fixed patterns take them for one number and
drop it when its digits are too many.
Gradient-boosted trees score each candidate from its format and from the words
around it (those for secrets are trees of their own, on other features), and a threshold for each kind, calibrated for precision on rows held
out of the fitting, selects. Of overlapping selected candidates the best stays;
none that touches a base span does.

No table has labelled spans, so the trees are fitted on TRAIN_ROWS rows that a
seeded rule writes: each kind in its context, and look-alikes (order numbers,
versions, dates, hashes, sums that fail their check) in theirs. The fit runs on
the driver in about a second, does not read the input and is the same each time.

Defined results: a null text counts as empty and has no spans: counts 0, spans
"" and base_sha256 of the empty string. Repeated rows are read each on its own.
An empty table gives an empty result. Other columns are ignored. Offsets are in
code points, the end exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_rows, texts

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
TRAIN_ROWS, SEED, ROUNDS, DEPTH, RATE, PRECISION = 6000, 11, 40, 3, 0.3, 0.995
#: Characters before and after a candidate whose words count as its context.
AROUND = 32

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Leftmost matches of local part, @ and domain, found from each @: what stands left of it up to the last match can't hold another @."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def quads(run: str, start: int) -> list[Span]:
    """Of a run of numbers and dots each four numbers in turn, if none is above 255. One pass; a pattern that tries each digit as a start takes the square of a long number's length."""
    out, parts = [], run.split(".")
    for i in range(0, len(parts) - 3, 4):
        length = sum(map(len, parts[i : i + 4])) + 3
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) < 256 for part in parts[i : i + 4]):
            out.append((start, start + length))
        start += length + 1
    return out


def base(text: str) -> dict[str, list[Span]]:
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if _DIGIT.search(text):
        out["ip"] = [span for m in _DOTTED.finditer(text) if m[0].count(".") > 2 for span in quads(m[0], m.start())]
        out["card"] = [m.span() for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# Generators: everything that may be of a kind.
_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?[A-Za-z0-9-]{1,63}(?:(?:\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\.)[A-Za-z0-9-]{2,24}){1,4}")
_HINT = re.compile(r"(?:at|AT|@)\s?[\])}>]")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_PLAIN_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s(?:at|AT)\s[A-Za-z0-9-]{1,63}(?:(?:\s(?:dot|DOT)\s|\.)[A-Za-z0-9-]{2,24}){1,4}(?![A-Za-z0-9])")
_PLAIN_HINT = re.compile(r"\s(?:at|AT)\s")
_HEX = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}"
_SHORT_IPV6 = re.compile(rf"(?<![0-9A-Za-z:])(?:{_HEX})?::(?:{_HEX})?(?![0-9A-Za-z:])")
_GROUP = re.compile("[0-9]+")
_SEPARATOR = re.compile(r"[\x20()./_ ‐-–-]{1,2}")
_FIRST = re.compile("0{0,2}[1-9]")
#: Groups of digits in a number at most.
GROUPS = 7


def numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """Start, end and digits of every run of up to GROUPS neighbouring groups of digits, 8 to 19 digits in all."""
    groups = [m.span() for m in _GROUP.finditer(text)]
    joined = [_SEPARATOR.fullmatch(text, b, c) is not None for (_, b), (c, _) in zip(groups, groups[1:], strict=False)]
    for i, (start, _) in enumerate(groups):
        before = text[start - 1 : start]
        if (before.isascii() and before.isalpha()) or (before == "." and not (i and joined[i - 1])) or not _FIRST.match(text, start):
            continue
        n = 0
        for j in range(i, min(i + GROUPS, len(groups))):
            end = groups[j][1]
            n += end - groups[j][0]
            if n > 19 or (j > i and not joined[j - 1]):
                break
            after = text[end : end + 1]
            if n >= 8 and not (after.isascii() and after.isalpha()):
                yield start, end, n


def candidates(text: str, taken: list[Span]) -> list[tuple[str, int, int]]:
    """Spans that touch no taken one. They may overlap: of a run of numbers, each part that may be one by itself."""
    out = []
    if _HINT.search(text):
        out += [("email", *m.span()) for m in _AT.finditer(text)]
    if _PLAIN_HINT.search(text):
        out += [("email", *m.span()) for m in _PLAIN_AT.finditer(text)]
    if "::" in text:
        out += [("ip", *m.span()) for m in _SHORT_IPV6.finditer(text) if 1 <= len(re.findall("[0-9A-Fa-f]+", m[0])) <= 7]
    if _DIGIT.search(text):
        if ":" in text:
            out += [("ip", *m.span()) for m in _IPV6.finditer(text)]
        for start, end, n in numbers(text):
            if n <= 15:
                before = text[start - 1 : start]
                out.append(("phone", start - (before == "+" or (before == "(" and ")" in text[start:end])), end))
            if n >= 13:
                out.append(("card", start, end))
    if not taken:
        return out
    full = covered(text, taken)
    return [(k, a, b) for k, a, b in out if full.find(1, a, b) < 0]


def covered(text: str, spans: list[Span]) -> bytearray:
    """A byte for each character: 1 in a span."""
    out = bytearray(len(text))
    for a, b in spans:
        out[a:b] = b"\x01" * (b - a)
    return out


#: Words that speak for a kind, in the languages of the tables.
CONTEXT = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel", "write", "reach"),
    "ip": ("ip", "host", "server", "address", "addr", "login", "client"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "anruf", "appel", "llama", "handy", "whatsapp"),
}
#: Words that speak against any.
AGAINST = ("order", "invoice", "version", "isbn", "serial", "id", "no", "ref", "sha", "token", "date", "page", "sum", "total", "ticket")
_WORD = re.compile(r"[a-z]+")
#: Numbers that stand next to a candidate, a separator apart.
_LEFT, _RIGHT = re.compile(rf"([0-9]+){_SEPARATOR.pattern}$"), re.compile(rf"{_SEPARATOR.pattern}([0-9]+)")
_TOP = re.compile(r"[.\s\])}>](?:com|org|net|edu|gov|info|io|[a-z]{2})$", re.IGNORECASE)


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context as numbers."""
    s = text[start:end]
    d = _digits(s)
    parts = _GROUP.findall(s)
    groups = [len(g) for g in parts]
    left, right = _LEFT.search(text[max(0, start - AROUND) : start]), _RIGHT.match(text, end)
    left, right = left[1] if left else "", right[1] if right else ""
    near = _WORD.findall(text[max(0, start - AROUND) : start].lower()) + _WORD.findall(text[end : end + AROUND // 2].lower())
    seps = {c for c in s if not c.isalnum()}
    return [
        float(KINDS.index(kind)),
        len(s),
        len(d),
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        len(seps),
        float(luhn(d)) if len(d) >= 13 else -1.0,
        float(d[:1] in ("3", "4", "5", "6")) if d else -1.0,
        float(s.startswith(("0", "(0"))),
        float(s.startswith("00")),
        float("(" in s),
        float("/" in s or "." in s),
        float(sum(c.isalpha() for c in s)),
        float(any(w.startswith(CONTEXT[kind]) for w in near)),
        float(any(w in AGAINST for w in near)),
        float(sum(w.startswith(v) for k, v in CONTEXT.items() if k != kind for w in near)),
        float(text[start - 1 : start] in "=:#\"'/" and start > 0),
        len(left),
        len(right),
        float(luhn(d) and 16 <= len(d) <= 19),
        float(luhn(left) if len(left) >= 13 else -1),
        float(luhn(right) if len(right) >= 13 else -1),
        float(s.startswith("+")),
        float(text[start - 1 : start] == "+" or text[max(0, start - 2) : start] == "+("),
        float(len(re.findall(r"\sdot\s", s, re.IGNORECASE))),
        float(any(c in "[({<" for c in s)),
        float(bool(_TOP.search(s))),
        float("::" in s),
        float(any(g.startswith("00") for g in parts[1:])),
        groups[0] if groups else 0,
        groups[-1] if groups else 0,
    ]


def _training() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of features, labels and kinds, written by rule."""
    rng = np.random.default_rng(SEED)
    syllables = ["an", "er", "the", "on", "tion", "le", "que", "ein", "ung", "ar", "in", "sh"]
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))

    def grouped(d: str, sizes: tuple[int, ...], sep: str) -> str:
        out, at = [], 0
        for n in sizes:
            out.append(d[at : at + n])
            at += n
        return sep.join(x for x in [*out, d[at:]] if x)

    def valid(n: int, ok: bool = True) -> str:
        d = pick("3456") + num(n - 2)
        return next(d + c for c in "0123456789" if luhn(d + c) == ok)

    def unlike(n: int) -> str:
        """Digits that the base, were they to stand alone, doesn't take for a card."""
        while luhn(d := pick("123456789") + num(n - 1)) and n >= 16:
            pass
        return d

    def beside() -> tuple[str, str | None]:
        """A number next to another one, and its kind if it is personal."""
        return pick([
            lambda: (next(d + c for d in [pick("123456789") + num(14)] for c in "0123456789" if luhn(d + c)), "card"),
            lambda: (f"+{pick(['1', '44', '49', '33', '34'])} ({num(3)}) {num(3)}-{num(4)}", "phone"),
            lambda: (".".join(str(int(x)) for x in rng.integers(1, 256, 4)), None),
            lambda: (unlike(int(rng.integers(16, 20))), None),
            lambda: (num(int(rng.integers(1, 5))), None),
        ])()

    def person(kind: str) -> str:
        if kind == "email":
            at, dot = pick(["(at)", "[at]", " (at) ", " [at] ", "{at}", " at ", " at "]), pick([".", "[dot]", " (dot) ", " dot "])
            if at == " at ":
                dot = " dot "
            return f"{word()}{pick(['.', '_', ''])}{word()}{at}{word()}{dot}{pick(['com', 'org', 'net', 'de', 'fr'])}"
        if kind == "ip":
            parts = [f"{int(x):x}" for x in rng.integers(256, 65536, 8)]
            if rng.random() < 0.5:
                return ":".join(parts)
            first, last = int(rng.integers(1, 4)), int(rng.integers(1, 4))
            return ":".join(parts[:first]) + "::" + ":".join(parts[-last:])
        if kind == "card":
            return pick([lambda: valid(15), lambda: grouped(valid(15), (4, 6), pick(" -")), lambda: grouped(valid(16), (4, 4, 4), pick("./_")), lambda: valid(14), lambda: grouped(valid(16), (4, 4, 4), " ")])()
        return pick([lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"00{pick(['49', '33', '34', '1'])} {num(3)} {num(7)}", lambda: f"0{num(3)}/{num(7)}", lambda: f"0{num(2)} {num(2)} {num(2)} {num(2)} {num(2)}", lambda: f"{num(3)}-{num(3)}-{num(4)}"])()

    def other(kind: str) -> str:
        if kind == "email":
            return pick([lambda: f"{word()} (at) {word()}.{word()}", lambda: f"{word()} at {word()}.{pick(['com', 'org', 'net', 'de'])}", lambda: f"{word()} at {word()} dot {word()}"])()
        if kind == "ip":
            return pick([lambda: ":".join(num(2) for _ in range(int(rng.integers(4, 7)))), lambda: f"{pick(['add', 'bad', 'face', 'a', 'dec'])}::{pick(['add', 'be', 'fade', 'b', 'feed'])}", lambda: f"{num(2)}::{num(2)}"])()
        if kind == "card":
            return pick([lambda: valid(int(rng.integers(13, 20)), False), lambda: unlike(int(rng.integers(13, 20))), lambda: grouped(unlike(16), (4, 4, 4), pick("./_"))])()
        return pick([lambda: num(int(rng.integers(8, 16))), lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(2)}.{num(2)}.{num(4)}", lambda: f"{num(4)} {num(4)}", lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"{num(5)}-{num(5)}"])()

    x, y, z = [], [], []
    while len(x) < TRAIN_ROWS:
        kind = pick(KINDS)
        real = rng.random() < 0.5
        s = person(kind) if real else other(kind)
        lead = pick(CONTEXT[kind]) if rng.random() < (0.8 if real else 0.1) else pick(AGAINST) if rng.random() < (0.05 if real else 0.5) else word()
        parts = [(s, kind if real else None)]
        if kind in ("card", "phone") and rng.random() < 0.4:  # numbers side by side, as no fixed pattern takes them
            parts = [beside(), beside()] if rng.random() < 0.7 else [*parts, beside()]
            if rng.random() < 0.5:
                parts.reverse()
        text, true = f"{word()} {word()} {lead}{pick([' ', ': ', ' '])}", set()
        for i, (part, of) in enumerate(parts):
            text += " " * (i > 0)
            true.add((of, len(text), len(text) + len(part)))
            text += part
        follow = pick(CONTEXT[pick(KINDS)]) if rng.random() < 0.2 else word()  # the next thing that the text names
        text += f"{pick(['', '.', ',', ' '])} {follow} {word()}"
        found = candidates(text, [s for v in base(text).values() for s in v])
        wrong = [c for c in found if c not in true]
        rng.shuffle(wrong)
        for k, a, b in [c for c in found if c in true] + [(k, int(a), int(b)) for k, a, b in wrong[:1]]:
            x.append(describe(text, k, a, b))
            y.append(float((k, a, b) in true))
            z.append(KINDS.index(k))
    return np.array(x), np.array(y), np.array(z)


class Boosted:
    """Logistic gradient boosting over small regression trees, splits by exact search."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        self.trees = []
        f = np.full(len(y), self.start)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - p, p * (1 - p), DEPTH)
            self.trees.append(tree)
            f += self._apply(tree, x)

    def _grow(self, x, g, h, depth):
        leaf = RATE * g.sum() / (h.sum() + 1.0)
        if depth == 0 or len(g) < 20:
            return leaf
        best = (1e-6, 0, 0.0)
        whole = g.sum() ** 2 / (h.sum() + 1.0)
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, cg, ch = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if len(cut):
                gain = cg[cut] ** 2 / (ch[cut] + 1) + (cg[-1] - cg[cut]) ** 2 / (ch[-1] - ch[cut] + 1) - whole
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), j, float((v[cut[i]] + v[cut[i] + 1]) / 2))
        if best[0] <= 1e-6:
            return leaf
        under = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[under], g[under], h[under], depth - 1), self._grow(x[~under], g[~under], h[~under], depth - 1)

    def _apply(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, v, left, right = tree
        return np.where(x[:, j] <= v, self._apply(left, x), self._apply(right, x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + sum(self._apply(t, x) for t in self.trees))))


def _cut(score: np.ndarray, y: np.ndarray) -> float:
    """The lowest score from which the rows have the wanted precision; 2 if there is none."""
    order = np.argsort(-score, kind="stable")
    s, good = score[order], np.cumsum(y[order])
    ends = np.append(s[1:] < s[:-1], True)  # rows of one score stand or fall together
    fine = np.flatnonzero(ends & (good >= PRECISION * np.arange(1, len(s) + 1)))
    return float(s[fine[-1]]) if len(fine) else 2.0


@lru_cache(maxsize=1)
def fitted() -> tuple[Boosted, tuple[float, ...]]:
    """The trees and each kind's threshold: the lowest score from which the held-out third has the wanted precision."""
    x, y, z = _training()
    held = np.arange(len(x)) % 3 == 0
    trees = Boosted(x[~held], y[~held])
    score = trees.score(x[held])
    own = [z[held] == k for k in range(len(KINDS))]
    return trees, tuple(_cut(score[o], y[held][o]) for o in own)


# Secrets: keys, tokens and passwords.
#: Names that a secret is assigned to, and words for digests and identifiers, which look like one.
SECRET_NAMES = ("token", "secret", "password", "passwd", "passphrase", "pwd", "key", "apikey", "credential", "bearer", "auth", "passwort", "contraseña")
DIGEST_NAMES = ("sha", "md", "commit", "hash", "checksum", "digest", "etag", "uuid", "guid", "id", "build", "rev", "file", "path", "url", "image", "version", "blob", "public")
#: How the keys of well-known services begin.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "eyJ")
_ASSIGNED = re.compile(r"[:=]\s{0,3}(?:\"([^\"\n]{6,128})\"|'([^'\n]{6,128})'|([A-Za-z0-9_+/.~!@$%^&*-]{6,}+))")
_NAMED = re.compile(rf"(?:{'|'.join(SECRET_NAMES)})[\"']?\s{{0,3}}$", re.IGNORECASE)
_TOKEN = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_NAME = re.compile(r"[^\W\d_]+")


def secret_candidates(text: str, taken: list[Span]) -> list[Span]:
    """What is assigned to a telling name, and long runs with letters and digits. None touches a taken span."""
    out = set()
    for m in _ASSIGNED.finditer(text):
        if _NAMED.search(text, max(0, m.start() - 24), m.start()):
            a, b = m.span(m.lastindex)
            if m.lastindex == 3:
                b = a + len(m[3].rstrip(".!%$&*^~-"))
            if b - a >= 6:
                out.add((a, b))
    for m in _TOKEN.finditer(text):
        if _DIGIT.search(m[0]) and not m[0].isdecimal() and re.search("[A-Za-z]", m[0]):
            out.add(m.span())
    full = covered(text, taken) if taken and out else None
    return sorted(s for s in out if full is None or full.find(1, *s) < 0)


def describe_secret(text: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate for a secret, as numbers. Of a very long one, counts are over all of it."""
    s = text[start:end]
    n = len(s)
    sorts = ["d" if c.isdecimal() else "u" if c.isupper() else "l" if c.islower() else "o" for c in s]
    share = np.array(list(Counter(s).values())) / n
    before = text[max(0, start - AROUND) : start]
    near = [w.lower() for w in _NAME.findall(before)[-4:]]
    letters = _NAME.findall(s)
    return [
        n,
        sorts.count("d") / n,
        sorts.count("u") / n,
        sorts.count("l") / n,
        sorts.count("o") / n,
        float(-(share * np.log2(share)).sum()),
        sum(a != b for a, b in zip(sorts, sorts[1:], strict=False)) / n,
        max(map(len, letters), default=0),
        sum(c in "aeiouAEIOU" for c in s) / n,
        float(all(c in "0123456789abcdef" for c in s) or all(c in "0123456789ABCDEF" for c in s)),
        float(_UUID.fullmatch(s) is not None),
        float(s.startswith(PREFIXES)),
        float(_NAMED.search(before.rstrip(" =:\"'")) is not None and before[-1:] in " =:\"'"),
        float(re.search(r"[=:]\s{0,3}[\"']?$", before) is not None),
        float(any(w.startswith(SECRET_NAMES) for w in near)),
        float(any(w in DIGEST_NAMES for w in near)),
        float(before[-1:] in ("\"", "'")),
        sum(c in "/-_." for c in s) / n,
        float(any(c.isspace() for c in s)),
    ]


def _secret_training() -> tuple[np.ndarray, np.ndarray]:
    """Rows of features and labels: secrets and their look-alikes, each in its context, written by rule."""
    rng = np.random.default_rng(SEED + 1)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    some = lambda of, lo, hi: "".join(of[int(i)] for i in rng.integers(0, len(of), int(rng.integers(lo, hi))))
    low, digits, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    alnum = low + low.upper() + digits
    word = lambda: "".join(pick(["an", "er", "the", "on", "tion", "le", "que", "ein", "ung", "ar", "in", "sh"]) for _ in range(int(rng.integers(1, 5))))
    name = lambda: pick([pick(SECRET_NAMES), f"{word()}_{pick(SECRET_NAMES)}", pick(SECRET_NAMES).upper(), f"api {pick(SECRET_NAMES)}"])
    link = lambda: pick([" = ", "=", ": ", ":", " : "])
    quote = lambda s: pick([s, f'"{s}"', f"'{s}'"])
    value = lambda: pick([lambda: some(hexa, 16, 65), lambda: some(alnum, 8, 65), lambda: some(alnum + "+/", 20, 65), lambda: f"{word()}{some(digits, 2, 5)}{some(low, 1, 5)}{some('!$%*', 1, 3)}{some(digits, 1, 3)}", lambda: some(alnum + "!$%*@", 10, 25), lambda: some(low.upper() + digits, 16, 41)])()
    uuid = lambda: "-".join(some(hexa, n, n + 1) for n in (8, 4, 4, 4, 12))
    real = [
        lambda: (f"{name()}{link()}", value()),
        lambda: (f"{name()}{link()}", value()),
        lambda: (f"{pick([word(), name() + link(), word() + link()])} ", pick(PREFIXES) + some(pick([low.upper() + digits, alnum]), 14, 41)),
        lambda: (f"{pick(SECRET_NAMES)} {pick(['', 'is '])}", some(pick([hexa, alnum]), 24, 65)),
    ]
    other = [
        lambda: (f"{pick(DIGEST_NAMES)}{pick([' ', link()])}", pick([some(hexa, 32, 65), uuid(), some(alnum + "+/", 24, 65)])),
        lambda: (f"{word()} ", some(hexa, 20, 65)),
        lambda: (f"{word()}{pick([' ', link()])}", uuid()),
        lambda: (f"{name()}{link()}", pick([word() + word(), f"{word()}_{word()}", f"{word()}.{word()}", f"{word()} {word()} {word()}", "required", "string", "null", "undefined"])),
        lambda: (f"{word()} ", "-".join([word(), word(), some(digits, 1, 5), word(), word()])),
        lambda: (f"{pick([word() + ' ', word() + link()])}", "/".join(["", word(), some(digits, 4, 5), word(), word(), some(digits, 1, 3)])),
        lambda: (f"{word()} ", f"{word()}{word()}{word()}{word()}{some(digits, 1, 3)}"),
        lambda: (f"{word()} ", f"{word()}_{word()}_{word()}{some(digits, 1, 4)}_{word()}"),
        lambda: (f"{word()}{link()}", some(alnum, 16, 41)),
        lambda: (f"{name()}{link()}", some(digits, 6, 9)),
    ]
    x, y = [], []
    while len(x) < TRAIN_ROWS:
        true = rng.random() < 0.5
        lead, s = pick(real if true else other)()
        lead = f"{word()} {word()} {lead}"
        shown = quote(s) if not lead.endswith(" ") or lead.endswith(("= ", ": ")) else s
        start = len(lead) + (shown != s)
        text = f"{lead}{shown}{pick(['', ' ', ', ', '. '])}{word()}" if shown != s else f"{lead}{shown} {word()}"
        found = secret_candidates(text, [t for v in base(text).values() for t in v])
        for a, b in found:
            x.append(describe_secret(text, a, b))
            y.append(float(true and a == start and b >= start + len(s.rstrip(".!%$&*^~-"))))
    return np.array(x), np.array(y)


@lru_cache(maxsize=1)
def fitted_secrets() -> tuple[Boosted, float]:
    """The trees for secrets and their threshold, calibrated on a third left out of the fit."""
    x, y = _secret_training()
    held = np.arange(len(x)) % 3 == 0
    trees = Boosted(x[~held], y[~held])
    return trees, _cut(trees.score(x[held]), y[held])


def find(text: str, model: tuple[Boosted, tuple[float, ...]], secrets: tuple[Boosted, float] | None = None) -> tuple[dict[str, list[Span]], list[tuple[str, int, int]]]:
    """Base spans by kind, and the spans that the trees add."""
    sure = base(text)
    taken = [s for v in sure.values() for s in v]
    scored: list[tuple[float, str, int, int]] = []
    if loose := candidates(text, taken):
        trees, cuts = model
        scores = trees.score(np.array([describe(text, *c) for c in loose]))
        scored += [(s, *c) for s, c in zip(scores, loose, strict=True) if s >= cuts[KINDS.index(c[0])]]
    if hidden := secret_candidates(text, taken):
        trees, cut = secrets or fitted_secrets()
        scores = trees.score(np.array([describe_secret(text, *c) for c in hidden]))
        scored += [(s, SECRET, *c) for s, c in zip(scores, hidden, strict=True) if s >= cut]
    added: list[tuple[str, int, int]] = []
    if scored:
        full = bytearray(len(text))
        for _, k, a, b in sorted(scored, key=lambda c: (-c[0], c[2] - c[3], c[2])):  # of equals the longest
            if full.find(1, a, b) < 0:
                added.append((k, a, b))
                full[a:b] = b"\x01" * (b - a)
    return sure, added


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: ((*KINDS, SECRET).index(s[0]), *s[1:])))


def scan(docs: DataFrame) -> DataFrame:
    """Every row's personal data: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added, n_spans."""
    model, secrets = fitted(), fitted_secrets()

    def start():
        def batch(ids, rows):
            out = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans")}
            for text in rows:
                sure, added = find(text, model, secrets)
                for k in KINDS:
                    out[f"n_{k}"].append(len(sure[k]))
                fixed = [(k, a, b) for k in KINDS for a, b in sure[k]]
                out["base_sha256"].append(sha256(_joined(fixed).encode()).hexdigest())
                out["spans"].append(_joined(fixed + added))
                out["n_added"].append(len(added))
                out["n_spans"].append(len(fixed) + len(added))
            return {"doc_id": ids} | out

        return batch

    return map_rows(texts(docs), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long", start)


def redact(text: str, model=None) -> str:
    """The text with every span replaced by its kind in brackets."""
    sure, added = find(text, model or fitted())
    spans = sorted([(a, b, k) for k in KINDS for a, b in sure[k]] + [(a, b, k) for k, a, b in added])
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
