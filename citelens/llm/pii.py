"""Surrogates for personal data.

Detected entities are replaced by keyed surrogates of the same kind and shape: digits stay digits, letters stay letters of
their script and case, separators stay, card and account check digits hold, addresses stay valid, given names keep their
gender. A surrogate is a permutation (a keyed Feistel network with cycle walking) of the values of one shape, so equal
entities stay equal and different ones different, in all documents and without a table of entities. What a permutation
cannot rule out is checked per text: a surrogate that is an entity of the text itself is permuted once more.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# Given names by gender, and the titles that tell it.
NAMES = {
    "f": "Alice Amelia Angela Anna Barbara Beatriz Carla Carmen Caroline Catherine Charlotte Christine Claire Clara Eleanor Elena Elizabeth Emily Emma Eva Greta Hannah Helen Helga Ines Irene Isabel Jennifer Julia Laura Linda Lucia Margaret Maria Marie Martha Monika Nicole Olivia Patricia Paula Rachel Rosa Sabine Sandra Sarah Sofia Sophie Susan Teresa Ursula Wanda".split(),
    "m": "Adam Albert Alexander Andreas Antonio Benjamin Carlos Charles Christopher Daniel David Diego Edward Fernando Frank Georg George Hans Harry Henri Henry Jack Jakob James Jean John Jonas Joseph Juan Karl Klaus Luis Marco Martin Matthew Michael Miguel Nicolas Oliver Oscar Patrick Paul Pedro Peter Philippe Pierre Richard Robert Samuel Simon Stefan Thomas Victor Walter William".split(),
}
TITLES = {"m": "Mr Mister Herr Monsieur Señor Sir".split(), "f": "Mrs Ms Miss Frau Madame Mme Señora Señorita".split(), "": "Dr Prof".split()}
# Words that make a given name before them a place, and words before four dotted numbers that are no address.
PLACES = "Airport Avenue Boulevard Bridge Cathedral Church City College County Hall Hospital House Island Lane Museum Park River Road School Square Station Street University".split()
NUMBERED = "appendix article build chapter clause figure paragraph part release rule section step table version".split()
PREFIXES = "AKIA ghp_ gho_ ghu_ ghs_ ghr_ sk- eyJ".split()
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x410, 0x430))), "".join(map(chr, [*range(0x3B1, 0x3C2), *range(0x3C3, 0x3CA)])), "".join(map(chr, [*range(0x391, 0x3A2), *range(0x3A3, 0x3AA)]))]


def _classes() -> dict[str, str]:
    """The alphabet of every digit and letter: ALPHABETS, then digit blocks, then letters by script, case and block."""
    own = {c: a for a in ALPHABETS for c in a}
    groups: dict[tuple, list[str]] = {}
    for i in range(0x80, 0x30000):
        c = chr(i)
        kind = unicodedata.category(c)
        if c in own or kind not in ("Nd", "Lu", "Ll", "Lo"):
            continue
        script = unicodedata.name(c, "").split(" ")[0]
        # accented Latin up to U+017F is one class a case; rarer letters stay within their block of 128
        block = i - unicodedata.decimal(c) if kind == "Nd" else (i >> 16, i < 0x4E00) if script == "CJK" else 0 if script == "HANGUL" or 0xC0 <= i < 0x180 else i >> 7
        groups.setdefault((script, kind, block), []).append(c)
    for cs in groups.values():
        own.update(dict.fromkeys(cs, "".join(cs)))
    return own


CLASS = _classes()
PLACE = {a: {c: i for i, c in enumerate(a)} for a in set(CLASS.values())}
HEX = "0123456789abcdef"

# Where a group of digits starts another entity, a phone number ends before it.
_other = r"(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)|(?:\d{13,19}(?!\w)|\d{4}(?:[\ -]\d{4}){3}|\d{4}[\ -]\d{6}[\ -]\d{5})(?![\ -]?\d)|\d{3}-\d{2}-\d{4}(?![\w-])|[\w.+%-]+@"
_title = "|".join(t for ts in TITLES.values() for t in ts)
_TITLES = {t: g for g, ts in TITLES.items() for t in ts}
_GENDER = {n: g for g, ns in NAMES.items() for n in ns}
_given = "|".join(n for ns in NAMES.values() for n in ns)
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
PATTERN = re.compile(
    rf"""(?P<email>[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{{2,}})
    |(?P<secret>(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|key)\b["']?\s*[:=]\s*["']?)[A-Za-z0-9+/_=.-]{{8,}}|\b(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{{32,64}}\b|\b(?:AKIA[0-9A-Z]{{16}}|gh[pousr]_\w{{20,}}|sk-\w{{20,}})\b
        |(?i:\bbearer)\ +[A-Za-z0-9+/_=.~-]{{15,}}[A-Za-z0-9+/_=-]|\beyJ[\w-]{{8,}}\.[\w-]{{8,}}\.[\w-]*[A-Za-z0-9_-])
    |(?P<iban>\b[A-Z]{{2}}\d{{2}}(?:\ ?[A-Z0-9]{{4}}){{3,7}}(?:\ ?[A-Z0-9]{{1,3}})?\b)
    |(?P<ssn>(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))
    |(?P<ip>(?<![\w.])(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?![\w]|\.\d))
    |(?P<card>(?<![\w])\d(?:[ -]?\d){{12,18}}(?!\w|\.\d))
    |(?P<phone>(?<![\w])(?:\+\d{{7,15}}|\+\d{{1,3}}[ .-]?(?:\(\d{{1,5}}\)[ .-]?)?\d{{1,8}}(?:[ .-](?!{_other})\d{{1,8}}){{0,5}}
        |0\d{{2,5}}/\d{{3,10}}(?:[ -](?!{_other})\d{{2,8}}){{0,3}}
        |\(\d{{2,5}}\)[ .-]?\d{{2,8}}(?:[ .-](?!{_other})\d{{2,8}}){{0,4}}|\d{{2,8}}(?:[ .-](?!{_other})\d{{2,8}}){{1,4}})(?![\w]))
    |(?P<name>\b(?:{_title})\.?\ [^\W\d_][\w'-]+(?:\ [A-ZÀ-ÞА-ЯΑ-Ω][\w'-]+)?|\b(?:{_given})(?:-[A-ZÀ-Þ][\w']+)?\ [A-ZÀ-Þ][\w'-]+)""",
    re.X,
)
# Every match of PATTERN holds one of these, so a text without them has none.
HINT = re.compile(rf"[\d@]|\b(?:{_title}|{_given})\b|(?i:token|secret|passw|key|bearer)|gh[pousr]_|sk-|AKIA|eyJ")
_NUMBERED = re.compile(rf"(?:\b(?i:{'|'.join(NUMBERED)})s?|§)\s*$")
_YEAR = re.compile(r"(?:1[5-9]|20)\d\d")
_DATE = re.compile(r"\d{4}([ .-])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([ .-])(?:0[1-9]|1[0-2])\2\d{4}|(?:0[1-9]|1[0-2])([ .-])(?:0[1-9]|[12]\d|3[01])\3\d{4}")
_DECIMAL = re.compile(r"\d+\.\d+")


def _no_entity(kind: str, own: str, before: str) -> bool:
    """What has an entity's form and is none: years and ranges of years, dates and decimal numbers are no phone number, four
    years no card whose check digit fails, the number of a section no address, a street no person. A plus sign or bracket, or a title, leaves no doubt."""
    if kind == "phone":
        if not own[0].isdigit():
            return False
        parts = re.split(r"[ .-]", own)
        return all(_YEAR.fullmatch(x) for x in parts) or bool(_DATE.fullmatch(own) or _DECIMAL.fullmatch(own)) or ("/" in own and len(plain_digits(own.partition("/")[2])) < 5)
    if kind == "card":
        digits = plain_digits(own)
        return all(_YEAR.fullmatch(x) for x in re.split("[ -]", own)) and luhn_digit(digits[:-1]) != digits[-1]
    if kind == "ip":
        return bool(_NUMBERED.search(before))
    if kind == "name":
        title, words = name_parts(own)
        return words[0][0].islower() or (not title and words[-1] in PLACES)
    return False



def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, text) of what PATTERN finds. A phone number has 7 to 15 digits; a longer run of groups is cut at the
    last boundary that leaves it so many, and read on from there. A word in small letters after a title is no name; what else
    only looks like an entity is told by ``_no_entity``."""
    out, at = [], 0
    while m := PATTERN.search(text, at):
        start, end, kind = m.start(), m.end(), m.lastgroup
        if _no_entity(kind, m[0], text[max(0, start - 16) : start]):
            at = start + m[0].index(" ") + 1 if kind == "name" else end
            continue
        if kind == "phone":
            ends = [end, *(start + x.start() for x in re.finditer(r"(?<=\d)[ .-]", m[0]))]
            fits = [e for e in ends if 7 <= sum(c.isdigit() for c in text[start:e]) <= 15]
            if not fits:
                at = end
                continue
            end = max(fits)
        out.append((start, end, kind, text[start:end]))
        at = end
    return out


def name_parts(text: str) -> tuple[str, list[str]]:
    """A name's title, which may be missing, and its words."""
    first, *words = text.split(" ")
    return (first, words) if first.rstrip(".") in _TITLES else ("", [first, *words])


class Permutation:
    """Keyed permutations of 0 .. n-1; each tweak has its own."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def _f(self, tweak: str, i: int, x: int, m: int) -> int:
        return int.from_bytes(hmac.digest(self.key, f"{tweak}|{i}|{x}".encode(), "sha256"), "big") % m

    def __call__(self, tweak: str, x: int, n: int) -> int:
        if n < 2:
            return x
        b = math.isqrt(n - 1) + 1
        while True:  # walks the cycle back into range: at most a few steps, as b * b is near n
            left, right = divmod(x, b)
            for i in range(0, 8, 2):
                left = (left + self._f(tweak, i, right, b)) % b
                right = (right + self._f(tweak, i + 1, left, b)) % b
            x = left * b + right
            if x < n:
                return x


def plain_digits(text: str) -> str:
    return "".join(str(unicodedata.decimal(c)) for c in text if c.isdecimal())


def luhn_digit(digits: str) -> str:
    total = sum((2 * int(d) - 9 * (d > "4")) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


class Surrogates:
    def __init__(self, key: str) -> None:
        self.permute = Permutation(key.encode())
        self.of = lru_cache(100_000)(self._of)

    def shape(self, text: str, tweak: str, alphabet: str | None = None) -> str:
        """Permutes a text among those of its shape: the same classes of characters at the same places."""
        return self._permuted(text, tweak, [alphabet if alphabet and c in alphabet else CLASS.get(c) for c in text])

    def name(self, text: str) -> str:
        """Permutes a word of a name among those with vowels and consonants at the same places, so that it can be said."""
        sounds = {c: a for plain in (VOWELS, CONSONANTS) for a in (plain, plain.upper()) for c in a}
        return self._permuted(text, "name", [sounds.get(c) or CLASS.get(c) for c in text])

    def word(self, text: str) -> str:
        """A listed given name becomes another of its gender, any other word one of its shape that holds none: the walk goes on
        from listed names, so that it stays a permutation of the rest."""
        if gender := _GENDER.get(text):
            names = NAMES[gender]
            return names[self.permute(f"name{gender}", names.index(text), len(names))]
        new = self.name(text)
        while new in _GENDER:
            new = self.name(new)
        return new

    def given(self, text: str, told: str) -> str:
        """An unlisted given name whose gender its title or its first part tells becomes two: a listed one of that gender and
        the word of its own, which keeps different names different."""
        gender = _GENDER.get(text.partition("-")[0]) or told
        if text in _GENDER or not gender:
            return self.word(text)
        names = NAMES[gender]
        at = int.from_bytes(hmac.digest(self.permute.key, f"given|{text}".encode(), "sha256"), "big") % len(names)
        return f"{names[at] if names[at] != text.partition('-')[0] else names[at - 1]} {self.word(text)}"

    def _permuted(self, text: str, tweak: str, sets: list[str | None]) -> str:
        x = n = 0
        n = 1
        for c, a in zip(text, sets, strict=True):
            if a:
                x, n = x * len(a) + (PLACE[a][c] if a in PLACE else a.index(c)), n * len(a)
        shape = "".join(a[0] if a else c for c, a in zip(text, sets, strict=True))
        x = self.permute(f"{tweak}|{shape}", x, n)
        out = []
        for c, a in zip(reversed(text), reversed(sets), strict=True):
            if a:
                x, d = divmod(x, len(a))
                c = a[d]
            out.append(c)
        return "".join(reversed(out))

    def _digits(self, text: str, digits: str) -> str:
        """New (ASCII) digits in the places of a text's, each in the block of the digit it replaces."""
        left = iter(digits)
        return "".join(chr(ord(c) - unicodedata.decimal(c) + int(next(left))) if c.isdecimal() else c for c in text)

    def pseudonym(self, kind: str, text: str, turn: int = 0) -> str:
        """For an entity whose shape allows no other value: a keyed name without its shape."""
        return f"{kind}-{hmac.digest(self.permute.key, f'{kind}|{turn}|{text}'.encode(), 'sha256').hex()[:16]}"

    def _of(self, kind: str, text: str) -> str:
        if kind == "email":
            local, _, domain = text.lower().partition("@")
            host, _, top = domain.rpartition(".")
            return f"{self.shape(local, 'local')}@{self.shape(host, 'host')}.{top}"
        if kind == "ip":
            parts = [int(p) for p in text.split(".")]
            if max(parts) > 255:
                return self.shape(text, "version")
            x = self.permute("ip", int.from_bytes(bytes(parts), "big"), 1 << 32)
            zero = ord(text[0]) - unicodedata.decimal(text[0])
            return "".join(chr(zero + int(c)) if c != "." else c for c in ".".join(map(str, x.to_bytes(4, "big"))))
        if kind == "card":
            d = plain_digits(text)
            good = luhn_digit(d[:-1]) == d[-1]
            if good:
                own = self.shape(d[:-1], "card")
                return self._digits(text, own + luhn_digit(own))
            while True:  # numbers that fail the check stay among those
                d = self.shape(d, "number")
                if luhn_digit(d[:-1]) != d[-1]:
                    return self._digits(text, d)
        if kind == "iban":
            flat = text.replace(" ", "")
            body = self.shape(flat[4:], "iban")
            left = iter(flat[:2] + f"{98 - int(''.join(str(int(c, 36)) for c in body + flat[:2] + '00')) % 97:02d}" + body)
            return "".join(c if c == " " else next(left) for c in text)
        if kind == "phone":
            code = re.match(r"\+(?:[17]|\d{2,3}(?=\D)|\d\d)", text)
            head = code[0] if code else ""
            d = plain_digits(text[len(head):])
            return head + self._digits(text[len(head):], self.shape(d, f"phone{head}"))
        if kind == "secret":
            m = re.search(r"[A-Za-z0-9+/_=.~-]{8,}$", text)
            head = next((p for p in PREFIXES if m[0].startswith(p)), "")
            return text[: m.start()] + head + self.shape(m[0][len(head) :], f"secret{head}", HEX if set(m[0]) <= set(HEX) else None)
        if kind == "name":
            title, words = name_parts(text)
            out = [self.given(words[0], _TITLES.get(title.rstrip("."), "")) if len(words) > 1 else self.word(words[0]), *map(self.word, words[1:])]
            return " ".join([title, *out] if title else out)
        return self.shape(text, kind)

    def text(self, text: str | None) -> tuple[str | None, int, int]:
        """A text with its entities replaced, and how many entities (mentions of a name among them), and how many different
        ones, it held."""
        if not text or not HINT.search(text):
            return text, 0, 0
        found = entities(text)
        if not found:
            return text, 0, 0
        # a name without a title is a mention where its surname has one elsewhere
        titled = {words[-1] for _, _, kind, own in found if kind == "name" for title, words in [name_parts(own)] if title}
        found = [x for x in found if x[2] != "name" or name_parts(x[3])[0] or name_parts(x[3])[1][-1] not in titled]
        originals = {x[3].lower() for x in found}
        named: dict[tuple[str, str], str] = {}
        taken: set[str] = set()
        for _, _, kind, own in found:
            if (kind, own) in named:
                continue
            new = self.of(kind, own)
            for _ in range(64):  # collision check: neither an entity of this text nor another entity's surrogate
                if new.lower() not in originals and (new.lower() not in taken or any(k == kind and o.lower() == own.lower() for k, o in named)):
                    break
                new = self.of(kind, new)
            else:  # the shape allows no other value
                new = next(p for i in range(1 << 30) if (p := self.pseudonym(kind, own, i)) not in originals and p not in taken)
            named[kind, own] = new
            taken.add(new.lower())
        bare, again = self._mentions(named)
        out, at, more = [], 0, 0
        for start, end, kind, own in [*found, (len(text), len(text), "", "")]:
            gap = text[at:start]
            if bare:
                gap, n = bare.subn(again, gap)
                more += n
            out += [gap, named.get((kind, own), "")]
            at = end
        return "".join(out), len(found) + more, len(originals)

    def _mentions(self, named: dict[tuple[str, str], str]) -> tuple[re.Pattern | None, Callable[[re.Match], str]]:
        """A pattern of the later mentions, without a title, of a text's names, and their replacement: the whole name, either
        part, or a listed given name before a surname that was found."""
        parts: dict[str, str] = {}
        surnames: set[str] = set()
        for (kind, own), new in named.items():
            if kind != "name":
                continue
            olds, news = name_parts(own)[1], name_parts(new)[1]
            halves = [" ".join(news[:-1]), news[-1]] if len(olds) == 2 and len(news) > 1 else [" ".join(news)] * len(olds)
            pairs = [(" ".join(olds), " ".join(news)), *zip(olds, halves, strict=True)]
            for o, n in pairs:
                if not o[0].islower():
                    parts.setdefault(o, n)
            surnames.add(olds[-1])
        if not parts:
            return None, str
        listed = "|".join(w for ws in NAMES.values() for w in ws)
        known = "|".join(map(re.escape, sorted(parts, key=lambda p: (-len(p), p))))

        def again(m: re.Match) -> str:
            if m["given"] and m["known"] in surnames:
                return f"{parts.get(m['given']) or self.word(m['given'])} {parts[m['known']]}"
            return (m["given"] + " " if m["given"] else "") + parts[m["known"]]

        return re.compile(rf"(?<!\w)(?:(?P<given>{listed})\ (?={'|'.join(map(re.escape, sorted(surnames, key=len, reverse=True)))}))?(?P<known>{known})(?!\w)"), again


def replace_pii(df: DataFrame, key: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with ``text_col`` replaced, and n_entities, n_distinct.

    A null or empty text stays as it is. Repeated rows stay repeated and equal texts stay equal. Columns of ``keep`` called
    n_entities or n_distinct are replaced. Whole texts are read. One narrow pass.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("n_entities", "n_distinct")]
    names = [f"c{i}" for i in range(len(keep))]
    inner = df.select(F.col(f"`{text_col}`").cast("string").alias("t"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True) if c != text_col])
    kinds = [f"{n} {inner.schema[n].dataType.simpleString()}" for n in inner.columns]
    cache: list[Surrogates] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not cache:
            cache.append(Surrogates(key))
        text, n, distinct = zip(*[cache[0].text(t) for t in batch.column(0).to_pylist()], strict=True)
        return pa.RecordBatch.from_arrays([pa.array(text, pa.string()), *batch.columns[1:], pa.array(n, pa.int64()), pa.array(distinct, pa.int64())], names=[*batch.schema.names, "n_entities", "n_distinct"])

    out = map_rows(inner, run, ", ".join([*kinds, "n_entities long", "n_distinct long"]))
    return out.select(*[F.col("t" if c == text_col else n).alias(c) for n, c in zip(names, keep, strict=True)], "n_entities", "n_distinct")
