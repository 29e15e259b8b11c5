"""Personal data replaced by format-preserving pseudonyms.

A found value that passes its kind's validation is read as a number in the set of all values of its format, moved by
a keyed Feistel permutation of that set, and written in the same format. The same value always becomes the same
pseudonym, in whatever document it stands, and different values of a format stay different. Check digits are made anew,
so a card number stays a card number.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise
from math import isqrt, prod

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabscope.llm.rows import map_rows

ROUNDS = 10
#: Key of the permutations in tests and registered queries; a real one comes from the caller.
DEMO_KEY = b"public demonstration key"

DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
HEX = DIGITS + "abcdef"
#: What stands for a sign in a secret; a quotation mark would end it.
SIGNS = "!#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: Most characters of a secret that are permuted as one number; longer ones are cut evenly.
SECRET = 128

#: Patterns by kind, tried in this order at each place.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}\b"),
    ("password", r"(?i:\b(?:password|passwd|pwd|secret|api_?key|access_?token|token(?!\s?[=:]\s?[\"'][0-9a-f]{32,64}[\"']))\s?[=:]\s?[\"']?)[^\s\"']{6,}"
     r"|(?i:\bbearer\s)[^\s\"']{16,}|\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    ("access_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("hex_token", r"(?<=[\"'])[0-9a-f]{32,64}(?=[\"'])"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ipv4", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"),
    ("date", r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\d+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"),
    ("foreign_phone", r"(?<![\d+])\+(?!1\b)\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)"),
    ("card", r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])"),
)
#: Kinds that take in neighbouring groups: the pattern without its surroundings, and what must hold at an end.
GROUPED = {
    "iban": (r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", r"\b"),
    "foreign_phone": (r"\+(?!1\b)\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}", r"(?!\d)"),
    "card": (r"\d(?:[ -]?\d){12,18}", r"(?!\d)"),
}
#: How card numbers are usually grouped: tried before other groupings, all of which are tried.
USUAL = re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{4,5}", re.ASCII)
#: A text without any of these characters has no personal data of these kinds.
HINTS = re.compile(r"[0-9@=:]|[Bb][Ee][Aa][Rr][Ee][Rr]|eyJ")


class Cipher:
    """Keyed permutations of 0 .. size-1."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, number: int, value: int, size: int) -> int:
        data = b"%d|%d|%b" % (number, value, tweak)
        wide = hashlib.blake2b(data, key=self.key, digest_size=min(64, size.bit_length() // 8 + 9)).digest()
        return int.from_bytes(wide, "big") % size

    def permute(self, value: int, size: int, tweak: str) -> int:
        """A Feistel network on two halves whose product is just over ``size``; values outside are moved again."""
        if size <= 1:
            return value
        a = isqrt(size - 1) + 1
        b = -(-size // a)
        label = f"{tweak}|{size}".encode()
        while True:
            left, right = divmod(value, b)
            for i in range(ROUNDS):
                if i % 2:
                    right = (right + self._round(label, i, left, b)) % b
                else:
                    left = (left + self._round(label, i, right, a)) % a
            value = left * b + right
            if value < size:
                return value

    def characters(self, text: str, alphabets: list[str], tweak: str) -> str:
        """Permute the texts that have each character from its alphabet."""
        value = 0
        for char, alphabet in zip(text, alphabets, strict=True):
            value = value * len(alphabet) + alphabet.index(char)
        value = self.permute(value, prod(map(len, alphabets)), tweak)
        out = []
        for alphabet in reversed(alphabets):
            value, at = divmod(value, len(alphabet))
            out.append(alphabet[at])
        return "".join(reversed(out))

    def by_class(self, text: str, tweak: str, secret: bool = False) -> str:
        """Permute digits among digits, letters among letters of the same case; all else stays, but not in a ``secret``."""
        kinds = [next((a for a in (DIGITS, LOWER, UPPER) if c in a), None) for c in text]
        if secret:
            kinds = [a or kin(c) for c, a in zip(text, kinds, strict=True)]
        moved = iter(self.characters(
            "".join(c for c, a in zip(text, kinds, strict=True) if a), [a for a in kinds if a], tweak
        ))
        return "".join(next(moved) if a else c for c, a in zip(text, kinds, strict=True))


@lru_cache(maxsize=4096)
def kin(char: str) -> str:
    """The characters that may stand for this one in a secret: signs, or those of its Unicode category nearby."""
    if char in SIGNS:
        return SIGNS
    first, kind = ord(char) & ~0xFF, unicodedata.category(char)
    near = (c for c in map(chr, range(first, first + 256)) if unicodedata.category(c) == kind and not c.isspace())
    return "".join(c for c in near if c.isascii() == char.isascii())


def refill(shape: str, symbols: str) -> str:
    """The letters and digits of ``shape`` replaced in order."""
    rest = iter(symbols)
    return "".join(next(rest) if c.isalnum() else c for c in shape)


def luhn_digit(digits: str) -> str:
    """The check digit that follows these digits."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_remainder(plain: str) -> int:
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


FIRST_DAY, DAYS = datetime.date(1900, 1, 1), 73049  # to 2099-12-31


def _email(cipher: Cipher, text: str) -> str:
    start, _, top = text.rpartition(".")
    return f"{cipher.by_class(start, 'email')}.{top}"


def _password(cipher: Cipher, text: str) -> str:
    found = re.match(r"(?i:bearer\s)|\w+\s?[=:]\s?[\"']?", text)
    head = found.end() if found else 0  # a token may stand alone
    value = text[head:]
    if len(value) <= SECRET:
        return text[:head] + cipher.by_class(value, "password", secret=True)
    parts = -(-len(value) // SECRET)
    cuts = [len(value) * i // parts for i in range(parts + 1)]
    return text[:head] + "".join(
        cipher.by_class(value[a:b], f"password {i} of {parts}", secret=True) for i, (a, b) in enumerate(pairwise(cuts))
    )


def _access_key(cipher: Cipher, text: str) -> str:
    return text[:4] + cipher.characters(text[4:], [UPPER + DIGITS] * 16, "access_key")


def _hex_token(cipher: Cipher, text: str) -> str:
    return cipher.characters(text, [HEX] * len(text), "hex_token")


def _iban(cipher: Cipher, text: str) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_remainder(plain) != 1:
        return None
    body = cipher.by_class(plain[4:], f"iban {plain[:2]}")
    check = 98 - iban_remainder(f"{plain[:2]}00{body}")
    return refill(text, f"{plain[:2]}{check:02d}{body}")


def _ipv4(cipher: Cipher, text: str) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (p[0] == "0" and len(p) > 1) for p in parts):
        return None
    value = cipher.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ipv4")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(cipher: Cipher, text: str) -> str | None:
    numbers = [int(p) for p in re.findall(r"\d+", text)]
    separator = re.search(r"\D", text).group()
    orders = [(0, 1, 2)] if separator == "-" else [(2, 1, 0), (2, 0, 1)] if separator == "/" else [(2, 1, 0)]
    for order in orders:  # day before month if that is a date
        try:
            day = (datetime.date(*(numbers[i] for i in order)) - FIRST_DAY).days
        except ValueError:
            continue
        if 0 <= day < DAYS:
            moved = FIRST_DAY + datetime.timedelta(days=cipher.permute(day, DAYS, "date"))
            parts = dict(zip(order, (f"{moved.year:04d}", f"{moved.month:02d}", f"{moved.day:02d}"), strict=True))
            return separator.join(parts[i] for i in range(3))
    return None


def _ranged(cipher: Cipher, digits: str, ranges: list[tuple[int, int, int]], tweak: str) -> str | None:
    """Permute groups of digits, each with its width and allowed range."""
    value, at, size = 0, 0, 1
    for width, low, high in ranges:
        number = int(digits[at : at + width])
        if not low <= number <= high:
            return None
        value, size, at = value * (high - low + 1) + number - low, size * (high - low + 1), at + width
    value = cipher.permute(value, size, tweak)
    out = []
    for width, low, high in reversed(ranges):
        value, number = divmod(value, high - low + 1)
        out.append(f"{number + low:0{width}d}")
    return "".join(reversed(out))


def _ssn(cipher: Cipher, text: str) -> str | None:
    if text[:3] == "666":
        return None
    digits = text.replace("-", "")
    moved = _ranged(cipher, digits, [(3, 1, 899), (2, 1, 99), (4, 1, 9999)], "ssn")
    while moved and moved[:3] == "666":  # not a number of this kind: move on
        moved = _ranged(cipher, moved, [(3, 1, 899), (2, 1, 99), (4, 1, 9999)], "ssn")
    return refill(text, moved) if moved else None


def _phone(cipher: Cipher, text: str) -> str:
    digits = re.sub(r"\D", "", text)
    head = digits[:-10]
    return refill(text, head + cipher.characters(digits[-10:], [DIGITS] * 10, "phone"))


def _foreign_phone(cipher: Cipher, text: str) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 8 <= len(digits) <= 15:
        return None
    code = len(re.match(r"\+(\d{1,3})", text).group(1)) if re.match(r"\+\d{1,3}\D", text) else 2
    rest = cipher.characters(digits[code:], [DIGITS] * (len(digits) - code), f"phone {digits[:code]}")
    return refill(text, digits[:code] + rest)


def _card(cipher: Cipher, text: str) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = cipher.characters(digits[:-1], [DIGITS] * (len(digits) - 1), "card")
    return refill(text, body + luhn_digit(body))


REPLACE: dict[str, Callable[[Cipher, str], str | None]] = {
    "email": _email, "password": _password, "access_key": _access_key, "hex_token": _hex_token, "iban": _iban,
    "ipv4": _ipv4, "date": _date, "ssn": _ssn, "phone": _phone, "foreign_phone": _foreign_phone, "card": _card,
}
KINDS = tuple(REPLACE)


class Pseudonymizer:
    """Replace the personal data of texts."""

    def __init__(self, key: bytes) -> None:
        self.cipher = Cipher(key)
        named = {kind: f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS}
        self.pattern = re.compile("|".join(named.values()), re.ASCII)
        self.single = {kind: re.compile(pattern, re.ASCII) for kind, pattern in named.items()}
        self.grouped = {kind: tuple(re.compile(x, re.ASCII) for x in own) for kind, own in GROUPED.items()}

    def __call__(self, text: str) -> tuple[str, Counter]:
        """The text with pseudonyms, and how many of each kind."""
        found: Counter = Counter()
        if not HINTS.search(text):
            return text, found

        return "".join(self._moved(text, 0, len(text), found)), found

    def _moved(self, text: str, at: int, stop: int, found: Counter) -> Iterator[str]:
        """The pieces of ``text[at:stop]`` with pseudonyms. After a match without a valid value, the next start is tried."""
        copied, settled = at, {}
        while match := self.pattern.search(text, at, stop):
            hit = self._valid(text, match, stop, settled)
            if hit is None:
                at = match.start() + 1
                continue
            kind, begin, end, new = hit
            yield text[copied : match.start()]
            if begin > match.start():
                yield from self._moved(text, match.start(), begin, found)
            found[kind] += 1
            yield new
            at = copied = end
        yield text[copied:stop]

    def _valid(self, text: str, match: re.Match, stop: int, settled: dict[str, int]) -> tuple[str, int, int, str] | None:
        """Kind, begin, end and pseudonym of a match; if it is not valid, of a value in it or of a later kind's match."""
        kind = match.lastgroup
        new = REPLACE[kind](self.cipher, match.group())
        if new is not None:
            return kind, match.start(), match.end(), new
        hit = self._inside(text, match, stop, settled) if kind in GROUPED else None
        if hit is not None:
            return hit
        for other in KINDS[KINDS.index(kind) + 1 :]:
            if again := self.single[other].match(text, match.start(), stop):
                return self._valid(text, again, stop, settled)
        return None

    def _inside(self, text: str, match: re.Match, stop: int, settled: dict[str, int]) -> tuple[str, int, int, str] | None:
        """The longest valid value of the match's kind that starts at one of its groups (the first of equal ones); one
        with the usual groups comes before longer ones.

        ``settled`` has the place of each kind up to which no start gives a valid value.
        """
        kind, best, rank = match.lastgroup, None, (False, 0)
        pattern, border = self.grouped[kind]
        for begin in range(max(match.start(), settled.get(kind, 0)), match.end()):
            if begin > match.start() and text[begin - 1] not in " -":
                continue
            whole = pattern.match(text, begin, stop)
            for end in range(whole.end(), begin, -1) if whole else ():
                own = USUAL.fullmatch(text, begin, end) is not None, end - begin
                if own > rank and border.match(text, end) and pattern.fullmatch(text, begin, end):
                    new = REPLACE[kind](self.cipher, text[begin:end])
                    if new is not None:
                        best, rank = (kind, begin, end, new), own
        if best is None:
            settled[kind] = match.end()
        return best


def pseudonymize(docs: DataFrame, key: bytes, found: str | None = None) -> DataFrame:
    """Documents with pseudonyms in ``text``; all other columns as they are.

    ``found`` names a column to add: a map from kind to the number replaced. A null text stays null. A value that
    fails its validation stays as it is, but for valid ones in it. Rows are independent: no shuffle, equal values agree because the key does.
    Repeated rows come out each, an empty text stays empty, texts of any length are read whole, other columns may have any
    name but that of ``found``; an empty table gives no row.
    """
    names = [c for c in docs.columns if c != "text"]
    fields = [*(docs.schema[c] for c in names), T.StructField("text", T.StringType())]
    if found:
        fields.append(T.StructField(found, T.MapType(T.StringType(), T.IntegerType())))

    def start():
        replace = Pseudonymizer(key)

        def work(text: str | None, *kept: object) -> tuple:
            new, counts = replace(text) if text is not None else (None, {})
            return (*kept, new, list(counts.items())) if found else (*kept, new)

        return work

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    moved = map_rows(docs, ["text", *(f"`{c}`" for c in names)], schema, start)
    return moved.select(*(f"`{c}`" for c in docs.columns), *([f"`{found}`"] if found else []))
