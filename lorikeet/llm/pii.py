"""PII by format-preserving Feistel pseudonyms.

Numbers and dates that validate are permuted under a key within their own
format: a card number stays one of the same length that passes the check digit,
a phone number keeps its shape and country, an address stays an address, a date
a date. A permutation is one to one, so equal values stay linked across
documents and different ones stay apart, and who holds the key can invert it.

The permutation is a Feistel network over the integers below a * b (a and b
near the root of the number of values): two halves take turns in being shifted
by a keyed hash of the other. A value goes through the network, one step on, and
back through it: that is a permutation too, and none of its values stays itself.
Where a format is not a whole range of integers, values outside it are permuted
again until one lies inside (cycle walking), which keeps it one to one.

The key is an argument, or the setting ``spark.lorikeet.pii.key``. Where neither
is given the application makes a random one: values are linked within it only.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import math
import re
import secrets
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorikeet.llm.common import frugal

ROUNDS = 10
KEY_SETTING = "spark.lorikeet.pii.key"
_own_key = secrets.token_bytes(32)


def key_of(spark: SparkSession) -> bytes:
    """The key that the session is set to, or the application's own."""
    given = spark.conf.get(KEY_SETTING, None)
    return given.encode() if given else _own_key


class Feistel:
    """A keyed permutation of the integers below ``size``."""

    def __init__(self, key: bytes, kind: str, size: int):
        self.size = size
        self.a = max(1, math.isqrt(size - 1) + 1)
        self.b = -(-size // self.a)
        self.state = hashlib.blake2b(f"{kind}:{size}".encode(), key=key[:64], digest_size=64)

    def _f(self, turn: int, x: int) -> int:
        h = self.state.copy()
        h.update(turn.to_bytes(1, "big") + x.to_bytes(x.bit_length() // 8 + 1, "big"))
        return int.from_bytes(h.digest(), "big")

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if turn % 2:
                right = (right + sign * self._f(turn, left)) % self.b
            else:
                left = (left + sign * self._f(turn, right)) % self.a
        return left * self.b + right

    def _image(self, x: int, back: bool) -> int:
        y = self._once(x, back)
        while y >= self.size:
            y = self._once(y, back)
        return y

    def apply(self, x: int, back: bool = False, valid: Callable[[int], bool] | None = None) -> int:
        """The image of x, another number if there is one; with ``valid``, which
        holds for x, within what it holds for."""
        while True:
            x = self._image((self._image(x, False) + (-1 if back else 1)) % self.size, True)
            if valid is None or valid(x):
                return x


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 - i % 2)
        total += n - 9 if n > 9 else n
    return -total % 10


def _in_shape(shape: str, digits: str) -> str:
    """``digits`` put in the places of the digits of ``shape``."""
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), shape)


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


#: Lengths of account numbers by country, the public registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18,
    "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23,
    "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
#: Most digits of a phone number after the country's; elsewhere 12.
PHONE_DIGITS = {
    "1": 10, "7": 10, "20": 10, "27": 9, "30": 10, "31": 9, "32": 9, "33": 9, "34": 9, "36": 9, "39": 11, "40": 9, "41": 9, "44": 10,
    "45": 8, "46": 10, "47": 8, "48": 9, "49": 11, "51": 9, "52": 10, "54": 11, "55": 11, "56": 9, "57": 10, "58": 10, "60": 10, "61": 9,
    "63": 10, "64": 10, "65": 8, "66": 9, "81": 10, "82": 10, "84": 10, "86": 11, "90": 10, "91": 10, "92": 10, "94": 9, "98": 10,
    "351": 9, "352": 11, "353": 9, "420": 9, "421": 9,
}
#: Calling codes of one and two digits; all others have three.
CALLING_CODES = {
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53",
    "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
}
#: What a number isn't carried on into after a space or hyphen: an address, a date; a card neither into a shorter number.
_OTHER = r"(?:[0-9]{1,3}\.){3}[0-9]|(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])|[0-9]{2}([./])[0-9]{2}\1[0-9]{4}|[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]"
_SHORT = r"[0-9]{3}-[0-9]{2,3}-[0-9]{4}(?![0-9-])"
#: Usual shapes of card numbers; sixteen digits in fours may have three more.
_CARD = re.compile(r"[0-9]{4}(?:([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|([ -])[0-9]{6}\2[0-9]{4,5}|[0-9]{9,15})(?![0-9])")
_FIRST_DAY, _LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)
_DAYS = (_LAST_DAY - _FIRST_DAY).days + 1
#: Letters that are permuted among themselves in the local part of an address: a-z, and those with an accent.
_ACCENTED = [c for c in map(chr, range(0xDF, 0x250)) if c.islower() and len(c.upper()) == 1 and c.upper() <= "ɏ" and c.upper().lower() == c]
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "".join(_ACCENTED))
_LETTER = {c: (alphabet, i) for alphabet in _ALPHABETS for i, c in enumerate(alphabet)}
_HEX4 = "[0-9A-Fa-f]{1,4}"


def _calling_code(digits: str) -> str:
    return next((digits[:n] for n in (1, 2) if digits[:n] in CALLING_CODES), digits[:3])


class Pseudonyms:
    """Finds personal data in texts and replaces it under one key."""

    #: (kind, pattern); earlier kinds win where several match at a place.
    PATTERNS = (
        ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{40}|[0-9A-F]{40}|[0-9a-f]{64}|[0-9a-f]{32}|[0-9A-F]{32})(?![0-9A-Za-z])"),
        ("email", r"(?<![A-Za-zÀ-ɏ0-9._%+-])[A-Za-zÀ-ɏ0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
        ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?"),
        ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
        ("ipv6", rf"(?<![0-9A-Za-z:.])(?:{_HEX4}:){{7}}{_HEX4}(?![0-9A-Za-z:])"),
        ("ipv6", rf"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{{3,4}}(?::{_HEX4}){{0,5}}::{_HEX4}(?::{_HEX4}){{0,5}}(?![0-9A-Za-z:]|\.[0-9])"),
        ("phone", rf"\+[0-9]{{1,3}}[ -]?(?:\(0\) ?)?\(?[0-9]{{1,4}}\)?(?:(?:[ -](?!{_OTHER}))?[0-9]{{2,4}}){{2,4}}(?![0-9])"),
        ("phone", r"(?<![0-9+])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9+-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9])"),
        ("date", r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"),
        ("date", r"(?<![0-9./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![0-9]|[./][0-9])"),
        ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
        ("card", rf"(?<![0-9])[0-9](?:(?:[ -](?!{_OTHER}|{_SHORT}))?[0-9]){{12,18}}(?![0-9])"),
    )

    def __init__(self, key: bytes):
        self.key, self.made = key, {}
        parts = []
        for i, (kind, pattern) in enumerate(self.PATTERNS):
            pattern = pattern.replace(r"\1", f"(?P=sep{i})").replace("([./])", f"(?P<sep{i}>[./])")
            parts.append(f"(?P<p{i}>{pattern})")
        self.find = re.compile("|".join(parts)).search
        self.maybe = re.compile(r"[0-9@]|[0-9A-Fa-f]{32}").search  # an address of version 6 without a digit isn't taken for one

    def _map(self, kind: str, size: int, x: int, back: bool, valid=None) -> int:
        got = self.made.get((kind, size))
        if got is None:
            got = self.made[kind, size] = Feistel(self.key, kind, size)
        return got.apply(x, back, valid)

    def _number(self, kind: str, digits: str, back: bool, valid=None) -> str:
        n = len(digits)
        check = valid and (lambda x: valid(f"{x:0{n}d}"))
        return f"{self._map(kind, 10**n, int(digits), back, check):0{n}d}"

    def _length(self, kind: str, text: str, start: int, end: int) -> int:
        """Length of the value at the start of a match, which may have taken more; 0
        for none. Only what pseudonyms keep decides: shapes, countries, validity."""
        found = text[start:end]
        if kind == "iban":
            left = IBAN_LENGTHS.get(found[:2], 0)
            for i, c in enumerate(found):
                left -= c != " "
                if not left:
                    return i + 1 if not text[start + i + 1 : start + i + 2].isalnum() else 0
            return 0
        if kind == "phone" and found[0] == "+":
            code, cuts, n = _calling_code(_digits(found)), [], 0
            for m in re.finditer(r"(?<!\()[0-9]+|(?<=\()[0-9]+", found):
                n += 0 if found[m.start() - 1 : m.end() + 1] == "(0)" else m.end() - m.start()
                cuts.append((n - len(code), m.end()))
            most = PHONE_DIGITS.get(code, 12)
            return max((at for n, at in cuts if 7 <= n <= most), default=next((at for n, at in cuts if n > most), len(found)))
        if kind == "card":
            usual = _CARD.match(found)
            if usual:
                return usual.end()
            if any(_CARD.match(found, m.start()) for m in re.finditer(r"(?<=[ -])[0-9]", found)):
                return 0
        return len(found)

    def replace(self, kind: str, text: str, back: bool = False) -> str | None:
        """The pseudonym of a value of a kind, or None where it doesn't validate."""
        return getattr(self, f"_{kind}")(text, back)

    def _secret(self, text: str, back: bool) -> str:
        upper = text != text.lower()
        out = f"{self._map('secret', 16 ** len(text), int(text, 16), back):0{len(text)}x}"
        return out.upper() if upper else out

    def _email(self, text: str, back: bool) -> str | None:
        # letters and digits of the local part are permuted within their places; case, other characters and the domain stay
        local, _, domain = text.partition("@")
        at = [i for i, c in enumerate(local) if c.lower() in _LETTER]
        letters = [_LETTER[local[i].lower()] for i in at]
        size, x = 1, 0
        for alphabet, i in letters:
            size, x = size * len(alphabet), x * len(alphabet) + i
        if size == 1:
            return None
        shape = "".join("9aé"[_ALPHABETS.index(alphabet)] for alphabet, _ in letters)
        y, out = self._map(f"email:{shape}:{domain.lower()}", size, x, back), list(local)
        for i, (alphabet, _) in zip(reversed(at), reversed(letters)):
            y, d = divmod(y, len(alphabet))
            out[i] = alphabet[d] if local[i] in _LETTER else alphabet[d].upper()
        return "".join(out) + "@" + domain

    def _iban(self, text: str, back: bool) -> str | None:
        flat = text.replace(" ", "")
        if len(flat) != IBAN_LENGTHS.get(flat[:2]) or self._mod97(flat[4:] + flat[:4]) != 1:
            return None
        size, x = 1, 0
        for c in flat[4:]:
            base = 10 if c.isdigit() else 26
            size, x = size * base, x * base + (int(c) if base == 10 else ord(c) - 65)
        shape = "".join("9" if c.isdigit() else "A" for c in flat[4:])
        y, out = self._map(f"iban:{flat[:2]}:{shape}", size, x, back), []
        for c in reversed(flat[4:]):
            y, d = divmod(y, 10 if c.isdigit() else 26)
            out.append(str(d) if c.isdigit() else chr(65 + d))
        body = "".join(reversed(out))
        new = iter(f"{flat[:2]}{98 - self._mod97(f'{body}{flat[:2]}00'):02d}{body}")
        return "".join(c if c == " " else next(new) for c in text)

    @staticmethod
    def _mod97(text: str) -> int:
        return int("".join(str(int(c, 36)) for c in text)) % 97

    def _ip(self, text: str, back: bool) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
            return None
        x = 0
        for p in parts:
            x = x * 256 + int(p)
        y = self._map("ip", 1 << 32, x, back)
        return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))

    def _ipv6(self, text: str, back: bool) -> str | None:
        # the digits are permuted in their places, so that the notation stays
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return None
        groups = [g for g in text.split(":") if g]
        if not any(c.isdigit() for c in text) or len(groups) == 8 and max(map(len, groups)) < 3:
            return None
        digits = "".join(groups)
        n = len(digits)
        y = f"{self._map(f'ipv6:{n}', 16**n, int(digits, 16), back):0{n}x}"
        new = iter(y.upper() if digits != digits.lower() else y)
        return "".join(c if c == ":" else next(new) for c in text)

    def _phone(self, text: str, back: bool) -> str | None:
        # a number is its calling code and the digits behind, however they are set apart; +1 is meant where no code stands
        at = [m.start() for m in re.finditer(r"[0-9]", text) if text[m.start() - 1 : m.start() + 2] != "(0)"]
        digits = "".join(text[i] for i in at)
        code = _calling_code(digits) if text[0] == "+" else "1"
        if text[0] == "+":
            at, digits = at[len(code) :], digits[len(code) :]
        if not 7 <= len(digits) <= 15:
            return None
        out = list(text)
        for i, c in zip(at, self._number(f"phone:{code}", digits, back)):
            out[i] = c
        return "".join(out)

    def _date(self, text: str, back: bool) -> str | None:
        try:
            day = dt.date.fromisoformat(text) if text[4] == "-" else dt.date(int(text[6:]), int(text[3:5]), int(text[:2]))
        except ValueError:
            return None
        if not _FIRST_DAY <= day <= _LAST_DAY:
            return None
        new = _FIRST_DAY + dt.timedelta(days=self._map("date", _DAYS, (day - _FIRST_DAY).days, back))
        return new.isoformat() if text[4] == "-" else f"{new.day:02d}{text[2]}{new.month:02d}{text[2]}{new.year:04d}"

    def _ssn(self, text: str, back: bool) -> str | None:
        def valid(d: str) -> bool:
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

        digits = _digits(text)
        return _in_shape(text, self._number("ssn", digits, back, valid)) if valid(digits) else None

    def _card(self, text: str, back: bool) -> str | None:
        digits = _digits(text)
        if re.fullmatch(r"[0-9]{4}([ -])(?:[0-9]{4}\1){3}[0-9]{3}", text):  # of the sixteen and of the three each by itself
            return self._card(text[:19], back) + text[19] + self._number("card", digits[16:], back)
        if luhn(digits[:-1]) == int(digits[-1]):  # the check digit is made anew for the rest
            body = self._number("card", digits[:-1], back)
            return _in_shape(text, f"{body}{luhn(body)}")
        if len(digits) != 16:
            return None
        # 16 digits that look like a card with a slip in it: permuted among those that fail the check
        return _in_shape(text, self._number("account", digits, back, lambda d: luhn(d[:-1]) != int(d[-1])))

    def mask(self, text: str, back: bool = False) -> tuple[str, int]:
        """(text with pseudonyms, how many values were replaced)."""
        if not self.maybe(text):
            return text, 0
        n, done, at, no_card, out = 0, 0, 0, 0, []
        while m := self.find(text, at):
            kind, start = self.PATTERNS[int(m.lastgroup[1:])][0], m.start()
            at = start + 1  # what doesn't validate may hold another value
            length = 0 if kind == "card" and start < no_card else self._length(kind, text, start, m.end())
            new = self.replace(kind, text[start : start + length], back) if length else None
            if new is not None:
                n += 1
                out += [text[done:start], new]
                at = done = start + length
            elif kind == "card" and length:
                no_card = max(no_card, start + length)
        return "".join(out) + text[done:], n


def pseudonymise(docs: DataFrame, key: bytes | None = None, back: bool = False, count: str | None = "n_replaced") -> DataFrame:
    """``docs`` (doc_id, text, ...) with personal data in the whole text replaced
    by pseudonyms, and, under the name ``count`` unless that is None, how many
    values were. ``back`` inverts. ``key``: see the module.

    Replaced are e-mail addresses, IBANs that validate, IPv4 and IPv6 addresses,
    phone numbers, real dates of 1900 to 2099, social security numbers, card
    numbers, 16-digit numbers that fail the check digit (within those that fail),
    and hexadecimal secrets. Addresses keep their domain, phone numbers their
    country; a phone number has one pseudonym however it is set. A null text stays
    null, an empty one empty; every other column stays as it is, but for one of
    the name ``count``, which is replaced. Rows are treated one by one, whatever
    their doc_id: nothing is shuffled or held.
    """
    base = docs.drop(count) if count else docs
    at, key = base.columns.index("text"), key if key is not None else key_of(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            done = [(None, 0) if x is None else names.mask(x, back) for x in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in done], pa.string())
            if count:
                columns.append(pa.array([n for _, n in done], pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *([count] if count else [])])

    own = [T.StructField(count, T.IntegerType())] if count else []
    return base.mapInArrow(frugal(each), T.StructType([*base.schema.fields, *own]))


def op10_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_replaced) of all documents: see ``pseudonymise`` for what is
    replaced, nulls, empty texts and repeated rows, and the module for the key."""
    return pseudonymise(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")))
