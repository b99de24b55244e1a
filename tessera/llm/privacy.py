"""Format-preserving pseudonyms of personal data by a keyed Feistel permutation."""

from __future__ import annotations

import datetime as dt
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


ROUNDS = 10
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
KINDS = ("email", "ip", "phone", "card", "iban", "ssn", "date", "token")
TWO_DIGIT_COUNTRIES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _half(value: int, n: int, i: int, key: bytes, tweak: str, mask: int) -> int:
    mac = blake2b(b"%d/" % i + value.to_bytes(n, "big"), digest_size=min(64, n), key=key, person=tweak.encode()[:16]).digest()
    return int.from_bytes(mac, "big") & mask


def _walk(value: int, size: int, key: bytes, tweak: str, back: bool) -> int:
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, n = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            if back:
                left, right = right ^ _half(left, n, ROUNDS - 1 - i, key, tweak, mask), left
            else:
                left, right = right, left ^ _half(right, n, i, key, tweak, mask)
        value = left << half | right
        if value < size:
            return value


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size-1: a balanced Feistel network on the next even number of bits, walked along its
    cycle until it is back in range. Equal values give equal results for one key and tweak."""
    return _walk(value, size, key, tweak, False)


def unpermute(value: int, size: int, key: bytes, tweak: str) -> int:
    """The value that `permute` turns into this one: the rounds backwards, along the same cycle."""
    return _walk(value, size, key, tweak, True)


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _refill(form: str, digits: str) -> str:
    """`form` with its digits replaced in order, all else kept."""
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in form)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _permuted(digits: str, key: bytes, tweak: str) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, f"{tweak}{len(digits)}")).zfill(len(digits)) if digits else ""


def _by_class(text: str, key: bytes, tweak: str) -> str:
    """Letters to letters of the same case and digits to digits; other characters stay."""
    low = text.lower()
    radix = [26 if c in LETTERS else 10 if c in "0123456789" else 1 for c in low]
    value, size = 0, 1
    for c, r in zip(low, radix, strict=True):
        if r > 1:
            value, size = value * r + (LETTERS.index(c) if r == 26 else int(c)), size * r
    value = permute(value, size, key, f"{tweak}{len(text)}")
    out = []
    for c, r in zip(reversed(text), reversed(radix), strict=True):
        if r > 1:
            value, d = divmod(value, r)
            c = (LETTERS[d].upper() if c.isupper() else LETTERS[d]) if r == 26 else str(d)
        out.append(c)
    return "".join(reversed(out))


def _email(m, key):
    name, _, host = m.partition("@")
    return _by_class(name.lower(), key, "email") + "@" + host


def _ip(m, key):
    parts = [int(x) for x in m.split(".")]
    if max(parts) > 255:
        return None
    v = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, v.to_bytes(4, "big")))


def _country(digits: str) -> int:
    """How many digits the country code at the start of an international number has."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_COUNTRIES else 3


def _phone(m, key):
    digits = _digits(m)
    n = len(digits)
    if m[0] == "+" or digits.startswith("00"):
        zeros = 0 if m[0] == "+" else 2
        if not 8 <= n - zeros <= 15:
            return None
        head = zeros + _country(digits[zeros:])
        head += m.count("(0)") if digits[head] == "0" else 0
    elif digits[0] == "0":
        if not 9 <= n <= 15:
            return None
        low = 10 ** (n - 2)  # after the trunk 0 no other one
        return _refill(m, f"0{low + permute(int(digits) - low, 9 * low, key, f'phone0{n}')}")
    elif n == 9 and digits[0] in "6789":
        return _refill(m, str(6 * 10**8 + permute(int(digits) - 6 * 10**8, 4 * 10**8, key, "phone9")))
    elif 10 <= n <= 15:
        head = n - 10
    else:
        return None
    return _refill(m, digits[:head] + _permuted(digits[head:], key, "phone"))


def _local(m, key):
    """A phone number in three groups, without + or leading 0."""
    return _phone(m, key) if len(_digits(m)) >= 10 else None


def _card(m, key):
    digits = _digits(m)
    if not luhn(digits):
        return None
    body = _permuted(digits[:-1], key, "card")
    return _refill(m, body + next(d for d in "0123456789" if luhn(body + d)))


def _iban(m, key):
    def rest(country: str, check: str, body: str) -> int:
        return int("".join(str(int(c, 36)) for c in body + country + check)) % 97

    text = m.replace(" ", "")
    if rest(text[:2], text[2:4], text[4:]) != 1:
        return None
    body = _by_class(text[4:], key, "iban")
    made = iter(text[:2] + f"{98 - rest(text[:2], '00', body):02d}" + body)
    return "".join(c if c == " " else next(made) for c in m)


def _ssn(m, key):
    area, group, serial = m.split("-")
    if area in ("000", "666") or area > "899" or group == "00" or serial == "0000":
        return None
    areas = [a for a in range(1, 900) if a != 666]
    v = permute((areas.index(int(area)) * 99 + int(group) - 1) * 9999 + int(serial) - 1, len(areas) * 99 * 9999, key, "ssn")
    v, serial = divmod(v, 9999)
    area, group = divmod(v, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _date(m, key):
    a, mark, b, _, c = re.split(r"([-/.])", m)
    year_first = len(a) == 4
    try:
        day = dt.date(int(a), int(b), int(c)) if year_first else dt.date(int(c), int(b), int(a))
        order = "ymd" if year_first else "dmy"
    except ValueError:
        try:
            day, order = dt.date(int(c), int(a), int(b)), "mdy"
        except ValueError:
            return None
    if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
        return None
    new = dt.date.fromordinal(FIRST_DAY + permute(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))
    part = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return mark.join(part[x] for x in order)


def _token(m, key):
    v = permute(int(m, 16), 16 ** len(m), key, f"token{len(m)}")
    text = f"{v:0{len(m)}x}"
    return text.upper() if m.isupper() else text


#: What after a blank is a value of its own and no part of the phone number before it: an address, a date, an SSN, a card.
_OTHER = r"(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])|[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?![0-9])|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}(?![0-9])|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])|[0-9]{13}|[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])|[0-9a-fA-F]{32})"
_NEXT = rf"(?:(?:[./-]| (?!{_OTHER}))?\(?[0-9]\)?)"
#: Where each kind may stand; the makers validate what is found there.
_FOUND = re.compile(
    r"(?P<email>[A-Za-z0-9À-ÿ._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24})"
    r"|(?<![A-Za-z0-9.])(?:"
    r"(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?![0-9]|\.[0-9])"
    r"|(?P<date>(?:\d{4}([-/.])\d{1,2}\4\d{1,2}|\d{1,2}([-/.])\d{1,2}\5\d{4}))(?:(?![0-9A-Za-z])|(?=[Tt][0-9]{2}(?![A-Za-z])|Z(?![0-9A-Za-z])))"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![-0-9A-Za-z])"
    r"|(?P<token>[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
    r"|(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z])"
    r"|(?P<card>(?!00[1-9][0-9]{7,12}(?![0-9]))\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![0-9A-Za-z])"
    r"|(?P<phone>(?:\+|00 ?)1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}"
    rf"|\+[0-9]{_NEXT}{{7,14}}|00 ?[1-9]{_NEXT}{{7,14}}"
    rf"|(?<![0-9],)(?:0[1-9](?:[ .-][0-9]{{2}}){{4}}|0 8[0-9]{{2}}(?: [0-9]{{3}}){{2}}|\(?0\)?[1-9]\)?{_NEXT}{{7,10}})"
    r"|(?<![0-9][ -])[6-9][0-9]{2}(?: [0-9]{3} [0-9]{3}|-[0-9]{3}-[0-9]{3}|(?: [0-9]{2}){3}|(?:-[0-9]{2}){3})(?![ -]?[0-9]))(?![0-9A-Za-z])"
    r"|(?P<local>(?:\(\d{2,4}\)[ ]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4})(?![0-9A-Za-z])"
    r")"
)
_MAKERS = {"email": _email, "ip": _ip, "phone": _phone, "local": _local, "card": _card, "iban": _iban, "ssn": _ssn, "date": _date, "token": _token}


class Pseudonymizer:
    """Replaces personal data in texts and counts it by kind; remembers what it has replaced."""

    def __init__(self, key: bytes, remember: int = 200_000):
        self.key = blake2b(key, digest_size=32).digest()
        self.remember = remember
        self.known: dict[tuple[str, str], str | None] = {}

    def value(self, kind: str, found: str) -> str | None:
        """The pseudonym of a value; None if it isn't valid for its kind."""
        at = (kind, found)
        if at not in self.known:
            if len(self.known) >= self.remember:
                self.known.clear()
            self.known[at] = _MAKERS[kind](found, self.key)
        return self.known[at]

    def text(self, text: str) -> tuple[str, dict[str, int]]:
        counts = dict.fromkeys(KINDS, 0)

        def put(m: re.Match) -> str:
            kind, found = m.lastgroup, m.group(0)
            new = self.value(kind, found)
            if new is None:
                return found
            counts["phone" if kind == "local" else kind] += 1
            return new

        return _FOUND.sub(put, text), counts


def _replace(key: bytes):
    def run(batches):
        made = Pseudonymizer(key)
        for b in batches:
            out, counts = [], {k: [] for k in KINDS}
            for text, look in zip(b.column("text").to_pylist(), b.column("look").to_pylist(), strict=True):
                new, n = made.text(text) if look else (text, {})
                out.append(new)
                for k in KINDS:
                    counts[k].append(n.get(k, 0))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string()), *[pa.array(counts[k], pa.int32()) for k in KINDS]], names=["doc_id", "text", *[f"n_{k}" for k in KINDS]])

    return run


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """Every document with its personal data replaced: doc_id, text, and how many values of each kind (n_email ...).

    Valid e-mail names, IPv4 addresses, phone and card numbers (Luhn), IBANs (mod 97), social security numbers, dates
    from 1900 to 2099 and hexadecimal tokens of 32 to 64 digits are permuted within
    their kind and form, so the result is valid again and equal values stay equal in all documents, for one key. What
    is not valid stays. Phone numbers are international ones (+ or 00) of 8 to 15 digits, national ones of 9 to 12 with
    a leading 0, of 10 to 15 in three groups, and of 9 from 6 to 9 in groups of 3 or 2; country codes and the leading 0
    stay. Numbers without +, leading 0 or groups are not taken for phones. The time after a date stays. A text without
    digit or @ is passed on unread; a null text stays null, an empty one empty. Rows are independent, so repeated rows and
    rows without doc_id are rewritten each, and a text is at work whole. Other columns are not read. Empty tables give
    empty results. The key is the caller's: it belongs in a secret store.
    """
    look = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", look.alias("look"))
    return rows.mapInArrow(_replace(key), "doc_id long, text string, " + ", ".join(f"n_{k} int" for k in KINDS))
