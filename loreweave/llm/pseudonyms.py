"""Format-preserving pseudonyms for personal data: a keyed Feistel permutation within each value's own format.

A value that passes its validation (Luhn, mod 97, calendar, ranges) is numbered within the set of all values of its
format, the number is permuted under the key, and the new number is written back in the same format. So equal values
get equal pseudonyms in every document, different ones stay different, and a card number stays a valid card number.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import small_batches
from .words import tidied

ROUNDS = 8
KINDS = ("card", "date", "email", "iban", "ip", "phone", "secret", "ssn")

_NUMBER = re.compile(
    r"""(?<![0-9A-Za-z_])(?<![0-9]\.)(?:
      (?P<date>(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}))
    | (?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.[0-9]))
    | (?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})
    | (?P<card>[0-9]{13,19}|[0-9]{4}(?P<four>[ -])[0-9]{4}(?P=four)[0-9]{4}(?P=four)[0-9]{4}|[0-9]{4}(?P<six>[ -])[0-9]{6}(?P=six)[0-9]{4,5})
    | (?P<iban>[A-Z]{2}[0-9]{2}(?:\ ?[0-9A-Z]){11,30})
    | (?P<phone>(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{8,15})
    )(?![0-9A-Za-z_])""",
    re.X,
)
_EMAIL = re.compile(r"(?<![0-9A-Za-z._%+-])([0-9A-Za-z._%+-]+)@([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)+)")
#: Public prefixes by which access keys are known without a name before them, and the forms of what follows.
_KEY = re.compile(
    r"""(?<![0-9A-Za-z_])(?:
      A[KS]IA(?P<aws>[0-9A-Z]{16})
    | gh[opsur]_(?P<hub>[0-9A-Za-z]{36})
    | AIza(?P<api>[0-9A-Za-z_-]{35})
    | xox[abprs]-(?P<chat>[0-9A-Za-z-]{10,})
    | [rs]k_(?:live|test)_(?P<pay>[0-9A-Za-z]{16,})
    )(?![0-9A-Za-z_])""",
    re.X,
)
_SECRET = re.compile(r"""(?i:\b(?:api[_-]?key|access[_-]?key|token|secret|passw(?:or)?d|pwd))['"]?\s*(?:[=:]|=>)\s*['"]?([0-9A-Za-z_+/-]{8,})""")
#: A text without a match has no personal values.
_SOME = "[0-9@]|A[KS]IA|AIza|gh[opsur]_|xox[abprs]-|[rs]k_(live|test)_"
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdef"


class Feistel:
    """A keyed permutation of range(n) without fixed points."""

    def __init__(self, key: bytes, label: str, n: int) -> None:
        self.n, self.a = n, max(1, math.isqrt(n - 1) + 1 if n > 1 else 1)
        self.seed = hashlib.blake2b(f"{label}/{n}".encode(), key=key[:64], digest_size=32).digest()

    def _f(self, k: int, x: int) -> int:
        size = (self.a.bit_length() + 71) // 8
        return int.from_bytes(hashlib.shake_128(self.seed + bytes([k]) + x.to_bytes(size, "big")).digest(size), "big")

    def forward(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.a)
            for k in range(ROUNDS):
                left, right = right, (left + self._f(k, right)) % self.a
            x = left * self.a + right
            if x < self.n:
                return x

    def back(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.a)
            for k in reversed(range(ROUNDS)):
                left, right = (right - self._f(k, left)) % self.a, left
            x = left * self.a + right
            if x < self.n:
                return x

    def move(self, x: int) -> int:
        """One step along the cycle that the permutation makes of the whole range: never the value itself."""
        return self.back((self.forward(x) + 1) % self.n) if self.n > 1 else x


@lru_cache(4096)
def _feistel(key: bytes, label: str, n: int) -> Feistel:
    return Feistel(key, label, n)


def _permute(key: bytes, label: str, values: list[int], bases: list[int]) -> list[int]:
    """Permutes a number of mixed bases."""
    n, x = math.prod(bases), 0
    for v, b in zip(values, bases, strict=True):
        x = x * b + v
    x = _feistel(key, label, n).move(x)
    out = []
    for b in reversed(bases):
        x, v = divmod(x, b)
        out.append(v)
    return out[::-1]


def _characters(key: bytes, label: str, text: str, hexadecimal: bool = False) -> str:
    """Digits, small and capital letters permuted together, each within its own class; other characters stay."""
    sets = [_DIGITS if c in _DIGITS else _HEX if hexadecimal and c in _HEX else _LOWER if c in _LOWER else _UPPER if c in _UPPER else "" for c in text]
    own = [(s, c) for s, c in zip(sets, text, strict=True) if s]
    new = iter(_permute(key, f"{label}/{''.join(s[0] for s, _ in own)}", [s.index(c) for s, c in own], [len(s) for s, _ in own]))
    return "".join(s[next(new)] if s else c for s, c in zip(sets, text, strict=True))


def _fill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in _DIGITS else c for c in shape)


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the rest."""
    return _luhn_digit(digits[:-1]) == digits[-1]


def _luhn_digit(payload: str) -> str:
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _card(key: bytes, text: str) -> str | None:
    digits = re.sub("[^0-9]", "", text)
    if not luhn(digits) or len(set(digits)) == 1:
        return None
    payload = _characters(key, "card", digits[:-1])
    return _fill(text, payload + _luhn_digit(payload))


def _iban(key: bytes, text: str) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    account = _characters(key, f"iban/{plain[:2]}", plain[4:])
    new = iter(f"{plain[:2]}{98 - _mod97(account + plain[:2] + '00'):02d}{account}")
    return "".join(c if c == " " else next(new) for c in text)


def _date(key: bytes, text: str) -> str | None:
    parts, mark = re.split("[-/.]", text), re.search("[-/.]", text)[0]
    first = len(parts[0]) == 4
    year, month, day = (int(x) for x in (parts if first else [parts[2], parts[1], parts[0]]))
    swapped = not first and mark == "/" and month > 12
    if swapped:
        month, day = day, month
    try:
        number = datetime.date(year, month, day).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    if not 0 <= number <= _LAST_DAY - _FIRST_DAY:
        return None
    new = datetime.date.fromordinal(_FIRST_DAY + _permute(key, "date", [number], [_LAST_DAY - _FIRST_DAY + 1])[0])
    a, b = (f"{new.month:02d}", f"{new.day:02d}") if swapped or first else (f"{new.day:02d}", f"{new.month:02d}")
    return mark.join([f"{new.year}", a, b] if first else [a, b, f"{new.year}"])


def _ip(key: bytes, text: str) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    low = {1: 0, 2: 10, 3: 100}
    bases = [{1: 10, 2: 90, 3: 156}[len(p)] for p in parts]
    new = _permute(key, "ip/" + "".join(str(len(p)) for p in parts), [int(p) - low[len(p)] for p in parts], bases)
    return ".".join(str(v + low[len(p)]) for v, p in zip(new, parts, strict=True))


def _ssn(key: bytes, text: str) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    a, g, s = _permute(key, "ssn", [area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999])
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


def _phone(key: bytes, text: str) -> str | None:
    country = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
    head = country[0] if country else "+" if text[0] == "+" else ""
    rest = text[len(head) :]
    digits = re.sub("[^0-9]", "", rest)
    if not 7 <= len(digits) <= 15 or not (head or "(" in text or len(digits) >= 9):
        return None
    return head + _fill(rest, _characters(key, "phone", digits))


_RULES = {"card": _card, "date": _date, "iban": _iban, "ip": _ip, "phone": _phone, "ssn": _ssn}


def pseudonymise(text: str, key: bytes) -> tuple[str, Counter]:
    """The text with its personal values permuted, and how many of each kind."""
    found: Counter = Counter()

    def numbers() -> str:
        out, at = [], 0
        while m := _NUMBER.search(text, at):
            kind, old = m.lastgroup, m[0]
            new = _RULES[kind](key, old)
            while new is None and kind == "iban" and " " in old:  # words that follow an account number are none of it
                old = old.rpartition(" ")[0]
                new = _iban(key, old)
            out += [text[at : m.start()], old if new is None else new]
            at = m.start() + len(old)
            found[kind] += new is not None
        return "".join([*out, text[at:]])

    def access_key(m: re.Match) -> str:
        found["secret"] += 1
        return m[0][: m.start(m.lastgroup) - m.start()] + _characters(key, "secret", m[m.lastgroup])

    def email(m: re.Match) -> str:
        if not any(c in _DIGITS or c in _LOWER or c in _UPPER for c in m[1]):
            return m[0]
        found["email"] += 1
        return f"{_characters(key, 'email', m[1])}@{m[2]}"

    def secret(m: re.Match) -> str:
        if not re.search("[0-9]", m[1]) or _KEY.fullmatch(m[1]):  # access keys have been replaced already
            return m[0]
        found["secret"] += 1
        return m[0][: m.start(1) - m.start()] + _characters(key, "secret", m[1], bool(re.fullmatch("[0-9a-f]+", m[1])))

    text = _KEY.sub(access_key, text)
    if re.search("[0-9]", text):
        # Secrets go first and number rules skip what they wrote: a run inside a word is no number.
        text = _SECRET.sub(secret, text)
        text = numbers()
    if "@" in text:
        text = _EMAIL.sub(email, text)
    return text, found


def _run(key: bytes, extra: bool):
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            old = batch.column(at)
            texts = old.to_pylist() if batch.num_rows else []
            some = pc.fill_null(pc.match_substring_regex(old, _SOME), False).to_pylist()
            counts = [Counter()] * len(texts)
            for k, yes in enumerate(some):
                if yes:
                    texts[k], counts[k] = pseudonymise(texts[k], key)
            columns = batch.columns
            columns[at] = pa.array(texts, pa.string())
            names = batch.schema.names
            if extra:
                columns += [pa.array([sum(c.values()) for c in counts], pa.int64())] + [pa.array([c[k] for c in counts], pa.int64()) for k in KINDS]
                names = [*names, "n_masked", *(f"n_{k}" for k in KINDS)]
            elif "n_chars" in names:
                n = names.index("n_chars")
                if pa.types.is_int64(columns[n].type):
                    columns[n] = pa.array([len(t) if yes and t is not None else was for t, was, yes in zip(texts, columns[n].to_pylist(), some, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names)

    return tidied(run)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def mask(docs: DataFrame, key: str) -> DataFrame:
    """docs with personal values of `text` permuted, all columns and rows kept; n_chars follows where a text changed.

    Null texts stay null, texts without personal values stay as they are, repeated rows get equal results, other
    columns pass through whatever their names. An empty table gives an empty one. Rows are handled one by one.
    """
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_run(key.encode(), False), _ddl(docs))


def mask_report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the masked text, n_masked and a count for each kind (card, date, email, iban, ip, phone, secret, ssn); nulls as in `mask`."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(_run(key.encode(), True), f"{_ddl(docs)}, n_masked long, " + ", ".join(f"n_{k} long" for k in KINDS))
