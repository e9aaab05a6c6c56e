"""PII surrogates: keyed, type-consistent replacements that keep gender, script and format, and stay distinct.

A surrogate is the image of an entity under a keyed permutation of all strings of its shape, so equal entities get
equal surrogates everywhere and different ones different surrogates, without a table of entities. The permutation is
one cycle through all of them, so that no entity with a letter or digit to exchange is its own surrogate. What is
permuted is the entity without its format (the digits of a number, the letters of a name in lower case); the format is
put back.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scratch
from .words import texts

#: Forms of numbers, in order of precedence at the same place; titles by gender; given names by gender and script.
NUMBERS = {
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d.])",
    "card": r"(?<!\d)\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "phone": r"(?<![\d+])\+?\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]\d{3,4}[ .-]?\d{3,4}(?!\d)",
}
TITLES = {
    "Mr": "m", "Herr": "m", "Señor": "m", "Monsieur": "m", "Господин": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Madame": "f", "Госпожа": "f",
}
#: Titles of either gender; they count with a full stop or before two names.
DEGREES = ("Dr", "Prof", "Professor", "Doktor", "Доктор")
GIVEN = {
    ("f", "latin"): (
        "Alice", "Amina", "Anna", "Barbara", "Camille", "Carmen", "Clara", "Diana", "Elena", "Elizabeth", "Emily", "Emma", "Fatima", "Greta", "Hannah", "Helen", "Ida", "Ingrid", "Jennifer", "Julia",
        "Karen", "Laura", "Linda", "Lucía", "Margaret", "Maria", "Mary", "Nina", "Olivia", "Patricia", "Paula", "Priya", "Rosa", "Sara", "Sarah", "Sophie", "Susan", "Teresa", "Ursula", "Vera",
    ),
    ("m", "latin"): (
        "Adam", "Ahmed", "Anton", "Bruno", "Carl", "Carlos", "Charles", "David", "Eric", "Felix", "George", "Hans", "Henry", "Ivan", "Jacob", "James", "Javier", "John", "José", "Karl",
        "Leo", "Louis", "Martin", "Michael", "Mohammed", "Noah", "Oscar", "Paul", "Peter", "Pierre", "Rahul", "Richard", "Robert", "Simon", "Stefan", "Thomas", "Victor", "William", "Wolfgang", "Yusuf",
    ),
    ("f", "cyrillic"): ("Анна", "Вера", "Дарья", "Екатерина", "Елена", "Ирина", "Мария", "Наталья", "Нина", "Ольга", "Светлана", "Татьяна"),
    ("m", "cyrillic"): ("Александр", "Антон", "Борис", "Виктор", "Владимир", "Денис", "Иван", "Максим", "Михаил", "Олег", "Павел", "Сергей"),
}
#: Characters that are exchanged within their class only; other letters: those of their block, see ``_class``.
CLASSES = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ъь")
#: Ranges of addresses that an address stays in; what is in none is public.
RANGES = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
#: Country codes of one and two digits; all others have three.
COUNTRIES = (
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)
ROUNDS = 8

_KNOWN = {c: chars for chars in CLASSES for c in chars}
_NETS = tuple((int(n.network_address), n.prefixlen) for n in map(ipaddress.ip_network, RANGES))
_LISTED = {n.lower(): (of, i) for of, names in GIVEN.items() for i, n in enumerate(names)}
#: Letters of addresses: Latin, Greek and Cyrillic ones with their marks, so that no run of other scripts before an address joins it.
_LETTERS = "A-Za-zÀ-ÖØ-öø-\u052f"
_LOCAL = re.compile(rf"[{_LETTERS}0-9._%+-]")
_DOMAIN = re.compile(rf"[{_LETTERS}0-9-]+(?:\.[{_LETTERS}0-9-]+)*\.[{_LETTERS}]{{2,}}")
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_RUN = re.compile(r"[+\d][\d .()+-]{6,}")
_NUMBER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in NUMBERS.items()))
_PROPER = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][^\W\d_]*(?:[-'’][^\W\d_]+)*"
#: A capitalised word and, after blanks, up to two more: told apart by the tables above.
_CAPITAL = re.compile(rf"[A-ZÀ-ÖØ-ÞА-ЯЁ][^\W\d_]+(?=\.? +{_PROPER})")
_NAMES = re.compile(rf"( +)({_PROPER})(?:( +)({_PROPER}))?")


def _feistel(key: bytes, label: str, n: int, size: int, rounds: Iterator[int]) -> int:
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    a, b = n >> half, n & mask
    for r in rounds:
        f = hashlib.blake2b(f"{label}:{size}:{r}:{b}".encode(), key=key).digest()
        a, b = b, a ^ (int.from_bytes(f, "big") & mask)
    return a << half | b


def _short(key: bytes) -> bytes:
    return key if len(key) <= 64 else hashlib.blake2b(key).digest()


def permute(key: bytes, label: str, n: int, size: int) -> int:
    """A keyed permutation of range(size): a balanced Feistel network, walked until it lands inside."""
    if size < 2:
        return n
    while True:
        n = _feistel(_short(key), label, n, size, range(ROUNDS))
        if n < size:
            return n


def unpermute(key: bytes, label: str, n: int, size: int) -> int:
    """The number that ``permute`` takes to n: halves exchanged, rounds from the last to the first."""
    if size < 2:
        return n
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    swap = lambda x: (x & ((1 << half) - 1)) << half | x >> half
    while True:
        n = swap(_feistel(_short(key), label, swap(n), size, reversed(range(ROUNDS))))
        if n < size:
            return n


def move(key: bytes, label: str, n: int, size: int, ok: Callable[[int], bool] = lambda m: True) -> int:
    """The next number after n that is ``ok``, on a keyed cycle through all of range(size).

    One to one among the numbers that are ok, and n itself only if no other number is; n must be ok. The cycle is the
    keyed permutation of 0, 1, 2, ...: its steps have no fixed point, as a permutation's own steps may.
    """
    if size < 2:
        return n
    at = unpermute(key, label, n, size)
    while True:
        at = (at + 1) % size
        m = permute(key, label, at, size)
        if ok(m):
            return m


def _upper(c: str) -> str:
    """One capital letter for one small one."""
    return "ẞ" if c == "ß" else c.upper() if len(c.upper()) == 1 else c


@lru_cache(4096)
def _class(c: str) -> str | None:
    """The characters that c is exchanged with: a class of ``CLASSES``, or for other letters those of c's block of 128
    that are of its general category, vowels or consonants as c is, and have a capital if c has; None: c stays.
    """
    if c in _KNOWN:
        return _KNOWN[c]
    if not c.isalpha():
        return None

    def kind(x: str) -> tuple[str, bool, bool]:
        return unicodedata.category(x), unicodedata.normalize("NFD", x)[0] in "aeiouæœø", _upper(x).lower() == x

    start = ord(c) // 128 * 128
    block = (chr(i) for i in range(start, start + 128))
    like = "".join(x for x in block if x.isalpha() and x not in _KNOWN and kind(x) == kind(c))
    return like if len(like) > 1 else None


def reshape(key: bytes, label: str, text: str, ok: Callable[[str], bool] = lambda made: True) -> str:
    """The image of a lower-case text among all texts of its shape that are ok: each character stays in its class."""
    of = [_class(c) for c in text]
    shape = "".join(c if a is None else f"\0{a[0]}" for c, a in zip(text, of, strict=True))
    n, size = 0, 1
    for c, a in zip(text, of, strict=True):
        if a:
            n, size = n * len(a) + a.index(c), size * len(a)

    def spell(n: int) -> str:
        out = list(text)
        for i in range(len(text) - 1, -1, -1):
            if of[i]:
                n, r = divmod(n, len(of[i]))
                out[i] = of[i][r]
        return "".join(out)

    return spell(move(key, f"{label}:{shape}", n, size, lambda m: ok(spell(m))))


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _ip(entity: str, key: bytes) -> str:
    """An address of the same range; a public one for a public one."""
    n = int(ipaddress.IPv4Address(entity))
    net = lambda m: next(((base, bits) for base, bits in _NETS if m >> (32 - bits) == base >> (32 - bits)), None)
    own = net(n)
    if own is None:
        return str(ipaddress.IPv4Address(move(key, "ip", n, 1 << 32, lambda m: net(m) is None)))
    base, size = own[0], 1 << (32 - own[1])
    return str(ipaddress.IPv4Address(base + move(key, f"ip{base}", n - base, size)))


def _groups(address: str) -> list[int]:
    return list(struct.unpack(">8H", ipaddress.IPv6Address(address).packed))


def _ip6(entity: str, key: bytes) -> str:
    """Groups that are zero stay zero, the prefix of a kind of address (local, link-local, multicast, documentation) stays."""
    groups = _groups(entity)
    special = groups[0] >= 0xFC00 or not 0x2000 <= groups[0] < 0x4000
    fixed = 2 if groups[:2] == [0x2001, 0xDB8] else 1 if special else 0
    at = [i for i in range(fixed, 8) if groups[i]]
    if not at:
        return entity
    low = [(0x2000, 0x2000) if i == 0 else (1, 0xFFFF) for i in at]
    n, size = 0, 1
    for i, (base, span) in zip(at, low, strict=True):
        n, size = n * span + groups[i] - base, size * span
    label = "ip6:" + ":".join("x" if i in at else f"{g:x}" for i, g in enumerate(groups))
    documented = lambda g: g[:2] == [0x2001, 0xDB8]

    def spell(n: int) -> list[int]:
        out = list(groups)
        for i, (base, span) in zip(reversed(at), reversed(low), strict=True):
            n, r = divmod(n, span)
            out[i] = r + base
        return out

    made = spell(move(key, label, n, size, lambda m: fixed == 2 or not documented(spell(m))))
    return str(ipaddress.IPv6Address(":".join(f"{g:x}" for g in made)))


def iban_check(country: str, account: str) -> str:
    """The two check digits of an account number: 98 less the remainder by 97, letters as two digits."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def _ssn(digits: str) -> bool:
    """Whether a social-security number can be one: areas 000, 666 and 900 up, group 00 and serial 0000 are never given."""
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _phone(entity: str, key: bytes) -> str:
    """The country code stays; so does whether the number begins as numbers of its plan do."""
    if entity[0] == "+":
        n = next((n for n in (1, 2) if entity[1 : 1 + n] in COUNTRIES), 3)
        code, rest = entity[: 1 + n], entity[1 + n :]
    else:
        code, rest = "", entity
    form = (lambda d: (d[:1] >= "2", d[3:4] >= "2")) if code == "+1" or not code and len(rest) == 10 else (lambda d: d[:1] == "0")
    own = form(rest)
    return code + reshape(key, f"phone{code}", rest, lambda made: form(made) == own)


def surrogate(kind: str, entity: str, key: bytes) -> str:
    """One entity's surrogate, without format; of the same kind and shape, never the entity and never another's of the kind."""
    if kind == "email":
        local, _, domain = entity.partition("@")
        name, dot, top = domain.rpartition(".")
        return reshape(key, f"email{top}", f"{local}@{name}") + dot + top
    if kind == "ip":
        return _ip(entity, key)
    if kind == "ip6":
        return _ip6(entity, key)
    if kind == "card":
        good = luhn(entity)  # as valid as the original
        return entity[0] + reshape(key, f"card{entity[0]}", entity[1:], lambda rest: luhn(entity[0] + rest) == good)
    if kind == "ssn":
        good = _ssn(entity)
        return reshape(key, kind, entity, lambda made: _ssn(made) == good)
    if kind == "phone":
        return _phone(entity, key)
    if kind == "iban":
        account = reshape(key, f"iban{entity[:2]}", entity[4:].lower()).upper()
        return entity[:2] + iban_check(entity[:2], account) + account
    if kind == "given":
        if entity in _LISTED:
            of, i = _LISTED[entity]
            return GIVEN[of][move(key, f"given:{of}", i, len(GIVEN[of]))].lower()
        return reshape(key, "given", entity, lambda made: made not in _LISTED)  # listed names are images of listed ones
    return reshape(key, kind, entity)


def _recase(like: str, text: str) -> str:
    """The text with capitals where ``like`` has them; a capital first stays one, however long the text is."""
    if len(like) == len(text):
        return "".join(_upper(c) if o.isupper() else c for o, c in zip(like, text, strict=True))
    return "".join(map(_upper, text)) if like.isupper() and len(like) > 1 else _upper(text[0]) + text[1:] if text and like[:1].isupper() else text


def _put(kind: str, found: str, made: str) -> str:
    """A surrogate in the format of what was found."""
    if kind in ("card", "ssn", "phone"):
        digits = iter(made.lstrip("+"))
        return "".join(next(digits) if "0" <= c <= "9" else c for c in found)
    if kind == "iban":
        signs = iter(made)
        return "".join(c if c == " " else next(signs) for c in found)
    if kind == "ip6":
        groups = [f"{g:04x}" for g in _groups(made)]
        head, gap, tail = found.partition("::")
        first, last = (x.split(":") if x else [] for x in (head, tail))
        new = groups[: len(first)], groups[8 - len(last) :] if last else []
        text = gap.join(":".join(g if len(o) == 4 else g.lstrip("0") or "0" for o, g in zip(old, own, strict=True)) for old, own in zip((first, last), new, strict=True))
        return text.upper() if any(c.isupper() for c in found) else text
    return made if kind == "ip" else _recase(found, made)


def entity_of(kind: str, found: str) -> str:
    """What was found, without its format: a phone keeps its leading +, which eleven digits from 1 also get."""
    if kind in ("card", "ssn", "phone"):
        digits = "".join(c for c in found if "0" <= c <= "9")
        return "+" + digits if kind == "phone" and (found[0] == "+" or len(digits) == 11 and digits[0] == "1") else digits
    if kind == "iban":
        return found.replace(" ", "")
    return str(ipaddress.IPv6Address(found)) if kind == "ip6" else ".".join(str(int(x)) for x in found.split(".")) if kind == "ip" else found.lower()


def _people(t: str) -> Iterator[tuple[str, int, int]]:
    """Names after a title, or after a listed given name."""
    end = 0
    for m in _CAPITAL.finditer(t):
        word, start = m.group(), m.start()
        if start < end or (start and t[start - 1].isalnum()):
            continue
        if word in TITLES or word in DEGREES:
            dot = t[m.end()] == "."
            got = _NAMES.match(t, m.end() + dot)
            if got and (word in TITLES or dot or got.group(4)):
                kind = "given" if got.group(4) or got.group(2).lower() in _LISTED else "family"
                yield kind, got.start(2), got.end(2)
                if got.group(4):
                    yield "family", got.start(4), got.end(4)
                end = got.end()
        elif word.lower() in _LISTED and t[m.end()] == " ":
            got = _NAMES.match(t, m.end())
            yield "given", start, m.end()
            yield "family", got.start(2), got.end(2)
            end = got.end(2)


def _is_ip6(found: str) -> bool:
    """Three groups or more with a digit among them, so that names with two colons stay."""
    if sum(map(bool, found.split(":"))) < 3 or not any(c.isdigit() for c in found):
        return False
    try:
        ipaddress.IPv6Address(found)
    except ValueError:
        return False
    return True


def _is_iban(found: str) -> bool:
    plain = found.replace(" ", "")
    return 15 <= len(plain) <= 34 and iban_check(plain[:2], plain[4:]) == plain[2:4]


def scan(t: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text's entities, in order, none over another."""
    out = []
    at = t.find("@")
    while at >= 0:
        start = at
        while start and _LOCAL.match(t, start - 1):
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        at = t.find("@", m.end() if m else at + 1)
    for run in _RUN.finditer(t):
        out += [(m.lastgroup, m.start(), m.end()) for m in _NUMBER.finditer(t, run.start(), run.end())]
    if _COLONS.search(t):
        out += [("ip6", m.start(), m.end()) for m in _IP6.finditer(t) if _is_ip6(m.group())]
    out += [("iban", m.start(), m.end()) for m in _IBAN.finditer(t) if _is_iban(m.group())]
    people = list(_people(t))
    if people:
        out += people
        families = {t[a:b] for k, a, b in people if k == "family"}
        # a name that the text has given once is the same person's wherever it stands alone
        lone = re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, sorted(families, key=lambda f: (-len(f), f)))) + r")(?![^\W_])")
        out += [("family", m.start(), m.end()) for m in lone.finditer(t)] if families else []
    kept, end = [], 0
    for kind, a, b in sorted(out, key=lambda x: (x[1], -x[2])):
        if a >= end:
            kept.append((kind, a, b))
            end = b
    return kept


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, entity) of all texts, without their formats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {(k, entity_of(k, t[a:b])) for raw in batch.column("text").to_pylist() for t in [raw.decode("utf-8", "replace")] for k, a, b in scan(t)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([e for _, e in seen], pa.string())], ["kind", "entity"])

    return texts(docs).mapInArrow(run, "kind string, entity string").distinct()


def collisions(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, surrogate, n) of surrogates that more than one entity of ``found`` would get; none, if the key is sound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            made = [surrogate(k, e, key) for k, e in zip(kinds, batch.column("entity").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(made, pa.string())], ["kind", "surrogate"])

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "kind", "entity").mapInArrow(run, "kind string, surrogate string").groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, n_entities, spans, text_sha256) of every row: the text with surrogates, and what was replaced, as kind:start:end.

    Entities are e-mail addresses, IP addresses of both versions, account numbers (IBAN), card, social-security and
    phone numbers, and names after a title or a listed given name; a family name found so is replaced wherever the text
    has it. Given names keep their gender and script (of listed ones), letters their script, numbers their punctuation,
    cards, accounts and social-security numbers their validity, addresses their range, phones their country, names
    their capitals, whatever the mention. No entity with a letter or digit is its own surrogate (an address of a kind
    that has no other, as ::1, stays). Before any text is changed, the surrogates of all distinct entities are checked to be distinct, by a
    grouping of the table of entities. Null texts are empty; repeated rows are treated alike; other columns, whatever
    their names, take no part; an empty table gives no rows.
    """
    found = scratch.table(entities(docs), "entities")
    if not collisions(found, key).isEmpty():
        raise ValueError("two entities share a surrogate; use another key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lru_cache(100_000)(lambda kind, entity: surrogate(kind, entity, key))
        for batch in batches:
            out, spans = [], []
            for raw in batch.column("text").to_pylist():
                t = raw.decode("utf-8", "replace")
                own, at, parts = scan(t), 0, []
                for k, a, b in own:
                    parts += [t[at:a], _put(k, t[a:b], made(k, entity_of(k, t[a:b])))]
                    at = b
                out.append("".join(parts) + t[at:] if own else t)
                spans.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array([",".join(f"{k}:{a}:{b}" for k, a, b in s) for s in spans], pa.string()),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in out], pa.string())],
                ["doc_id", "text", "n_entities", "spans", "text_sha256"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, text string, n_entities long, spans string, text_sha256 string")
