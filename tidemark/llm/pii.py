"""PII: surrogates for detected personal data and secrets.

Found entities are replaced by keyed values of the same type and format: an
address stays an address, a card number passes the same check digit, private IPs
stay private, hex stays hex, a given name becomes one of the same gender and
script, letters keep their case and script.

Within a type and format the replacement is a keyed permutation without fixed points:
an unbalanced Feistel network over the variable characters takes an entity to a
number, the number is raised by one, and the inverse network gives the surrogate,
again until the format is the same. So one entity has one surrogate wherever it
appears, none is its own, and different entities never share one: distinctness needs
no table of all entities. :func:`checked` runs :func:`collisions` over what was
replaced. Separators of numbers and IBANs are no part of the entity.

Detected are e-mail addresses, IPv4 and IPv6 addresses, MACs, IBANs, numbers of nine
digits or more (not dates), shorter ones after a word like "phone" or "call", values
of passwords, keys and tokens, bearer and prefixed tokens, and names. Of names, every
capitalised word in the run that follows a title or begins with a known given name is
replaced, compounds and words with an apostrophe as one, and in all other mentions too
(a lone letter only there). Particles (van, de la) stay. So does a name that nowhere in
the text follows a title or a known given name.

The key is a secret of the user: ``spark.tidemark.pii.key`` or the variable
``TIDEMARK_PII_KEY``; without them each session draws one, so its surrogates can't be
reproduced or inverted later.

Edge cases: a null text stays null, an empty one empty; very long texts are
scanned whole, in time that grows with their length; other characters stay in place;
equal texts (repeated rows) give equal results; extra columns are kept, whatever their
names; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import ipaddress
import os
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, materialize

ROUNDS = 8
#: Characters of a value that are permuted as one number.
BLOCK = 512

# -- names --------------------------------------------------------------------
_GIVEN = {
    ("latin", "f"): "Anna Maria Laura Julia Sarah Emma Sophie Claire Marie Camille Lucía Carmen Elena Sofía Paula Ingrid Heike Petra Sabine Ursula Emily Grace Alice Ruth Helen Nora Clara Ida Eva Irene".split(),
    ("latin", "m"): "John James Robert David Michael Thomas Peter Hans Klaus Jürgen Stefan Wolfgang Pierre Jean Louis Antoine Marc Carlos Juan Diego Pablo Javier Miguel Paul Henry Oscar Felix Hugo Leo Bruno".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Алексей Сергей Дмитрий Андрей Михаил Николай Павел Владимир Юрий".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Παναγιώτης Βασίλης Χρήστος Αντώνης".split(),
}
_GIVEN_AT = {n: (k, i) for k, names in _GIVEN.items() for i, n in enumerate(names)}
_TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mademoiselle Mme Señor Señora Sra Господин Госпожа Κύριος Κυρία".split()
_TITLED = re.compile(r"\b(?:(?:" + "|".join(_TITLES) + r")\b\.? )+")
_LETTER = r"(?:[^\W\d_]|[\u0300-\u036f])+"
_NAME_WORD = re.compile(rf"{_LETTER}(?:['\u2019\u2010\u2011-]{_LETTER})*")
#: Lower-case words within a name; they stay.
_PARTICLES = set("van von der den de la le les du da di del della do dos das des zu zum zur af av ten ter bin ibn y".split())
_JOINT = re.compile(r"['\u2019\u2010\u2011-]")
#: What follows a name without belonging to it: "'s" and the like, "-led".
_AFTER = re.compile(r"['\u2019](?:s|S|d|ll|re|ve|m)$|[\u2010\u2011-][^\W\d_]+$")
#: A capitalised word before another one.
_GIVEN_FIRST = re.compile(r"\b([^\W\d_]+) (?=[^\W\d_])")
_RUN = re.compile(_LETTER)
_BEARER = re.compile(r"(?i)\b(?:bearer|basic) ")
_ANY_TITLE = re.compile(r"\b(?:" + "|".join(_TITLES) + r")\b")

# -- characters -----------------------------------------------------------------
_ALPHABETS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ"]
_ALPHABETS += ["аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ"]
_ALPHABETS += ["αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ"]
_ALPHABETS += ["áéíóúàèùâêîôûäëïöü", "çñ", "ÁÉÍÓÚÀÈÙÂÊÎÔÛÄËÏÖÜ", "ÇÑ"]
_CLASS = {c: a for a in _ALPHABETS for c in a}
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OTHER_DIGIT = re.compile(r"[^\D0-9]")
_ASCII = {c: a for a in ("0123456789", _LOWER, _UPPER) for c in a}


def _halves(values: list[int], bases: list[int]) -> tuple[list[int], list[int]]:
    half, numbers, sizes = (len(bases) + 1) // 2, [], []
    for own, base in ((values[:half], bases[:half]), (values[half:], bases[half:])):
        x, m = 0, 1
        for v, b in zip(own, base, strict=True):
            x, m = x * b + v, m * b
        numbers.append(x)
        sizes.append(m)
    return numbers, sizes


def _mix(key: bytes, tweak: str, numbers: list[int], sizes: list[int], back: bool = False) -> None:
    """The rounds of the network, or their inverse, in place."""
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        i = r % 2
        seed = hashlib.blake2b(f"{tweak}|{r}|{numbers[1 - i]}".encode(), key=hashlib.sha256(key).digest(), digest_size=64).digest()
        wide = seed if sizes[i] < 1 << 448 else b"".join(hashlib.blake2b(seed + j.to_bytes(4), digest_size=64).digest() for j in range(sizes[i].bit_length() // 512 + 2))
        add = int.from_bytes(wide)
        numbers[i] = (numbers[i] - add if back else numbers[i] + add) % sizes[i]


def _feistel(key: bytes, tweak: str, values: list[int], bases: list[int]) -> list[int]:
    """A keyed permutation of all tuples with these bases, one cycle, so none stays."""
    if len(bases) > BLOCK:
        return _chained(key, tweak, values, bases)
    numbers, sizes = _halves(values, bases)
    _mix(key, tweak, numbers, sizes)
    up, numbers[1] = divmod(numbers[1] + 1, sizes[1])
    numbers[0] = (numbers[0] + up) % sizes[0]
    _mix(key, tweak, numbers, sizes, back=True)
    out, half = [], (len(bases) + 1) // 2
    for x, base in zip(numbers, (bases[:half], bases[half:]), strict=True):
        own = []
        for b in reversed(base):
            x, v = divmod(x, b)
            own.append(v)
        out += own[::-1]
    return out


def _chained(key: bytes, tweak: str, values: list[int], bases: list[int]) -> list[int]:
    """The same for very long tuples: blocks, each permuted by what the ones before it
    became, forwards and then backwards, so time grows with the length."""
    shape = hashlib.blake2b(tweak.encode(), digest_size=32).hexdigest()
    for way in ("to", "fro"):
        out, last = [], hashlib.blake2b(digest_size=32)
        for i in range(0, len(bases), BLOCK):
            made = _feistel(key, f"{shape}|{way}|{i}|{last.hexdigest()}", values[i : i + BLOCK], bases[i : i + BLOCK])
            last.update(bytes(made))
            out += made
        values, bases = out[::-1], bases[::-1]
    return values


def _permute(key: bytes, tweak: str, s: str, classes: list[str | None], same=None) -> str:
    """Replaces the characters that have a class; ``same`` must stay true of the result."""
    at = [i for i, c in enumerate(classes) if c]
    if not at:
        return s
    shape = tweak + "|" + "".join("." if c is None else c[0] for c in classes) + "|" + "".join(x for x, c in zip(s, classes, strict=True) if c is None)
    values, bases = [classes[i].index(s[i]) for i in at], [len(classes[i]) for i in at]
    chars = list(s)
    while True:
        values = _feistel(key, shape, values, bases)
        for i, v in zip(at, values, strict=True):
            chars[i] = classes[i][v]
        out = "".join(chars)
        if same is None or same(out):
            return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _ascii_digits(s: str) -> str:
    """Digits of any script as ASCII digits, the rest as it is."""
    return s if s.isascii() else _OTHER_DIGIT.sub(lambda m: str(unicodedata.decimal(m[0])), s)


def _digits_of(c: str) -> str:
    """The ten digits of a digit's script."""
    zero = ord(c) - unicodedata.decimal(c)
    return "".join(map(chr, range(zero, zero + 10)))


def _only_digits(s: str) -> str:
    return "".join(c for c in _ascii_digits(s) if c.isdecimal())


def _is_card(s: str) -> bool:
    d = _only_digits(s)
    return 13 <= len(d) <= 19 and _luhn(d)


def _number(key: bytes, s: str) -> str:
    """Phone, card and account numbers: separators, each digit's script and the first digit's kind stay."""
    at = [i for i, c in enumerate(s) if c.isdecimal()]
    d = "".join(s[i] for i in at)
    classes = [_digits_of(c) for c in d]
    classes[0] = classes[0][1:] if d[0] != classes[0][0] else None
    if _is_card(d):  # the last digit follows from the others
        ten = _digits_of(d[-1])
        out = _permute(key, "card", d[:-1] + ten[0], [*classes[:-1], None])
        out = next(x for c in ten if _luhn(_only_digits(x := out[:-1] + c)))
    else:
        out = _permute(key, "number", d, classes, lambda x: not _is_card(x))
    chars = list(s)
    for i, c in zip(at, out, strict=True):
        chars[i] = c
    return "".join(chars)


def _ip(key: bytes, s: str) -> str:
    a = ipaddress.IPv4Address(_ascii_digits(s))
    kind = (a.is_private, a.is_loopback, a.is_multicast, a.is_reserved)
    values = list(a.packed)
    while True:
        values = _feistel(key, "ip", values, [256] * 4)
        b = ipaddress.IPv4Address(bytes(values))
        if (b.is_private, b.is_loopback, b.is_multicast, b.is_reserved) == kind:
            return str(b).translate(dict(zip(range(48, 58), _digits_of(s[0]), strict=True)))


def _ip6(key: bytes, s: str) -> str:
    """The prefix' kind stays; written in full where it was, else shortened."""
    a = ipaddress.IPv6Address(s)
    kind = lambda x: (x.is_private, x.is_loopback, x.is_multicast, x.is_reserved, x.is_link_local, x.is_global)
    values, keep = list(a.packed), 2 if not a.is_global else 0
    while True:
        values[keep:] = _feistel(key, f"ip6|{bytes(values[:keep]).hex()}", values[keep:], [256] * (16 - keep))
        b = ipaddress.IPv6Address(bytes(values))
        if kind(b) == kind(a):
            break
    out = b.exploded if "::" not in s else str(b)
    return out.upper() if s != s.lower() else out


def _cased(model: str, s: str) -> str:
    return "".join(c.upper() if m.isupper() else c for m, c in zip(model, s, strict=True))


def _email(key: bytes, s: str) -> str:
    """Both parts by themselves, so equal domains stay equal; case carries over."""
    local, _, domain = s.rpartition("@")
    low = local.lower()
    out = _cased(local, _permute(key, "mail", low, [_ASCII.get(c) for c in low]))
    labels = domain.split(".")
    keep = 2 if len(labels) > 1 and labels[-2].lower() == "example" else 1
    moved = ".".join(labels[:-keep])
    low = moved.lower()
    moved = _cased(moved, _permute(key, "domain", low, [_ASCII.get(c) for c in low])) if moved else ""
    return f"{out}@" + ".".join(x for x in (moved, *labels[-keep:]) if x)


_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")


def _secret(key: bytes, s: str) -> str:
    if _HEX.fullmatch(s):
        kind = "0123456789abcdef" if s == s.lower() else "0123456789ABCDEF"
        return _permute(key, "hex", s, [kind] * len(s), lambda x: (x == x.lower()) == (s == s.lower()))
    return _permute(key, "secret", s, [_ASCII.get(c) for c in s], lambda x: not _HEX.fullmatch(x))


def _access_key(key: bytes, s: str) -> str:
    return s[:4] + _permute(key, "access", s[4:], [_ASCII.get(c) for c in s[4:]])


def _token(key: bytes, s: str) -> str:
    """A token's well-known beginning stays."""
    n = _TOKEN_HEAD.match(s).end()
    return s[:n] + _permute(key, "token", s[n:], [_ASCII.get(c) for c in s[n:]])


def _mac(key: bytes, s: str) -> str:
    kinds = {s.lower(): "0123456789abcdef", s.upper(): "0123456789ABCDEF"}
    kind = kinds.get(s, "0123456789abcdefABCDEF")  # of mixed case it stays
    mixed = lambda x: x not in (x.lower(), x.upper())
    return _permute(key, "mac", s, [kind if c.isalnum() else None for c in s], lambda x: mixed(x) == mixed(s) and (x == x.lower()) >= (s == s.lower()))


def _iban(key: bytes, s: str) -> str:
    """Country and grouping stay, the check digits follow from the rest."""
    at = [i for i, c in enumerate(s) if c.isalnum()]
    plain = "".join(s[i] for i in at)
    body = _permute(key, "iban|" + plain[:2], plain[4:], [_ASCII.get(c) for c in plain[4:]])
    check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2]) + "00") % 97
    chars = list(s)
    for i, c in zip(at, f"{plain[:2]}{check:02d}{body}", strict=True):
        chars[i] = c
    return "".join(chars)


@lru_cache(maxsize=64)
def _order(key: bytes, kind: tuple[str, str]) -> list[int]:
    n = len(_GIVEN[kind])
    rank = sorted(range(n), key=lambda i: hashlib.blake2b(f"{kind}|{i}".encode(), key=hashlib.sha256(key).digest()).digest())
    return [rank[(rank.index(i) + 1) % n] for i in range(n)]  # one cycle: nobody keeps a name


def _name(key: bytes, s: str) -> str:
    """A known given name becomes one of its gender and script, another word one of its letters' kinds."""
    at = _GIVEN_AT.get(s)
    if at:
        return _GIVEN[at[0]][_order(key, at[0])[at[1]]]
    return _permute(key, "name", s, [_CLASS.get(c) for c in s], lambda x: x not in _GIVEN_AT)


SURROGATE = {"email": _email, "ip": _ip, "ip6": _ip6, "number": _number, "secret": _secret, "access_key": _access_key, "token": _token, "mac": _mac, "iban": _iban, "name": _name}

_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9.-]+")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)")
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{3,39}(?![0-9A-Za-z:])")
_SECRET = re.compile(r"(?i)(?:password|passwd|(?<![a-z])pass|(?<![a-z])pwd|secret|token|api[_-]?key|access[_-]?key|(?<![a-z])auth)[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?P<v>[A-Za-z0-9+/_.~-]{6,}={0,2})|(?<![a-z])(?:bearer|basic)\s{1,3}(?P<w>(?=[A-Za-z+/_.~-]{0,64}[0-9])[A-Za-z0-9+/_.~-]{8,}={0,2})")
_ACCESS = re.compile(r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])")
_HEADS = ("gh[pousr]_", "github_pat_", "glpat-", "sk-", "[sr]k_live_", "xox[abprs]-", "AIza", "npm_", "hf_", "eyJ")
_TOKEN_HEAD = re.compile("|".join(_HEADS))
_TOKEN = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(_HEADS) + r")(?=[A-Za-z_.-]{0,64}[0-9])[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]+){0,2}")
_MAC = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")
#: Nine digits or more, alone or in groups that one separator each parts; and a number
#: of up to 19 among several that only a separator parts.
_NUMBER = re.compile(r"(?<![\d.])\+?\(?\d(?:[ ./()-]{0,2}\d){8,}(?!\d)")
_ONE_NUMBER = re.compile(r"(?<![\d.])\+?\(?\d(?:[ ./()-]{0,2}\d){8,18}(?!\d)")
_SHORT = re.compile(r"(?i)\b(?:call|phone|tel|telephone|fax|mobile|cell|dial|sms)\b[.:]?\s{0,3}(?:(?:me|us|at|on|number|no\.?|is)\s{1,3}){0,3}(?P<v>\+?\(?\d(?:[ ./()-]{0,2}\d){4,7})(?!\d)")
_DATE = re.compile(r"(?<!\d)(?<!\d[-/.])(?:(?:19|20)\d\d([-/.])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/.])(?:0?[1-9]|[12]\d|3[01])\2(?:19|20)\d\d)(?:[T ](?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d)?)?(?![-/.]?\d)")
_DIGIT = re.compile(r"\d")


def _one_script(s: str) -> bool:
    return s.isascii() or len({_digits_of(c) for c in s if c.isdecimal()}) == 1


def _valid_iban(s: str) -> bool:
    body = "".join(c for c in s if c.isalnum())
    return 15 <= len(body) <= 34 and int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1


def _numbers(text: str):
    """Spans of numbers, dates aside. What has more than 19 digits is cut where a shorter
    number begins or ends, so a card beside another stays a card; every part is a span."""
    text = _DATE.sub(lambda m: "\0" * len(m[0]), text)
    for m in _NUMBER.finditer(text):
        b, e = m.span()
        if sum(c.isdecimal() for c in m[0]) <= 19:
            yield b, e
            continue
        cuts = {b, e}
        for one in _ONE_NUMBER.finditer(text, b, e):
            cuts.update(one.span())
        cuts = sorted(cuts)
        for x, y in zip(cuts, cuts[1:], strict=False):
            while x < y and not text[x].isdecimal() and text[x] not in "+(":
                x += 1
            while x < y and not text[y - 1].isdecimal():
                y -= 1
            if x < y:
                yield x, y
    for m in _SHORT.finditer(text):
        yield m.span("v")


def _emails(text: str):
    """Spans of addresses, searched from each @ to both sides."""
    last, at = 0, text.find("@")
    while at >= 0:
        back = _LOCAL_BACK.match(text[last:at][::-1])
        begin = at - back.end() if back else at
        while begin < at and not text[begin].isalnum():
            begin += 1
        found = _DOMAIN.match(text, at + 1)
        end, labels, place = at + 1, 0, at + 1
        for label in found[0].split(".") if found else ():
            core = label.rstrip("-")
            if not core or core[0] == "-":
                break
            labels, end, place = labels + 1, place + len(core), place + len(label) + 1
            if core != label:
                break
        if begin < at and labels > 1:
            yield begin, end
            last = end
        else:
            last = at + 1
        at = text.find("@", last)


def _ip6s(text: str):
    for m in _IP6.finditer(text):
        if m[0].count(":") > 1:
            try:
                ipaddress.IPv6Address(m[0])
            except ValueError:
                continue
            if m[0].strip(":"):
                yield m.span()


def _bare(word: str) -> str:
    """A capitalised word without endings that are no part of the name."""
    while (m := _AFTER.search(word)) and not m[0][1].isupper() and any(p[:1].isupper() for p in _JOINT.split(word[: m.start()])):
        word = word[: m.start()]
    return word


def _name_words(text: str, at: int) -> list[tuple[int, int]]:
    """Spans of the capitalised words that follow a title up to ``at``, over particles and initials."""
    out: list[tuple[int, int]] = []
    initial = False  # the last word is one letter without a full stop
    while m := _NAME_WORD.match(text, at):
        b, e = m.span()
        if any(p[:1].isupper() for p in _JOINT.split(m[0])):
            e = b + len(_bare(m[0]))
            out.append((b, e))
        elif m[0] not in _PARTICLES:
            break
        at = m.end()
        initial = at - b == 1
        if initial and text[at : at + 1] == ".":
            at, initial = at + 1, False
            if _NAME_WORD.match(text, at):
                continue
        if e < m.end() or text[at : at + 1] != " ":
            break
        at += 1
    if initial and len(out) > 1:  # as in "Mr Smith I know"
        out.pop()
    return out


def _mentions(text: str, names: set[str]):
    """Spans of whole words that are one of these names, the longest at each place."""
    by_head: dict[str, list[str]] = {}
    for n in sorted(names, key=lambda n: (-len(n), n)):
        by_head.setdefault(_RUN.match(n)[0], []).append(n)
    for m in _RUN.finditer(text):
        for n in by_head.get(m[0], ()):
            e = m.start() + len(n)
            if text.startswith(n, m.start()) and not (e < len(text) and (text[e].isalnum() or text[e] == "_")) and not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_")):
                yield m.start(), e
                break


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans and types of entities, in order, without overlaps; earlier detectors win."""
    spans: list[tuple[int, int, str]] = []
    if "=" in text or ":" in text or _BEARER.search(text):
        spans += [(*m.span("v" if m["v"] else "w"), "secret") for m in _SECRET.finditer(text)]
    if "@" in text:
        spans += [(*at, "email") for at in _emails(text)]
    if "AKIA" in text or "ASIA" in text:
        spans += [(*m.span(), "access_key") for m in _ACCESS.finditer(text)]
    if _DIGIT.search(text):
        if _TOKEN_HEAD.search(text):
            spans += [(*m.span(), "token") for m in _TOKEN.finditer(text)]
        if "." in text:
            spans += [(*m.span(), "ip") for m in _IP.finditer(_ascii_digits(text)) if _one_script(text[slice(*m.span())])]
        spans += [(*m.span(), "mac") for m in _MAC.finditer(text)] if ":" in text or "-" in text else []
        spans += [(*at, "ip6") for at in _ip6s(text)] if ":" in text else []
        spans += [(*m.span(), "iban") for m in _IBAN.finditer(text) if _valid_iban(m[0])]
        spans += [(*at, "number") for at in _numbers(text)]
    runs = [_name_words(text, m.end()) for m in _TITLED.finditer(text)] if _ANY_TITLE.search(text) else []
    given = [_name_words(text, m.start()) for m in _GIVEN_FIRST.finditer(text) if m[1] in _GIVEN_AT]
    words = set()
    for run in runs + [r for r in given if len(r) > 1]:
        for b, e in run:
            spans.append((b, e, "name"))
            if e - b > 1:  # a lone letter is replaced in this place only
                words.add(text[b:e])
    if words:  # later and earlier mentions of the same person
        spans += [(*at, "name") for at in _mentions(text, words)]
    if len(spans) < 2:
        return spans
    taken, out = bytearray(len(text)), []
    for b, e, kind in spans:
        if taken.find(1, b, e) < 0:
            taken[b:e] = b"\1" * (e - b)
            out.append((b, e, kind))
    return sorted(out)


def replace(text: str, key: bytes) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (type, entity, surrogate) of each span."""
    spans = find(text)
    if not spans:
        return text, []
    out, at, made = [], 0, []
    for b, e, kind in spans:
        s = text[b:e]
        new = SURROGATE[kind](key, s)
        made.append((kind, s, new))
        out += [text[at:b], new]
        at = e
    return "".join([*out, text[at:]]), made


_SESSION: list[bytes] = []


def configured_key(spark: SparkSession) -> bytes:
    """The user's key, or one that this session draws."""
    own = spark.conf.get("spark.tidemark.pii.key", None) or os.environ.get("TIDEMARK_PII_KEY")
    if own:
        return own.encode()
    if not _SESSION:
        _SESSION.append(os.urandom(32))
    return _SESSION[0]


def _run(df: DataFrame, key: bytes | None, text: str, pairs: bool) -> DataFrame:
    """Adds ``__pii``: the new text, the number of replaced spans, and with ``pairs``
    keyed hashes of each distinct entity and its surrogate by type."""
    key = configured_key(df.sparkSession) if key is None else key
    pair = pa.list_(pa.struct([("type", pa.string()), ("entity", pa.binary()), ("surrogate", pa.binary())]))
    kind = pa.struct([("t", pa.string()), ("n", pa.int64()), ("pairs", pair)])
    short = lambda x: hashlib.blake2b(x.encode(), key=hashlib.sha256(key).digest(), digest_size=16).digest()

    @F.arrow_udf("t string, n long, pairs array<struct<type string, entity binary, surrogate binary>>")
    def run(col: pa.Array) -> pa.Array:
        claim("pii")
        rows = []
        for t in col.to_pylist():
            new, made = replace(t, key) if t else (t, [])
            found = [{"type": k, "entity": short(x), "surrogate": short(y)} for k, x, y in dict.fromkeys(made)] if pairs else []
            rows.append({"t": new, "n": len(made), "pairs": found})
        return pa.array(rows, kind)

    return df.withColumn("__pii", run(F.col(text)))


def _replaced(run: DataFrame, columns: list[str], text: str, count: str | None) -> DataFrame:
    own = [F.col("__pii.t").alias(text) if c == text else F.col(f"`{c}`") for c in columns if c != count]
    return run.select(*own, *([F.col("__pii.n").alias(count)] if count else []))


def pseudonymize(df: DataFrame, key: bytes | None = None, text: str = "text", count: str | None = None) -> DataFrame:
    """Replaces ``text``; with ``count``, adds the number of replaced spans."""
    return _replaced(_run(df, key, text, False), df.columns, text, count)


def checked(df: DataFrame, key: bytes | None = None, text: str = "text", count: str | None = None) -> DataFrame:
    """The same, written to the shared folder, after :func:`collisions` found none there;
    a collision is an error."""
    done = materialize(_run(df, key, text, True), "pii")
    found = collisions(done.select(F.explode("__pii.pairs").alias("e")).select("e.*"))
    if not found.isEmpty():
        raise ValueError("surrogates collide")
    return _replaced(done, df.columns, text, count)


def entities(df: DataFrame, key: bytes | None = None, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """``doc_id, type, entity, surrogate``, a row for each replaced span."""
    key = configured_key(df.sparkSession) if key is None else key

    @F.arrow_udf("array<struct<type string, entity string, surrogate string>>")
    def run(col: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("type", pa.string()), ("entity", pa.string()), ("surrogate", pa.string())]))
        return pa.array([[dict(zip(("type", "entity", "surrogate"), m, strict=True)) for m in replace(t, key)[1]] if t else [] for t in col.to_pylist()], kind)

    return df.select(F.col(doc).alias("doc_id"), F.explode(run(F.col(text))).alias("e")).select("doc_id", "e.*")


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates of a type that stand for two entities, entities with two surrogates, and
    entities that are their own: none."""
    pairs = found.select("type", "entity", "surrogate").distinct()
    one = pairs.groupBy("type", F.col("surrogate").alias("value")).agg(F.count("*").alias("n"))
    two = pairs.groupBy("type", F.col("entity").alias("value")).agg(F.count("*").alias("n"))
    own = pairs.where("entity = surrogate").select("type", F.col("entity").alias("value"), F.lit(2).cast("long").alias("n"))
    return one.unionByName(two).where("n > 1").unionByName(own)
