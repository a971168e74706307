"""PII surrogates: detected entities get keyed replacements of the same kind, script, gender and format. Replacement is a
keyed permutation of the values of one format, so different values stay different and equal ones equal, everywhere."""

from __future__ import annotations

import datetime
import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from webloom.llm.common import own_columns, small_batches, table

#: The key of the registered query; a real one comes from the caller.
DEMO_KEY = b"surrogates"

# Letters by kind: a letter is replaced by one of its own row and case. Fixed values.
LETTERS = [
    "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóú", "àèìòù", "âêîôû", "äëïöü", "ãõ", "çñ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "іїєґ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ", "אבגדהוזחטיכלמנסעפצקרשת", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
]
# Scripts whose letters are replaced within the whole run of their code points: first and last. Fixed values.
SCRIPTS = [("अ", "ह"), ("ก", "ฮ"), ("ぁ", "ゖ"), ("ァ", "ヺ"), ("一", "龥"), ("가", "힣"), ("Ա", "Ֆ"), ("ա", "ֆ"), ("ა", "ჰ")]
DIGITS = "0123456789"
# Given names by gender and script, replaced by another of their own list. Fixed values.
GIVEN = {
    "female latin": "Anna Maria Emma Julia Laura Sarah Alice Claire Sophie Elena Lucía Carmen Ingrid Greta Helena Martha Nora Olivia Paula Rosa Teresa Victoria Amélie Chloé",
    "male latin": "John James Peter Paul David Thomas Martin Hans Karl Otto Pierre Louis Hugo Carlos Diego Javier Miguel Henry Oscar Simon Walter Edward François Jürgen",
    "female cyrillic": "Анна Мария Елена Ольга Ирина Наталья Светлана Татьяна Юлия Екатерина",
    "male cyrillic": "Иван Пётр Алексей Дмитрий Николай Сергей Андрей Михаил Павел Виктор",
    "female greek": "Μαρία Ελένη Σοφία Άννα Κατερίνα",
    "male greek": "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης",
}
# Endings that tell a name's gender; they stay. Fixed values.
ENDINGS = ("ская", "ский", "ова", "ева", "ина", "ová", "ской", "ов", "ев", "ин", "ός", "ης", "ου", "ос")
# Titles before a name, with the gender they give it. Fixed values.
TITLES = {
    "male": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"],
    "female": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"],
    "": ["Dr", "Prof"],
}
TITLES["male"] += ["السيد", "מר", "श्री"]
TITLES["female"] += ["السيدة", "גברת", "श्रीमती"]
# Words with a capital that follow a title or given name and are no names: function words, ranks, programs. Fixed values.
NO_NAMES = frozenset("""the this that these those he she it they we you i a an and or but in on at of for to from with by as is was are were who when
der die das den dem ein eine und er sie es wir ist war le la les un une et il elle nous el los las una y o
president minister chairman chairwoman speaker secretary ambassador general judge mayor governor senator director professor doctor
word excel office windows right wrong wonderful perfect universe world big best new""".split())
# What names the person behind it, without a title. Fixed values.
CALLS = """my name is|name:|Name:|signed by|Sincerely,|Best regards,|Kind regards,|Dear|Mein Name ist|Liebe|Lieber|je m'appelle|Je m'appelle|me llamo|Me llamo|Querido|Querida|меня зовут|Меня зовут""".split("|")
# What stands before a date of birth. Fixed values.
BORN = r"born(?: on)?|DOB|[Dd]ate of [Bb]irth|[Bb]irth ?date|geboren(?: am)?|geb\.|Geburtsdatum|née? le|[Dd]ate de naissance|nacid[oa] el|[Ff]echa de nacimiento|родил(?:ся|ась)"
# Kinds of streets: after the name, as its ending, before it. Fixed values.
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Terrace"
STREET_ENDS = "straße|strasse|str\\.|weg|platz|allee|gasse"
STREET_HEADS = "rue|avenue|boulevard|place|Rue|Calle|Avenida|Plaza"

_GIVEN_LIST = {name: kind for kind, names in GIVEN.items() for name in names.split()}
_TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
#: A word that begins with a capital, or one of a script without capitals.
_MARKS = "\u0900-\u0903\u093a-\u094f"
_CAPITAL = rf"[^\W\d_a-zß-öø-ÿа-џα-ώա-ֆ](?:[^\W\d_]|[{_MARKS}])*"
_GAP = r"\W{1,5}?"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Kinds of entities, the first that matches at a place counts. Signs stuck to the parts of a number do not hide it.
KINDS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9]{20,64}\b|\bxox[abprs]-[A-Za-z0-9-]{10,72}\b|\bAIza[A-Za-z0-9_-]{35}(?![\w-])",
    "secret": r"\b(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d)",
    "ipv6": rf"(?<![\w:.])(?:{_HEX}(?::{_HEX}){{7}}|(?:{_HEX}(?::{_HEX}){{0,5}})?::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\w:])",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": rf"\+\d{{1,3}}{_GAP}\d{{2,4}}{_GAP}\d{{3}}{_GAP}\d{{3,4}}(?!\d)|\(\d{{3}}\){_GAP}\d{{3}}{_GAP}\d{{4}}(?!\d)|\+\d{{8,15}}(?!\d)|(?<![\w.-])\d{{3}}([-.])\d{{3}}\1\d{{4}}(?![\w-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "birth": rf"(?:\b(?:{BORN})\W{{1,3}})(?P<date>\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}})(?!\d)",
    "street": rf"(?<![\w.])\d{{1,5}} (?:{_CAPITAL} ){{1,2}}(?:{STREETS})\b|\b{_CAPITAL}(?:{STREET_ENDS}) \d{{1,4}}(?!\d)|(?<![\w.])\d{{1,4}},? (?:{STREET_HEADS}) (?:de la |de |du |des )?{_CAPITAL}|\b(?:{STREET_HEADS}) (?:de la |de |del )?{_CAPITAL},? \d{{1,4}}(?!\d)",
    "name": rf"(?<!\w)(?:{'|'.join(_TITLE_GENDER)})(?!\w)\.? {_CAPITAL}(?: {_CAPITAL})?|\b(?:{'|'.join(_GIVEN_LIST)}) {_CAPITAL}|(?:{'|'.join(CALLS)}) (?P<called>{_CAPITAL} {_CAPITAL})",
}
_ENTITY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()).replace(r"\1", "(?P=sep)").replace("([-.])", "(?P<sep>[-.])"))
#: Texts without any of these hold no entity; the search for them is quicker than the patterns.
_MAYBE = re.compile(rf"@|\d{{3}}|\d\.\d|[0-9a-fA-F]{{32}}|:[0-9a-fA-F]{{0,4}}:|(?<!\w)(?:{'|'.join([*_TITLE_GENDER, *_GIVEN_LIST])})(?!\w)|AKIA|ASIA|gh[pousr]_|sk-|xox|AIza|{'|'.join(CALLS)}|\d (?:{_CAPITAL} ){{1,2}}(?:{STREETS})\b|(?:{STREET_ENDS}|{STREET_HEADS}) \w")


def _digest(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.digest(key, "\x1f".join(map(str, parts)).encode(), "sha256")[:16], "big")


def permute(key: bytes, tweak: str, value: int, size: int) -> int:
    """The value after ``value`` on a keyed cycle through all of ``range(size)``: one-to-one, and never the value itself unless it is the only one.
    The cycle's order is a Feistel network over the next even number of bits, walked until within."""
    place = _walk(key, tweak, value, size, back=True)
    return _walk(key, tweak, (place + 1) % size, size, back=False)


def _walk(key: bytes, tweak: str, value: int, size: int, back: bool) -> int:
    half = max(1, (size - 1).bit_length() + 1 >> 1)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for turn in reversed(range(6)) if back else range(6):
            if back:
                left, right = right ^ (_wide(key, tweak, turn, left, half) & mask), left
            else:
                left, right = right, left ^ (_wide(key, tweak, turn, right, half) & mask)
        value = left << half | right
        if value < size:
            return value


def _wide(key: bytes, tweak: str, turn: int, value: int, bits: int) -> int:
    out, n = 0, 0
    while n * 128 < bits:
        out = out << 128 | _digest(key, tweak, turn, n, value)
        n += 1
    return out


_ROW = {c: row for row in LETTERS for c in row} | {c: DIGITS for c in DIGITS}


class _Run(str):
    """All characters between two, as a row of letters that finds a place without a search."""

    def index(self, c: str) -> int:  # noqa: D102
        return ord(c) - ord(self[0])


_RUNS = [_Run("".join(map(chr, range(ord(a), ord(z) + 1)))) for a, z in SCRIPTS]


def _row(c: str) -> str:
    return _ROW.get(c) or next((run for run in _RUNS if run[0] <= c <= run[-1]), "")


def _keep_format(key: bytes, tweak: str, text: str) -> str:
    """``text`` with every letter and digit replaced by one of its own kind, script and case, all else as it is. One-to-one, and other than ``text`` if
    it has any letter or digit that has others of its kind."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    rows = [_row(c) for c in low]
    shape = "".join(row[0] if row else c for c, row in zip(low, rows, strict=True))
    size, value = 1, 0
    for c, row in zip(low, rows, strict=True):
        if row:
            value = value * len(row) + row.index(c)
            size *= len(row)
    value = permute(key, f"{tweak}:{shape}", value, size) if size > 1 else 0
    out = []
    for c, old, row in zip(reversed(low), reversed(text), reversed(rows), strict=True):
        if row:
            value, k = divmod(value, len(row))
            c = row[k]
        out.append(c.upper() if old != old.lower() and old == old.upper() else c)
    return "".join(reversed(out))


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def _numbers(key: bytes, kind: str, text: str, fixed: int) -> str:
    """New digits in the old layout, but for the first ``fixed``; a card's go on passing the Luhn check."""
    digits = re.sub(r"\D", "", text)
    head, rest = digits[:fixed], digits[fixed:]
    new = rest
    # A phone number is the same person's with and without its country's code.
    of = "" if kind == "phone" else head
    while True:
        new = f"{permute(key, f'{kind}:{of}:{len(rest)}', int(new), 10 ** len(rest)):0{len(rest)}}"
        if kind != "card" or _luhn(head + new):
            break
    fresh = iter(head + new)
    return re.sub(r"\d", lambda _: next(fresh), text)


def _ip(key: bytes, text: str) -> str:
    """Another address of its first octet's kind: none, private ten, loopback, multicast and up, or any other."""
    octets = [int(x) for x in text.split(".")]
    kind = lambda a: (a in (0, 10, 127), a if a in (0, 10, 127) else a >= 224)
    value = int.from_bytes(bytes(octets), "big")
    while True:
        value = permute(key, "ip", value, 2**32)
        out = value.to_bytes(4, "big")
        if kind(out[0]) == kind(octets[0]):
            return ".".join(map(str, out))


def _iban_left(text: str) -> int:
    """An account number's remainder, 1 for a valid one."""
    compact = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def _iban(key: bytes, text: str) -> str:
    """Another of the country and format; a valid one gets the check digits that its new account has."""
    if _iban_left(text) == 1:
        new = _keep_format(key, "iban", text[4:])
        return f"{text[:2]}{98 - _iban_left(text[:2] + '00' + new):02}{new}"
    new = text
    while True:
        new = text[:2] + _keep_format(key, "iban!", new[2:])
        if _iban_left(new) != 1:
            return new


def _tail(word: str) -> str:
    """The ending that tells a name's gender."""
    tail = next((e for e in ENDINGS if len(word) > len(e) + 1 and word.endswith(e)), "")
    return tail or (word[-1] if len(word) > 2 and word[-1].lower() in "aeoаяαη" else "")


def _word(key: bytes, tweak: str, word: str) -> str:
    """A name outside the lists, in its own script and format, with the ending that tells its gender; never one that the lists use as a surrogate. Names of one
    ending are permuted among themselves: a step that leaves them is followed by the next, until it is back among them."""
    tail = _tail(word)
    while True:
        word = _keep_format(key, f"{tweak}:{tail}", word[: len(word) - len(tail)]) + tail
        if word not in _GIVEN_LIST and _tail(word) == tail:
            return word


@lru_cache(maxsize=64)
def _cycle(key: bytes, kind: str) -> dict[str, str]:
    """Every name of a list and the one that replaces it: the next in a keyed order, so that none replaces itself."""
    names = sorted(GIVEN[kind].split(), key=lambda n: _digest(key, kind, n))
    return dict(zip(names, names[1:] + names[:1], strict=True))


def _given(key: bytes, name: str) -> str:
    kind = _GIVEN_LIST.get(name)
    return _word(key, "given", name) if kind is None else _cycle(key, kind)[name]


def _surname(key: bytes, name: str) -> str:
    return _given(key, name) if name in _GIVEN_LIST else _word(key, "surname", name)


def _name_parts(key: bytes, text: str) -> list[tuple[str, str]]:
    """The words of a name with their replacements; a title stays."""
    words = text.split(" ")
    parts = [(words[0], words[0])] if words[0].rstrip(".") in _TITLE_GENDER else []
    own = words[len(parts) :]
    return parts + [(w, _given(key, w)) for w in own[:-1]] + [(own[-1], _surname(key, own[-1]))]


def _name(key: bytes, text: str) -> str:
    return " ".join(new for _, new in _name_parts(key, text))


def _shape(text: str) -> tuple:
    """What a date's surrogate keeps: order, signs and how many digits each part has; a date that two orders allow stays one."""
    parts = re.split(r"\D", text)
    both = "/" in text and max(int(parts[0]), int(parts[1])) <= 12
    return *map(len, parts), "/" in text and int(parts[1]) > 12, both, *("0" == p[0] for p in parts)


def _date_parts(text: str) -> tuple[int, int, int]:
    a, b, c = map(int, re.split(r"\D", text))
    return (a, b, c) if a > 31 else (c, a, b) if "/" in text and b > 12 else (c, b, a)


def _birth(key: bytes, text: str) -> str:
    """Another day of the years 1900 to 2029, written alike; what is no such day gets other digits that are none either."""
    first, last = datetime.date(1900, 1, 1).toordinal(), datetime.date(2030, 1, 1).toordinal()
    year, month, day = _date_parts(text)
    shape = _shape(text)
    try:
        place = datetime.date(year, month, day).toordinal() - first
    except ValueError:
        place = -1
    if not 0 <= place < last - first:
        return _numbers(key, "birth!", text, 0)
    sign = re.search(r"\D", text)[0]
    while True:
        place = permute(key, "birth", place, last - first)
        d = datetime.date.fromordinal(first + place)
        order = (d.year, d.month, d.day) if shape[0] == 4 else (d.month, d.day, d.year) if shape[3] else (d.day, d.month, d.year)
        out = sign.join(f"{v:0{n}}" for v, n in zip(order, shape[:3], strict=True))
        if _shape(out) == shape:
            return out


def _street(key: bytes, text: str) -> str:
    """Another house number of as many digits, and other words for the street's name; what kind of street it is stays."""
    def other(m: re.Match) -> str:
        word = m[0]
        if word.isdigit():
            low = 10 ** (len(word) - 1) if word[0] != "0" else 0
            return f"{low + permute(key, f'house:{low}', int(word) - low, 10 ** len(word) - low):0{len(word)}}"
        end = re.search(rf"(?:{STREET_ENDS})$", word)
        own = word[: end.start()] if end else word
        kept = re.fullmatch(rf"{STREETS}|{STREET_HEADS}|de|du|des|del|la", word)
        return word if kept or not own else _keep_format(key, "street", own) + word[len(own) :]

    return re.sub(r"[^\W_]+\.?" if re.search(r"str\.", text) else r"[^\W_]+", other, text)


def _ipv6(key: bytes, text: str) -> str:
    """Another address written alike; its first group stays, which tells the kind of network."""
    first = re.match(r"[0-9A-Fa-f]{0,4}", text)[0]
    rest = text[len(first) :]
    digits = re.sub("[^0-9A-Fa-f]", "", rest)
    if not digits:
        return text
    large = text != text.lower()
    new = iter(f"{permute(key, f'ipv6:{first.lower()}:' + re.sub('[0-9A-Fa-f]', 'x', rest), int(digits, 16), 16 ** len(digits)):0{len(digits)}x}")
    out = re.sub("[0-9A-Fa-f]", lambda _: next(new), rest)
    return first + (out.upper() if large else out)


def _key(key: bytes, text: str) -> str:
    """An access key of the same issuer: its prefix stays, capitals, small letters and digits are replaced by their like."""
    prefix = re.match(r"AKIA|ASIA|gh._|sk-|xox.-|AIza", text)[0]
    rest = text[len(prefix) :]
    kinds = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", DIGITS)
    rows = [next((k for k in kinds if c in k), "") for c in rest]
    size, value = 1, 0
    for c, row in zip(rest, rows, strict=True):
        if row:
            value, size = value * len(row) + row.index(c), size * len(row)
    value = permute(key, f"key:{prefix}:" + "".join(row[0] if row else c for c, row in zip(rest, rows, strict=True)), value, size)
    out = []
    for c, row in zip(reversed(rest), reversed(rows), strict=True):
        if row:
            value, k = divmod(value, len(row))
            c = row[k]
        out.append(c)
    return prefix + "".join(reversed(out))


def _email(key: bytes, text: str) -> str:
    """A new mailbox in a new domain, the same one for all its mailboxes; the top level and reserved example domains stay."""
    box, _, domain = text.rpartition("@")
    labels = domain.split(".")
    keep = 2 if len(labels) > 1 and labels[-2].lower() == "example" else 1
    own, tail = ".".join(labels[:-keep]), ".".join(labels[-keep:])
    new = _keep_format(key, f"domain:{tail.lower()}", own) + "." if own else ""
    return f"{_keep_format(key, f'mailbox:{domain.lower()}', box)}@{new}{tail}"


@lru_cache(maxsize=100_000)
def surrogate(key: bytes, kind: str, text: str) -> str:
    """The replacement of an entity as it stands in a text."""
    if kind == "email":
        return _email(key, text)
    if kind == "secret":
        row = "0123456789abcdef"
        value = permute(key, f"secret:{len(text)}", int(text, 16), 16 ** len(text))
        out = "".join(row[value >> 4 * k & 15] for k in reversed(range(len(text))))
        return out.upper() if text.upper() == text and text.lower() != text else out
    if kind == "ip":
        return _ip(key, text)
    if kind == "ipv6":
        return _ipv6(key, text)
    if kind == "key":
        return _key(key, text)
    if kind == "card":
        return _numbers(key, kind, text, 1)
    if kind == "phone":
        code = re.match(r"\+(\d{1,3})\b", text)
        return _numbers(key, kind, text, len(code[1]) if code and len(code[1]) < 4 else 0)
    if kind == "ssn":
        return _numbers(key, kind, text, 0)
    if kind == "iban":
        return _iban(key, text)
    if kind == "birth":
        return _birth(key, text)
    if kind == "street":
        return _street(key, text)
    return _name(key, text)


def _holds(kind: str, text: str) -> bool:
    """Whether what looks like an entity is one: numbers with a check digit have to pass it, addresses to parse."""
    if kind == "card":
        return _luhn(re.sub(r"\D", "", text))
    if kind == "ipv6":
        try:
            return int(ipaddress.IPv6Address(text)) > 1 and sum(c not in ":" for c in text) > 2 and any(map(str.isdigit, text))
        except ValueError:
            return False
    return True


def _without_words(name: str, text: str) -> str:
    """A found name without what is no name at its end: words that stand in NO_NAMES or in small letters in the same text. Empty if no name is left."""
    words = name.split(" ")
    titled = words[0].rstrip(".") in _TITLE_GENDER
    for k, word in enumerate(words[titled:], titled):
        low = word.lower()
        if low in NO_NAMES or (low != word and word not in _GIVEN_LIST and re.search(rf"(?<!\w){re.escape(low)}(?!\w)", text)):
            words = words[:k]
            break
    return " ".join(words) if len(words) > 1 else ""


def replace(key: bytes, text: str | None) -> tuple[str | None, list[tuple[str, int, int, str, str]]]:
    """The text with surrogates, and per entity its kind, span in the given text, value and surrogate. A name that is found once is
    known in all of its text: its parts are replaced wherever they stand alone."""
    if not text or not _MAYBE.search(text):
        return text, []
    found, known, at = [], {}, 0
    while m := _ENTITY.search(text, at):
        at = m.end()
        kind = m.lastgroup if m.lastgroup != "sep" else "phone"
        # Of a phrase that names a person or a day, those alone.
        start, stop = next((m.span(part) for part in ("date", "called") if m[part] is not None), m.span())
        if kind == "name":
            stop = start + len(_without_words(text[start:stop], text))
            # What was no name may still hold the beginning of something else.
            at = max(stop, start + 1) if stop < m.end() else at
        value = text[start:stop]
        if value and _holds(kind, value):
            found.append((kind, start, stop, value, surrogate(key, kind, value)))
            if kind == "name":
                known |= {old: new for old, new in _name_parts(key, value) if old != new}
    if known:
        # Scripts that part no words have no borders to ask for.
        bounded = [re.escape(n) if isinstance(_row(n[0]), _Run) else rf"\b{re.escape(n)}\b" for n in sorted(known, key=len, reverse=True)]
        alone = re.compile("|".join(bounded))
        taken, at = [], 0
        for kind, start, end, value, new in [*found, ("", len(text), len(text), "", "")]:
            taken += [("name", at + m.start(), at + m.end(), m[0], known[m[0]]) for m in alone.finditer(text[at:start])]
            if kind:
                taken.append((kind, start, end, value, new))
            at = end
        found = taken
    out, at = [], 0
    for _, start, end, _, new in found:
        out += [text[at:start], new]
        at = end
    return ("".join(out) + text[at:], found) if found else (text, [])


def fingerprint_of(key: bytes, value: str) -> str:
    """A keyed hash of a value, to compare values without showing them."""
    return hmac.new(key, value.encode(), hashlib.sha256).hexdigest()[:16]


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """Replaces every detected entity of every whole text by its surrogate.

    Under one key an entity has one surrogate in all documents, other than itself, and two entities of a kind and format never share one: each
    replacement is a one-to-one step through the values of that format, so that no table of entities is gathered and any executor can do it again.
    ``colliding_surrogates`` checks that over a table. Names keep title, script and gender; the parts of a name are the same for one person under
    any title, also where they stand alone in that text; common words behind a title are no names. Phone numbers are one with and without a country's code. Cards have to pass their check digit. Null doc_id: as it is. Null text: null. Empty text or none found: as it is. Very long text: whole. Repeated rows: alike. Empty
    table: no rows. Returns all columns with ``text`` replaced, and n_entities and entities (kind, start, end, original, surrogate), of which the last is
    for audits only; those two names are overwritten.
    """
    docs = small_batches(docs).select(*own_columns(docs, ("n_entities", "entities")))
    place = docs.columns.index("text")
    entity = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("original", pa.string()), ("surrogate", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [replace(key, t) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array([t for t, _ in done], pa.string())
            found = [[dict(zip(entity.names, e, strict=True)) for e in es] for _, es in done]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([len(es) for es in found], pa.int64()), pa.array(found, pa.list_(entity))], names=[*batch.schema.names, "n_entities", "entities"]
            )

    more = StructType.fromDDL("n_entities bigint, entities array<struct<kind:string,start:bigint,end:bigint,original:string,surrogate:string>>")
    return docs.mapInArrow(run, StructType(docs.schema.fields + more.fields))


def colliding_surrogates(replaced: DataFrame) -> DataFrame:
    """(kind, surrogate, n) of surrogates that stand for more than one value: none, unless the rule above is broken. Counted on both
    sides of a shuffle, so that a value found everywhere is no skew."""
    pairs = replaced.select(F.explode("entities").alias("e")).select("e.kind", "e.original", "e.surrogate").distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in its text."""
    return pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY).select("doc_id", "text", "n_entities")
