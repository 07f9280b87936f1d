"""Surrogates for personal data and secrets.

Each entity is read as a number in the space of all entities of its type and format: its template says which characters
stay and which alphabet every other one is from. A keyed permutation of that space, conjugated with a step of one, gives
the surrogate: the same entity always has the same surrogate (coreference), two entities never share one (distinctness),
and none is its own; this holds across a corpus of any size without a table of what has been seen, and whoever has the
key can turn it back. A given name of the lists becomes another of its gender and script; any other word of a name keeps
its length, its pattern of vowels and consonants, and its ending, which tells gender where the title doesn't.

The map is one for the whole corpus and never gives way within a document. Where a document has the surrogate of one of its
names as a word of its own, that word is taken for a name too and gets its own surrogate, so that after the change the
surrogate stands for one name only there. ``collisions`` checks a corpus's replacements.
"""

from __future__ import annotations

import re
import secrets
import unicodedata
import warnings
from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from hashlib import blake2b
from math import isqrt
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS, HEX, LOWER, UPPER = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ACCENTED = "àáâãäåæçèéêëìíîï"
#: Titles before a name, by the gender they tell; those in neither tell none.
FEMININE = {"Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Госпожа"}
MASCULINE = {"Mr", "Herr", "Monsieur", "Señor", "Господин"}
NEUTRAL = {"Dr", "Prof"}
TITLES = sorted(FEMININE | MASCULINE | NEUTRAL)
#: Given names that tell a name without a title if a capitalised word follows. Those that are as often a word, a month or a
#: place (Mark, Grace, April, Virginia, Paris) are left out.
GIVEN_FEMININE = frozenset(
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Margaret Sandra Ashley Kimberly Emily Donna Michelle "
    "Carol Amanda Dorothy Melissa Deborah Stephanie Rebecca Sharon Laura Cynthia Kathleen Amy Angela Shirley Anna Brenda Pamela Emma Nicole Helen "
    "Samantha Katherine Christine Debra Rachel Carolyn Janet Catherine Maria Heather Diane Ruth Julie Olivia Joyce Virginie Kelly Christina Joan Evelyn "
    "Lauren Judith Megan Andrea Cheryl Hannah Jacqueline Martha Gloria Teresa Ann Anne Sara Madison Frances Kathryn Janice Jean Abigail Alice Julia Judy "
    "Sophie Sophia Isabella Denise Amber Doris Marilyn Danielle Beverly Theresa Diana Brittany Natalie Kayla Alexis Lori Jane Claire Camille Chloé Manon "
    "Léa Amélie Élodie Céline Nathalie Isabelle Sylvie Françoise Monique Hélène Aurélie Margaux Ursula Sabine Petra Monika Renate Brigitte Ingrid Heike "
    "Katharina Greta Lena Anja Birgit Silke Ute Gisela Carmen Josefa Isabel Dolores Pilar Lucía Sofía Elena Marta Cristina Beatriz Rocío Inés Giulia "
    "Francesca Chiara Alessandra Valentina Fatima Aisha Priya Ananya Yuki Sakura Olga Tatiana Natalia Svetlana Irina Ekaterina "
    "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Анастасия Дарья Людмила Галина Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Αγγελική".split()
)
GIVEN_MASCULINE = frozenset(
    "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Donald Steven Paul Andrew Joshua Kenneth "
    "Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel "
    "Gregory Frank Alexander Raymond Patrick Jack Dennis Jerry Tyler Aaron Jose Adam Henry Nathan Douglas Zachary Peter Kyle Walter Ethan Jeremy Harold "
    "Keith Christian Roger Noah Gerald Carl Terry Sean Austen Arthur Lawrence Jesse Dylan Bryan Joe Jordan Billy Bruce Albert Willie Gabriel Logan Alan "
    "Juan Wayne Roy Ralph Randy Eugene Vincent Russell Louis Philip Bobby Johnny Bradley Pierre Michel Jacques Philippe François Antoine Julien Nicolas "
    "Laurent Étienne Olivier Hans Klaus Jürgen Günter Wolfgang Dieter Manfred Uwe Heinz Stefan Andreas Matthias Thorsten Karl Friedrich Heinrich Otto "
    "José Carlos Luis Javier Miguel Antonio Francisco Manuel Pedro Diego Alejandro Fernando Sergio Pablo Jorge Marco Giovanni Giuseppe Luca Alessandro "
    "Mohammed Muhammad Ahmed Ali Omar Hassan Rahul Arjun Hiroshi Kenji Ivan Dmitri Sergei Vladimir Alexei Mikhail Nikolai Boris "
    "Иван Александр Сергей Дмитрий Алексей Андрей Михаил Владимир Николай Павел Юрий Борис Олег Виктор Γιώργος Δημήτρης Κωνσταντίνος Νίκος Ιωάννης".split()
)
#: Letters of names by script: vowels and consonants, plain and accented, each in order; other letters stay.
LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâäèéêëìíîïòóôöùúûü", "çćčłńñśšźžß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ")
_LETTERS = {c: letters for letters in LETTERS for c in letters}
#: Given names by gender and script, in order; a word's list and its place there.
_GIVEN_LISTS = [
    sorted(n for n in names if unicodedata.name(n[0]).startswith(script)) for names in (GIVEN_FEMININE, GIVEN_MASCULINE) for script in ("LATIN", "CYRILLIC", "GREEK")
]
_GIVEN = {n: (k, i) for k, names in enumerate(_GIVEN_LISTS) for i, n in enumerate(names)}


_BETWEEN = regex.compile(r"(\s+|-|['’]s(?!\p{L}))")


class Permutation:
    """A keyed bijection of range(size) without fixed points (for size of 2 or more): an alternating Feistel network
    over two moduli, walked until it falls into range, as the change of names of a step of one."""

    ROUNDS = 8

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.a = isqrt(max(size - 1, 0)) + 1
        self.b = -(-size // self.a)
        self.key = blake2b(tweak.encode("utf-8", "surrogatepass"), key=key[:64], digest_size=32).digest()

    def _noise(self, k: int, value: int) -> int:
        width = max(16, (self.size.bit_length() + 7) // 8 + 8)
        out = b"".join(blake2b(b"%d:%d:%d" % (k, i, value), key=self.key, digest_size=64).digest() for i in range(-(-width // 64)))
        return int.from_bytes(out[:width], "big")

    def _forth(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for k in range(self.ROUNDS):
            if k % 2:
                right = (right + self._noise(k, left)) % self.b
            else:
                left = (left + self._noise(k, right)) % self.a
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for k in reversed(range(self.ROUNDS)):
            if k % 2:
                right = (right - self._noise(k, left)) % self.b
            else:
                left = (left - self._noise(k, right)) % self.a
        return left * self.b + right

    def _walk(self, step: Callable[[int], int], x: int) -> int:
        x = step(x)
        while x >= self.size:
            x = step(x)
        return x

    def __call__(self, x: int, step: int = 1) -> int:
        """step -1 gives back what 1 made."""
        if self.size < 2:
            return x
        return self._walk(self._back, (self._walk(self._forth, x) + step) % self.size)


class Key(NamedTuple):
    value: bytes
    step: int = 1


_permutation = lru_cache(maxsize=4096)(Permutation)


def _permuted(key: Key, kind: str, text: str, alphabets: list[str | None], ok: Callable[[str], bool] | None = None) -> str:
    """text with each character that has an alphabet changed, all together. Of texts that are ok, which text itself is,
    each becomes another: those between are passed by."""
    new = _changed(key, kind, text, alphabets)
    while ok is not None and not ok(new):
        new = _changed(key, kind, new, alphabets)
    return new


def _changed(key: Key, kind: str, text: str, alphabets: list[str | None]) -> str:
    size, x = 1, 0
    for c, letters in zip(text, alphabets, strict=True):
        if letters:
            size, x = size * len(letters), x * len(letters) + letters.index(c)
    template = "\0".join(letters or "=" + c for c, letters in zip(text, alphabets, strict=True))
    y = _permutation(key.value, f"{kind}\1{template}", size)(x, key.step)
    out = []
    for c, letters in zip(reversed(text), reversed(alphabets), strict=True):
        if letters:
            y, k = divmod(y, len(letters))
            c = letters[k]
        out.append(c)
    return "".join(reversed(out))


def _is_hex(text: str) -> bool:
    return re.fullmatch(r"[0-9a-f]*", text) is not None and re.search("[0-9]", text) is not None


def _classes(text: str) -> list[str | None]:
    if _is_hex(text):
        return [HEX] * len(text)
    return [next((a for a in (DIGITS, LOWER, UPPER) if c in a), None) for c in text]


def _same_case(old: str, new: str) -> str:
    return "".join(n.upper() if o.isupper() else n for o, n in zip(old, new, strict=True))


def luhn(digits: str) -> bool:
    return _check_digit(digits[:-1]) == digits[-1]


def _check_digit(payload: str) -> str:
    total = sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(payload))))
    return str(-total % 10)


def email(key: Key, m) -> str:
    """The local part and the domain apart, so that addresses of a domain keep one; reserved and top-level labels stay."""
    local, domain = m[0].rsplit("@", 1)
    small = local.lower() if len(local.lower()) == len(local) else local
    if not local.isascii():
        local = _accented(key, small)
    else:
        local = _same_case(local, _permuted(key, "local", small, [DIGITS if c in DIGITS else LOWER if c in LOWER else None for c in small]))
    low = domain.lower() if len(domain.lower()) == len(domain) else domain
    labels = low.split(".")
    stay = 2 if re.search(r"(^|\.)example\.(com|net|org)$", low) and len(labels) > 2 else 1
    head = ".".join(labels[:-stay])
    head = _permuted(key, "domain", head, [DIGITS if c in DIGITS else LOWER if c in LOWER else None for c in head])
    return f"{local}@{_same_case(domain, '.'.join([head, *labels[-stay:]]))}"


def _accented(key: Key, local: str) -> str:
    """A local part with letters beyond ASCII is spelled anew from its bytes, in letters that no other local part gets."""
    number = int.from_bytes(b"\1" + local.encode("utf-8", "surrogatepass"), "big")
    top = 1 << (number.bit_length() - 1)
    number = top + _permutation(key.value, f"accented{number.bit_length()}", top)(number - top, key.step)
    return "".join(ACCENTED[int(c, 16)] for c in f"{number:x}")


def ipv4(key: Key, m) -> str:
    parts = [int(x) for x in m[0].split(".")]
    low = [0 if x < 10 else 10 if x < 100 else 100 for x in parts]
    many = [10 if x < 10 else 90 if x < 100 else 156 for x in parts]
    size, x = 1, 0
    for p, lo, n in zip(parts, low, many, strict=True):
        size, x = size * n, x * n + p - lo
    y = _permutation(key.value, f"ipv4{low}", size)(x, key.step)
    out = []
    for lo, n in zip(reversed(low), reversed(many), strict=True):
        y, k = divmod(y, n)
        out.append(str(lo + k))
    return ".".join(reversed(out))


def ipv6(key: Key, m) -> str:
    """Groups keep their lengths, :: its place, and a tail written as IPv4 stays one."""
    at = m[0].rindex(":") + 1 if "." in m[0] else len(m[0])
    head, tail = m[0][:at], m[0][at:]
    small = head.lower()
    head = _same_case(head, _permuted(key, "ipv6", small, [HEX if c in HEX else None for c in small]))
    return head + (ipv4(key, {0: tail}) if tail else "")


def card(key: Key, m) -> str:
    """The first digit stays; the check digit is right if, and only if, it was."""
    digits = re.sub(r"\D", "", m[0])
    checked = luhn(digits)
    new = iter(_permuted(key, "card", digits, [None, *[DIGITS] * (len(digits) - 1)], lambda x: luhn(x) == checked))
    return "".join(next(new) if c.isdigit() else c for c in m[0])


def phone(key: Key, m) -> str:
    """The country code stays, and so do places of a nonzero first digit; numbers are one whatever divides them."""
    text = m[0]
    start = re.match(r"\+\d{1,3}(?=\D)|[A-Za-z][^\d+(]*", text)
    start = start.end() if start else 0
    digits = re.sub(r"\D", "", text[start:])
    first = DIGITS[1:] if digits[0] != "0" else None
    new = iter(_permuted(key, f"phone{text[:start]}", digits, [first, *[DIGITS] * (len(digits) - 1)]))
    return text[:start] + "".join(next(new) if c.isdigit() else c for c in text[start:])


def ssn(key: Key, m) -> str:
    return _permuted(key, "ssn", m[0], [DIGITS if c.isdigit() else None for c in m[0]])


def iban(key: Key, m) -> str:
    """The country stays, and the check digits are right if they were; spaces don't matter."""
    whole = m[0].replace(" ", "")
    country, given, old = whole[:2], int(whole[2:4]), whole[4:]
    body = _permuted(key, f"iban{country}", old, _plain(old))
    # how far the check digits are from right ones stays: other digits of one account number are other entities
    new = iter(f"{country}{(given - _iban_check(country, old) + _iban_check(country, body)) % 100:02d}{body}")
    return "".join(next(new) if c != " " else c for c in m[0])


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _plain(text: str) -> list[str | None]:
    return [DIGITS if c in DIGITS else UPPER if c in UPPER else None for c in text]


def cloud_key(key: Key, m) -> str:
    return m[0][:4] + _permuted(key, "cloud", m[0][4:], [UPPER if c in UPPER else DIGITS for c in m[0][4:]])


def secret(key: Key, m) -> str:
    return m["lead"] + _permuted(key, "secret", m["secret"], _classes(m["secret"]), _like(m["secret"]))


def _like(text: str) -> Callable[[str], bool]:
    kind = _is_hex(text)
    return lambda x: _is_hex(x) == kind


def hexadecimal(key: Key, m) -> str:
    """Digits in one case are one number; in mixed case each letter keeps its case, and each digit stays one."""
    text, small = m[0], m[0].lower()
    if text not in (small, text.upper()):
        return _permuted(key, "mixed", text, [next(a for a in (DIGITS, "abcdef", "ABCDEF") if c in a) for c in text])
    return _same_case_all(text, _permuted(key, "secret", small, _classes(small), _mixed_hex))


def _same_case_all(old: str, new: str) -> str:
    return new.upper() if old == old.upper() else new


def _mixed_hex(text: str) -> bool:
    return _is_hex(text) and re.search("[a-f]", text) is not None


def token(key: Key, m) -> str:
    """What tells the kind of token stays, and so do its dots, dashes and lengths."""
    return m["fixed"] + _permuted(key, f"token{m['fixed']}", m["free"], _each(m["free"]))


def private_key(key: Key, m) -> str:
    """The lines around the key stay, and its line breaks and padding."""
    return m["begin"] + _permuted(key, "private", m["body"], _each(m["body"])) + m["end"]


def mac(key: Key, m) -> str:
    small = m[0].lower()
    if m[0] not in (small, m[0].upper()):
        return _permuted(key, "mixed mac", m[0], [next((a for a in (DIGITS, "abcdef", "ABCDEF") if c in a), None) for c in m[0]])
    return _same_case_all(m[0], _permuted(key, "mac", small, [HEX if c in HEX else None for c in small]))


def _each(text: str) -> list[str | None]:
    return [next((a for a in (DIGITS, LOWER, UPPER) if c in a), None) for c in text]


def name(key: Key, m) -> str:
    """The title stays."""
    return m["before"] + "".join(new for _, new in _named(key, m["name"]))


def person(key: Key, m) -> str:
    return "".join(new for _, new in _named(key, m["person"]))


def _named(key: Key, text: str) -> list[tuple[str, str]]:
    """The words of a name and what stands between them, each with what replaces it; an ending 's is none of the name."""
    return [(w, w if k % 2 or not w else name_word(key, w)) for k, w in enumerate(_BETWEEN.split(text))]


def name_word(key: Key, word: str) -> str:
    """A word has one surrogate, wherever in a name it stands and whatever title is before it."""
    given = word[:1] + word[1:].lower() if word.isupper() and len(word) > 1 else word
    if given in _GIVEN:
        k, i = _GIVEN[given]
        new = _GIVEN_LISTS[k][_permutation(key.value, f"given{k}", len(_GIVEN_LISTS[k]))(i, key.step)]
        return new.upper() if word != given else new
    small = word.lower()
    if len(small) != len(word):
        return word
    own = [_LETTERS.get(c) for c in small]
    if len(word) > 3:
        own[-1] = None
    return _same_case(word, _permuted(key, "name", small, own, lambda x: x.capitalize() not in _GIVEN and x.capitalize() not in TITLES))


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4, _GROUP = rf"{_OCTET}(?:\.{_OCTET}){{3}}", "[0-9a-fA-F]{1,4}"
#: Full, or with :: after a first group of four digits, as those of all assigned networks are but 64:ff9b::; so no slice
#: or scope of a program (x[1::2], a::b) is taken for an address.
_IPV6 = rf"(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{6}}{_IPV4}|(?!(?:[0-9a-fA-F]*:+){{9}})(?:[0-9a-fA-F]{{4}}|64:[fF]{{2}}9[bB])(?::{_GROUP}){{0,6}}::(?:(?:{_GROUP}:){{0,5}}(?:{_IPV4}|{_GROUP}))?)"
#: Words that tell of a secret, also within longer names (db_password, clientSecret, AWS_SECRET_ACCESS_KEY, auth_token):
#: what precedes them stays before the match. Ordinary words that begin alike (author, secretary, tokenizer) are none.
_SECRET_WORD = r"(?:password|passwd|pwd|secret(?!ar|i[ov]|e|ly)|token(?!i[sz]|ed)|api[_-]?key|access[_-]?key|auth(?!or(?!i[sz]ation)|ent(?!icat)))[\w-]*+"
#: What is found, in order: of two that begin at one place, the earlier.
DETECTORS: dict[str, tuple[str, Callable]] = {
    "private_key": (r"(?P<begin>-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)(?P<body>[A-Za-z0-9+/=\s]+)(?P<end>-----END [A-Z ]{0,20}PRIVATE KEY-----)", private_key),
    "web_token": (r"(?<![\w-])(?P<fixed>eyJ)(?P<free>[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})(?![\w-])", token),
    "api_token": (r"(?<![\w-])(?P<fixed>(?:sk|pk|rk|gh[opsu]|github_pat|glpat|xox[abprs])[-_])(?P<free>(?=[\w-]*\d)[\w-]{16,})(?![\w-])", token),
    "url_password": (r"(?P<fixed>(?<![\w+.-])[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@]+:)(?P<free>[^\s@/]+)(?=@)", token),
    "email": (r"(?<![\w.+-])\w[\w.%+-]*@(?:[^\W_](?:[^\W_]|-(?=[^\W_]|-))*\.)+[A-Za-z]{2,}", email),
    "secret": (rf"(?i:(?P<lead>{_SECRET_WORD}[\"']?\s*[=:]\s*(?:(?:bearer|basic)\s+)?[\"']?)(?P<secret>[^\s\"',;]{{6,}}))", secret),
    "cloud_key": (r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{12,20}(?![A-Za-z0-9])", cloud_key),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    "hexadecimal": (r"(?<![A-Za-z0-9])(?=[a-fA-F]*\d)(?=\d*[a-fA-F])[0-9a-fA-F]{32,}(?![A-Za-z0-9])", hexadecimal),
    "ipv6": (rf"(?<![\w:]){_IPV6}(?![\w:]|\.\d)", ipv6),
    "ipv4": (rf"(?<!\d)(?<!\d\.){_IPV4}(?!\d|\.\d)", ipv4),
    "mac": (r"(?<![\w:-])[0-9a-fA-F]{2}(?:(?P<dash>[:-])[0-9a-fA-F]{2})(?:(?P=dash)[0-9a-fA-F]{2}){4}(?![\w:-])", mac),
    "ssn": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", ssn),
    "card": (r"(?<![\d+-])\d(?:[ -]?\d){12,18}(?![\d-])", card),
    "phone": (r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|(?<!\d[ ./,-])(?:\d{3} \d{3} \d{4}|0[1-9]\d{1,3}[ /]\d{5,8})(?![ ./,-]?\d)|(?i:phone|tel|telephone|mobile|cell|fax|call|text|whatsapp)(?:[ ](?i:no|number|me|us|at|on|is))*[.:]?[ ]?\d{7,15})(?![\w])", phone),
    "name": (rf"(?P<before>(?<!\w)(?P<title>{'|'.join(TITLES)})\.?\s+)(?P<name>\p{{Lu}}[\p{{L}}'’]+(?:[ -]\p{{Lu}}[\p{{L}}'’]+){{0,2}})", name),
    "person": (rf"(?P<person>(?<![\w'’-])(?P<given>(?=\p{{Lu}})\L<given>)(?:[ -]\p{{Lu}}[\p{{L}}'’]+|[ ]\p{{Lu}}\.(?=[ ]\p{{Lu}}\p{{Ll}})){{1,3}}(?!\w))", person),
}
@cache
def _pattern(kinds: tuple[str, ...]) -> regex.Pattern:
    words = {"given": sorted(GIVEN_FEMININE | GIVEN_MASCULINE)} if "person" in kinds else {}
    return regex.compile("|".join(f"(?P<is_{k}>{DETECTORS[k][0]})" for k in kinds), **words)


_ALL = _pattern(tuple(DETECTORS))
_DIGIT, _WORD = re.compile(r"\d"), re.compile(r"[^\W\d_]+")


def _possible(text: str) -> tuple[str, ...]:
    """The detectors that may match: each is left out only where what all of its matches hold does not stand in the text."""
    low = text.casefold().replace("ı", "i").replace("i\u0307", "i")
    digit = _DIGIT.search(text) is not None
    holds = {
        "email": "@" in text,
        "private_key": "PRIVATE KEY" in text,
        "web_token": "eyJ" in text,
        "api_token": digit and any(t in text for t in ("sk", "pk", "rk", "gh", "glpat", "xox")),
        "url_password": "://" in text and "@" in text,
        "secret": ("=" in text or ":" in text) and any(w in low for w in ("passw", "pwd", "secret", "token", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key", "auth")),
        "cloud_key": "AKIA" in text or "ASIA" in text,
        "ipv6": "::" in text or text.count(":") > 5,
        "name": any(t in text for t in TITLES),
        "person": not GIVEN_FEMININE.isdisjoint(words := _WORD.findall(text)) or not GIVEN_MASCULINE.isdisjoint(words),
    }
    return tuple(k for k in DETECTORS if holds.get(k, digit))



def replaced(text: str, key: bytes, step: int = 1) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (type, entity, surrogate) of each that was found. A step of -1 turns surrogates back."""
    kinds = _possible(text)
    if not kinds:
        return text, []
    keyed = Key(key, step)
    matches = [(next(k for k in kinds if m[f"is_{k}"] is not None), m) for m in _pattern(kinds).finditer(text)]
    if not matches:
        return text, []
    known = _words_of_names(keyed, text, [m for k, m in matches if k in NAMES])
    found: list[tuple[str, str, str]] = []
    pieces: list[str] = []
    at = 0
    # what lies between matches is at even places
    for kind, m in matches:
        if kind in NAMES:
            new = m.groupdict().get("before") or ""
            new = (new if kind == "name" else "") + "".join(known.get(w, w) if k % 2 == 0 else w for k, w in enumerate(_BETWEEN.split(m[kind])))
        else:
            new = DETECTORS[kind][1](keyed, m)
        pieces += [text[at : m.start()], new]
        found.append((kind, m[0], new))
        at = m.end()
    pieces.append(text[at:])
    again = {w.casefold(): w for w in known if len(w) > 1 and not w.endswith(".")}
    if again:
        # the same words elsewhere, alone, without a title and in any case: "Weber left", "WEBER"
        pattern = regex.compile(r"(?<![\p{L}\p{N}_])(?:" + "|".join(map(regex.escape, sorted(again, key=len, reverse=True))) + r")(?![\p{L}\p{N}_])", regex.IGNORECASE)

        def mention(m) -> str:
            w = again.get(m[0].casefold())
            if w is None:
                return m[0]
            new = known.get(m[0]) or _in_case_of(m[0], known[w])
            found.append(("mention", m[0], new))
            return new

        pieces[::2] = [pattern.sub(mention, p) for p in pieces[::2]]
    return "".join(pieces), found


NAMES = ("name", "person")


def _words_of_names(key: Key, text: str, matches: list) -> dict[str, str]:
    """The words of the document's names with their surrogates. A word that the document has besides, and that is the
    surrogate of one of them, is one of them too: it would stand for two else."""
    named = (parts.get("name") or parts.get("person") for parts in (m.groupdict() for m in matches))
    out = {w: name_word(key, w) for text_ in named for w in _BETWEEN.split(text_)[::2] if w}
    if not out:
        return out
    own, forth = set(_WORD.findall(text)), Key(key.value)
    todo = [*out]
    while todo:
        follows = name_word(forth, todo.pop())  # which way this is turned, a surrogate follows its name
        if follows in own and follows not in out and len(follows) > 1:
            out[follows] = name_word(key, follows)
            todo.append(follows)
    return out


def _in_case_of(word: str, new: str) -> str:
    """new in capitals or small letters, as word is."""
    return new.upper() if word.isupper() else new.lower() if word.islower() else new[:1].upper() + new[1:].lower() if word.istitle() else new


def surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """docs, all columns as they came, with surrogates in text, and n_entities (which replaces a column of docs by this
    name). A null text stays null and an empty one empty. Repeated rows are changed alike. An empty table gives no rows."""
    from pyspark.sql.types import LongType, StructType

    base = docs.drop("n_entities")
    schema = StructType([*base.schema.fields]).add("n_entities", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], []
            for t in b.column("text"):
                new, found = replaced(t.as_py(), key) if t.is_valid else (None, [])
                texts.append(new)
                counts.append(len(found))
            columns = [pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in b.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*b.schema.names, "n_entities"])

    return base.mapInArrow(run, schema)


def entities(docs: DataFrame, key: bytes) -> DataFrame:
    """kind, entity and surrogate of everything found, a row for each time. For audits; it holds what is to be hidden."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x for t in b.column("text") if t.is_valid for x in replaced(t.as_py(), key)[1]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], ["kind", "entity", "surrogate"])

    return docs.select("text").mapInArrow(run, "kind string, entity string, surrogate string")


def collisions(found: DataFrame) -> DataFrame:
    """Of entities(): kinds and surrogates that stand for several entities, or entities with several surrogates; none
    if distinctness and coreference hold. Entities that differ only in how they are divided or in case are one."""
    divided = F.col("kind").isin("phone", "card", "iban")
    plain = lambda c: F.lower(F.when(divided, F.regexp_replace(c, r"[\s().-]", "")).otherwise(F.col(c)))
    pairs = found.select("kind", plain("entity").alias("entity"), plain("surrogate").alias("surrogate")).distinct()
    shared = pairs.groupBy("kind", "surrogate").count().where("count > 1").select("kind", F.col("surrogate").alias("of"), F.lit("surrogate").alias("what"))
    split = pairs.groupBy("kind", "entity").count().where("count > 1").select("kind", F.col("entity").alias("of"), F.lit("entity").alias("what"))
    return shared.union(split)


#: The setting of the key, which a deployment fills from its store of secrets. No key is in this code.
KEY_SETTING = "spark.tessera.surrogates.key"

_drawn: dict[str, bytes] = {}


def key_of(spark: SparkSession) -> bytes:
    """The session's key. Where none is set, each application draws one that it tells nobody: its surrogates agree with one
    another, but not with those of other runs, and nobody can turn them back."""
    held = spark.conf.get(KEY_SETTING, None)
    if held:
        return held.encode()
    app = spark.sparkContext.applicationId
    if app not in _drawn:
        warnings.warn(f"{KEY_SETTING} is not set: surrogates of this run can't be turned back", stacklevel=2)
    return _drawn.setdefault(app, secrets.token_bytes(32))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key_of(spark))
