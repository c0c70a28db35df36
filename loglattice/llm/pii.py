"""Surrogates for personal data.

Detection is a set of patterns with checks; replacement is a keyed permutation of each entity's own format, so
two entities never share a surrogate (distinctness) and one entity has the same surrogate everywhere
(coreference), in every document and on every executor, without a lookup table. Names are permuted within
their pool of the same gender and script. An entity is known by its canonical form (an address in lower case, a
number's digits, a name without its title), so all its spellings have the same surrogate, each in its own format. A surrogate that would equal another entity of the same document, or
its surrogate, is reported and moved on along the permutation's cycle to a free value. If the document holds
the whole cycle (all names of two letters, say), the surrogate is longer than the original.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from loglattice.llm.runtime import with_fields

#: Given names by script and gender. Surrogates come from the same list as the name they replace.
GIVEN = {
    ("latin", "f"): "Anna Maria Emma Julia Laura Sarah Sophie Clara Lucia Elena Carmen Alice Emily Grace Hannah Ingrid Petra Sabine Claire Camille Priya Ananya Lakshmi Deepa Fatima Aisha Layla Yasmin Mei Xiuying Yuki Sakura Haruka Minji Nguyet Amara Ngozi Wanjiku Olga Natalia Agnieszka Katarzyna Zuzana Ines Beatriz".split(),
    ("latin", "m"): "John James Peter Thomas Paul Michael David Daniel Robert Hans Klaus Jürgen Pierre Jean Louis Carlos Miguel Javier Antonio Luis Arjun Rahul Vikram Sanjay Mohammed Ahmed Omar Hassan Wei Jun Hiroshi Kenji Takeshi Minjun Quang Chidi Kwame Tunde Sergei Dmitri Piotr Tomasz Jiri Mateus Thiago".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Андрей Николай Михаил".split(),
}
#: Forms of address by gender.
TITLES = {"f": ["Mrs.", "Ms.", "Miss", "Mme", "Madame", "Frau", "Señora", "Sra.", "г-жа"], "m": ["Mr.", "Monsieur", "Herr", "Señor", "Sr.", "г-н"]}

UPPER, LOWER = "A-ZÀ-ÖØ-ÞА-ЯЁ", "a-zß-öø-ÿа-яё"
_title = "|".join(re.escape(t) for ts in TITLES.values() for t in ts)
_given = "|".join(n for names in GIVEN.values() for n in names)
PATTERN = re.compile(
    rf"""(?P<email>(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{{2,}})
    |(?P<iban>\b[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?\b)
    |(?P<secret>\b(?:sk|pk|ghp|gho|xox[bp]|AKIA)[_\-]?[A-Za-z0-9_\-]{{16,}}\b|(?<=["'=])[A-Fa-f0-9]{{32,}}\b)
    |(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d))
    |(?P<ssn>(?<![\d\-])\d{{3}}-\d{{2}}-\d{{4}}(?![\d\-]))
    |(?P<phone>(?<![\w+])(?:\+\d{{1,3}}[ .\-]?)?\(\d{{2,4}}\)[ .\-]?\d{{3,4}}[ .\-]?\d{{3,4}}(?!\d)|(?<!\w)\+\d{{1,3}}(?:[ .\-]?\d{{2,4}}){{2,5}}(?!\d)|(?<![\d.\-])\d{{3}}[.\-]\d{{3}}[.\-]\d{{4}}(?![\d.\-]*\d))
    |(?P<card>(?<![\d.])\d(?:[ \-]?\d){{12,18}}(?![\d]))
    |(?P<name>(?:\b(?:{_title})[ ]+[{UPPER}][{LOWER}]+(?:[ ]+[{UPPER}][{LOWER}]+)?)|\b(?:{_given})[ ]+[{UPPER}][{LOWER}]+)""",
    re.X,
)
#: A text without any of these has nothing for PATTERN: it is passed through at two cheap scans.
SIGNS = re.compile(r"[@0-9]|(?:sk|pk|gh[po]|xox[bp]|AKIA)[_\-]?[A-Za-z0-9_\-]{16}|[\"'=][A-Fa-f0-9]{32}")
NAMES = [f"{w} " for ws in (*TITLES.values(), *GIVEN.values()) for w in ws]
ENTITY = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("surrogate", pa.string()), ("moved", pa.bool_())]))

CLASSES, HEX = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("0123456789", "abcdef", "ABCDEF")
_class_of = {c: k for k, letters in enumerate(CLASSES) for c in letters}


def _number(digits: list[int], radices: list[int]) -> int:
    n = 0
    for d, r in zip(digits, radices, strict=True):
        n = n * r + d
    return n


def _digits(n: int, radices: list[int]) -> list[int]:
    out = []
    for r in reversed(radices):
        n, d = divmod(n, r)
        out.append(d)
    return out[::-1]


def permute(digits: list[int], radices: list[int], key: bytes, rounds: int = 6) -> list[int]:
    """The next of all digit strings over the radices on one keyed cycle, so that none stays and no two meet.

    A Feistel network over two halves gives a string its place on the cycle, and its inverse the string of the next place.
    """
    mid = len(digits) // 2
    (ra, rb), (a, b) = (radices[:mid], radices[mid:]), (_number(digits[:mid], radices[:mid]), _number(digits[mid:], radices[mid:]))
    na, nb = _size(ra), _size(rb)
    if mid == 0:
        ranked = sorted(range(nb), key=lambda n: hashlib.blake2b(b"%d" % n, key=key).digest())
        return _digits(ranked[(ranked.index(b) + 1) % nb], rb)
    for k in range(rounds):
        if k % 2:
            a = (a + _round(key, k, b, na)) % na
        else:
            b = (b + _round(key, k, a, nb)) % nb
    a, b = divmod((a * nb + b + 1) % (na * nb), nb)
    for k in reversed(range(rounds)):
        if k % 2:
            a = (a - _round(key, k, b, na)) % na
        else:
            b = (b - _round(key, k, a, nb)) % nb
    return _digits(a, ra) + _digits(b, rb)


def _size(radices: list[int]) -> int:
    n = 1
    for r in radices:
        n *= r
    return n


def _round(key: bytes, k: int, half: int, n: int) -> int:
    return int.from_bytes(hashlib.blake2b(b"%d:%d" % (k, half), key=key, digest_size=32).digest(), "big") % n


def permute_text(text: str, key: bytes, fixed: set[int] = frozenset(), classes: tuple[str, ...] = CLASSES) -> str:
    """Permute letters and digits within their own class, all else and the positions in ``fixed`` staying."""
    at = [k for k, c in enumerate(text) if c in _class_of and k not in fixed]
    if not at:
        return text
    pools = [classes[_class_of[text[k]]] for k in at]
    # The format is part of the key: texts of other formats are permuted independently.
    got = permute([p.index(text[k]) for k, p in zip(at, pools, strict=True)], [len(p) for p in pools], key)
    out = list(text)
    for k, p, d in zip(at, pools, got, strict=True):
        out[k] = p[d]
    return "".join(out)


def luhn_digit(digits: str) -> str:
    total = sum(sum(divmod(int(d) * (2 if k % 2 == 0 else 1), 10)) for k, d in enumerate(reversed(digits)))
    return str(-total % 10)


def luhn_valid(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _email(v: str, key: bytes) -> str:
    """A new local part and new host names; the last two labels stay if they are a reserved example domain."""
    local, _, host = v.partition("@")
    labels = host.split(".")
    keep = 2 if len(labels) > 1 and labels[-2].lower() == "example" else 1
    head = ".".join(labels[:-keep])
    return permute_text(f"{local}@{head}", key) + "." * bool(head) + ".".join(labels[-keep:])


def _card(v: str, key: bytes) -> str:
    """The first digit (the network) stays; a number that passed the Luhn check passes it again."""
    at = [k for k, c in enumerate(v) if c.isdigit()]
    digits = "".join(v[k] for k in at)
    if luhn_valid(digits):
        body = permute_text(digits[:-1], key + b"luhn", {0})
        new = body + luhn_digit(body)
    else:
        new = digits
        while True:  # cycle-walk within the numbers that fail the check
            new = permute_text(new, key, {0})
            if not luhn_valid(new):
                break
    out = list(v)
    for k, c in zip(at, new, strict=True):
        out[k] = c
    return "".join(out)


def _iban(v: str, key: bytes) -> str:
    """Check digits stay as far from the right ones as they were: right ones stay right, and no two numbers meet."""
    at = [k for k, c in enumerate(v) if c != " "]
    flat = "".join(v[k] for k in at)
    rest = permute_text(flat[4:], key)
    check = (int(iban_check(flat[:2], rest)) + int(flat[2:4]) - int(iban_check(flat[:2], flat[4:]))) % 100
    new = f"{flat[:2]}{check:02d}{rest}"
    out = list(v)
    for k, c in zip(at, new, strict=True):
        out[k] = c
    return "".join(out)


def _ip(v: str, key: bytes) -> str:
    return ".".join(map(str, permute([int(x) for x in v.split(".")], [256] * 4, key)))


def _phone(v: str, key: bytes) -> str:
    """The country code stays."""
    m = re.match(r"\+\d{1,3}(?=[ .\-(])", v)
    return permute_text(v, key, set(range(m.end() if m else 0)))


def _secret(v: str, key: bytes) -> str:
    """The issuer's prefix stays; what has none is hexadecimal and stays so."""
    m = re.match(r"(?:sk|pk|gh[po]|xox[bp]|AKIA)[_\-]?", v)
    return permute_text(v, key, set(range(m.end()))) if m else permute_text(v, key, classes=HEX)


@lru_cache(1 << 10)
def _pool(script: str, gender: str, key: bytes) -> dict[str, str]:
    names = GIVEN[script, gender]
    ranked = sorted(names, key=lambda n: hashlib.blake2b(n.encode(), key=key).digest())
    return dict(zip(ranked, [*ranked[1:], ranked[0]], strict=True))  # one cycle: no name stays


def _surname(word: str, key: bytes) -> str:
    """Consonants go to consonants and vowels to vowels of the same script and case."""
    pools = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ"]
    at = [(k, p) for k, c in enumerate(word) for p in pools if c in p]
    got = permute([p.index(word[k]) for k, p in at], [len(p) for _, p in at], key) if at else []
    out = list(word)
    for (k, p), d in zip(at, got, strict=True):
        out[k] = p[d]
    return "".join(out)


def _name(v: str, key: bytes) -> str:
    words = re.split(r"( +)", v)
    out = []
    for k, w in enumerate(words):
        pool = next((g for g, names in GIVEN.items() if w in names), None)
        if not w.strip() or k == 0 and any(w in ts for ts in TITLES.values()):
            out.append(w)
        else:
            out.append(_pool(*pool, key)[w] if pool else _surname(w, key))
    return "".join(out)


SURROGATES = {"email": _email, "iban": _iban, "secret": _secret, "ip": _ip, "ssn": permute_text, "phone": _phone, "card": _card, "name": _name}


@lru_cache(1 << 14)
def _typed_key(key: bytes, kind: str) -> bytes:
    return hashlib.blake2b(kind.encode(), key=key, digest_size=32).digest()


@lru_cache(1 << 16)
def surrogate(kind: str, value: str, key: bytes) -> str:
    """A value of the same type and format, never the value itself unless its format has a single member.

    Values of one type have different surrogates.
    """
    make, k = SURROGATES[kind], _typed_key(key, kind)
    shape = "".join("0aA"[_class_of[c]] if c in _class_of else c for c in value) if kind in ("email", "secret") else ""
    k = _typed_key(k, shape) if shape else k
    return make(value, k)


def longer(kind: str, value: str, key: bytes, n: int) -> str:
    """The n-th keyed surrogate that is longer than the value; only names and e-mail addresses have so few members."""
    k = _typed_key(key, f"longer {n} {kind} {value}")
    drawn = hashlib.blake2b(b"letters", key=k).digest()
    if kind == "email":
        local, _, host = _email(value, k).partition("@")
        return "".join("abcdefghijklmnopqrstuvwxyz"[d % 26] for d in drawn[: min(64, len(local) + 1 + n // 8)]) + "@" + host
    if kind != "name":
        return value + "".join("0123456789"[d % 10] for d in drawn[: 1 + n // 8])
    head, _, last = _name(value, k).rpartition(" ")
    letters = "абвгдежзиклмнопрстуфхцчшщэюя" if re.search("[А-ЯЁа-яё]", last) else "abcdefghijklmnopqrstuvwxyz"
    return f"{head} ".lstrip() + "".join(letters[d % len(letters)] for d in drawn[: min(64, len(last) + 1 + n // 8)]).capitalize()


def canonical(kind: str, value: str) -> str:
    """What an entity is whatever its spelling."""
    if kind == "email":
        return value.lower()
    if kind == "phone":
        return "".join(c for c in value[_country(value) :] if c.isdigit())
    if kind == "card":
        return "".join(c for c in value if c.isdigit())
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "name":
        words = value.split()
        return " ".join(words[1:] if any(words[0] in ts for ts in TITLES.values()) else words)
    return value


def _country(phone: str) -> int:
    """Where a number's national part begins."""
    m = re.match(r"\+\d{1,3}(?=[ .\-(])|\+1(?=\d{10}$)", phone)
    return m.end() if m else 0


def spelled(kind: str, value: str, new: str) -> str:
    """The canonical surrogate ``new`` in the spelling of ``value``."""
    if kind == "email":
        return "".join(c.upper() if o.isupper() else c for c, o in zip(new, value, strict=True)) if len(new) == len(value) else new
    if kind in ("phone", "card", "iban"):
        at = _country(value) if kind == "phone" else 0
        left = iter(new)
        return value[:at] + "".join(next(left) if c.isalnum() else c for c in value[at:])
    if kind == "name":
        title = re.match(rf"(?:{_title}) +", value)
        words, gaps = new.split(" "), re.findall(" +", value[title.end() if title else 0 :])
        return (title.group() if title else "") + words[0] + "".join(g + w for g, w in zip([*gaps, *[" "] * len(words)], words[1:], strict=False))
    return new


def assign(values: dict[tuple[str, str], None], key: bytes) -> dict[tuple[str, str], tuple[str, bool]]:
    """(surrogate, moved) of each (type, canonical value) of a text: no surrogate is a value of the text or another's surrogate."""
    got: dict[tuple[str, str], tuple[str, bool]] = {}
    used = {value for _, value in values}
    late, ahead = [], {}
    for kind, value in values:
        new = surrogate(kind, value, key)
        if new in used:
            late.append((kind, value, new))
        else:
            used.add(new)
            got[kind, value] = new, False
    for kind, value, first in late:
        new, seen = first, set()
        while new in used and new not in seen:
            seen.add(new)
            new = ahead.get((kind, new)) or surrogate(kind, new, key)
        ahead |= {(kind, x): new for x in seen}  # all between is used, and no value becomes free again
        n = 0
        while new in used:  # the whole cycle is in this text
            new, n = longer(kind, value, key, n), n + 1
        used.add(new)
        got[kind, value] = new, True
    return got


def detect(text: str) -> list[tuple[str, int, int]]:
    if not SIGNS.search(text) and not any(w in text for w in NAMES):
        return []
    return [(m.lastgroup, m.start(), m.end()) for m in PATTERN.finditer(text) if is_sound(m.lastgroup, m.group())]


def is_sound(kind: str, value: str) -> bool:
    """Whether a number is what it looks like: cards start as a network's do and pass the Luhn check, as IBANs do theirs; orders and times do not."""
    if kind == "card":
        digits = canonical(kind, value)
        return digits[0] in "23456" and len(set(digits)) > 1 and luhn_valid(digits)
    if kind == "iban":
        flat = canonical(kind, value)
        return iban_check(flat[:2], flat[4:]) == flat[2:4]
    return True


def pseudonymise(text: str, key: bytes) -> tuple[str, list[dict]]:
    """The text with each entity replaced, and the entities with their places in the original."""
    found = detect(text)
    if not found:
        return text, []
    surrogates = assign(dict.fromkeys((kind, canonical(kind, text[a:b])) for kind, a, b in found), key)
    out, at, entities = [], 0, []
    for kind, a, b in found:
        new, moved = surrogates[kind, canonical(kind, text[a:b])]
        new = spelled(kind, text[a:b], new)
        entities.append({"type": kind, "start": a, "end": b, "surrogate": new, "moved": moved})
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), entities


def replace_pii(df: DataFrame, key: bytes, text_col: str = "text", report: str | None = "pii") -> DataFrame:
    """Replace entities in ``text_col``, and report (type, start, end, surrogate, moved) in order of the original in a column of that name.

    A null text stays null with no entities, an empty one empty. All other columns pass through, but for one with the
    report's name, which it replaces; with ``report`` None no column is added. Equal rows come out equal; an empty table
    stays empty.
    """
    df = df.drop(report) if report else df
    names = df.columns
    t = names.index(text_col)
    key = hashlib.blake2b(key, digest_size=32).digest()

    def run(batches):
        for batch in batches:
            texts, spans = [], []
            for x in batch.column(t):
                text = x.as_py()
                new, found = (None, []) if text is None else pseudonymise(text, key)
                texts.append(new)
                spans.append(found)
            columns = [pa.array(texts, pa.string()) if k == t else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, ENTITY)] if report else columns, names=[*names, report] if report else names)

    return df.mapInArrow(run, with_fields(df.schema, f"`{report}` array<struct<type:string,start:bigint,end:bigint,surrogate:string,moved:boolean>>") if report else df.schema)
