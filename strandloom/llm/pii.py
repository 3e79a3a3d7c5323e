"""Surrogates for personal data.

Entities are found by shape (with checks: Luhn for cards, mod 97 for IBANs,
ranges for addresses) and, for names, by titles and name lists. A replacement is
drawn by a keyed permutation of the entity's own format: lengths, letter case,
scripts, separators, country codes and check digits stay; names keep gender and
script. The permutation has no fixed point and is one to one on a format, so
equal entities stay equal in all documents (coreference) and different ones
stay different. Mail addresses are the same in either case, telephone numbers,
cards and accounts with any separators, and a surname after any title.

``replace`` checks before it that no two entities of the whole table have one
surrogate, and draws all anew under another key where they do. The key comes
from the caller or the session's ``spark.strandloom.surrogates.key``; whoever
has it can undo the surrogates, so the key of the source is for tests only.

Null and empty texts have no entities and stay as they are; texts are read
whole; repeated rows get the same text; an empty table gives no rows; other
columns aren't looked at.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

KEY, SETTING = "strandloom", "spark.strandloom.surrogates.key"
#: Country calling codes of one and two digits; all others have three.
CALLING = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

#: Names by script and gender.
FIRST = {
    ("latin", "f"): "Mary Jennifer Linda Elizabeth Barbara Susan Jessica Karen Margaret Sarah Emily Hannah Claudia Sabine Monika Isabelle Camille Brigitte Carmen Lucia Pilar".split(),
    ("latin", "m"): "James Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Stefan Wolfgang Juergen Philippe Laurent Thierry Carlos Alejandro Javier Miguel".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("cyrillic", "m"): "Александр Дмитрий Сергей Андрей Михаил Николай Владимир Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Αναστασία".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Γιάννης Κώστας".split(),
}
LAST = {
    "latin": "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Thompson White Harris Mueller Schmidt Schneider Fischer Weber Dubois Lefebvre Moreau Laurent Garcia Rodriguez Martinez Hernandez Lopez Gonzalez".split(),
    "cyrillic": "Иванов Смирнов Кузнецов Попов Васильев Петров Соколов Михайлов".split(),
    "greek": "Παπαδόπουλος Βλάχος Αγγελόπουλος Νικολαΐδης Οικονόμου".split(),
}
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f", "Dr": "", "Prof": ""}
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
_CLASS = {c: a for a in ALPHABETS for c in a}
_FIRST = {n: (key, names) for key, names in FIRST.items() for n in names}
_LAST = {n: names for names in LAST.values() for n in names}

_names = "|".join(sorted(_FIRST, key=len, reverse=True))
_lasts = "|".join(sorted(_LAST, key=len, reverse=True))
PATTERN = re.compile(
    r"(?P<email>[^\W_][\w.+-]{0,63}@(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.){1,8}[^\W\d_]{2,24}(?![\w@]))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?\b)"
    r"|(?P<ssn>(?<![\d.-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d))"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-]))"
    rf"|(?P<titled>\b(?:{'|'.join(TITLES)})\.? (?:[^\W\d_a-zа-яα-ω][^\W\d_]+ )?[^\W\d_a-zа-яα-ω][^\W\d_]+(?!\w))"
    rf"|(?P<name>\b(?:{_names}) (?:{_lasts})\b)"
)
SIEVE = r"[0-9@]|\b(?:" + "|".join(TITLES) + rf")\.? \S|\b(?:{_names}) (?:{_lasts})\b"
_QUICK = re.compile(r"[0-9@]")
_NAMES = re.compile(r"\b(?:" + "|".join(TITLES) + rf")\.? \S|\b(?:{_names}) (?:{_lasts})\b")


def luhn(digits: str) -> bool:
    return _luhn_sum(digits) % 10 == 0


def _luhn_sum(digits: str) -> int:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))


def _iban_rest(country: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _round(key: bytes, i: int, value: int, bits: int) -> int:
    size = (bits + 7) // 8
    return int.from_bytes(hashlib.blake2b(bytes([i]) + value.to_bytes(size, "big"), key=key, digest_size=min(64, size)).digest(), "big") & ((1 << bits) - 1)


def _scramble(key: bytes, value: int, domain: int, back: bool) -> int:
    """A keyed permutation of range(domain): a balanced Feistel network, walked on until it lands inside."""
    half = max(1, ((domain - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = value >> half, value & mask
        for i in reversed(range(8)) if back else range(8):
            if back:
                a, b = b ^ _round(key, i, a, half), a
            else:
                a, b = b, a ^ _round(key, i, b, half)
        value = a << half | b
        if value < domain:
            return value


def shift(key: bytes, value: int, domain: int) -> int:
    """A permutation of range(domain) without fixed points: one step along a keyed cycle."""
    if domain < 2:
        return value
    return _scramble(key, (_scramble(key, value, domain, False) + 1) % domain, domain, True)


def _key(key: str, kind: str, form: str) -> bytes:
    return hashlib.blake2b(f"{kind}\0{form}".encode(), key=hashlib.blake2b(key.encode(), digest_size=32).digest(), digest_size=32).digest()


def reshape(key: str, kind: str, text: str) -> str:
    """Letters and digits replaced within their alphabets; everything else stays."""
    radix = [_CLASS.get(c) for c in text]
    value, domain = 0, 1
    for c, a in zip(text, radix):
        if a:
            value, domain = value * len(a) + a.index(c), domain * len(a)
    form = "".join(str(ALPHABETS.index(a)) if a else c for c, a in zip(text, radix))
    value, out = shift(_key(key, kind, form), value, domain), []
    for c, a in zip(reversed(text), reversed(radix)):
        if a:
            value, i = divmod(value, len(a))
            out.append(a[i])
        else:
            out.append(c)
    return "".join(reversed(out))


def _listed(key: str, kind: str, name: str, names: list[str]) -> str:
    return names[shift(_key(key, kind, names[0]), names.index(name), len(names))]


def _unlisted(key: str, kind: str, word: str) -> str:
    """Walks the permutation on past listed names, so no other name's surrogate is one of those."""
    out = reshape(key, kind, word)
    while out in _LAST or out in _FIRST:
        out = reshape(key, kind, out)
    return out


def _person(key: str, words: list[str], gender: str) -> list[str]:
    """The last word is the surname, whatever the title; first names keep to their gender."""
    out = []
    for i, w in enumerate(words):
        last = i == len(words) - 1
        if w in _FIRST and (not last or w not in _LAST):
            out.append(_listed(key, "first", w, _FIRST[w][1]))
        elif w in _LAST:
            out.append(_listed(key, "last", w, _LAST[w]))
        else:
            out.append(_unlisted(key, "surname" if last else "forename" + gender, w))
    return out


def _lower(text: str) -> str:
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _cased(new: str, old: str) -> str:
    return "".join(n.upper() if o != o.lower() and len(n.upper()) == 1 else n for n, o in zip(new, old))


def _calling(digits: str) -> str:
    return next((digits[:n] for n in (1, 2) if digits[:n] in CALLING), digits[:3])


def _refill(text: str, digits: str) -> str:
    fresh = iter(digits)
    return re.sub(r"\d", lambda _: next(fresh), text)


def identity(kind: str, text: str) -> str:
    """What makes two mentions the same entity."""
    if kind == "email":
        return _lower(text)
    return re.sub(r"[^\w+]", "", text) if kind in ("phone", "card", "iban") else text


def surrogate(kind: str, text: str, key: str = KEY) -> str:
    if kind == "email":
        local, _, domain = _lower(text).rpartition("@")
        host, dot, top = domain.rpartition(".")
        return _cased(reshape(key, "local", local) + "@" + reshape(key, "host", host) + dot + top, text)
    if kind == "card":
        digits = re.sub(r"\D", "", text)
        body = reshape(key, "card", digits[:-1])
        return _refill(text, body + str(-_luhn_sum(body + "0") % 10))
    if kind == "iban":
        flat = text.replace(" ", "")
        body = reshape(key, "iban", flat[4:])
        fresh = iter(flat[:2] + f"{98 - _iban_rest(flat[:2], body):02d}" + body)
        return "".join(c if c == " " else next(fresh) for c in text)
    if kind == "ip":
        parts = text.split(".")
        value, domain = 0, 1
        spans = [(10, 0) if len(p) == 1 else (90, 10) if len(p) == 2 else (156, 100) for p in parts]
        for p, (n, low) in zip(parts, spans):
            value, domain = value * n + int(p) - low, domain * n
        value, out = shift(_key(key, kind, ".".join(str(len(p)) for p in parts)), value, domain), []
        for n, low in reversed(spans):
            value, i = divmod(value, n)
            out.append(str(i + low))
        return ".".join(reversed(out))
    if kind == "phone":
        digits = re.sub(r"\D", "", text)
        code = _calling(digits) if text.startswith("+") else ""
        return _refill(text, code + reshape(key, "phone+" + code if code else "phone", digits[len(code) :]))
    if kind == "titled":
        title, *words = text.split(" ")
        return " ".join([title, *_person(key, words, TITLES.get(title.rstrip("."), ""))])
    if kind == "name":
        return " ".join(_person(key, text.split(" "), ""))
    return reshape(key, kind, text)


def entities(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in PATTERN.finditer(text):
        kind, found = m.lastgroup, m.group()
        if kind == "card" and not luhn(re.sub(r"\D", "", found)):
            continue
        if kind == "iban" and (98 - _iban_rest(found[:2], found.replace(" ", "")[4:]) != int(found[2:4])):
            continue
        out.append((m.start(), m.end(), kind))
    return out


def _replace(text: str, key: str) -> tuple[str, list[tuple[int, int, str, str]]]:
    if not _QUICK.search(text) and not _NAMES.search(text):
        return text, []
    parts, at, found = [], 0, []
    for a, b, kind in entities(text):
        new = _cached(kind, text[a:b], key)
        parts += [text[at:a], new]
        at = b
        found.append((a, b, kind, new))
    return "".join([*parts, text[at:]]), found


@functools.lru_cache(1 << 14)
def _cached(kind: str, text: str, key: str) -> str:
    return surrogate(kind, text, key)


def replace(docs: DataFrame, key: str | None = None, tries: int = 5) -> DataFrame:
    """doc_id, text with surrogates, n_entities, kinds (one a found entity, in order) of every row."""
    chosen = key or docs.sparkSession.conf.get(SETTING, KEY)
    for turn in range(tries):
        key = f"{chosen}\0{turn}" if turn else chosen
        if not collisions(docs, key).limit(1).count():
            return _replaced(docs, key)
    raise RuntimeError("surrogates of different entities met under every key")


def _replaced(docs: DataFrame, key: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [_replace(t, key) if isinstance(t, str) else (None, []) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": pd.Series([t for t, _ in done], index=frame.index, dtype=object), "n_entities": [len(f) for _, f in done], "kinds": pd.Series([[k for _, _, k, _ in f] for _, f in done], index=frame.index, dtype=object)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, text string, n_entities long, kinds array<string>")


def mentions(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, start, stop, kind, entity, surrogate: one row a mention."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, a, b, k, t[a:b], new) for d, t in zip(frame["doc_id"], frame["text"]) if isinstance(t, str) for a, b, k, new in _replace(t, key)[1]]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "stop", "kind", "entity", "surrogate"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, start long, stop long, kind string, entity string, surrogate string")


def _pairs(kind: str, old: str, new: str) -> Iterator[tuple[str, str, str]]:
    """What must stay apart: whole entities, and of persons each name."""
    if kind in ("titled", "name"):
        words = list(zip(old.split(" "), new.split(" ")))[kind == "titled" :]
        for i, (a, b) in enumerate(words):
            yield ("surname" if i == len(words) - 1 else "forename"), a, b
    else:
        yield kind, identity(kind, old), identity(kind, new)


def collisions(docs: DataFrame, key: str = KEY, flush: int = 1 << 16) -> DataFrame:
    """kind, surrogate of surrogates that stand for more than one entity of the table; empty unless formats overlap. Only hashes of entities are sent, once a task and ``flush`` of them."""
    number = lambda s: int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: set[tuple[str, str, str]] = set()

        def done() -> pd.DataFrame:
            rows = [(k, b, number(a)) for k, a, b in held]
            held.clear()
            return pd.DataFrame(rows, columns=["kind", "surrogate", "entity"])

        for frame in frames:
            for text in frame["text"]:
                if isinstance(text, str):
                    for a, b, kind, new in _replace(text, key)[1]:
                        held.update(_pairs(kind, text[a:b], new))
                    if len(held) >= flush:
                        yield done()
        if held:
            yield done()

    met = docs.select("text").mapInPandas(run, "kind string, surrogate string, entity long")
    return met.groupBy("kind", "surrogate").agg(F.min("entity").alias("least"), F.max("entity").alias("most")).filter(F.col("least") != F.col("most")).select("kind", "surrogate")
