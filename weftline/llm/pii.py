"""Surrogates for personal data and secrets.

Entities are found by pattern (e-mail, phone, IPv4 address, card, IBAN, US
social security number, IPv6 and MAC address, access key, quoted token, password
also in an address, bearer token, private key, and persons: after a title or an
introduction, by a known given name before a capitalised word, or by an e-mail
address of first and last name) and replaced by keyed surrogates of their own type. Every
surrogate comes from a permutation of the set of strings with the entity's
format: characters keep their class (digits of a script, its vowels and
consonants, case), separators and lengths stay, card and IBAN check digits and
private address ranges stay as valid or not as they were, and given names are
permuted within the names of their gender and script. The permutation is a
Feistel network over the format's numbering, cycle-walked, and conjugated with
a shift, so that nothing is its own surrogate. Equal entities hence get equal
surrogates across all documents (coreference), different ones different
surrogates: every format has a permutation of its own strings, and formats
share no string, so distinctness holds for every key. It is checked all the
same: ``collisions`` looks over all rows for surrogates of a type with several
originals and originals with several surrogates, and pseudonymised() fails
if there are any.

A given name is replaced by one of its own script and gender, as the lists have
it, whatever title stands before it: one name, one surrogate.

Texts without a digit, ``@``, ``=``, title, introduction, two capitalised words in
a row, access key or secret's name before a colon pass unchanged and never leave
the JVM. A null text stays null, an empty one empty; repeated rows are
replaced alike; an empty table gives an empty result. Parts of one text are
replaced left to right, of those that begin together the longer first and then
the earlier pattern. Entities of any length are replaced whole, in texts of any
length. Unknown scripts' letters stay. All other columns are carried unread,
whatever their names.

The key is an argument, else the session's KEY_CONF; KEY serves tests only.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import quoted, small_batches, stored, table

KEY, KEY_CONF = "surrogates", "spark.weftline.surrogates.key"
ROUNDS = 8
#: Characters of a secret that are permuted at once.
PIECE = 200

#: Fixed lists: given names by script and gender.
GIVEN = {
    ("latin", "m"): (
        "James John Robert Michael David Thomas Daniel Paul Peter William Richard Joseph Charles Christopher Matthew Anthony Steven Andrew Kenneth George Kevin Brian Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott"
        " Andreas Stefan Jürgen Klaus Wolfgang Hans Uwe Matthias Markus Pierre Louis Henri Antoine Jacques Olivier Laurent Mathieu Carlos Juan Luis Miguel Javier Fernando Pablo Diego"
    ).split(),
    ("latin", "f"): (
        "Mary Anna Laura Sarah Emma Julia Claire Marie Sophie Camille Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Karen Nancy Lisa Margaret Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Amy"
        " Ursula Petra Sabine Heike Monika Renate Brigitte Ingrid Isabelle Nathalie Sylvie Valérie Hélène Carmen Lucía Elena Isabel Rosa Teresa Pilar Dolores Marta Beatriz"
    ).split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Сергей Дмитрий Николай Андрей Михаил".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Πέτρος".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Άννα Σοφία Δήμητρα".split(),
}
#: Fixed list: titles and the gender they tell.
TITLES = {
    "Mr.": "m", "Mister": "m", "Sir": "m", "Mrs.": "f", "Ms.": "f", "Miss": "f", "Madam": "f", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mademoiselle": "f",
    "Señor": "m", "Señora": "f", "Señorita": "f", "Sr.": "m", "Sra.": "f", "Mme.": "f", "Dr.": "", "Prof.": "", "господин": "m", "госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
#: Fixed alphabets: vowels and consonants, plain and marked, by script.
ALPHABETS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "áàâäãåæéèêëíìîïóòôöõøœúùûüýÿ", "ñçßšžłđðþ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρσςτφχψ", "άέήίόύώϊϋΐΰ"]
SURNAME_ENDINGS = ("ская", "ский", "ова", "ева", "ина", "ов", "ев", "ин")
_CLASS = {c: a for a in ALPHABETS for c in a}

_NAME = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_WORD = re.compile(_NAME)
PATTERNS = {
    "email": re.compile(r"(?<![\w.+-])[\w+-][\w.+-]*+@(?:[\w-]+\.)+[^\W\d_]{2,}+(?![\w-])"),
    # A secret's name may be part of a longer one, as in AWS_SECRET_KEY, and quoted, as in JSON.
    "token": re.compile(r"(?i:(?<![a-z0-9])(?:token|secret|api[_-]?key|auth|password|passwd|pwd)(?:[_-]\w+)?[\"'`]?\s*+[=:]\s*+)(?:\"([^\"\n]{4,}+)\"|'([^'\n]{4,}+)'|`([^`\n]{4,}+)`)"),
    "password": re.compile(r"(?i:(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key)(?:[_-]\w+)?\s*+[=:]\s*+)([^\s\"'`&*%$#|<>!,;]{6,}+)"),
    "bearer": re.compile(r"(?i:(?<![a-z0-9])bearer\s++)(?=[\w.~+/=-]*\d)([\w.~+/=-]{8,}+)"),
    "url_password": re.compile(r"://[^/\s:@]++:([^/\s@]++)@"),
    "private_key": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----([^-]++)-----END"),
    "access_key": re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)([A-Z0-9]{16})(?![A-Za-z0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<![\w.+-])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}|3[47]\d{13})(?![\w-])"),
    "ssn": re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"),
    "ipv6": re.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,7}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*+)?|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*+)(?![\w:])"),
    "mac": re.compile(r"(?<![\w:-])[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}(?![\w:-])"),
    "phone": re.compile(r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}([-.])\d{3}\1\d{4})(?![\w-])"),
    "person": re.compile(rf"(?<!\w)({'|'.join(sorted(map(re.escape, TITLES), key=len, reverse=True))})\s+({_NAME}(?: {_NAME}){{0,2}})"),
}
#: Fixed list: words that introduce a person, whatever the name.
CUES = (
    r"[Mm]y name is|[Mm]ein Name ist|[Ii]ch heiße|[Jj]e m['’]appelle|[Mm]e llamo|[Mm]i nombre es|[Мм]еня зовут|[Μμ]ε λένε|[Ss]igned by|[Ss]igned:|[Ss]incerely,|[Rr]egards,|[Yy]ours truly,|[Ff]reundlichen Grüßen,?|[Cc]ordialement,|[Aa]tentamente,"
)
SECRETS = ("token", "password", "access_key", "bearer", "url_password", "private_key")
PERSONS = {
    "introduced": re.compile(rf"(?<!\w)(?:{CUES})\s+({_NAME}(?: {_NAME}){{0,3}})"),
    "named": re.compile(rf"(?<!\w)({_NAME})(?= {_NAME})"),
}
#: What a text must hold to be searched, in the regular expressions of the JVM; two capitalised words may be a name.
SUSPECT = r"[0-9@=\p{Nd}]|::|-----BEGIN|\p{Lu}[\p{L}'’-]+ \p{Lu}\p{L}|(?<!\p{L})(?:" + CUES + r")|(?<![\p{L}\p{Nd}])[A-Fa-f]{2}[:-][A-Fa-f]{2}[:-]|(?=[" + "".join(sorted({t[0] for t in TITLES})) + r"])(?:" + "|".join(sorted(map(re.escape, TITLES))) + ")"
#: A secret may also stand after a colon or an access key's first letters, without any of these.
SECRET_WORD = r"(?:token|secret|api[_-]?key|auth|passwd|pwd|password)(?:[_-][\p{L}\p{Nd}_]+)?[^\p{L}\p{Nd}]*:"
ACCESS_KEYS = ("AKIA", "ASIA")
_MAC = re.compile(r"(?<![^\W_])[A-Fa-f]{2}[:-][A-Fa-f]{2}[:-]")
_SECRET_WORD = re.compile(SECRET_WORD.replace(r"[^\p{L}\p{Nd}]", r"[\W_]").replace(r"[\p{L}\p{Nd}_]", r"\w"), re.I)


def _mac(key: str, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=hashlib.sha256(key.encode()).digest(), digest_size=64).digest(), "big")


def _walk(x: int, n: int, key: str, tweak: str, inverse: bool) -> int:
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def f(r: int, value: int) -> int:
        out, k = 0, 0
        while k * 512 < half:
            out |= _mac(key, tweak, n, r, value, k) << (512 * k)
            k += 1
        return out & mask

    while True:
        left, right = x >> half, x & mask
        for r in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
            left, right = (right ^ f(r, left), left) if inverse else (right, left ^ f(r, right))
        x = left << half | right
        if x < n:
            return x


def permuted(x: int, n: int, key: str, tweak: str) -> int:
    """Where a keyed permutation of 0..n-1 without fixed points (n > 1) takes x."""
    if n < 2:
        return x
    shift = 1 + _mac(key, tweak, n, "shift") % (n - 1)
    return _walk((_walk(x, n, key, tweak, False) + shift) % n, n, key, tweak, True)


def alphabet(c: str) -> str:
    """The characters that may stand for c; c alone if its class is unknown."""
    if (d := unicodedata.decimal(c, -1)) >= 0:
        return "".join(chr(ord(c) - d + i) for i in range(10))
    low = c.lower()
    own = _CLASS.get(low, c) if len(low) == 1 else c
    return own.upper() if c != low and low in own and len(own.upper()) == len(own) else own if low in own and c == low else c


def reshaped(text: str, key: str, tweak: str, alphabets: list[str] | None = None) -> str:
    """Another string of the same format: a permutation of all strings of that format."""
    alphabets = alphabets or [alphabet(c) for c in text]
    n = x = 0
    n = 1
    for c, own in zip(text, alphabets, strict=True):
        x, n = x * len(own) + own.index(c), n * len(own)
    x = permuted(x, n, key, f"{tweak}/{'/'.join(alphabets)}")
    out = []
    for own in reversed(alphabets):
        x, i = divmod(x, len(own))
        out.append(own[i])
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _digits(text: str, new: str) -> str:
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _card(text: str, key: str) -> str:
    d = "".join(c for c in text if c.isdigit())
    kept = 2 if d[:2] in ("34", "37") and len(d) == 15 else 1
    body = d[:kept] + reshaped(d[kept:-1], key, f"card{d[:kept]}")
    return _digits(text, body + str((_luhn(body) + int(d[-1]) - _luhn(d[:-1])) % 10))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(text: str, key: str) -> str:
    flat = text.replace(" ", "")
    body = reshaped(flat[4:], key, f"iban{flat[:2]}", [("0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in flat[4:]])
    out = iter(flat[:2] + f"{98 - _mod97(body + flat[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(out) for c in text)


#: Private and reserved IPv4 ranges keep to themselves: first address and size.
RANGES = [(0x0A000000, 1 << 24), (0x7F000000, 1 << 24), (0xAC100000, 1 << 20), (0xC0A80000, 1 << 16)]


def _ip(text: str, key: str) -> str:
    parts = text.split(".")
    if any(len(p) > 1 and p[0] == "0" for p in parts):
        # Numbers with a leading zero are a format of their own, kept number by number.
        sizes = [10 if len(p) > 1 and p[0] == "0" else 256 for p in parts]
        x = n = 0
        n = 1
        for p, size in zip(parts, sizes, strict=True):
            x, n = x * size + int(p), n * size
        x = permuted(x, n, key, f"ip/{sizes}")
        out = []
        for size in reversed(sizes):
            x, i = divmod(x, size)
            out.append(f"0{i}" if size == 10 else str(i))
        return ".".join(reversed(out))
    x = 0
    for part in parts:
        x = x << 8 | int(part)
    for first, size in RANGES:
        if first <= x < first + size:
            x = first + permuted(x - first, size, key, f"ip{first}")
            break
    else:
        # Public addresses are numbered without the ranges above.
        rank = x - sum(size for first, size in RANGES if first < x)
        x = permuted(rank, (1 << 32) - sum(size for _, size in RANGES), key, "ip")
        for first, size in RANGES:
            x += size if x >= first else 0
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _phone(text: str, key: str) -> str:
    code = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", text)
    kept = len(re.sub(r"\D", "", code[0])) if code else 0
    d = "".join(c for c in text if c.isdigit())
    rest = d[kept:]
    own = [("0" if c == "0" else "123456789") if i == 0 else "0123456789" for i, c in enumerate(rest)]  # trunk zeros stay
    return _digits(text, d[:kept] + reshaped(rest, key, f"phone{d[:kept]}/{re.sub(r'[0-9]', '9', text)}", own))


def _email(text: str, key: str) -> str:
    local, domain = text.rsplit("@", 1)
    labels = domain.split(".")
    return f"{reshaped(local, key, 'local')}@{reshaped('.'.join(labels[:-1]), key, f'domain/{labels[-1]}')}.{labels[-1]}"


_HEX = re.compile(r"[0-9a-f]+")


def _secret(text: str, key: str) -> str:
    if _HEX.fullmatch(text):
        return _chained(text, key, ["0123456789" if c.isdigit() else "abcdef" for c in text])
    own = ["0123456789" if c in "0123456789" else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else alphabet(c) for c in text]
    while _HEX.fullmatch(text := _chained(text, key, own)):
        pass  # walks on: hexadecimal strings are the format above
    return text


def _chained(text: str, key: str, own: list[str]) -> str:
    """Of a long secret, each piece has a permutation of its own, keyed by the pieces before it: one to one as a whole, in linear time."""
    out, before = [reshaped(text[:PIECE], key, "secret", own[:PIECE])], hashlib.blake2b(digest_size=32)
    for i in range(PIECE, len(text), PIECE):
        before.update(text[i - PIECE : i].encode("utf-8", "surrogatepass"))
        out.append(reshaped(text[i : i + PIECE], key, f"secret/{before.hexdigest()}", own[i : i + PIECE]))
    return "".join(out)


def _hexadecimal(text: str, key: str) -> str:
    """Digits for digits, letters for letters of their case; a first group of a reserved range (f...) stays."""
    kept = len(text.split(":")[0]) if text[:1] in "fF" and text.count(":") and "-" not in text and len(text.split(":")[0]) == 4 else 0
    own = [c if i < kept else "0123456789" if c.isdigit() else "abcdef" if c in "abcdef" else "ABCDEF" if c in "ABCDEF" else c for i, c in enumerate(text)]
    return reshaped(text, key, "hex", own)


def script(word: str) -> str:
    name = unicodedata.name(word[0], "LATIN")
    return "cyrillic" if name.startswith("CYRILLIC") else "greek" if name.startswith("GREEK") else "latin"


LISTED = {n: group for group, names in GIVEN.items() for n in names}


def _ending(word: str) -> str:
    return next((e for e in SURNAME_ENDINGS if word.endswith(e) and len(word) > len(e) + 1), "")


def person_word(word: str, key: str) -> str:
    """A given name's surrogate from the names of its script and gender; another word of like form otherwise."""
    if word in LISTED:
        names = GIVEN[LISTED[word]]
        return names[permuted(names.index(word), len(names), key, "given/" + "/".join(LISTED[word]))]
    ending = _ending(word)
    stem = word[: len(word) - len(ending)]
    while True:  # walks on where it meets a listed name or another ending: these are formats of their own
        stem = reshaped(stem, key, f"name/{ending}")
        if (out := stem + ending) not in LISTED and _ending(out) == ending:
            return out


@lru_cache(maxsize=20_000)
def surrogate(kind: str, text: str, key: str = KEY) -> str:
    own = {"email": _email, "card": _card, "iban": _iban, "ip": _ip, "phone": _phone, "ipv6": _hexadecimal, "mac": _hexadecimal, **dict.fromkeys(SECRETS, _secret), "person": person_word}
    return own[kind](text, key) if kind in own else reshaped(text, key, kind)


def _own_check(iban: str) -> bool:
    """Whether an IBAN bears the check digits of its body; 00, 01 and 99 stand for none."""
    return iban[2:4] == f"{98 - _mod97(iban[4:] + iban[:2] + '00'):02d}"


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of what is replaced, in order and apart from each other."""
    found: list[tuple[int, int, str]] = []
    if any(c.isdigit() for c in text) or "@" in text or "=" in text or "-----BEGIN" in text or any(k in text for k in ACCESS_KEYS) or ":" in text and _SECRET_WORD.search(text) or _MAC.search(text):
        for kind, pattern in PATTERNS.items():
            if kind == "person" or kind == "email" and "@" not in text:
                continue
            for m in pattern.finditer(text):
                if kind == "iban" and not _own_check(m[0].replace(" ", "")):
                    continue
                if kind == "card" and len(re.sub(r"\D", "", m[0])) == 15 and _luhn(m[0][:-1]) != int(m[0][-1]):
                    continue
                if kind == "ipv6" and not any(c.isdigit() for c in m[0]):
                    continue  # words of code, rather
                group = m.lastindex if kind in SECRETS else 0
                found.append((m.start(group), m.end(group), kind))
    names: dict[str, None] = {}

    def add(words: list[str]) -> None:
        for word in words:
            if not word[0].isupper() or len(word) < 2:
                break
            names[word] = None

    for pattern, group in ((PATTERNS["person"], 2), (PERSONS["introduced"], 1)):
        for m in pattern.finditer(text):
            add(m[group].split(" "))
    if " " in text:
        for m in PERSONS["named"].finditer(text):  # a known given name before another capitalised word
            if m[1] in LISTED:
                after = _WORD.match(text, m.end() + 1)[0]
                if after[0].isupper() and len(after) > 1 and not after.isupper():
                    add([m[1], after])
    for start, _, kind in list(found):
        if kind == "email":  # Robert Brown, as robert.brown@...
            parts = [p for p in re.split(r"[._-]", text[start:].split("@", 1)[0]) if len(p) > 1 and p.isalpha()]
            if len(parts) == 2 and (full := re.search(rf"(?<!\w){re.escape(parts[0].capitalize())} {re.escape(parts[1].capitalize())}(?!\w)", text)):
                add(full[0].split(" "))
    if names:  # later mentions without the title are the same person
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, names), key=len, reverse=True))})(?!\w)", text):
            found.append((m.start(), m.end(), "person"))
    out, at = [], 0
    for start, end, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if start >= at:
            out.append((start, end, kind))
            at = end
    return out


def replaced(text: str, key: str = KEY) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (type, original, surrogate) of each."""
    out, at, found = [], 0, []
    for start, end, kind in entities(text):
        new = surrogate(kind, text[start:end], key)
        out += [text[at:start], new]
        found.append((kind, text[start:end], new))
        at = end
    return "".join([*out, text[at:]]), found


def suspect(text_col: str = "text") -> Column:
    """Whether a text may hold an entity: never false where entities() finds one."""
    own = quoted(text_col)
    secret = own.contains(":") & own.rlike(f"(?iu){SECRET_WORD}")
    for k in ACCESS_KEYS:
        secret |= own.contains(k)
    return F.coalesce(own.rlike(SUSPECT) | secret, F.lit(False))


def collisions(pairs: DataFrame) -> DataFrame:
    """Surrogates of a type that stand for several originals, and originals with several surrogates; originals may be digests."""
    pairs = pairs.select("type", "original", "surrogate").distinct()
    by = lambda one, other: pairs.groupBy("type", F.col(one).alias("value")).agg(F.count("*").alias("n")).filter("n > 1").select("type", F.lit(one).alias("side"), "value", "n")
    return by("surrogate", "original").union(by("original", "surrogate"))


_FOUND = "text string, entities array<struct<type: string, original: string, surrogate: string>>"


def _surrogates(key: str):
    @F.pandas_udf(_FOUND)
    def run(texts: pd.Series) -> pd.DataFrame:
        both = [replaced(t, key) for t in texts]
        own = [[{"type": k, "original": hashlib.blake2b(o.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest(), "surrogate": s} for k, o, s in e] for _, e in both]
        return pd.DataFrame({"text": [t for t, _ in both], "entities": own})

    return run


def pseudonymised(docs: DataFrame, key: str | None = None, text_col: str = "text", entities_col: str | None = None) -> DataFrame:
    """docs with surrogates in the text; entities_col, if named, gets (type, surrogate) of each replacement.

    Suspect texts are searched once; they are stored with their surrogates (and
    digests of the originals), all rows of which are then checked for collisions.
    """
    small_batches(docs.sparkSession)
    key = key or docs.sparkSession.conf.get(KEY_CONF, KEY)
    own = [quoted(c) for c in docs.columns]
    rest = [quoted(c) for c in docs.columns if c != text_col]
    searched = stored(docs.filter(suspect(text_col)).select(F.struct(F.lit(0).alias("__only"), *rest).alias("row"), _surrogates(key)(quoted(text_col)).alias("new")), "surrogates")
    pairs = searched.select(F.explode("new.entities").alias("e")).select("e.*")
    if (found := collisions(pairs).limit(5).collect()):
        raise ValueError(f"surrogates collide: {[(r['type'], r['side'], r['n']) for r in found]}")
    kind = "array<struct<type: string, surrogate: string>>"
    clean = docs.filter(~suspect(text_col)).select(*own, *([F.array().cast(kind).alias(entities_col)] if entities_col else []))
    fields = [F.col("new.text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    brief = F.transform("new.entities", lambda e: F.struct(e["type"].alias("type"), e["surrogate"].alias("surrogate"))).cast(kind)
    return clean.union(searched.select(*fields, *([brief.alias(entities_col)] if entities_col else [])))


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return pseudonymised(docs, entities_col="entities").withColumn("n_entities", F.size("entities"))
