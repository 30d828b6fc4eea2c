"""Personal data replaced by keyed, type-consistent surrogates.

Each entity found is reduced to a normal form (a phone's national number, an
address in lower case), so that all its mentions share one surrogate. The
surrogate comes from an HMAC of type and normal form under a secret key and
keeps what the type has: lengths and letter classes, a card's network and check
digit, an IBAN's country and checksum, a name's gender and script. It is written
in the mention's own format: separators, brackets, country code, case.

Each word of a person's name is an entity of its own, and so is each half of a
double name, so "Mr John Smith", "Mrs Smith" and "Dr Smith" share their surname's
surrogate. Names are found after titles and phrases of introduction, with any
number of words, initials and particles ("van der", "de la"), which stay; what a
text names so is then found in all of it, alone too, in capitals or not. Where all
is in capitals a name ends at the first common word. A first name's gender is the one that most of its mentions in the
corpus have.

Surrogates are checked over the whole corpus: one that two entities would share,
or that is itself an entity of the corpus, is drawn anew for all but the first
(in order of the normal form), until none is left; where a type's room runs out
they get longer. So distinct entities stay distinct, and no surrogate is someone
else's data.

Each text is searched once. Only texts with entities (and the few that a filter
of keys lets through) are shuffled, once; only distinct entities are checked.

Defined results: null texts stay null, empty texts empty, texts without entities
unchanged. Repeated rows and other columns stay. Of overlapping mentions the
earliest counts, of those that begin together the first kind in KINDS. Names
that nothing introduces, and common words, are not told from other words.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import cut, key_filter, passes, salted_join, text_key

#: For the query only; a caller passes a secret of its own.
DEMO_KEY = b"not a secret: pass your own"
SALTS = 16
#: Attempts after which surrogates of a type with little room get longer.
WIDEN = 24

#: Titles that come before a name, by the gender they tell.
TITLES = {"m": ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "M", "Señor", "Sr", "Don", "господин", "г-н"], "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "Doña", "госпожа", "г-жа"], "n": ["Dr", "Prof", "Professor", "Doktor", "Docteur", "Doctor", "доктор"]}
#: Syllables and endings that surrogate names are put together from.
SYLLABLES = {"latin": ["ba", "be", "da", "el", "fi", "ga", "jo", "ka", "le", "li", "ma", "mi", "na", "no", "pe", "ra", "ri", "sa", "so", "ta", "ti", "va", "vi", "za"], "cyrillic": ["ба", "ве", "га", "да", "жа", "ка", "ле", "ли", "ма", "ми", "на", "но", "пе", "ра", "ри", "са", "со", "та", "ти", "фе"]}
ENDINGS = {"latin": {"m": ["n", "r", "s", "k", "d"], "f": ["na", "la", "ra", "sa", "ta"], "n": ["", "n", "l"]}, "cyrillic": {"m": ["н", "р", "с", "к", "й"], "f": ["на", "ла", "ра", "са", "я"], "n": ["", "н", "л"]}}

#: Phrases that a name follows, in lower case.
CUES = ["my name is", "signed by", "mein name ist", "ich heiße", "je m'appelle", "mon nom est", "me llamo", "mi nombre es", "меня зовут"]
#: What a date of birth follows, in lower case.
BIRTH = ["born on", "date of birth", "dob", "geboren am", "geburtsdatum", "né le", "née le", "date de naissance", "nacido el", "nacida el", "fecha de nacimiento"]
#: Words of streets, after or before their names, and what German street names end with.
STREETS = ["Street", "Road", "Avenue", "Lane", "Drive", "Boulevard", "Court", "Square"]
RUES = ["rue", "avenue", "boulevard", "place", "chemin", "Calle", "Avenida", "Plaza", "Paseo"]
STRASSEN = ["straße", "strasse", "weg", "platz", "allee", "gasse"]
#: Country calling codes of two digits; 1 and 7 have one, all others three.
CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

_GENDER = {t.lower(): g for g, ts in TITLES.items() for t in ts}
_CAP = r"[^\W\d_a-zà-ÿа-я][\w'’-]*"
#: Particles inside names, and those that follow one.
PARTICLES = ["van", "von", "vom", "zu", "zum", "zur", "ter", "ten", "de", "del", "della", "di", "da", "dos", "das", "du", "y", "bin", "ibn", "af", "av"]
AFTER = ["der", "den", "dem", "het", "la", "las", "los", "le"]
#: Words that end a name in a text of capitals only, where case doesn't.
COMMON = set(
    "a am an and are as at be been but by can did do does for from had has have he her here him his i if in into is it its me my no not now of on or our out said says she so that the their them then there they this to too "
    "up us was we were what when where which who will with would you your aber als am an auf aus bei das dem den der des die doch ein eine er es für hat ich ihr im in ist mit nach nicht noch oder sagte sein sich sie sind über um und "
    "uns vom von war was wenn wie wir wird zu zum zur au aux avec ce cette dans des dit du elle en est et il ils je la le les leur lui mais ne nous ou où par pas pour qui sa se ses son sont sur un une vous al como con de del dijo "
    "el ella en era es está este fue ha la las lo los más no nos para pero por que se según si sin son su sus un una y ya".split()
)
_WORD = r"(?:[dD]['’])?" + _CAP
_INITIALS = r"(?:[^\W\d_a-zà-ÿа-я]\.)+(?:-(?:[^\W\d_a-zà-ÿа-я]\.)+)?"
_LINK = r"(?:(?:" + "|".join(PARTICLES) + r")[ \u00a0](?:(?:" + "|".join(AFTER) + r")[ \u00a0])?)*"
_NAME = rf"(?P<x>{_LINK}(?:{_INITIALS}|{_WORD})(?:[ \u00a0]?(?<=[ .\u00a0]){_LINK}(?:{_INITIALS}|{_WORD}))*)"
# A class first lets the search skip to the letters that titles begin with; the look behind then asks for a word's begin.
_FIRST = "".join(sorted({t[0] for ts in TITLES.values() for t in ts}))
_TITLED = rf"(?:(?P<t>[{_FIRST}](?<!\w.)(?:" + "|".join(sorted({re.escape(x) for ts in TITLES.values() for t in ts for x in (t[1:], t[1:].upper())}, key=len, reverse=True)) + r"))\.?[ \u00a0])+"
_PLACE = r"(?:(?:de la|de|des|du|del) |d')?" + _CAP
_RULES = [
    ("email", re.compile(r"[\w.%+-]*[\w%+]@[\w-]+(?:\.[\w-]+)+")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?i)(?<![a-z])(?:token|password|passwort|passwd|pwd|secret|api[ _-]?key)[\"']?\s*[=:]\s*[\"']?(?P<x>[A-Za-z0-9_+/-]{6,}=*)")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?P<x>(?:AKIA|ASIA)[A-Z0-9]{12,}|(?:ghp_|gho_|sk-|xox[abp]-)[A-Za-z0-9_-]{10,}|(?=[A-Fa-f]*\d)[0-9A-Fa-f]{32,})(?![A-Za-z0-9])")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")),
    ("ip", re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("card", re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?P<s>[ -])\d{4}(?P=s)\d{4}(?P=s)\d{1,7}|\d{4}(?P<u>[ -])\d{6}(?P=u)\d{5})(?![\w-]|\.\d)")),
    ("phone", re.compile(r"(?<![\w.])(?:(?:\+|00)\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,8}(?:[ .-]\d{2,8}){1,4}(?![\w-]|\.\d)|(?<![\w.])\+\d{8,15}(?!\w)")),
    ("birth", re.compile(r"(?i:\b(?:" + "|".join(BIRTH) + r"))(?:[: ]| is ){1,2}(?P<x>\d{4}-\d{1,2}-\d{1,2}|\d{1,2}(?P<d>[./-])\d{1,2}(?P=d)\d{4})(?!\w)")),
    ("address", re.compile(r"(?<!\w)(?:\d{1,5} (?:" + _CAP + r" ){1,3}(?:" + "|".join(STREETS) + r")|" + _CAP + r"(?:" + "|".join(STRASSEN) + r") \d{1,4}[a-z]?|\d{1,4},? (?:" + "|".join(RUES[:5]) + r") " + _PLACE + r"|(?:" + "|".join(RUES[5:]) + r") " + _PLACE + r",? \d{1,4})(?!\w)")),
    ("name", re.compile(_TITLED + _NAME)),
    ("name", re.compile(r"(?i:\b(?:" + "|".join(CUES) + r"))[: ] ?" + _NAME)),
]
KINDS = [*dict.fromkeys(k for k, _ in _RULES), "initial"]
#: Alphabets whose letters initials change among.
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя"]
_SOME = re.compile(r"[0-9@]|::")
_SECRET = ("token", "passw", "pwd", "secret", "api", "akia", "asia", "ghp_", "gho_", "sk-", "xox")
_STREET = tuple(w.lower() for w in (*STREETS, *RUES, *STRASSEN))
_US = re.compile(r"\d{3}([ .-])\d{3}\1\d{4}")
_DATE = re.compile(r"\d{1,2}([.-])\d{1,2}\1\d{4}|\d{4}([.-])\d{1,2}\2\d{1,2}")
_TITLE = re.compile(_TITLED)
_POSSESSIVE = re.compile(r"['’]s?$")


def luhn(digits: str) -> int:
    """0 if the check digit is right."""
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10


def _iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def network(digits: str) -> int:
    """How many of a card number's first digits tell its network; 0 where no network has such numbers."""
    n, two, four = len(digits), int(digits[:2]), int(digits[:4])
    if digits[0] == "4" and n in (13, 16, 19):
        return 1
    known = n == 16 and (51 <= two <= 55 or 2221 <= four <= 2720 or 3528 <= four <= 3589)
    known |= n == 15 and two in (34, 37) or n == 14 and (two in (36, 38, 39) or 3000 <= four <= 3059)
    known |= n in (16, 19) and (four == 6011 or two == 65 or 6440 <= four <= 6499) or 16 <= n <= 19 and two in (50, 56, 57, 58, 62, 63, 67, 68)
    return 4 if known else 0


def national(text: str, digits: str) -> str:
    """A phone number without country code and trunk zeros, so that its national and international forms are one."""
    if text.startswith("00"):
        digits = digits[2:]
    if text[0] == "+" or text.startswith("00"):
        digits = digits[1 if digits[0] in "17" else 2 if digits[:2] in CODES else 3 :]
    elif len(digits) == 11 and digits[0] == "1":
        digits = digits[1:]
    return digits.lstrip("0")


def normal(kind: str, text: str) -> str | None:
    """The normal form of a mention; None if it isn't one after all."""
    if kind == "ssn":
        return re.sub(r"\D", "", text)
    if kind == "card":
        digits = re.sub(r"\D", "", text)
        return digits if luhn(digits) == 0 and network(digits) else None
    if kind == "phone":
        digits = re.sub(r"\D", "", text)
        plain = digits[0] == "0" and len(digits) >= 9 and not _DATE.match(text) or _US.fullmatch(text)
        if not 8 <= len(digits) <= 15 or not (text[0] in "+(" or plain):
            return None
        return national(text, digits) or None
    if kind == "birth":
        a, b, c = re.split(r"[./-]", text)
        y, m, d = (a, b, c) if len(a) == 4 else (c, b, a)
        return f"{y}-{int(m):02d}-{int(d):02d}" if 1 <= int(m) <= 31 and 1 <= int(d) <= 31 else None
    if kind == "ip" and ":" in text:
        try:
            return str(ipaddress.IPv6Address(text)) if sum(map(bool, text.split(":"))) > 1 else None
        except ValueError:
            return None
    if kind == "iban":
        flat = text.replace(" ", "")
        return flat if _iban_ok(flat) else None
    if kind == "address":
        return " ".join(text.replace(",", " ").lower().split())
    return text.lower() if kind in ("email", "secret") else text


def _name_words(m: re.Match, titled: bool) -> list[tuple[int, int, str, str, str]]:
    """The words of a name found: start, end, kind, normal form, gender (of first names). Titles and particles are no part
    of it; the halves of a double name are words of their own; in a run of capitals a common word ends it."""
    titles = re.findall(r"\S+", m.string[m.start() : m.start("x")]) if titled else []
    if titled and (any(t.rstrip(".").lower() not in _GENDER for t in titles) or titles[-1] == "M"):  # without a point it is a letter
        return []
    told = [g for t in titles if (g := _GENDER[t.rstrip(".").lower()]) != "n"]
    gender, shout = told[-1] if told else "n", m["x"].isupper() and len(m["x"]) > 2
    words, linked = [], False
    for w in re.finditer(r"[^ \u00a0]+", m["x"]):
        low = w[0].rstrip(".").lower()
        if low in _GENDER and (w[0][0].isupper() and len(low) > 1):
            gender = _GENDER[low] if not words and _GENDER[low] != "n" else gender
            continue
        if low in PARTICLES or low in AFTER and (linked or not w[0][0].isupper()):
            linked = True
            continue
        linked = False
        if shout and low in COMMON or not (w[0][0].isupper() or w[0][:2].lower() in ("d'", "d’")):
            break
        words.append(w)
    out = []
    for i, w in enumerate(words):
        first = gender if i + 1 < len(words) else "n"
        for part in re.finditer(r"[^.-]+", w[0]):
            bare = _POSSESSIVE.sub("", part[0])
            at = m.start("x") + w.start() + part.start()
            if bare and any(c.isalpha() for c in bare):
                kind = "initial" if len(bare) == 1 else "name"
                out.append((at, at + len(bare), kind, unicodedata.normalize("NFC", bare).lower(), first if kind == "name" else "n"))
    return out


def find(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """Mentions in order, without overlaps: start, end, kind, normal form, gender ("n" where there is none)."""
    if not text:
        return []
    some = _SOME.search(text)
    low = text.lower()
    secret = any(w in low for w in _SECRET)
    title = _TITLE.search(text)
    cue = any(w in low for w in CUES)
    if not (some or secret or title or cue):
        return []
    wanted = {"email": "@" in text, "birth": some and any(w in low for w in BIRTH), "address": some and any(w in low for w in _STREET)}
    got, named = [], set()
    for order, (kind, rule) in enumerate(_RULES):
        if kind == "name":
            titled = "t" in rule.groupindex
            for m in rule.finditer(text) if (title if titled else cue) else ():
                for start, end, what, n, gender in _name_words(m, titled):
                    got.append((start, order, end, what, n, gender))
                    if what == "name":
                        named.add(text[start:end])
            continue
        if not (secret if kind == "secret" and order == 2 else wanted.get(kind, some or secret)):
            continue
        for m in rule.finditer(text):
            g = "x" if "x" in rule.groupindex else 0
            n = normal(kind, m[g])
            if n is not None:
                got.append((m.start(g), order, m.end(g), kind, n, "n"))
    if named:
        alone = re.compile(r"(?i:(?<!\w)(?:" + "|".join(sorted(map(re.escape, named), key=len, reverse=True)) + r")(?!\w))")
        got += [(m.start(), len(_RULES), m.end(), "name", unicodedata.normalize("NFC", m[0]).lower(), "n") for m in alone.finditer(text) if m[0][0].isupper() or m[0][1] in "'’"]
    out, end = [], 0
    for start, _, stop, kind, n, gender in sorted(got):
        if start >= end:
            out.append((start, stop, kind, n, gender))
            end = stop
    return out


class Stream:
    """Keyed pseudo-random choices for one entity and attempt."""

    def __init__(self, key: bytes, *what: str):
        self.key, self.what, self.n, self.pool = key, "\x00".join(what).encode(), 0, 0
        self.left = 1

    def below(self, n: int) -> int:
        if self.left < n << 32:
            self.pool = int.from_bytes(hmac.new(self.key, self.what + b"\x00%d" % self.n, hashlib.sha256).digest(), "big")
            self.left, self.n = 1 << 256, self.n + 1
        self.pool, r = divmod(self.pool, n)
        self.left //= n
        return r

    def like(self, text: str, hexa: bool = False) -> str:
        """Letters for letters, digits for digits, in the same case; all else stays."""
        letters = "abcdef" if hexa else "abcdefghijklmnopqrstuvwxyz"
        return "".join(str(self.below(10)) if c.isdigit() else letters[self.below(len(letters))].upper() if c.isupper() else letters[self.below(len(letters))] if c.isalpha() else c for c in text)


def _made_word(s: Stream, script: str, gender: str, attempt: int) -> str:
    n = 2 + s.below(2) + attempt // 4
    return "".join(SYLLABLES[script][s.below(len(SYLLABLES[script]))] for _ in range(n)) + ENDINGS[script][gender][s.below(len(ENDINGS[script][gender]))]


def initial(key: bytes, letter: str) -> str:
    """The next letter on a keyed round through the alphabet: another one for each, and never itself."""
    letters = next((a for a in ALPHABETS if letter in a), None)
    if letters is None:
        return Stream(key, "initial", letter).like("a")
    ring = sorted(letters, key=lambda c: hmac.new(key, f"initial\x00{c}".encode(), hashlib.sha256).digest())
    return ring[(ring.index(letter) + 1) % len(ring)]


def surrogate(key: bytes, kind: str, norm: str, gender: str, attempt: int) -> str:
    """The attempt's surrogate, as a normal form. Addresses of the net come from ranges that are nobody's."""
    if kind == "initial":
        return initial(key, norm)
    s = Stream(key, kind, norm, str(attempt))
    room = "0" * max(0, (attempt - WIDEN) // 8 + 1) if attempt >= WIDEN else ""
    if kind == "email":
        local, _, domain = norm.partition("@")
        host, _, tld = domain.rpartition(".")
        d = Stream(key, "domain", domain, str(attempt // 3))
        # From the tenth attempt on a longer name makes room.
        return s.like(local) + s.like("a" * max(0, attempt - 9)) + "@" + d.like(host) + "." + tld
    if kind == "ip":
        if ":" in norm:
            return str(ipaddress.IPv6Address(0x20010DB8 << 96 | s.below(1 << 96)))
        return ".".join(str(x) for x in (240 + s.below(15), s.below(256), s.below(256), 1 + s.below(254)))
    if kind == "card":
        head = network(norm)
        body = norm[:head] + s.like(norm[head:-1])
        return body + next(d for d in "0123456789" if luhn(body + d) == 0) + s.like(room)
    if kind == "phone":
        first = str(2 + s.below(8)) if norm[0] not in "01" else norm[0]
        return first + s.like(norm[1:] + room)
    if kind == "iban":
        body = s.like(norm[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + norm[:2] + "00")) % 97
        return f"{norm[:2]}{check:02d}{body}"
    if kind == "ssn":
        return s.like(norm + room)
    if kind == "birth":
        # The years that may be drawn widen, for there are few dates.
        span = min(8000, 120 + 60 * attempt)
        return f"{max(1000, 1900 - 3 * attempt) + s.below(span):04d}-{1 + s.below(12):02d}-{1 + s.below(28):02d}"
    script = "cyrillic" if any("а" <= c <= "я" or c == "ё" for c in norm) else "latin"
    if kind == "name":
        return _made_word(s, script, gender, attempt)
    if kind == "address":
        out = []
        for w in norm.split():
            end = next((e for e in STRASSEN if w.endswith(e) and w != e), "")
            plain = w in _STREET or w in ("de", "la", "des", "du", "del")
            out.append(w if plain else str(1 + s.below(9)) + s.like(w[1:]) if w[0].isdigit() else _made_word(s, script, "n", attempt) + end)
        return " ".join(out)
    prefix = next((p for p in ("akia", "asia", "ghp_", "gho_", "sk-") if norm.startswith(p)), "")
    rest = norm[len(prefix) :]
    return prefix + s.like(rest + room, hexa=not prefix and bool(re.fullmatch(r"[0-9a-f]+", rest)))


def _cased(new: str, mention: str) -> str:
    return new.upper() if len(mention) > 1 and mention.isupper() else new.capitalize() if mention[:1].isupper() else new


def write(kind: str, mention: str, norm: str, new: str) -> str:
    """The surrogate in the mention's format."""
    if kind in ("card", "phone", "ssn", "iban"):
        # A phone's country code and trunk zeros come before what is replaced.
        kept = sum(c.isalnum() for c in mention) - len(norm)
        it = iter(re.sub(r"[\W_]", "", mention)[:kept] + new)
        return "".join(next(it, "") if c.isalnum() else c for c in mention) + "".join(it)
    if kind == "birth":
        y, m, d = new.split("-")
        parts = re.split(r"([./-])", mention)
        order = (y, m, d) if len(parts[0]) == 4 else (d, m, y)
        return parts[1].join(p if len(o) > 1 else str(int(p)) for p, o in zip(order, parts[::2], strict=True))
    if kind in ("name", "initial"):
        return new.upper() if kind == "initial" else _cased(new, mention)
    if kind == "address":
        comma = re.sub(r"[^,]", "", mention)
        words = [_cased(n, o) for n, o in zip(new.split(), mention.replace(",", " ").split(), strict=True)]
        return " ".join(w + ("," if comma and o.endswith(",") else "") for w, o in zip(words, mention.split(), strict=True))
    letters = [c for c in mention if c.isalpha()]
    if letters and all(c.isupper() for c in letters):
        return new.upper()
    if kind == "secret" and len(new) == len(mention):
        return "".join(n.upper() if o.isupper() else n for n, o in zip(new, mention, strict=True))
    return new


# --- over a corpus ----------------------------------------------------------------------------------------------------


def mentions(texts: DataFrame) -> DataFrame:
    """(k, text) -> k, start, end (code points), kind, norm, tag: a row for each mention, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *m) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in find(t)]
            types = (pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["k", "start", "end", "kind", "norm", "tag"])

    return texts.mapInArrow(run, "k binary, start int, end int, kind string, norm string, tag string")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, tag), distinct by kind and norm -> kind, norm, surrogate, distinct over kind and free of the corpus' own
    norms. Each round settles nearly all that is left, so there are few."""

    @F.arrow_udf(T.StringType())
    def draw(kinds: pa.Array, norms: pa.Array, tags: pa.Array, attempts: pa.Array) -> pa.Array:
        return pa.array([surrogate(key, *x) for x in zip(*(c.to_pylist() for c in (kinds, norms, tags, attempts)), strict=True)], pa.string())

    own = entities.select("kind", F.col("norm").alias("surrogate"), F.lit(True).alias("own"))
    open_, settled = entities.withColumn("attempt", F.lit(0)), None
    while True:
        drawn = open_.withColumn("surrogate", draw("kind", "norm", "tag", "attempt"))
        taken = own if settled is None else own.unionByName(settled.select("kind", "surrogate", F.lit(True).alias("own")))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("norm").alias("winner"))
        drawn = drawn.join(first, ["kind", "surrogate"]).join(taken.distinct(), ["kind", "surrogate"], "left")
        good = F.col("own").isNull() & (F.col("norm") == F.col("winner"))
        drawn = cut(drawn.select("kind", "norm", "tag", "attempt", "surrogate", good.alias("good")))
        won = drawn.where("good").select("kind", "norm", "surrogate")
        settled = won if settled is None else settled.unionByName(won)
        open_ = drawn.where("NOT good").select("kind", "norm", "tag", (F.col("attempt") + 1).alias("attempt"))
        if open_.isEmpty():
            return settled


def replaced(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """The same rows with their text replaced, and ``__found``, the mentions that were (start, end, kind, norm, surrogate)."""
    # Equal texts have equal mentions: what one copy has stands for all.
    found = cut(mentions(docs.select(text_key(F.col(text)).alias("k"), text).where(F.col(text).isNotNull())).distinct())
    told = [F.count(F.when(F.col("tag") == g, 1)).alias(g) for g in "mf"]
    gender = F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("n")
    entities = cut(found.groupBy("kind", "norm").agg(*told).select("kind", "norm", gender.alias("tag")))
    # An initial isn't anyone's: letters change places, which keeps them apart without a check.
    letter = F.arrow_udf(lambda norms: pa.array([initial(key, n) for n in norms.to_pylist()], pa.string()), T.StringType())
    mapping = assign(entities.where("kind <> 'initial'"), key).unionByName(entities.where("kind = 'initial'").select("kind", "norm", letter("norm").alias("surrogate")))
    # A hot entity's mentions are dealt over SALTS keys.
    salted = mapping.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mapped = found.withColumn("salt", F.pmod(F.hash("k"), F.lit(SALTS))).join(salted, ["kind", "norm", "salt"])
    # A group is one text's mentions.
    new = cut(mapped.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "norm", "surrogate"))).alias("__found")))

    @F.arrow_udf(T.StringType())
    def put(texts: pa.Array, founds: pa.Array) -> pa.Array:
        out = []
        for t, ms in zip(texts.to_pylist(), founds.to_pylist(), strict=True):
            parts, at = [], 0
            for m in ms or ():
                parts += [t[at : m["start"]], write(m["kind"], t[m["start"] : m["end"]], m["norm"], m["surrogate"])]
                at = m["end"]
            out.append("".join(parts) + t[at:])
        return pa.array(out, pa.string())

    keyed = docs.withColumn("__k", text_key(F.col(text)))
    may = passes(F.xxhash64("__k"), key_filter(new.select(F.xxhash64("k"))), docs.sparkSession) & F.col(text).isNotNull()
    none = F.array().cast(new.schema["__found"].dataType)
    some = salted_join(keyed.where(may), new.withColumnRenamed("k", "__k"), ["__k"])
    some = some.withColumns({text: put(text, "__found"), "__found": F.coalesce("__found", none)})
    return keyed.where(~may).withColumn("__found", none).select(*docs.columns, "__found").unionByName(some.select(*docs.columns, "__found"))


def op6(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    got = replaced(docs.select("doc_id", "text"), key)
    kinds = F.col("__found.kind")
    return got.select("doc_id", "text", F.size("__found").cast("long").alias("n_entities"), F.size(F.array_distinct(F.transform("__found", lambda m: F.concat(m["kind"], F.lit(" "), m["norm"])))).cast("long").alias("n_distinct"), F.array_sort(F.array_distinct(kinds)).alias("kinds"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with surrogates for its personal data; n_chars follows the text."""
    got = replaced(docs, DEMO_KEY)
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return got.select(docs.columns)
