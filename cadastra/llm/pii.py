"""PII: detected entities give way to keyed surrogates of the same type.

Detected are e-mail addresses, telephone numbers (international, North American, and
national ones that begin with 0), IPv4 and IPv6 addresses, payment card numbers, IBANs,
social security numbers, secrets (tokens and keys) and names of persons behind a title or
words that introduce a name, with the bare recurrences of those names in the same document.
A surrogate comes from an HMAC of the entity's normal form under a secret key, and keeps the
format: separators, length, case, script, the country code, the leading 0 and exchange 555
of a telephone number, the checksum of a card or IBAN and its country, the private range of
an address, the gender of a name. Surrogate mail domains and the areas of social security
numbers are reserved ones.

Coreference: equal normal forms (case, spacing and punctuation aside) have one surrogate
in the whole corpus; the parts of a name are entities of their own, so "Mr Smith" and a bare
"Smith" follow "Mr John Smith". A bare part is taken as the name only when it is capitalised
(wholly in capitals, if the name was so wherever it had its title). Distinctness: the
surrogates of all distinct entities are compared with each other and with all entities,
names of all kinds together; one that is taken is drawn again until none is, names with one
more part each time. These draws (normally few) reach their documents by a join.

Edge cases: a null text stays null and has no entities; entities do not overlap, the
leftmost wins; repeated rows are treated alike; an empty table gives an empty result;
columns named n_entities or entities are replaced, all others stay as they are.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastra.llm.tables import fresh, small, written
from cadastra.llm.text import frugal

#: The setting that holds the secret key, and the key of tests, where it is unset.
KEY_SETTING, KEY = "spark.cadastra.pii.key", b"cadastra surrogate key"
MASCULINE = ("Mr", "Sir", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Κύριος")
FEMININE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Mme", "Mlle", "Madame", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof", "Doctor", "Professor", "Доктор", "Профессор")
CAPITAL = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme")
TITLE = {t: g for g, names in (("m", MASCULINE), ("f", FEMININE), ("n", NEUTRAL)) for t in names}
TITLE |= {t.upper(): TITLE[t] for t in CAPITAL}
#: Words that introduce a name.
CUES = ("My name is", "my name is", "Je m'appelle", "Je m’appelle", "je m'appelle", "je m’appelle", "Me llamo", "me llamo", "Mi nombre es", "Mein Name ist", "mein Name ist", "Ich heiße", "ich heiße", "Меня зовут", "меня зовут")
NAMES = {
    "latin": {
        "m": "Adrian Bruno Carlos Dario Emil Felix Gaspar Henrik Ivo Jonas Kaspar Leon Marco Nestor Oskar Paul Quentin Ramon Simon Tomas Ulrich Viktor Walter Xavier Yannick Zeno".split(),
        "f": "Adela Beatriz Clara Daria Elena Flora Greta Helene Ines Julia Karin Lucia Marta Nadia Olivia Paula Renata Sofia Teresa Ursula Vera Wanda Xenia Yvonne Zelda".split(),
        "n": "Alex Camille Charlie Dominique Eden Frankie Jamie Jules Kim Lou Morgan Noa Quinn Robin Sam Sascha".split(),
        "s": "Albrecht Barreto Castell Delmas Eberle Fontana Gerard Hartwig Ibarra Jansen Keller Lambert Marchand Navarro Olsen Perrin Quiroga Richter Salinas Thibault Urban Vidal Winkler Ximenes Ybarra Zeller".split(),
    },
    "cyrillic": {"m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл".split(), "f": "Анна Вера Галина Дарья Елена Ирина Ксения Мария".split(), "n": "Женя Саша Слава Валя".split(), "s": "Белов Волков Громов Дроздов Зимин Ильин Климов Лосев".split()},
    "greek": {"m": "Άρης Γιώργος Δήμος Ηλίας Κώστας Λουκάς Μάρκος Νίκος".split(), "f": "Άννα Γεωργία Δήμητρα Ελένη Ζωή Κατερίνα Μαρία Σοφία".split(), "s": "Βλάχος Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Λάμπρου Μάρκου Παππάς".split()},
}
#: Given names whose gender is known without a title.
GIVEN = {
    "m": "Ahmed Alexander Andrew Anthony Antonio Carlos Charles Christian Daniel David Edward Francisco George Hans Henry Ivan James Jean John Jose Joseph José Juan Jürgen Klaus Luis Manuel Mark Martin Matthew Michael Mohamed Nicolas Paul Pedro Peter Philippe Pierre Richard Robert Stefan Steven Thomas William Wolfgang".split(),
    "f": "Alice Amanda Ana Andrea Angela Anna Anne Barbara Carmen Catherine Charlotte Claire Elena Elizabeth Emily Emma Fatima Françoise Helen Ingrid Isabel Jennifer Jessica Julie Karen Laura Linda Lisa Lucy Margaret Maria Marie María Mary Monika Nathalie Patricia Petra Sabine Sandra Sarah Sophie Susan Sylvie Ursula".split(),
}
GENDER = {n.casefold(): g for g in "mf" for names in (*(NAMES[s][g] for s in NAMES), GIVEN[g]) for n in names}
PERSON = ("m", "f", "n", "surname")
#: Letters that stand for letters of the same script.
SCRIPTS = ["abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "אבגדהוזחטיכלמנסעפצקרשת", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह"]
_NAME = r"[^\W\d_]['’\-]?[^\W\d_]+(?:['’\-][^\W\d_]+)*"
PATTERN = re.compile(
    r"(?P<email>[\w.%+\-]{1,64}@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+)"
    r"|(?P<secret>(?<![\w])(?:[0-9a-fA-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_\-]{20,})(?![\w])"
    r"|(?<=[=:] )[\"'](?=[^\"']*\d)[\w+/\-.]{16,}[\"'](?!\w))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ssn>(?<![\w.\-])\d{3}-\d{2}-\d{4}(?![\w\-]))"
    r"|(?P<ipv6>(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|::)(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{1,4}(?![\w:]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
    r"|(?P<card>(?<![\w.])\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?![\w]|\.\d))"
    r"|(?P<phone>(?<![\w.])(?:\+?\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])?\d{3}[.\-]\d{4}(?![\w\-])"
    r"|(?<![\w.])\+\d{1,3}(?:[ .\-]?\(?\d{1,4}\)?)?(?:[ .\-]?\d{2,4}){2,4}(?![\w])"
    r"|(?<![\w.+\-])0(?:\d(?:[ .\-]\d{2}){4}|\d{2,4}[ /\-]\d{5,8})(?![\w\-]))"
    rf"|(?P<person>(?<!\w)(?P<lead>(?:{'|'.join(sorted(TITLE, key=len, reverse=True))})\.?|{'|'.join(CUES)})[ ]+{_NAME}(?:[ ]{_NAME}){{0,2}})"
)
_HINT = re.compile(r"[0-9@]")
_WORD = re.compile(rf"(?<![\w'’\-]){_NAME}")
_OWNER = re.compile(r"['’][sS]$")


class _Draw:
    """Numbers below given bounds from an HMAC stream."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.n, self.pool = key, "\0".join(parts).encode(), 0, b""

    def __call__(self, below: int) -> int:
        while len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % below

    def letter(self, c: str) -> str:
        low = c.lower()
        for letters in SCRIPTS:
            if low in letters:
                new = letters[self(len(letters))]
                return new.upper() if c != low and len(new.upper()) == 1 else new
        return c

    def like(self, text: str) -> str:
        return "".join(str(self(10)) if "0" <= c <= "9" else self.letter(c) if c.isalpha() else c for c in text)


def luhn(digits: str) -> int:
    """The checksum's remainder: 0 for a valid number."""
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def iban(value: str) -> int:
    """The remainder of an IBAN without blanks: 1 for a valid one."""
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def _address(value: str) -> bool:
    """Whether this is an IPv6 address with a digit and three groups at least, so no time and no name of a program."""
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return any(c.isdigit() for c in value) and len([g for g in value.split(":") if g]) >= 3


def _persons(text: str, m: re.Match):
    """(start, end, kind, normal form) of the parts of a name behind a title or cue."""
    title = TITLE.get(m["lead"].rstrip("."), "n")
    names = m[0][len(m["lead"]) :].split()
    names = names[: next((i for i, n in enumerate(names) if not n[0].isupper() or n in TITLE), len(names))]
    if m["lead"].isupper():  # the words after a name are in capitals, too
        names = names[: next((i for i, n in enumerate(names) if not n.isupper()), 2)][:2]
    at = m.end("lead")
    for i, name in enumerate(names):
        name = _OWNER.sub("", name)
        a = text.index(name, at)
        at, value = a + len(name), name.casefold()
        given = i == 0 and (len(names) > 1 or m["lead"] in CUES)
        yield a, at, (GENDER.get(value, "n") if title == "n" else title) if given else "surname", value


def entities(text: str):
    """(start, end, kind, normal form) of the entities of a text, left to right."""
    if not (_HINT.search(text) or any(t in text for t in TITLE) or any(c in text for c in CUES)):
        return []
    found, known, end = [], {}, 0
    while m := PATTERN.search(text, end):
        kind, value, end = m.lastgroup, m[0], m.end()
        if kind == "person":
            end = m.end("lead")
            for a, e, kind, name in _persons(text, m):
                found.append((a, e, kind, name))
                old, capital = known.get(name, (kind, True))
                known[name] = (kind if old == "n" else old, capital and text[a:e].isupper())
                end = e
        elif kind == "secret":
            quoted = value[0] in "\"'"
            found.append((m.start() + quoted, m.end() - quoted, kind, value.strip("\"'").lower()))
        elif kind == "card" and (not 13 <= len(_digits(value)) <= 19 or luhn(_digits(value))):
            continue  # a number without a valid checksum is no card
        elif kind == "iban" and iban(value.replace(" ", "")) != 1 or kind == "ipv6" and not _address(value):
            end = m.start() + 1  # nor is this an account or address, but one may follow
        else:
            found.append((m.start(), m.end(), kind, _digits(value) if kind in ("card", "phone", "ssn") else value.replace(" ", "").lower()))
    if not known:
        return found
    found = [(a, e, known[v][0] if k == "n" else k, v) for a, e, k, v in found]
    bare, i = [], 0
    for w in _WORD.finditer(text):
        name = _OWNER.sub("", w[0])
        kind, capital = known.get(name.casefold(), (None, False))
        if kind and (name.isupper() if capital else name[0].isupper()):
            a, e = w.start(), w.start() + len(name)
            while i < len(found) and found[i][1] <= a:
                i += 1
            if i == len(found) or found[i][0] >= e:
                bare.append((a, e, kind, name.casefold()))
    return sorted(found + bare)


def _script(word: str) -> str:
    return "cyrillic" if re.search(r"[Ѐ-ӿ]", word) else "greek" if re.search(r"[Ͱ-Ͽἀ-῿]", word) else "latin"


def surrogate(kind: str, value: str, attempt: int, key: bytes = KEY) -> str:
    """The normal form that stands for an entity's normal form."""
    draw = _Draw(key, kind, value, str(attempt))
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        part = _Draw(key, "domain", domain, "0").like(domain.rsplit(".", 2)[0])
        ending = ".".join(domain.split(".")[-2:])
        return f"{draw.like(local)}@{part}.{ending if ending in ('example.com', 'example.org', 'example.net') else 'example.org'}"
    if kind == "phone":
        at = len(value) - 7  # the last seven digits: exchange and line
        keep = value[:-10] if len(value) >= 10 else ""
        exchange = value[at : at + 3] if at >= 0 else ""
        rest = value[len(keep) :]
        new = draw.like(rest)
        if not keep and value[0] == "0":
            new = "0" + new[1:]
        return keep + (new[:-7] + exchange + new[-4:] if exchange == "555" else new)
    if kind == "card":
        new = value[0] + draw.like(value[1:])
        return new[:-1] + next(d for d in "0123456789" if luhn(new[:-1] + d) == 0) if luhn(value) == 0 else new
    if kind == "iban":
        body = "".join(c if c.isalpha() and i < 4 else draw.like(c) for i, c in enumerate(value[4:])).upper()
        return f"{value[:2]}{98 - iban(value[:2].upper() + '00' + body):02d}{body.lower()}"
    if kind == "ssn":
        return f"9{draw.like(value[1:])}"
    if kind == "ipv6":
        groups = value.split(":")
        keep = 1 if re.match("f[cde]", value) else 0
        return ":".join(g if i < keep else "".join("123456789abcdef"[draw(15)] for _ in g) for i, g in enumerate(groups))
    if kind == "ip":
        octets = value.split(".")
        keep = 1 if octets[0] in ("10", "127") else 2 if octets[:2] == ["192", "168"] or octets[0] == "172" and 16 <= int(octets[1]) <= 31 else 0
        return ".".join([*octets[:keep], *(str(draw(223 if i == 0 else 254) + 1) for i in range(keep, 4))])
    if kind == "secret":
        hexadecimal = re.fullmatch("[0-9a-f]+", value)
        return "".join("0123456789abcdef"[draw(16)] if hexadecimal else draw.like(c) for c in value)
    script = _script(value)
    names = NAMES[script].get("s" if kind == "surname" else kind) or NAMES[script]["s"]
    ending = "а" if script == "cyrillic" and kind == "surname" and value.endswith("а") else ""
    return "-".join(names[draw(len(names))].casefold() for _ in range(1 + attempt)) + ending


def dressed(kind: str, original: str, new: str) -> str:
    """A surrogate's normal form in the format of the original."""
    if kind in ("card", "phone", "ssn"):
        it = iter(new)
        return "".join(next(it) if c.isdigit() else c for c in original)
    if kind == "iban":
        it = iter(new.upper())
        return "".join(" " if c == " " else next(it) for c in original)
    if original.isupper() and len(original) > 1:
        return new.upper()
    if kind in PERSON:
        return "-".join(part[:1].upper() + part[1:] for part in new.split("-"))
    if len(new) == len(original):
        return "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for n, o in zip(new, original, strict=True))
    return new


def _found(batches):
    for b in batches:
        seen = {(kind, value) for t in b.column("text") if t.is_valid for *_, kind, value in entities(t.as_py())}
        kinds, values = zip(*sorted(seen), strict=True) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"])


def secret(docs: DataFrame) -> bytes:
    """The key that the session's settings hold."""
    own = docs.sparkSession.conf.get(KEY_SETTING, None)
    return own.encode() if own else KEY


def redrawn(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, value, attempt) of the entities whose first surrogate is taken by another one or is itself an entity."""
    every = written(docs.select("text").mapInArrow(frugal(_found), "kind string, value string").distinct())

    def draw(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("kind", "value", "attempt")), strict=True)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("kind", "value", "attempt")), pa.array([surrogate(k, v, a, key) for k, v, a in rows], pa.string())], names=["kind", "value", "attempt", "new"])

    shape = "kind string, value string, attempt int, new string"
    # few names stand for many would be a loss, so all surrogates of one sort must differ
    sort = F.when(F.col("kind").isin(*PERSON), "person").otherwise(F.col("kind"))
    taken = every.select(sort.alias("sort"), F.col("value").alias("new")).distinct()
    now = written(every.withColumn("attempt", F.lit(0)).mapInArrow(draw, shape))
    while True:
        held = now.groupBy(sort.alias("sort"), "new").agg(F.min(F.struct(-F.col("attempt"), "kind", "value")).alias("own"))
        free = held.join(taken, ["sort", "new"], "left_anti").select("own.kind", "own.value")
        again = written(now.join(free, ["kind", "value"], "left_anti").select("kind", "value", (F.col("attempt") + 1).alias("attempt")))
        if again.isEmpty():
            return now.filter("attempt > 0").select("kind", "value", "attempt")
        kept = now.join(free, ["kind", "value"], "left_semi").select("kind", "value", "attempt", "new")
        now = written(kept.unionByName(again.mapInArrow(draw, shape)))


def replace(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """docs with surrogates in text, n_entities and entities (kind, begin, end in the new text); the key, if not given, is the session's."""
    key = key or secret(docs)
    again = written(redrawn(docs, key))
    keep = [c for c in docs.columns if c not in ("n_entities", "entities")]
    kinds = T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_entities", T.LongType()), T.StructField("entities", T.ArrayType(kinds))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    draws_, key_, text_ = fresh(rows, "_again", "_key", "_text")
    if again.isEmpty():
        rows = rows.withColumn(draws_, F.lit(None).cast("map<string,int>"))
    else:

        def occur(batches):
            for b in batches:
                rows = {(k, kind, value) for k, t in zip(b.column("_key").to_pylist(), b.column("text"), strict=True) if t.is_valid for *_, kind, value in entities(t.as_py())}
                cols = list(zip(*sorted(rows), strict=True)) if rows else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=[text_, "kind", "value"])

        there = docs.select("text", F.xxhash64("text").alias("_key")).mapInArrow(occur, f"{text_} long, kind string, value string")
        there = there.join(small(again, 64), ["kind", "value"]).distinct().groupBy(text_)
        there = written(there.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "kind", "value"), "attempt"))).alias(draws_)))
        rows = rows.withColumn(key_, F.xxhash64("text")).join(small(there, 128), F.col(key_) == F.col(text_), "left").drop(key_, text_)

    def run(batches):
        known: dict = {}
        for b in batches:
            texts, found = [], []
            for t, draws in zip(b.column("text"), b.column(draws_).to_pylist(), strict=True):
                text, spans, out, at, grown = t.as_py(), [], [], 0, 0
                draws = dict(draws or ())
                for a, e, kind, value in entities(text) if text else ():
                    turn = draws.get(f"{kind} {value}", 0)
                    if (new := known.get((kind, value, turn))) is None:
                        if len(known) > 100_000:
                            known.clear()
                        new = known[kind, value, turn] = surrogate(kind, value, turn, key)
                    new = dressed(kind, text[a:e], new)
                    out += [text[at:a], new]
                    spans.append({"kind": kind, "begin": a + grown, "end": a + grown + len(new)})
                    grown += len(new) - (e - a)
                    at = e
                texts.append(text if not spans else "".join([*out, text[at:]]))
                found.append(spans)
            cols = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([len(x) for x in found], pa.int64()), pa.array(found, arrow)], names=[*keep, "n_entities", "entities"])

    return rows.mapInArrow(frugal(run), schema)
