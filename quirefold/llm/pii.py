"""Surrogates for personal data.

Entities (e-mail and IP addresses, phone, card, account and social-security numbers, secrets, persons after a title) get
replacements of their own kind, drawn by a keyed hash of kind and normal form: the same person or number gets the
same surrogate in every document, in the format in which it stands there. Digits stay digits, letters letters of
the same script and case, and a valid card number stays valid.

A person's given and family names are entities of their own, so `Mr. John Smith`, `Dr. Smith` and `Smith's` keep one
family name, and full names are told apart by their parts. A given name is drawn for the gender of the titles that it
stands after in the whole table; initials are rotated through the alphabet by a keyed number. Names of a person with
a title are replaced wherever they stand in that text, with a title or without.

Collision checks run over the distinct entities of the whole table: a surrogate may neither be another entity's
surrogate nor a value that occurs in the table; the losers (all but the least) draw again, from a larger pool of names,
until none is left. Only those that drew again must be looked up when texts are rewritten. They travel to the executors
while there are at most LOOKUP of them; beyond that, the texts that hold one are rewritten through a join.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ._common import Scratch, bundle, carried, mapped, named, table

LOOKUP = 100_000
#: The session's setting that holds the secret key; without it this key is used, which keeps nothing secret.
KEY_SETTING, KEY = "spark.quirefold.pii.key", b"surrogates"

#: Combining signs, which \w leaves out.
MARKS = "\u0300-\u036f\u0591-\u05c7\u064b-\u065f\u0900-\u0dff\u0e31-\u0e4e"
TITLE = "(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)"
#: Initials, or a word that is no title.
PART = rf"(?:(?:[^\W\d_]\.-?)+(?![^\W\d_]\w)|(?!{TITLE}\b)[^\W\d_][\w{MARKS}'’-]*)"
PARTICLES = {"von", "vom", "van", "de", "der", "den", "del", "della", "di", "da", "dos", "du", "la", "le", "ter", "ten", "zu", "zur", "al", "el", "bin", "ibn", "y", "af", "av"}
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: In order of precedence; group 1, where there is one, is the entity.
PATTERNS = (
    ("email", re.compile(rf"(?<![\w.+{MARKS}-])[\w.+{MARKS}-]{{1,64}}@[\w{MARKS}-]+(?:\.[\w{MARKS}-]+)*\.(?:[A-Za-z]{{2,24}}|[^\W\d_A-Za-z]{{2,24}})"), "@"),
    ("secret", re.compile(r"(?i)\b(?:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|auth)\b[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_+/=.-]{12,})"), "0"),
    ("secret", re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{32,128})\b"), "0"),
    ("iban", re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])"), "0"),
    ("ip6", re.compile(rf"(?<![\w:])(?:[0-9A-Fa-f]{{0,4}}:){{2,7}}(?:(?:{OCTET}\.){{3}}{OCTET}|[0-9A-Fa-f]{{1,4}}|(?<=::))(?!\w)(?!:[\w:])"), ":"),
    ("ip", re.compile(rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?![\d]|\.\d)"), "0"),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), "0"),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)"), "0"),
    ("card", re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"), "0"),
    ("phone", re.compile(r"(?<![\w-])(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[.-]\d{4}(?![\w-])"), "0"),
    ("phone", re.compile(r"(?<![\w-])(?:1[ .-])?(?:\([2-9]\d{2}\) ?|[2-9]\d{2} )\d{3} \d{4}(?![\w-])"), "0"),
    # national numbers with their trunk zero: pairs, short groups, two or three groups, an area code in brackets, or in one
    ("phone", re.compile(
        r"(?<![\w.,:/-])(?:0\d(?:[ .-]\d\d){4}|0\d{2,4}[ /-]\d{2,3}(?:[ -]\d{2,3}){2,3}|0\d{1,4}[ /-]\d{3,4}[ -]\d{3,4}|0\d{1,5} ?[ /-] ?\d{4,9}"
        r"|\(0\d{1,5}\) ?\d{2,9}(?:[ -]\d{2,5}){0,3}|0[1-9]\d{8,9})(?![\w-]|[.,]\d)"
    ), "0"),
    ("person", re.compile(rf"\b(?:{TITLE}\b\.? )+({PART}(?: {PART})*)"), "M"),
)
MALE, FEMALE = ("Mr", "Herr", "Monsieur", "Señor"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora")


def _first(consonants: str, vowels: str) -> tuple[str, ...]:
    return tuple(c + v for c in consonants.split() for v in vowels.split())


#: By script: first syllables, those put in between by later draws, and the ends of male and female given and of family names.
SYLLABLES = {
    "latin": (
        _first("B D F G H J K L M N P R S T V W", "a e i o u"), _first("b d l m n r s t", "a e i o"), ("rin", "lon", "ric", "mund", "das", "vin", "bert", "nard", "lius", "thar"),
        ("ra", "lina", "nia", "ssa", "tta", "rielle", "mira", "ndra", "via", "lisa"), ("rtel", "lden", "nsen", "ckman", "mford", "rgate", "ller", "ngton", "rwick", "sberg", "nton", "vers", "rham", "nnet", "ddow", "lkin"),
    ),
    "cyrillic": (
        _first("Б В Г Д З К Л М Н П Р С Т", "а е и о у"), _first("б в л м н р т", "а е и о"), ("дрей", "рис", "ктор", "лан", "мир", "слав"),
        ("нна", "рина", "льга", "лена", "мира", "слава"), ("лов", "рин", "шев", "нков", "ров", "син", "вцов", "дин"),
    ),
    "greek": (
        _first("Β Γ Δ Κ Λ Μ Ν Π Ρ Σ Τ Φ", "α ε ι ο"), _first("β λ μ ν ρ τ", "α ε ι ο"), ("νος", "ρης", "λος", "τας"),
        ("νη", "ρία", "φία", "λένη"), ("δης", "νου", "ρας", "τσης", "πουλος", "κης"),
    ),
}
#: Given names (male, female) and family names by script, of two parts.
NAMES = {script: tuple(tuple(x + y for x in first for y in ends) for ends in rest) for script, (first, _, *rest) in SYLLABLES.items()}


def normal(kind: str, value: str) -> str:
    if kind == "email":
        return value.lower()
    if kind == "ip6":
        return str(ipaddress.IPv6Address(value))  # one address, one spelling
    if kind == "iban":
        return value.replace(" ", "")
    if kind in ("phone", "card", "ssn"):
        return ("+" if value[0] == "+" else "") + "".join(c for c in value if c.isdecimal())
    return value


def address(value: str) -> bool:
    """Whether it is an IPv6 address, and not words between colons."""
    try:
        return any(c.isdecimal() for c in value) and bool(ipaddress.IPv6Address(value))
    except ValueError:
        return False


POSSESSIVE = re.compile(r"(?<=\w)['’]s?\Z")
INITIALS = re.compile(r"(?:[^\W\d_]\.-?)+\Z|[^\W\d_]\Z")


def name_length(value: str) -> int:
    """The places that a name takes of the words after a title: parts with a capital, and particles before one; two
    parts at most in scripts without capitals, where nothing tells a name from what follows it. A possessive ends it
    and is no part of it."""
    end = at = parts = 0
    for word in value.split(" "):
        at += len(word)
        plain = not (word[0].isupper() or word[0].islower() or word[0].istitle())
        if word[0].islower() and word not in PARTICLES or plain and parts == 2:
            break
        if not word[0].islower():
            end, parts = at, parts + 1
            if m := POSSESSIVE.search(word):
                return end - len(m[0])
        at += 1
    return end


def parts(kind: str, value: str) -> list[tuple[str, str, str]]:
    """(kind, gender, part) of a person's names: given names and initials, then the family name; particles are left out."""
    gender = kind.split(":")[1]
    words = [w for w in value.split(" ") if w not in PARTICLES]
    out = [("initials" if INITIALS.match(w) else "given", gender, w) for w in words]
    if not kind.endswith(":given") and out:
        out[-1] = ("family", "", words[-1])
    return out


def _repeats(text: str, rest: str, persons: list[tuple[str, str]]) -> list[tuple[int, int, str, str]]:
    """Names of these persons that stand in what is left of the text without a title."""
    known: dict[str, tuple[str, str]] = {}
    for kind, value in persons:
        for what, gender, part in parts(kind, value):
            if what != "initials" and len(part) > 1 and part[0].isupper() and known.get(part, ("",))[0] != "family":
                known[part] = (what, gender)
    if not known:
        return []
    out, end, run = [], -1, []

    def done() -> None:
        if run:
            s, e, words = run[0][0], run[-1][1], [w for _, _, w in run]
            families = [i for i, w in enumerate(words) if known[w][0] == "family"]
            genders = {known[w][1] for w in words} & {"m", "f"}
            gender = genders.pop() if len(genders) == 1 else "n"
            # names run up to a family name, or are given names only
            if families and families[0] < len(words) - 1:
                cut = families[0] + 1
                first, more = run[:cut], run[cut:]
                out.append((first[0][0], first[-1][1], f"person:{gender}", " ".join(w for *_, w in first)))
                run[:] = more
                done()
                return
            out.append((s, e, f"person:{gender}" + ("" if families else ":given"), " ".join(words)))
            run.clear()

    for m in re.finditer(rf"[^\W\d_][\w{MARKS}-]*(?:['’](?!s\b)[\w{MARKS}-]+)*", rest):
        if m[0] not in known:
            continue
        if run and not (m.start() == end + 1 and rest[end] == " "):
            done()
        run.append((m.start(), m.end(), m[0]))
        end = m.end()
    done()
    return out


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the entities, in order and apart from each other."""
    number, mail = re.search(r"\d", text), "@" in text
    colons = number and ("::" in text or text.count(":") > 5)
    title = re.search(r"\b(?:M(?:r|s|iss|onsieur|adame)|Dr|Prof|Herr|Frau|Señor)", text)
    got: list[tuple[int, int, str, str]] = []
    rest = text  # what has been found is blotted out, so that no later pattern runs into it
    for kind, pattern, needs in PATTERNS:
        if not {"@": mail, "0": number, ":": colons, "M": title}[needs]:
            continue
        before = len(got)
        for m in pattern.finditer(rest):
            s, e = m.span(pattern.groups)
            value = m[pattern.groups]
            if kind == "person":
                n = name_length(value)
                if not n:
                    continue
                value, e = value[:n], s + n
                titles = [t.rstrip(".") for t in m[0][: s - m.start()].split()]
                kind_of = "person:" + ("m" if any(t in MALE for t in titles) else "f" if any(t in FEMALE for t in titles) else "n")
            else:
                kind_of = kind
                if kind == "secret" and not any(map(str.isdigit, value)) or kind == "iban" and iban_rest(normal(kind, value)) != 1 or kind == "ip6" and not address(value):
                    continue
                if kind == "phone" and not 9 <= sum(map(str.isdecimal, value)) <= 20:  # shorter ones are dates and the like
                    continue
            got.append((s, e, kind_of, normal(kind, value)))
        if len(got) > before:
            left, at = [], 0
            for s, e, *_ in got[before:]:  # in order of their starts
                left += [rest[at:s], "\0" * (e - s)]
                at = e
            rest = "".join([*left, rest[at:]])
    if title:
        got += _repeats(text, rest, sorted({x[2:] for x in got if x[2].startswith("person")}))
    return sorted(got)


@cache
def _class(c: str) -> str:
    """The letters or signs of the script and case of c that stand near it."""
    kind, script = unicodedata.category(c), unicodedata.name(c, "").split(" ")[0]
    for width in (128, 1024, 8192):
        base = ord(c) // width * width
        own = [x for x in map(chr, range(max(base, 128), base + width)) if unicodedata.category(x) == kind and unicodedata.name(x, "").split(" ")[0] == script]
        if len(own) >= 8:
            return "".join(own)
    return "abcdefghijklmnopqrstuvwxyz"


class Draw:
    """Numbers below given limits, from a keyed hash."""

    def __init__(self, key: bytes, *what: str):
        self.key, self.what, self.n, self.left = key, "\0".join(what).encode(), 0, 0

    def below(self, limit: int) -> int:
        if self.left < 1 << 64:
            self.left = int.from_bytes(hmac.digest(self.key, self.what + b"\0%d" % self.n, hashlib.sha512), "big")
            self.n += 1
        self.left, r = divmod(self.left, limit)
        return r

    def alike(self, text: str) -> str:
        """Each letter or digit by one of its class; the rest stays."""
        out = []
        for c in text:
            if c.isascii() and c.isalpha():
                out.append(chr((65 if c.isupper() else 97) + self.below(26)))
            elif c.isdecimal():
                out.append(str(self.below(10)))
            elif "а" <= c <= "я":
                out.append(chr(0x430 + self.below(32)))
            elif unicodedata.category(c)[0] in "LM":
                near = _class(c)
                out.append(near[self.below(len(near))])
            else:
                out.append(c)
        return "".join(out)


def luhn(digits: str) -> int:
    """The checksum; 0 for a valid number."""
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10


def iban_rest(value: str) -> int:
    """1 for a valid account number."""
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def composed(kind: str, value: str, made: Callable[[str, str, str], str]) -> str:
    """A person's names, each by its own surrogate."""
    return " ".join(made(*part) for part in parts(kind, value))


def surrogate(kind: str, value: str, attempt: int, key: bytes = KEY) -> str:
    """The surrogate of a normal form, in normal form; each further attempt on a name draws from a pool many times larger."""
    d = Draw(key, kind.split(":")[0], value, str(attempt))
    if kind == "email":
        local, host = value.rsplit("@", 1)
        site = Draw(key, "host", host).alike(host.split(".")[0])  # one host, one surrogate
        return f"{d.alike(local) + ('' if len(local) > 3 else d.alike('aaaa'))}@{site}.example.{('com', 'net', 'org')[Draw(key, 'top', host).below(3)]}"
    if kind == "ip":
        return ".".join(["10", *(str(d.below(256)) for _ in range(3))]) if attempt < 4 else ".".join(str(1 + d.below(254)) for _ in range(4))
    if kind == "ip6":
        return str(ipaddress.IPv6Address(0xFD00 << 112 | sum(d.below(65536) << 16 * i for i in range(7))))
    if kind == "iban":
        body = d.alike(value[4:])
        return f"{value[:2]}{98 - iban_rest(value[:2] + '00' + body):02d}{body}"
    if kind == "ssn":
        return "9" + d.alike(value[1:])
    if kind == "phone":
        keep = 2 if value[0] == "+" else 0
        return value[:keep] + d.alike(value[keep:])
    if kind == "card":
        body = value[0] + d.alike(value[1:-1])
        if luhn(value):
            return body + str(d.below(10))
        return next(x for c in range(10) if luhn(x := body + str(c)) == 0)
    if kind.startswith("person"):
        return composed(kind, value, lambda what, gender, part: surrogate(f"{what}:{gender}", part, attempt, key))
    if kind.startswith("initials"):
        by = 1 + Draw(key, "initials").below(25)  # a rotation: distinct initials stay distinct, and none stays
        return "".join(chr((ord(c) - base + by) % 26 + base) if (base := 65 if c.isupper() else 97) and c.isascii() and c.isalpha() else d.alike(c) for c in value)
    if kind.startswith(("given", "family")):
        if not unicodedata.name(value[0], "").startswith(("LATIN", "CYRILLIC", "GREEK")):
            return d.alike(value)
        script = "cyrillic" if "Ѐ" <= value[0] <= "ԯ" else "greek" if "Ͱ" <= value[0] <= "Ͽ" else "latin"
        first, between, men, women, families = SYLLABLES[script]
        ends = families if kind.startswith("family") else {"m": men, "f": women}.get(kind[-1], men + women)
        name = first[d.below(len(first))] + "".join(between[d.below(len(between))] for _ in range(attempt)) + ends[d.below(len(ends))]
        # a Slavic family name keeps its gender
        return name + "а" * (ends is families and script == "cyrillic" and value[-1] in "ая")
    head = "AKIA" if value.startswith("AKIA") else m[0] if (m := re.match(r"gh[a-z]_|sk-", value)) else ""
    if re.fullmatch(r"[0-9a-f]+", value):
        return "".join("0123456789abcdef"[d.below(16)] for _ in value)
    return head + d.alike(value[len(head) :])


def written(kind: str, original: str, new: str) -> str:
    """The surrogate in the format in which the entity stands in the text."""
    if kind == "email":
        return new.upper() if original.isupper() else new
    if kind == "iban":
        signs = iter(new)
        return "".join(c if c == " " else next(signs) for c in original)
    if kind in ("phone", "card", "ssn"):
        digits = iter(c for c in new if c.isdecimal())
        return "".join(next(digits) if c.isdecimal() else c for c in original)
    return new


def held(text: str) -> set[tuple[str, str, str]]:
    """(kind, gender, normal form) of what a text's surrogates are drawn for: names apart, and without initials."""
    out: set[tuple[str, str, str]] = set()
    for _, _, kind, value in find(text):
        out |= {p for p in parts(kind, value) if p[0] != "initials"} if kind.startswith("person") else {(kind, "", value)}
    return out


def _collected(docs: DataFrame, text_col: str) -> DataFrame:
    """The distinct entities (kind, gender, value), and the genders under which each was met: one where they agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = sorted({x for t in b.column(0).to_pylist() for x in held(t)})
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.string()) for i in range(3)], names=["kind", "gender", "value"])

    met = docs.select(F.col(text_col).alias("text")).filter("text is not null").mapInArrow(run, "kind string, gender string, value string").distinct()
    known = F.array_remove("met", "n")
    return met.groupBy("kind", "value").agg(F.collect_set("gender").alias("met")).select("kind", F.when(F.size(known) == 1, known[0]).when(F.col("kind") == "given", "n").otherwise("").alias("gender"), "value", (F.size("met") > 1).alias("mixed"))


def _drawn(entities: DataFrame, key: bytes) -> DataFrame:
    """Entities (kind, gender, value, mixed, attempt) with their surrogates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, gender, value, _, attempt = (c.to_pylist() for c in b.columns)
            made = [surrogate(f"{k}:{g}" if g else k, v, n, key) for k, g, v, n in zip(kind, gender, value, attempt, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, "made"])

    return entities.select("kind", "gender", "value", "mixed", "attempt").mapInArrow(run, "kind string, gender string, value string, mixed boolean, attempt int, made string")


def assign(docs: DataFrame, text_col: str, key: bytes = KEY) -> DataFrame:
    """(kind, gender, value, mixed, attempt, made) of every distinct entity, all made values distinct and none of them real.

    mixed: the entity was met under several genders. A round draws for those only that the rounds before left over,
    and what has been settled stays.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    entities = scratch.write(_collected(docs, text_col))
    real = entities.select(F.col("value").alias("made")).distinct()
    drawn, settled = scratch.write(_drawn(entities.withColumn("attempt", F.lit(0)), key)), None
    while True:
        first = drawn.groupBy("made").agg(F.min(F.struct("kind", "value")).alias("first"))
        lost = drawn.join(first, "made").filter(F.struct("kind", "value") != F.col("first")).unionByName(drawn.join(real, "made", "left_semi").withColumn("first", F.lit(None)))
        if settled is not None:
            lost = lost.unionByName(drawn.join(settled.select("made"), "made", "left_semi").withColumn("first", F.lit(None)))
        bad = scratch.write(lost.select("kind", "gender", "value", "mixed", "attempt").distinct())
        good = drawn.join(bad, ["kind", "value"], "left_anti")
        settled = good if settled is None else settled.unionByName(good)
        if bad.isEmpty():
            return settled
        drawn = scratch.write(_drawn(bad.withColumn("attempt", F.col("attempt") + 1), key))


def _rewritten(text: str, chosen) -> tuple[str, list[dict]]:
    """chosen(kind, value): the surrogate."""
    out, spans, at = [], [], 0
    for s, e, kind, value in find(text):
        out += [text[at:s], written(kind, text[s:e], chosen(kind, value))]
        spans.append({"start": s, "end": e, "kind": kind.split(":")[0]})
        at = e
    return "".join([*out, text[at:]]), spans


def chooser(known: dict[tuple[str, str], str], key: bytes):
    """Surrogates by kind and value: those that are known, else first draws."""

    def part(kind: str, gender: str, value: str) -> str:
        return known.get((kind, value)) or surrogate(f"{kind}:{gender}" if gender else kind, value, 0, key)

    return lambda kind, value: composed(kind, value, part) if kind.startswith("person") else part(kind, "", value)


ENTITIES = "entities array<struct<start:int,end:int,kind:string>>"


def replace_pii(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, key: bytes | None = None, lookup: int = LOOKUP) -> DataFrame:
    """The carried columns (all by default), with surrogates in the text column, and entities.

    entities: start, end (code points of the original text) and kind. Null texts stay null and hold no entities;
    rows that repeat are rewritten alike, since a rewrite depends on the entities of the table and the key only. An
    empty table gives an empty result. Carried columns may have any names; one named entities gives way to the result.
    The key is the session's spark.quirefold.pii.key unless one is given.
    """
    spark = docs.sparkSession
    key = key or spark.conf.get(KEY_SETTING, KEY.decode()).encode()
    carry = carried(carry or docs.columns, "entities")
    again = assign(docs, text_col, key).filter("attempt > 0 or mixed").select("kind", "value", "made")
    few = again.limit(lookup + 1).collect()
    if len(few) > lookup:
        return _replaced_by_join(docs, text_col, carry, again, key)
    known = {(r.kind, r.value): r.made for r in few}

    def make(texts: list) -> list[list]:
        chosen = chooser(known, key)
        done = [(None, []) if t is None else _rewritten(t, chosen) for t in texts]
        return [[x[0] for x in done], [x[1] for x in done]]

    return mapped(docs, carry, text_col, f"`{text_col}` string, {ENTITIES}", make).select(*map(named, carry), "entities")


def _replaced_by_join(docs: DataFrame, text_col: str, carry: list[str], again: DataFrame, key: bytes) -> DataFrame:
    """Each row brings its entities' surrogates along: those that drew again are joined to the texts that hold them, by
    the texts' digests. A text that many rows hold meets them under as many salts as there are shuffle partitions."""
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in carry if c != text_col]
    rows = docs.select(bundle(rest).alias("carried"), F.col(text_col).alias("text")).withColumn("digest", F.sha2("text", 256)).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))
        for b in batches:
            got = [[{"kind": k, "value": v} for k, v in sorted({(k, v) for k, _, v in held(t)})] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, kind)], names=["digest", "held"])

    texts = rows.filter("text is not null").select("digest", "text")
    each = texts.mapInArrow(run, "digest string, held array<struct<kind:string,value:string>>").select("digest", F.explode("held").alias("h")).select("digest", "h.kind", "h.value").distinct()
    brought = each.join(again, ["kind", "value"]).groupBy("digest").agg(F.collect_list(F.struct("kind", "value", "made")).alias("made"))
    # every salt brings all that its rows may need, whichever of them they are
    brought = brought.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    both = rows.join(brought, ["digest", "salt"], "left").select("carried", "text", "made")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            done = []
            for t, made in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                done.append((None, []) if t is None else _rewritten(t, chooser({(x["kind"], x["value"]): x["made"] for x in made or []}, key)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], to_arrow_type(span))], names=["carried", "text", "entities"])

    shape = both.select("carried", "text").schema.add(ENTITIES.split()[0], DataType.fromDDL(ENTITIES.split()[1]))
    span = shape["entities"].dataType
    out = both.mapInArrow(rewrite, shape)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("carried").getField(c).alias(c) for c in carry], "entities")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in its text, and how many (see replace_pii for odd rows)."""
    return replace_pii(table(spark, sf_dir, "documents"), carry=["doc_id", "text"]).select("doc_id", "text", F.size("entities").alias("n_entities"))
