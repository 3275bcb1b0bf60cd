"""Personal data: entities are found in whole texts and replaced by keyed surrogates of the same type, script, gender and format."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import map_rows, texts_of
from folioscan.session import cut_lineage

# Patterns, titles and given names by gender.
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}(?![A-Za-z0-9])")
#: Runs of all the characters that IPV4, CARD, PHONE and SSN can match, from the first they can begin with: every match lies
#: inside one run, and one character after it is all that their look-aheads need.
DIGITS = re.compile(r"[+(\d][\d ().+-]{6,}+")
IPV4 = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)")
CARD = re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\d)")
PHONE = re.compile(
    r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
    r"|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
)
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "г-н")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "г-жа")
OTHER_TITLES = ("Dr", "Prof")
KNOWN_MALE = ("Adam", "Alan", "Anton", "Carlos", "Daniel", "David", "Diego", "Emil", "Felix", "George", "Henri", "Hugo", "James", "John", "Jules", "Karl", "Louis", "Marc", "Martin", "Michael", "Oscar", "Pablo", "Paul", "Peter", "Robert", "Simon", "Thomas", "Victor", "William")
KNOWN_FEMALE = ("Alice", "Anna", "Carmen", "Clara", "Claire", "Elena", "Emma", "Eva", "Greta", "Hanna", "Helen", "Jane", "Julia", "Laura", "Lena", "Lucia", "Maria", "Marie", "Marta", "Mary", "Nina", "Paula", "Rosa", "Sarah", "Sofia", "Susan", "Vera")
#: Surrogates of given names are drawn from these, which are not looked for in texts.
MORE_MALE_NAMES = ("Aaron", "Adrian", "Albert", "Alex", "Alfred", "Andre", "Andrew", "Antonio", "Arthur", "Bernard", "Boris", "Bruno", "Charles", "Christian", "Claude", "Dennis", "Dominic", "Edgar", "Edward", "Enrique", "Eric", "Ernest", "Fabian", "Fernando", "Francis", "Frank", "Frederick", "Gabriel", "Gerald", "Gregory", "Gustav", "Harold", "Harry", "Hector", "Henry", "Herman", "Ivan", "Jacob", "Jerome", "Joseph", "Julian", "Kevin", "Konrad", "Leonard", "Lorenzo", "Lucas", "Manuel", "Marco", "Mario", "Matthew", "Maurice", "Max", "Miguel", "Nathan", "Nicholas", "Olaf", "Oliver", "Otto", "Patrick", "Philip", "Ralph", "Raymond", "Ricardo", "Richard", "Roger", "Roland", "Samuel", "Sergio", "Stefan", "Stephen", "Theodor", "Timothy", "Vincent", "Walter", "Xavier")
MORE_FEMALE_NAMES = ("Adele", "Agnes", "Amelia", "Amy", "Andrea", "Angela", "Beatrice", "Bertha", "Brigitte", "Camila", "Caroline", "Catherine", "Cecilia", "Charlotte", "Christine", "Cornelia", "Daniela", "Diana", "Dora", "Dorothy", "Edith", "Eleanor", "Elisa", "Elizabeth", "Ella", "Emily", "Esther", "Eugenia", "Florence", "Frances", "Frida", "Gabriela", "Gloria", "Hedwig", "Helga", "Ida", "Ingrid", "Irene", "Isabel", "Johanna", "Josephine", "Judith", "Karin", "Katharina", "Lilian", "Linda", "Lisa", "Louise", "Luisa", "Lydia", "Magdalena", "Margaret", "Martha", "Martina", "Mathilda", "Monica", "Natalia", "Nora", "Olga", "Olivia", "Patricia", "Pauline", "Rebecca", "Renate", "Rita", "Ruth", "Sabine", "Silvia", "Sonja", "Sophie", "Teresa", "Ursula", "Valerie", "Victoria", "Yvonne")
MALE_NAMES, FEMALE_NAMES = KNOWN_MALE + MORE_MALE_NAMES, KNOWN_FEMALE + MORE_FEMALE_NAMES
NAME_KINDS = ("male", "female", "person")
#: From this attempt on a surrogate is longer than its shape, by one more syllable each time.
WIDER_FROM = 4
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
CYRILLIC_VOWELS, CYRILLIC_CONSONANTS = "аеиоуыэюя", "бвгджзклмнпрстфхцчш"
GREEK_VOWELS, GREEK_CONSONANTS = "αεηιουω", "βγδζθκλμνξπρστφχψ"

_WORD = r"[^\W\d_][^\W\d_a-zа-яα-ω]*[^\W\d_]*"
NAME = re.compile(
    rf"\b({'|'.join(MALE_TITLES)}|{'|'.join(FEMALE_TITLES)}|{'|'.join(OTHER_TITLES)})(\.? )((?:[A-ZÀ-ÞА-ЯΑ-Ω][^\W\d_]*)(?:[ -][A-ZÀ-ÞА-ЯΑ-Ω][^\W\d_]+){{0,2}})"
    rf"|\b({'|'.join(KNOWN_MALE + KNOWN_FEMALE)})( [A-ZÀ-Þ][^\W\d_]+)\b"
)
_CLASSES = [
    *(x for low in (VOWELS, CONSONANTS, CYRILLIC_VOWELS, CYRILLIC_CONSONANTS, GREEK_VOWELS, GREEK_CONSONANTS) for x in (low, low.upper())),
    "0123456789",
    "".join(map(chr, range(0x4E00, 0x9FA6))),
]
_CLASS_OF = {c: (k, i) for k, chars in enumerate(_CLASSES) for i, c in enumerate(chars)}


class Entity(NamedTuple):
    kind: str
    start: int
    end: int
    value: str


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _plain(value: str) -> str:
    return re.sub(r"[ ().-]", "", value)


def entities(text: str) -> list[Entity]:
    """Entities of one whole text, leftmost first and never overlapping; of those that overlap, the kind named first here wins:
    email, ip, iban, card, ssn, phone, male / female / person (names after a title, or a known given name and a surname)."""
    found: list[Entity] = []
    if "@" in text:
        found += [Entity("email", *m.span(), m.group()) for m in EMAIL.finditer(text)]
    for run in DIGITS.finditer(text):
        low, high = run.start(), min(len(text), run.end() + 1)
        for kind, pattern in (("ip", IPV4), ("card", CARD), ("ssn", SSN), ("phone", PHONE)):
            for m in pattern.finditer(text, low, high):
                digits = _plain(m.group())
                if kind == "card" and not (luhn(digits) or (len(digits) == 16 and digits[0] in "3456" and m.group().isdigit())):
                    continue
                if kind == "phone" and not 8 <= len(digits.lstrip("+")) <= 15:
                    continue
                found.append(Entity(kind, *m.span(), m.group()))
    for m in IBAN.finditer(text):
        value = m.group().replace(" ", "")
        if 15 <= len(value) <= 34 and _mod97(value) == 1:
            found.append(Entity("iban", *m.span(), m.group()))
    for m in NAME.finditer(text):
        if m.group(1):
            kind = "male" if m.group(1) in MALE_TITLES else "female" if m.group(1) in FEMALE_TITLES else "person"
            found.append(Entity(kind, *m.span(3), m.group(3)))
        else:
            found.append(Entity("male" if m.group(4) in KNOWN_MALE else "female", m.start(4), m.end(5), m.group(4) + m.group(5)))
    rank = {k: i for i, k in enumerate(("email", "ip", "iban", "card", "ssn", "phone"))}
    kept: list[Entity] = []
    taken: list[tuple[int, int]] = []
    for e in sorted(found, key=lambda e: (rank.get(e.kind, 9), e.start, -e.end)) if len(found) > 1 else found:
        if all(e.end <= a or e.start >= b for a, b in taken):
            kept.append(e)
            taken.append((e.start, e.end))
    return sorted(kept, key=lambda e: e.start)


def all_entities(text: str) -> list[Entity]:
    """Entities of one whole text, and every further mention of a word of the names found in it.

    A name that stands with a title or a given name in one place is often called by a single word in
    others: each whole word equal to a word of a found name, as it is or in capitals, is a mention of
    it (kind person; `value` is the word of the name). Words of fewer than three letters are left alone.
    """
    found = entities(text)
    words = {w for e in found if e.kind in NAME_KINDS for w in re.split("[ -]", e.value) if len(w) > 2}
    if not words:
        return found
    spelled = {v: w for w in sorted(words) for v in (w.upper(), w)} | {w: w for w in words}
    mention = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(spelled, key=lambda v: (-len(v), v)))) + r")(?!\w)")
    taken, more, at = [(e.start, e.end) for e in found], [], 0
    for m in mention.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at == len(taken) or m.end() <= taken[at][0]:
            more.append(Entity("person", *m.span(), spelled[m.group()]))
    return sorted(found + more, key=lambda e: e.start) if more else found


def _permuted(key: bytes, tweak: str, size: int, x: int, back: bool = False) -> int:
    """A keyed permutation of 0 .. size-1: a balanced Feistel network over the next even number of bits, walked until it is inside;
    `back` turns it round."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def mixed(turn: int, part: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{turn}|{part}|{size}|{tweak}".encode(), key=key, digest_size=16).digest(), "big") & mask

    while True:
        left, right = x >> half, x & mask
        if back:
            for turn in reversed(range(6)):
                left, right = right ^ mixed(turn, left), left
        else:
            for turn in range(6):
                left, right = right, left ^ mixed(turn, right)
        x = left << half | right
        if x < size:
            return x


def _moved(key: bytes, tweak: str, size: int, x: int) -> int:
    """A keyed permutation that is one cycle over all of 0 .. size-1 (2 at least): no value stays where it is."""
    return _permuted(key, tweak, size, (_permuted(key, tweak, size, x) + 1) % size, back=True)


def _shaped(key: bytes, tweak: str, value: str, classes: dict[int, str] | None = None) -> str:
    """Another string of the same shape: each letter or digit stays in its class (script, case, vowel or consonant; digits),
    all other characters stay. One-to-one within a shape and never the value itself, unless it has no such letter or digit."""
    classes = classes or {}
    alphabets, x, size = [], 0, 1
    for at, c in enumerate(value):
        if at in classes:
            alphabet, digit = classes[at], classes[at].index(c)
        elif c in _CLASS_OF:
            k, digit = _CLASS_OF[c]
            alphabet = _CLASSES[k]
        else:
            alphabets.append(c)
            continue
        alphabets.append(alphabet)
        x, size = x * len(alphabet) + digit, size * len(alphabet)
    if size == 1:
        return value
    shape = "".join(a if len(a) == 1 else chr(0xE000 + len(a) % 997) for a in alphabets)
    y = _moved(key, tweak + shape, size, x)
    out = []
    for a in reversed(alphabets):
        if len(a) == 1:
            out.append(a)
        else:
            y, digit = divmod(y, len(a))
            out.append(a[digit])
    return "".join(reversed(out))


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The surrogate of an entity under a secret key. Spelling variants of a number (spaces, dots, dashes) and the case of an
    e-mail address count as one entity, so mentions of one entity agree everywhere. `attempt` picks another surrogate; those of
    names and e-mail addresses, whose shapes may be short, get longer from attempt WIDER_FROM on."""
    tweak = f"{kind}|{attempt}|"
    if kind == "email":
        local, domain = value.lower().split("@")
        *labels, top = domain.split(".")
        labels = [x if x == "example" else _shaped(key, tweak + "d", x) for x in labels]
        return f"{_shaped(key, tweak + domain, local)}{_syllables(key, tweak + value.lower(), attempt)}@{'.'.join(labels)}.{top}"
    if kind == "ip":
        a, b, c, d = map(int, value.split("."))
        low, high = (1, 223) if 1 <= a <= 223 else (224, 255) if a else (0, 0)
        x = (((a - low) << 8 | b) << 8 | c) << 8 | d
        y = _moved(key, tweak + str(low), (high - low + 1) << 24, x)
        return f"{low + (y >> 24)}.{y >> 16 & 255}.{y >> 8 & 255}.{y & 255}"
    if kind in ("card", "ssn", "phone"):
        digits = re.sub(r"\D", "", value)
        fixed = 0
        if kind == "phone" and value.startswith("+"):
            fixed = len(re.match(r"\+(\d{1,3})(?=\D|$)|\+(\d)", value).group()) - 1
        if kind == "card":
            body = digits[0] + _shaped(key, tweak + digits[0], digits[1:-1])
            end = _shaped(key, tweak + "end", digits[-1])
            new = next(body + d for d in "0123456789" if luhn(body + d)) if luhn(digits) else body + end
            if not luhn(digits) and luhn(new):
                new = body + str((int(end) + 1) % 10)
        else:
            # a first digit of 2 to 9 stays one, as in area and exchange codes
            rest = digits[fixed:]
            firsts = {k: "23456789" if rest[k] in "23456789" else "01" for k in {0, len(rest) - 7} if 0 <= k < len(rest)}
            new = digits[:fixed] + _shaped(key, tweak + digits[:fixed], rest, firsts)
        source = iter(new)
        return "".join(next(source) if c.isdigit() else c for c in value)
    if kind == "iban":
        plain = value.replace(" ", "")
        body = _shaped(key, tweak + plain[:2], plain[4:])
        new = plain[:2] + f"{98 - _mod97(plain[:2] + '00' + body):02d}" + body
        source = iter(new)
        return "".join(next(source) if c != " " else c for c in value)
    return "".join(w if w in (" ", "-") else _name_word(key, w, attempt) for w in re.split(r"([ -])", value))


def _syllables(key: bytes, tweak: str, attempt: int) -> str:
    """Keyed syllables: none up to attempt WIDER_FROM, then one more at each, so that a short shape has room for all its values."""
    drawn = hashlib.blake2b(tweak.encode(), key=key, digest_size=64).digest()
    return "".join(CONSONANTS[drawn[2 * k] % len(CONSONANTS)] + VOWELS[drawn[2 * k + 1] % len(VOWELS)] for k in range(min(32, attempt - WIDER_FROM + 1)))


def _name_word(key: bytes, word: str, attempt: int) -> str:
    """The surrogate of one word of a name. A known given name first takes one of its gender that is not looked for."""
    for names, more in ((KNOWN_MALE, MORE_MALE_NAMES), (KNOWN_FEMALE, MORE_FEMALE_NAMES)):
        if word in names and attempt < WIDER_FROM:
            return more[_permuted(key, f"given|{attempt}|", len(more), names.index(word))]
    tweak = f"name|{attempt}|"
    new = _shaped(key, tweak, word)
    if new == word:  # of a script without classes: letters that the check over the corpus tells apart
        new = _syllables(key, tweak + word, WIDER_FROM + len(word) // 2).capitalize()
    return new + _syllables(key, tweak + word, attempt)


def entity_parts(kind: str, value: str) -> list[tuple[str, str, str]]:
    """What is kept apart over the corpus, as (kind, entity, sample): each word of a name, whatever its title; else the entity."""
    if kind in NAME_KINDS:
        return [("name", w, w) for w in re.split("[ -]", value)]
    return [(kind, entity_key(kind, value), value)]


def entity_key(kind: str, value: str) -> str:
    """What makes two mentions the same entity."""
    if kind == "email":
        return value.lower()
    return re.sub(r"\D", "", value) if kind in ("card", "ssn", "phone") else value.replace(" ", "") if kind == "iban" else value


def surrogate_exceptions(docs: DataFrame, key: bytes, text_column: str = "text", most_rounds: int = 20) -> DataFrame:
    """Entities that must not take their first surrogate: kind, entity, attempt (from 1 on).

    Over all distinct entities of the corpus, names word by word under the kind "name": a surrogate
    that is itself an entity of the corpus, or that two entities share (the smaller one keeps it), is
    drawn again until none is left; if some are left after `most_rounds`, that is an error. Everything
    is a distributed join; entities are pre-aggregated by distinct before they are shuffled.
    """

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = {(k, v): sample for text in texts_of(batch.column(0)) for e in all_entities(text) for k, v, sample in entity_parts(e.kind, e.value)}
        return pa.record_batch(
            [pa.array([k for k, _ in seen], pa.string()), pa.array([v for _, v in seen], pa.string()), pa.array(list(seen.values()), pa.string())],
            ["kind", "entity", "sample"],
        )

    def drawn(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds, own, sample, attempts = (batch.column(k).to_pylist() for k in range(4))
        new = [entity_key(k, surrogate(key, k, v, a)) for k, v, a in zip(kinds, sample, attempts)]
        return pa.record_batch([*batch.columns, pa.array(new, pa.string())], ["kind", "entity", "sample", "attempt", "new"])

    every = map_rows(docs, [text_column], found, "kind string, entity string, sample string")
    every = cut_lineage(every.groupBy("kind", "entity").agg(F.min("sample").alias("sample")))
    columns = "kind string, entity string, sample string, attempt int, new string"
    state = cut_lineage(map_rows(every.withColumn("attempt", F.lit(0)), ["kind", "entity", "sample", "attempt"], drawn, columns))
    for turn in range(most_rounds + 1):
        real = state.join(every.select("kind", F.col("entity").alias("new")), ["kind", "new"], "left_semi").select("kind", "entity")
        shared = state.groupBy("kind", "new").agg(F.min("entity").alias("first"), F.count("*").alias("n")).where("n > 1")
        later = state.join(shared.select("kind", "new", "first"), ["kind", "new"]).where("entity <> first").select("kind", "entity")
        again = cut_lineage(real.union(later).distinct())
        if again.isEmpty():
            break
        if turn == most_rounds:
            raise RuntimeError(f"surrogates still collide after {most_rounds} rounds, by kind: {dict(again.groupBy('kind').count().collect())}")
        moved = state.join(again, ["kind", "entity"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        moved = map_rows(moved, ["kind", "entity", "sample", "attempt"], drawn, columns)
        state = cut_lineage(state.join(again, ["kind", "entity"], "left_anti").unionByName(moved))
    return state.where("attempt > 0").select("kind", "entity", "attempt")


def replace_entities(text: str, key: bytes, attempts: dict[tuple[str, str], int], draw=surrogate) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The rewritten text and, per entity, (kind, start, end, surrogate); the offsets are those of the original."""
    out, at, spans = [], 0, []
    for e in all_entities(text):
        if e.kind in NAME_KINDS:
            new = "".join(w if w in (" ", "-") else draw(key, "name", w, attempts.get(("name", w), 0)) for w in re.split("([ -])", e.value))
            if text[e.start : e.end] != e.value:  # a mention in capitals
                new = new.upper()
        else:
            new = draw(key, e.kind, e.value, attempts.get((e.kind, entity_key(e.kind, e.value)), 0))
        out += [text[at : e.start], new]
        at = e.end
        spans.append((e.kind, e.start, e.end, new))
    return "".join(out) + text[at:], spans


def replace_personal_data(docs: DataFrame, key: bytes, text_column: str = "text", spans_column: str | None = "entities") -> DataFrame:
    """`docs` with the entities of `text_column` replaced, and a column `spans_column` (kind, start, end, surrogate), unless it is None.

    Equal entities have equal surrogates in all documents, distinct ones distinct surrogates that
    are no entity of the corpus. Null texts stay null with no entities, empty and clean texts stay as
    they are, repeated rows are rewritten alike; an input column called `spans_column` is replaced, all
    others are kept, whatever their names.
    Exceptions are few: they reach the documents that mention them by the hash of the text, and
    documents are only shuffled if there are any.
    """
    columns = [c for c in docs.columns if c != spans_column]
    whole = docs.select(F.struct("*").alias("row"), F.col(text_column).alias("body"), F.xxhash64(text_column).alias("body_hash"))
    exceptions = surrogate_exceptions(docs, key, text_column)
    kind = "array<struct<kind:string,start:int,end:int,surrogate:string>>"

    def rewritten(texts: Iterable[str | None], attempts: Iterable) -> pa.Array:
        draw = lru_cache(maxsize=100_000)(surrogate)
        rows = []
        for text, own in zip(texts, attempts):
            if text is None:
                rows.append({"text": None, "entities": []})
                continue
            new, spans = replace_entities(text, key, {(x["kind"], x["entity"]): x["attempt"] for x in own or ()}, draw)
            rows.append({"text": new, "entities": [dict(zip(("kind", "start", "end", "surrogate"), s)) for s in spans]})
        inner = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())])
        return pa.array(rows, pa.struct([("text", pa.string()), ("entities", pa.list_(inner))]))

    if exceptions.isEmpty():
        source = whole
        again = F.arrow_udf(lambda texts: rewritten(texts.to_pylist(), [None] * len(texts)), f"text string, entities {kind}")
        new = again(F.col("body"))
    else:

        def mentions(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = zip(batch.column(0).to_pylist(), texts_of(batch.column(1)))
            rows = [(h, k, v) for h, t in texts for e in all_entities(t) for k, v, _ in entity_parts(e.kind, e.value)]
            h, k, v = zip(*rows) if rows else ((), (), ())
            return pa.record_batch([pa.array(h, pa.int64()), pa.array(k, pa.string()), pa.array(v, pa.string())], ["text_hash", "kind", "entity"])

        hashed = whole.select(F.col("body_hash").alias("text_hash"), "body")
        hit = map_rows(hashed, ["text_hash", "body"], mentions, "text_hash bigint, kind string, entity string").join(exceptions, ["kind", "entity"])
        own = hit.groupBy("text_hash").agg(F.collect_set(F.struct("kind", "entity", "attempt")).alias("attempts"))
        source = whole.join(own.withColumnRenamed("text_hash", "body_hash"), "body_hash", "left")
        again = F.arrow_udf(lambda texts, own: rewritten(texts.to_pylist(), own.to_pylist()), f"text string, entities {kind}")
        new = again(F.col("body"), F.col("attempts"))
    done = source.select("row", new.alias("new"))
    kept = [F.col("new.text").alias(c) if c == text_column else F.col("row").getField(c).alias(c) for c in columns]
    return done.select(*kept, *([F.col("new.entities").alias(spans_column)] if spans_column else []))
