"""Secret scans with SQL functions only: known forms, and strings whose sliding-window entropy is high for their character class."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.scale import settle

# The known forms.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Matches of ASSIGN end where group 2 does, so its length says where group 2 begins.
ASSIGN_VALUE = 12


@dataclass(frozen=True)
class CharacterClass:
    """Runs of one class of characters, and the bits per character from which a window of them counts as random."""

    kind: str
    run: str
    window: int
    bits: float
    needs: str = ""  # what a candidate must hold
    never: str = ""  # what leaves a candidate to another class


CLASSES = (
    CharacterClass("entropy_hex", r"[0-9a-fA-F]{20,}", 20, 2.8, needs=r"[0-9].*[a-fA-F]|[a-fA-F].*[0-9]"),
    CharacterClass("entropy_base64", r"[A-Za-z0-9+/_-]{20,}", 20, 3.6, needs=r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]", never=r"^[0-9a-fA-F]+$"),
)
#: Candidates that are no secrets by themselves, and words before one that say so.
ALLOWED_PLAIN = (
    r"(?i)example|sample|dummy|placeholder|changeme|deadbeef|0123456789|abcdefgh"
    r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
)
ALLOWED_RUNS = "|".join(f"{c}{{8}}" for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
ALLOWED = f"{ALLOWED_PLAIN}|{ALLOWED_RUNS}"
ALLOWED_BEFORE = r"(?i)(sha-?(1|224|256|384|512)|md5|checksum|digest|commit|revision|integrity|base64)[\x20:=,/-]{1,3}$"

_BLOCK = 256
_PLACED = "array<struct<start:bigint,end:bigint,hit:string,before:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, even where `use` needs it inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _steps(text: Column, pattern: str, wanted: Column) -> Column:
    """All leftmost non-overlapping matches as (gap, long, hit, before): characters before each since the last one, its own, itself.

    What split leaves between the matches gives the gaps. Texts for which `wanted` is false have none.
    """
    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.split(text, pattern, -1),
        lambda hit, gap: F.struct(
            F.char_length(gap).cast("bigint").alias("gap"), F.char_length(hit).cast("bigint").alias("long"), hit.alias("hit"), F.right(gap, F.lit(24)).alias("before")
        ),
    )
    return F.when(wanted, F.filter(pairs, lambda x: x["hit"].isNotNull())).otherwise(F.array().cast("array<struct<gap:bigint,long:bigint,hit:string,before:string>>"))


def _placed(steps: Column) -> Column:
    """Matches as (start, end, hit, before), in code points: running sums, in blocks, so that the work stays in proportion to the matches."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(steps) - 1, F.lit(0)), F.lit(_BLOCK)), lambda b: F.slice(steps, b + 1, F.lit(_BLOCK)))

    def scan(block: Column, start: Column) -> Column:
        def add(a: Column, x: Column) -> Column:
            begin = a["at"] + x["gap"]
            span = F.struct(begin.alias("start"), (begin + x["long"]).alias("end"), x["hit"].alias("hit"), x["before"].alias("before"))
            return F.struct((begin + x["long"]).alias("at"), F.array_append(a["out"], span).alias("out"))

        return F.aggregate(block, F.struct(start.alias("at"), F.array().cast(_PLACED).alias("out")), add)["out"]

    whole = F.aggregate(
        blocks,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_PLACED}>").alias("out")),
        lambda a, block: F.struct(
            F.aggregate(block, a["at"], lambda n, x: n + x["gap"] + x["long"]).alias("at"), F.array_append(a["out"], scan(block, a["at"])).alias("out")
        ),
    )
    return F.flatten(whole["out"])


def _gain(n: Column) -> Column:
    """n log2 n; the entropy of a window of w characters is log2 w - (sum over characters of this) / w."""
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def _hot_range(hit: Column, kind: CharacterClass) -> Column:
    """Start of the first and end of the last window of at least `bits`, or -1 and 0.

    The first window is counted in full; each step then takes the leaving character's count down by
    one and the entering one's up by one, and changes only their two terms of the sum.
    """
    w = kind.window
    limit = w * (log2(w) - kind.bits) + 1e-9
    count = lambda part, c: F.size(F.filter(part, lambda x: x == c))

    def walk(chars: Column) -> Column:
        def moved(a: Column, i: Column, n: Column) -> Column:
            s = a["s"] - _gain(n["out"] + 1) + _gain(n["out"]) - _gain(n["new"]) + _gain(n["new"] + 1)
            return F.struct(s.alias("s"), a["first"].alias("first"), a["last"].alias("last"), i.alias("i"))

        def marked(a: Column) -> Column:
            hot = a["s"] <= limit
            return F.struct(
                a["s"].alias("s"),
                F.when(hot & (a["first"] < 0), a["i"] - 1).otherwise(a["first"]).cast("int").alias("first"),
                F.when(hot, a["i"] - 1 + w).otherwise(a["last"]).cast("int").alias("last"),
            )

        def step(a: Column, i: Column) -> Column:  # i: the window's start, from 1
            counts = _let(
                F.slice(chars, i, F.lit(w - 1)),
                lambda shared: F.struct(count(shared, F.element_at(chars, i - 1)).alias("out"), count(shared, F.element_at(chars, i + w - 1)).alias("new")),
            )
            return _let(_let(counts, lambda n: moved(a, i, n)), marked)

        first = _let(
            F.slice(chars, F.lit(1), F.lit(w)), lambda head: F.aggregate(F.array_distinct(head), F.lit(0.0), lambda s, c: s + _gain(count(head, c)))
        )
        start = _let(first, lambda s: marked(F.struct(s.alias("s"), F.lit(-1).alias("first"), F.lit(0).alias("last"), F.lit(1).alias("i"))))
        later = F.when(F.char_length(hit) > w, F.sequence(F.lit(2), F.char_length(hit) - w + 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(later, start, step)

    return _let(F.slice(F.split(hit, "", -1), F.lit(1), F.char_length(hit)), walk)


def _random_ranges(kind: CharacterClass, allowed: str, allowed_before: str) -> Column:
    """(start, end) in the text of what is random in the runs of the column `kind.kind`, without what the allow-list excuses."""

    def candidate(x: Column) -> Column:
        own = x["hit"].rlike(kind.needs or ".") & ~x["hit"].rlike(kind.never or r"^\b\B")
        return own & ~x["hit"].rlike(allowed) & ~x["before"].rlike(allowed_before)

    ranges = F.transform(
        F.filter(F.col(kind.kind), candidate), lambda x: F.struct(x["start"].alias("start"), _hot_range(x["hit"], kind).alias("range"))
    )
    return F.transform(
        F.filter(ranges, lambda x: x["range"]["first"] >= 0),
        lambda x: F.struct((x["start"] + x["range"]["first"]).alias("start"), (x["start"] + x["range"]["last"]).alias("end")),
    )


def _named(spans: Column, kind: str, number: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("number"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def listed_spans(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    rows = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(rows, ",")


def find_secrets(docs: DataFrame, classes: tuple[CharacterClass, ...] = CLASSES, allowed: str = ALLOWED, allowed_before: str = ALLOWED_BEFORE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_entropy, base_spans, all_spans.

    base_spans and all_spans are sorted arrays of (start, number, end, kind) in code points of the
    whole text, ends exclusive. Base kinds are assign (dropped if its value is shorter than 12),
    access and hex; each class adds, for each candidate run that the allow-list does not excuse, the
    range of its windows with entropy at or above the class's limit. Null and empty texts have no
    spans; repeated rows give equal rows; a null doc_id stays null; other columns are ignored; an
    empty table gives no rows. All of it is one narrow projection: nothing is shuffled.
    """
    text = F.col("body")
    rows = settle(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body")))
    longest = "|".join(f"(?:{c.run})" for c in classes)
    steps = settle(
        rows.select(
            "doc_id",
            _steps(text, ASSIGN, text.rlike(ASSIGN)).alias("assign"),
            _steps(text, ACCESS, text.contains("AKIA")).alias("access"),
            _steps(text, HEX, text.rlike(HEX)).alias("hex"),
            *(_steps(text, c.run, text.rlike(longest)).alias(c.kind) for c in classes),
        )
    )
    found = settle(steps.select("doc_id", *(_placed(F.col(c)).alias(c) for c in steps.columns[1:])))
    assign = F.filter("assign", lambda x: F.char_length(F.regexp_extract(x["hit"], "^(?:" + ASSIGN + ")$", 2)) >= ASSIGN_VALUE)
    hot = [_named(_random_ranges(c, allowed, allowed_before), c.kind, 3 + number) for number, c in enumerate(classes)]
    base = F.concat(_named(assign, "assign", 0), _named(F.col("access"), "access", 1), _named(F.col("hex"), "hex", 2))
    spans = settle(found.select("doc_id", base.alias("base"), F.concat(*hot).alias("added")))
    many = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint")
    return spans.select(
        "doc_id",
        many("assign").alias("n_assign"),
        many("access").alias("n_access"),
        many("hex").alias("n_hex"),
        F.size("added").cast("bigint").alias("n_entropy"),
        F.array_sort("base").alias("base_spans"),
        F.array_sort(F.concat("base", "added")).alias("all_spans"),
    )

