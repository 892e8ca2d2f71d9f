"""Text functions as column expressions, and the same rules in Python for use inside Arrow functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and what they are folded to.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝÆŒŠŽ"
PLAIN = "AAAAAACEEEEIIIINOOOOOOUUUUYAOSZ"
# Confusable characters folded to one of their class.
CLASS_FROM, CLASS_TO = "ODQILGSBZV", "00011C582U"
CLASSES = "0123456789ACEFHJKMNPRTUWXY"

_FOLD = {ord(a): b for a, b in zip(MARKED, PLAIN, strict=True)} | {ord("ß"): "S"}
_HELD = "\x01"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(c: str | Column) -> Column:
    """Upper case without marks; letters and digits only, and a point or comma between two digits as a point."""
    x = F.translate(F.upper(F.replace(col(c), F.lit("ß"), F.lit("S"))), MARKED, PLAIN)
    x = F.regexp_replace(x, r"(?<=\p{Nd})[.,](?=\p{Nd})", _HELD)
    return F.translate(F.regexp_replace(x, r"[^\p{L}\p{Nd}\x01]", ""), _HELD, ".")


def normalize_with_offsets(s: str) -> tuple[str, list[int]]:
    """The normalized text and the place in ``s`` of each kept character, then the end of ``s``."""
    kept, at = [], []
    for i, c in enumerate(s):
        u = c.upper()
        u = c if len(u) != 1 else u
        u = _FOLD.get(ord(u), u)
        if u.isalpha() or u.isdecimal():
            kept.append(u)
        elif u in ".," and 0 < i < len(s) - 1 and s[i - 1].isdecimal() and s[i + 1].isdecimal():
            kept.append(".")
        else:
            continue
        at.append(i)
    return "".join(kept), [*at, len(s)]


def offsets(c: str | Column) -> Column:
    """Places (from 0) of the kept characters of ``c``, then its length, as an array."""
    x = col(c)
    chars = F.filter(F.split(x, ""), lambda s: s != "")
    kept = lambda i: normalize(F.substring(x, i + 1, F.lit(1))) != ""
    point = lambda i: F.substring(x, i, F.lit(3)).rlike(r"^\p{Nd}[.,]\p{Nd}$") & (i > 0)
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(chars) - 1, F.lit(0))), lambda i: kept(i) | point(i))
    return F.concat(F.when(F.length(x) > 0, places).otherwise(F.array().cast("array<int>")), F.array(F.length(x)))


def numbers(norm: str | Column) -> Column:
    """Maximal runs of ASCII digits and points of a normalized text."""
    return F.regexp_extract_all(col(norm), F.lit(r"([0-9.]+)"), 1)


def class_fold(norm: str | Column) -> Column:
    return F.translate(col(norm), CLASS_FROM, CLASS_TO)


def histogram(norm: str | Column) -> Column:
    """Counts of the confusable classes, in the order of ``CLASSES``."""
    counts = lambda x: F.transform(F.array(*[F.lit(c) for c in CLASSES]), lambda c: F.length(x) - F.length(F.replace(x, c, F.lit(""))))
    return let(class_fold(norm), counts)


def deficit(claim: Column, read: Column) -> Column:
    """Characters of the claim, by class, that the reading cannot supply."""
    return F.aggregate(F.zip_with(claim, read, lambda a, b: F.greatest(a - b, F.lit(0))), F.lit(0), lambda s, x: s + x)


def beyond(claim: Column, read: Column, budget: Column) -> Column:
    """A proof that the claim is further from any stretch of the reading than ``budget`` half edits."""
    return 2 * deficit(claim, read) > budget


def is_upper(c: str | Column) -> Column:
    return col(c).rlike(r"\p{L}") & ~col(c).rlike(r"\p{Ll}")


def span_text(c: str | Column, start: str | Column, stop: str | Column) -> Column:
    """Characters start to stop (from 0, half open); empty where that is no span."""
    s, e = col(start), col(stop)
    return F.when((s >= 0) & (e <= F.length(c)) & (s < e), F.substring(col(c), s + 1, e - s)).otherwise("")


def header_words(c: str | Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(col(c)), r"\s+"), normalize), lambda w: w != "")


def quote(text: str | Column, at: str | Column, start: Column, stop: Column, otherwise: Column) -> Column:
    """What a stretch of the normalized text was printed as."""
    t, a = col(text), col(at)
    lo, hi = F.get(a, start), F.get(a, stop)
    return F.when((start < stop) & (stop < F.size(a)) & (start >= 0), F.trim(F.substring(t, lo + 1, hi - lo))).otherwise(otherwise)


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def title_words(c: str | Column) -> Column:
    return F.initcap(F.lower(col(c)))


# The two spellings of one designation.
WHISK = ("whiskey", "whisky")


def other_spellings(c: str | Column) -> Column:
    """The text with one spelling of the designation replaced by the other, in lower, upper and title case."""
    x = col(c)
    out = []
    for a, b in (WHISK, WHISK[::-1]):
        for f in (str.lower, str.upper, str.capitalize):
            out.append(F.when(F.contains(x, F.lit(f(a))), F.replace(x, F.lit(f(a)), F.lit(f(b)))))
    return F.filter(F.array(*out), lambda s: s.isNotNull())


def shortest(v: str | Column) -> Column:
    """A number with as few decimals as give it back."""
    x = col(v).cast("double")
    s = F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))
    return s


def _trimmed(s: Column) -> Column:
    return F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used; nested expressions stay small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fixed(v: str | Column, places: int) -> Column:
    """A number from 0 to a few hundred thousand with so many decimals, rounding its exact binary value, half to even.

    Java's formatter rounds the shortest decimal form instead, and so 0.355 up.
    """
    x = col(v).cast("double")

    def rounded(bits: int) -> Column:
        wide = F.lit(1 << bits).cast("decimal(19,0)")
        scaled = (x * F.lit(float(1 << bits))).cast("long").cast("decimal(19,0)") * F.lit(10**places).cast("decimal(4,0)")

        def up(n: Column, q: Column) -> Column:
            return let((n - q * wide) * 2, lambda rest: (q + F.when((rest > wide) | ((rest == wide) & (q % 2 == 1)), 1).otherwise(0)).cast("long"))

        return let(scaled, lambda n: let(F.floor(n / wide).cast("decimal(19,0)"), lambda q: up(n, q)))

    def written(q: Column) -> Column:
        return F.concat(F.floor(q / 10**places).cast("string"), F.lit("."), F.lpad((q % 10**places).cast("string"), places, "0"))

    return let(F.when(x >= 256.0, rounded(43)).when(x >= 4.0, rounded(54)).otherwise(rounded(60)), written)


def printings(v: str | Column) -> Column:
    """How a number may be printed: shortest, then with one and two decimals, with and without trailing zeros."""
    x = col(v).cast("double")
    forms = F.transform(F.array(fixed(x, 1), fixed(x, 2)), lambda s: F.array(s, _trimmed(s)))
    return F.array_distinct(F.concat(F.array(shortest(x)), F.flatten(forms)))


def abv_text(v: str | Column) -> Column:
    return F.concat(shortest(v), F.lit("% Alc./Vol."))


def proof_text(v: str | Column) -> Column:
    return F.concat(shortest(col(v) * 2), F.lit(" Proof"))


def net_text(v: str | Column) -> Column:
    x = col(v)
    return F.when(x >= 1000, F.concat(shortest(x / 1000), F.lit(" L"))).otherwise(F.concat(shortest(x), F.lit(" mL")))


def basename(c: str | Column) -> Column:
    return F.lower(F.element_at(F.split(col(c), "/"), -1))


def fnv1a32(c: str | Column) -> Column:
    """FNV-1a of the UTF-8 bytes, 32 bits."""
    h = F.hex(F.encode(col(c), "UTF-8"))
    n = (F.length(h) / 2).cast("int")
    steps = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(h, i * 2 - 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(steps, F.lit(2166136261).cast("long"), lambda acc, i: (acc.bitwiseXOR(byte(i)) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


def unit_share(c: str | Column) -> Column:
    """A number in [0, 1) from the low 24 bits of the hash."""
    return F.pmod(fnv1a32(c), F.lit(1 << 24)) / F.lit(float(1 << 24))


def fingerprint(version: str | Column, commit: str | Column, modified: str | Column, models: str | Column) -> Column:
    """Twelve hex digits over a build's identity; ``models`` is a map of names to hashes."""
    entries = F.transform(F.array_sort(F.map_entries(col(models))), lambda e: F.concat(F.lit("\0"), e["key"], F.lit("="), e["value"]))
    return F.substring(F.sha2(F.concat(col(version), F.lit("\0"), col(commit), F.lit("\0"), col(modified).cast("string"), F.array_join(entries, "")), 256), 1, 12)
