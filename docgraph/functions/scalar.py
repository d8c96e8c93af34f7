"""Scalar functions of the engine as column expressions (Catalyst sees all of them)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab

ZERO = F.lit  # readable in aggregates below


def count_tokens(text: Column) -> Column:
    """0 for an empty or null text, else a third of its code points, at least 1."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / vocab.CHARS_PER_TOKEN))).cast("long")


def tokens_from_chars(chars: Column) -> Column:
    return F.floor(chars / vocab.CHARS_PER_TOKEN).cast("long")


def normalized_fact(text: Column) -> Column:
    """Lower case, white space collapsed, then punctuation dropped; in this order, so a mark between blanks leaves two."""
    lower = F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    return F.regexp_replace(lower, r"(?U)[^\w\s]", "")


def normalized_ascii_name(name: Column) -> Column:
    """The normalized name of a name without combining marks: lower case, runs of non-word characters as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"(?U)[^\w\s]+", " "), r"(?U)\s+", " "))


def slug(name: Column, default: str = "entity") -> Column:
    s = F.regexp_replace(normalized_ascii_name(name), " ", "-")
    return F.when(s == "", default).otherwise(s)


def without_determiners(normalized: Column) -> Column:
    return F.array_join(F.filter(F.split(normalized, " "), lambda t: ~t.isin("the", "a", "an")), " ")


def truncated(text: Column, n: int) -> Column:
    """Trimmed and cut to n characters, the last of them an ellipsis where something is missing."""
    t = F.trim(text)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, n - 1)), F.lit("…")))


def clamp01(value: Column, default: float = 1.0) -> Column:
    """A number in [0, 1]; what is no number is the default."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(value.try_cast("double"), F.lit(default))))


def epoch_timestamp(n: Column) -> Column:
    """Epoch milliseconds above 1e12, else epoch seconds."""
    return F.when(n > 1_000_000_000_000, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n))


def ordinal_date(iso: Column) -> Column:
    """yyyymmdd of an ISO date string, else 0."""
    return F.coalesce(F.regexp_replace(F.substring(iso, 1, 10), "-", "").try_cast("int"), F.lit(0))


def review_date(horizon: Column, today: Column) -> Column:
    days = F.when(horizon == "short", vocab.HORIZON_DAYS["short"]).otherwise(vocab.HORIZON_DAYS["medium"])
    return F.date_add(today, days)


def one_edit(a: Column, b: Column) -> Column:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    n = F.length(a)
    first = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))), F.lit(1))
    swapped = F.concat(
        F.substring(a, F.lit(1), first - 1), F.substring(a, first + 1, F.lit(1)), F.substring(a, first, F.lit(1)), F.substring(a, first + 2, n)
    )
    return (F.levenshtein(a, b) <= 1) | ((n == F.length(b)) & (n > 1) & (swapped == b))


def tokens_similar(a: Column, b: Column) -> Column:
    """Equal; or both of three letters or more, one the other's prefix, two letters longer at most; or both of five or more, one edit apart."""
    prefix = (F.abs(F.length(a) - F.length(b)) <= 2) & (a.startswith(b) | b.startswith(a))
    return (a == b) | ((F.length(a) >= 3) & (F.length(b) >= 3) & (prefix | ((F.length(a) >= 5) & (F.length(b) >= 5) & one_edit(a, b))))


def pattern_cap(n: Column) -> Column:
    return F.when(n <= 0, 0).otherwise(F.least(F.lit(vocab.PATTERN_CAP), F.bround(F.pow(n.cast("double"), F.lit(0.6))).cast("int")))


def insight_cap(n: Column) -> Column:
    return F.when(n <= 0, 0).otherwise(F.least(F.lit(vocab.INSIGHT_CAP), F.greatest(F.lit(0), F.bround(F.log(n.cast("double"))).cast("int"))))


def cross_cap(total: Column) -> Column:
    """How many of the insights may be across domains; the rest are critical."""
    return F.bround(total * F.lit(0.6)).cast("int")


action_cap = insight_cap


def evenly_spaced(n: Column, k: Column) -> Column:
    """k of 0..n-1, evenly spaced, the last always among them."""
    inner = F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), lambda i: F.floor((i + 0.5) * n / k).cast("int"))
    with_last = F.concat(F.slice(inner, F.lit(1), F.greatest(k - 1, F.lit(0))), F.array((n - 1).cast("int")))
    return F.when(k >= n, F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))).when(k <= 0, F.array().cast("array<int>")).otherwise(F.array_distinct(with_last))


def action_score(axes: list[Column]) -> Column:
    return sum((F.lit(w) * a for w, a in zip(vocab.ACTION_WEIGHTS, axes, strict=True)), F.lit(0.0))


def cosine_distance(v: Column, query: Column) -> Column:
    """1 - dot product of unit vectors, summed in double."""
    d = lambda x: F.transform(x, lambda e: e.cast("double"))
    return F.lit(1.0) - F.aggregate(F.zip_with(d(v), d(query), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def degenerate(v: Column) -> Column:
    """Empty, not finite, constant or of almost no length."""
    bad = F.exists(v, lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))
    return v.isNull() | (F.size(v) == 0) | bad | (F.array_max(v) - F.array_min(v) <= 1e-6) | (squared_norm(v) <= 1e-12)


def percent(x: Column) -> Column:
    return F.concat(F.bround(x * 100).cast("int").cast("string"), F.lit("%"))


#: Fixed value: the characters of short ids, none of which looks like another.
SHORT_ID = "[abcdefghjkmnpqrstuvwxyz23456789]{4}"


def call_number(id_: Column, default: int = 0) -> Column:
    """The number that a call id is; the default where it is none."""
    return F.coalesce(id_.cast("string").try_cast("int"), F.lit(default))


def padded_call_id(id_: Column) -> Column:
    """A call id as four digits; null where it is no number from 0 to 9999."""
    n = F.trim(id_.cast("string")).try_cast("int")
    return F.when(n.between(0, 9999), F.lpad(n.cast("string"), 4, "0"))


def short_id(name: Column) -> Column:
    """The short id at the end of a name; null where there is none."""
    last = F.substring_index(name, "-", -1)
    return F.when(last.rlike(f"^{SHORT_ID}$"), last)


def canonical_hash(*columns: tuple[str, Column]) -> Column:
    """SHA-256 of the canonical JSON of named values, names ascending; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(columns, key=lambda x: x[0])])), 256)


def data_address(data: Column, mime: str) -> Column:
    """Bytes as a data address: on one line, though base64() breaks lines after 76 characters."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.translate(F.base64(data), "\r\n", ""))
