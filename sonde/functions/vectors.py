"""Column expressions on arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def confidence(d: Column) -> Column:
    """1 - d²/2 within 0 and 1: the cosine, for unit vectors at distance d."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d * d / 2))


def unit(v: Column) -> Column:
    size = F.greatest(norm(v), F.lit(1e-10))
    return F.transform(v, lambda x: x / size)


def cells_for(n: Column) -> Column:
    """Cells of a partitioned vector index of n rows."""
    return F.greatest(F.lit(4), F.least(F.lit(1024), F.floor(F.sqrt(n)) * 4)).cast("long")


# --- quality checks, in hundredths so that thresholds are exact


def check_tokens(tier: Column, tokens: Column) -> Column:
    n = F.coalesce(tokens, F.lit(0))
    most = F.when(tier == 1, fixed.TIER1_TOKENS * 99 // 100).when(tier == 2, fixed.TIER2_TOKENS * 99 // 100)
    return F.when((n >= 15) & (most.isNull() | (n < most)), 25).otherwise(0)


def check_ending(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(r'(?U)[.?!:"`]\s*\z')), 25).otherwise(0)


def balanced(text: Column) -> Column:
    """Whether round, square and curly brackets nest.

    Innermost pairs are taken out a few times; what is then left of most texts is nothing, or ends it at
    once. Only deeper nests are followed bracket by bracket.
    """
    left = F.regexp_replace(text, r"[^()\[\]{}]+", "")
    for _ in range(4):
        left = F.regexp_replace(left, r"\(\)|\[\]|\{\}", "")

    def step(open_: Column, c: Column) -> Column:
        pair = F.concat(F.right(open_, F.lit(1)), c)
        return (
            F.when(open_ == "x", "x")
            .when(c.isin("(", "[", "{"), F.concat(open_, c))
            .when(pair.isin("()", "[]", "{}"), F.substring(open_, F.lit(1), F.length(open_) - 1))
            .otherwise("x")
        )

    def deep(left: Column) -> Column:
        never = (F.length(left) % 2 == 1) | F.left(left, F.lit(1)).isin(")", "]", "}") | F.right(left, F.lit(1)).isin("(", "[", "{")
        followed = F.aggregate(F.filter(F.split(left, ""), lambda c: c != ""), F.lit(""), step) == ""
        return F.when(left == "", True).when(never, False).otherwise(followed)

    return F.get(F.transform(F.array(left), deep), 0)


def check_brackets(text: Column) -> Column:
    return F.when(balanced(text), 20).otherwise(0)


def check_blanks(text: Column) -> Column:
    blank = F.length(text) - F.length(F.regexp_replace(text, r"(?U)\s+", ""))
    return F.when(5 * blank <= 2 * F.length(text), 15).otherwise(0)


def check_repeats(text: Column) -> Column:
    words = F.array(F.array_remove(F.split(text, r"(?U)\s+"), ""))
    return F.when(F.get(F.transform(words, lambda w: 10 * F.size(F.array_distinct(w)) >= 3 * F.size(w)), 0), 15).otherwise(0)


def structural_hundredths(tier: Column, tokens: Column, text: Column) -> Column:
    return check_tokens(tier, tokens) + check_ending(text) + check_brackets(text) + check_blanks(text) + check_repeats(text)
