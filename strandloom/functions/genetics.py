"""Mendelian genetics, probability and counting.

Genotypes are arrays of codes: D homozygous dominant, R homozygous recessive, H heterozygous.
Gametes are arrays of the allele codes D and R.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.constants import DOMINANT, HETEROZYGOUS, RECESSIVE
from strandloom.functions.alphabet import let


def alleles(genotype: Column) -> Column:
    """Alleles one locus can pass on, dominant first."""
    return F.when(genotype == HETEROZYGOUS, F.lit([DOMINANT, RECESSIVE])).otherwise(F.array(genotype))


def mix_alleles(a: Column, b: Column) -> Column:
    return F.when(a == b, a).otherwise(F.lit(HETEROZYGOUS))


def mix_gametes(a: Column, b: Column) -> Column:
    """Genotype of two gametes, over the loci both have."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), mix_alleles)


def gametes(genotype: Column) -> Column:
    """All gametes, in order: the last locus varies fastest."""
    return F.aggregate(
        genotype,
        F.array(F.array().cast("array<string>")),
        lambda acc, locus: F.flatten(
            F.transform(acc, lambda g: F.transform(alleles(locus), lambda x: F.concat(g, F.array(x))))
        ),
    )


def cross(gametes_a: Column, gametes_b: Column) -> Column:
    """Offspring genotypes of two lists of gametes, row-major."""
    return F.flatten(F.transform(gametes_a, lambda a: F.transform(gametes_b, lambda b: mix_gametes(a, b))))


#: Loci whose alleles fit a number, a decimal digit each.
DIGITS = 18


def _digits(genotype: Column) -> Column:
    """All gametes in order as ascending numbers, a digit per locus: 0 for D and 1 for R."""
    loci = F.split(F.reverse(genotype), "")
    places = F.zip_with(loci, F.sequence(F.lit(0), F.length(genotype) - 1), lambda x, i: F.struct(x.alias("x"), F.pow(F.lit(10), i).cast("bigint").alias("v")))
    places = F.when(F.length(genotype) > 0, places).otherwise(F.array().cast("array<struct<x:string,v:bigint>>"))
    raised = lambda acc, v: F.transform(acc, lambda g: g + v)
    step = lambda acc, p: F.when(p.x == "H", F.concat(acc, raised(acc, p.v))).when(p.x == "R", raised(acc, p.v)).otherwise(acc)
    return F.aggregate(places, F.array(F.lit(0).cast("bigint")), step)


def _spelled(number: Column, size: Column, codes: str) -> Column:
    """The code of each digit, 0 and up."""
    return F.translate(F.lpad(number.cast("string"), size, F.lit("0")), "012"[: len(codes)], codes)


def gamete_rows(df: DataFrame, genotype: str) -> DataFrame:
    """The gametes of strings of D, H and R, a row each, with `n` and `gamete`. Up to 18 loci are numbers until
    they are spelled, so that a gamete is no list of letters."""
    size = F.length(genotype)
    short = df.where((size > 0) & (size <= DIGITS)).select("*", F.posexplode(_digits(F.col(genotype))).alias("n", "_g"))
    short = short.select(*df.columns, "n", _spelled(F.col("_g"), size, "DR").alias("gamete"))
    rest = df.where((size == 0) | (size > DIGITS)).select("*", F.posexplode(gametes(F.split(genotype, ""))).alias("n", "_g"))
    return short.unionByName(rest.select(*df.columns, "n", F.array_join("_g", "").alias("gamete")))


def offspring_rows(df: DataFrame, a: str, b: str) -> DataFrame:
    """The offspring of two genotypes in the same way, with `n` and `offspring`, row-major, over the loci that both
    have: the sum of two gametes has 0 for D, 1 for H and 2 for R at every locus."""
    a_size, b_size = F.length(a), F.length(b)
    fits = (a_size > 0) & (b_size > 0) & (a_size <= DIGITS) & (b_size <= DIGITS)
    size = F.least(a_size, b_size)
    cut = lambda x, n: F.transform(_digits(F.col(x)), lambda g: F.call_function("div", g, F.pow(F.lit(10), n - size).cast("bigint")))
    whole = lambda x, n: F.when(n == size, _digits(F.col(x))).otherwise(cut(x, n))
    lists = df.where(fits).select("*", whole(a, a_size).alias("_x"), whole(b, b_size).alias("_y"), size.alias("_size"))
    rows = lists.select(*df.columns, "_y", "_size", F.posexplode("_x").alias("_i", "_a"))
    rows = rows.select(*df.columns, "_size", "_i", "_a", F.size("_y").alias("_of"), F.posexplode("_y").alias("_j", "_b"))
    short = rows.select(*df.columns, (F.col("_i") * F.col("_of") + F.col("_j")).alias("n"), _spelled(F.col("_a") + F.col("_b"), F.col("_size"), "DHR").alias("offspring"))
    both = cross(gametes(F.split(a, "")), gametes(F.split(b, "")))
    rest = df.where(~fits).select("*", F.posexplode(both).alias("n", "_g"))
    return short.unionByName(rest.select(*df.columns, "n", F.array_join("_g", "").alias("offspring")))


def dominant_phenotype_probability(hom_dominant: Column, het: Column, hom_recessive: Column) -> Column:
    """Chance that two random members of the population have a dominant child.

    One minus the recessive cases: both recessive, one of each kind with half, two carriers
    with a quarter. NULL for a population of less than two.
    """
    total = hom_dominant + het + hom_recessive
    recessive = hom_recessive * (hom_recessive - 1) + hom_recessive * het + het * (het - 1) / 4
    return 1 - F.try_divide(recessive.cast("double"), (total * (total - 1)).cast("double"))


def expected_dominant(
    dom_dom: Column, dom_het: Column, dom_rec: Column, het_het: Column, het_rec: Column, children: int = 2
) -> Column:
    """Expected number of dominant children over all couples."""
    return children * (dom_dom + dom_het + dom_rec + het_het * 0.75 + het_rec * 0.5)


def choose(*, k: Column, n: Column) -> Column:
    """n over k as a double; 0 when k > n."""
    m = F.least(k, n - k)
    factors = F.sequence(F.lit(1).cast("bigint"), F.greatest(m, F.lit(1)).cast("bigint"))
    product = F.aggregate(factors, F.lit(1.0), lambda acc, i: acc * (n - m + i) / i)
    return F.when(m < 0, F.lit(0.0)).when(m == 0, F.lit(1.0)).otherwise(product)


def binomial(*, p: Column, k: Column, n: Column) -> Column:
    """Chance of exactly k successes in n trials."""
    return choose(k=k, n=n) * F.pow(p, k) * F.pow(1 - p, n - k)


#: Up to so many descendants the terms are summed one by one.
_SUMMED = 1 << 12
_NODES, _WEIGHTS = (v.tolist() for v in np.polynomial.legendre.leggauss(64))


def _summed_tail(total: Column, at_least: Column, p: float) -> Column:
    """Terms follow from one another by their ratio, from the largest one outwards, and are divided
    by their sum, so neither a binomial coefficient overflows nor the largest term underflows."""
    odds = p / (1 - p)
    top = F.floor((total + 1) * p)

    def walk(places: Column, ratio) -> Column:
        """Sum of all terms and of those that count, the largest being 1; `ratio` leads on."""
        start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("tail"))

        def step(acc: Column, i: Column) -> Column:
            kept = F.when(i >= at_least, acc["term"]).otherwise(F.lit(0.0))
            return F.struct(
                (acc["term"] * ratio(i)).alias("term"), (acc["sum"] + acc["term"]).alias("sum"), (acc["tail"] + kept).alias("tail")
            )

        return F.aggregate(places, start, step)

    up = walk(F.sequence(top, total.cast("bigint")), lambda i: (total - i) / (i + 1) * odds)
    down = walk(F.sequence(top, F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")), lambda i: i / (total - i + 1) / odds)
    one = F.when(top >= at_least, F.lit(1.0)).otherwise(F.lit(0.0))  # counted in both

    def share(both: Column) -> Column:
        return (both["up"]["tail"] + both["down"]["tail"] - one) / (both["up"]["sum"] + both["down"]["sum"] - 1)

    return let(F.struct(up.alias("up"), down.alias("down")), share)


def _log1p_rest(u: Column) -> Column:
    """log(1 + u) - u without the loss of digits near 0."""
    series = F.lit(1 / 9)
    for i in range(8, 1, -1):
        series = F.lit((-1.0) ** (i + 1) / i) + u * series
    return F.when(F.abs(u) < 0.01, u * u * series).otherwise(F.log1p(u) - u)


def _integrated_tail(total: Column, at_least: Column, p: float) -> Column:
    """The tail of many trials is an incomplete beta function: the share of t^(k-1) (1-t)^(n-k) that lies
    below p. Both sides of p are integrated with 64 points each, over 12 standard deviations from
    the mode, in units of those; nothing grows with the number of trials."""
    a, b = at_least.cast("double") - 1, total - at_least
    # The standard deviation is sqrt(a b / (a + b)) trials; in units of the mode and of its complement:
    place = F.try_divide(p * (a + b) - a, F.sqrt(F.try_divide(a * b, a + b)))
    per_a, per_b = F.sqrt(F.try_divide(b, a * (a + b))), F.sqrt(F.try_divide(a, b * (a + b)))
    points = F.arrays_zip(F.lit(_NODES).alias("x"), F.lit(_WEIGHTS).alias("w"))
    known = F.struct(*(c.alias(n) for c, n in ((a, "a"), (b, "b"), (per_a, "per_a"), (per_b, "per_b"), (place, "place"))))

    def integral(v: Column, low: Column, high: Column) -> Column:
        half = (high - low) / 2

        def add(acc: Column, point: Column) -> Column:
            s = low + half * (1 + point["x"])
            return acc + point["w"] * F.exp(v["a"] * _log1p_rest(s * v["per_a"]) + v["b"] * _log1p_rest(-s * v["per_b"]))

        return F.when(high > low, half * F.aggregate(points, F.lit(0.0), add)).otherwise(F.lit(0.0))

    def share(v: Column) -> Column:
        first, last = F.try_divide(F.lit(-1.0), v["per_a"]), F.try_divide(F.lit(1.0), v["per_b"])  # t is 0 and 1 there
        below = integral(v, F.greatest(first, F.least(v["place"], F.lit(0.0)) - 12), F.least(v["place"], F.lit(12.0)))
        above = integral(v, F.greatest(v["place"], F.lit(-12.0)), F.least(last, F.greatest(v["place"], F.lit(0.0)) + 12))
        both = let(F.struct(below.alias("below"), above.alias("above")), lambda x: F.try_divide(x["below"], x["below"] + x["above"]))
        # Too far from the mode for a double, one side is nothing.
        return F.coalesce(both, F.when(v["place"] > 0, F.lit(1.0)).otherwise(F.lit(0.0)))

    return let(known, share)


def independent_alleles_tail(*, generation: Column, at_least: Column, p: float = 0.25) -> Column:
    """Chance that at least `at_least` of the 2^generation descendants are AaBb; generations up to 62."""
    total = F.pow(F.lit(2.0), generation)
    few = total <= _SUMMED
    return (
        F.when(at_least <= 0, F.lit(1.0))
        .when(at_least > total, F.lit(0.0))
        .when(few, _summed_tail(F.least(total, F.lit(float(_SUMMED))), at_least, p))
        .when(at_least == 1, 1 - F.pow(F.lit(1 - p), total))
        .when(at_least == total, F.pow(F.lit(p), total))
        .otherwise(_integrated_tail(total, at_least, p))
    )


def rabbits(n: Column, k: Column) -> Column:
    """F(n) = F(n-1) + k F(n-2) with F(1) = F(2) = 1."""
    start = F.struct(F.lit(1).cast("bigint").alias("last"), F.lit(1).cast("bigint").alias("now"))
    steps = F.sequence(F.lit(3).cast("bigint"), F.greatest(n, F.lit(3)).cast("bigint"))
    grown = F.aggregate(
        steps, start, lambda s, _: F.struct(s["now"].alias("last"), (s["now"] + k * s["last"]).alias("now"))
    )["now"]
    return F.when(n <= 2, F.lit(1).cast("bigint")).otherwise(grown)


def mortal_rabbits(n: Column, m: Column) -> Column:
    """Pairs alive in month n when each lives m months and breeds from its second month on."""
    newborn = F.concat(F.array(F.lit(1).cast("bigint")), F.array_repeat(F.lit(0).cast("bigint"), (m - 1).cast("int")))

    def total(ages: Column) -> Column:
        return F.aggregate(ages, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def month(ages: Column, _: Column) -> Column:
        born = total(ages) - F.element_at(ages, 1)
        return F.concat(F.array(born), F.slice(ages, F.lit(1), (m - 1).cast("int")))

    months = F.sequence(F.lit(2).cast("bigint"), F.greatest(n, F.lit(2)).cast("bigint"))
    return F.when(n < 2, F.lit(1).cast("bigint")).otherwise(total(F.aggregate(months, newborn, month)))


def inner_nodes(leaves: Column) -> Column:
    """Inner nodes of an unrooted binary tree."""
    return leaves - 2


def _longest(df: DataFrame, length: Column, given: int | None) -> tuple[DataFrame, int]:
    """How many letters the longest row asks for; with a given number, rows beyond it are errors."""
    if given is None:
        return df, df.agg(F.max(length)).first()[0] or 0
    beyond = F.raise_error(F.concat(F.lit(f"more than {given}: "), length.cast("string"))).cast("boolean")
    return df.where(F.when(length > given, beyond).otherwise(F.lit(True))), given


def words(df: DataFrame, symbols: str, length: Column, max_length: int | None = None, name: str = "word") -> DataFrame:
    """All strings of `length` over the array column `symbols`, as rows.

    One generator per letter: rows grow inside the tasks, nothing is shuffled or held as one
    array. Without `max_length` the longest length is read from the data first.
    """
    df, longest = _longest(df, length, max_length)
    out = df.withColumn(name, F.lit(""))
    for i in range(longest):
        grown = F.transform(F.col(symbols), lambda c: F.concat(F.col(name), c))
        out = out.withColumn(name, F.explode(F.when(length > i, grown).otherwise(F.array(name))))
    return out


def permutations(df: DataFrame, n: Column, max_n: int | None = None, name: str = "permutation") -> DataFrame:
    """All permutations of 1..n as integer arrays, one per row. Without `max_n` the largest n is
    read from the data first."""
    df, longest = _longest(df, n, max_n)
    out = df.withColumn(name, F.array().cast("array<int>"))
    for i in range(longest):
        rest = F.array_except(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.col(name))
        grown = F.transform(rest, lambda x: F.concat(F.col(name), F.array(x)))
        out = out.withColumn(name, F.explode(F.when(n > i, grown).otherwise(F.array(name))))
    return out
