"""URL rules and a list of URLs: a blocked Bloom filter in front of an exact join.

A URL is judged by the longest rule that fits it, else by a list of canonical URLs. It is on the
list if its canonical form is, or a whole site it belongs to: `site/` for its host or any ending of
it of two labels or more. All these forms are looked up in a Bloom filter first, whose bits for one
form lie in one block of 256, so a lookup is one probe of a hash table of blocks. Only what may be on
the list goes on to the join with the list itself, which removes the false hits; most URLs are
settled without any shuffle but that of the last join with the distinct URLs found.

The filter is broadcast: it has `2^block_bits` rows of one number and four words at most (4 MB by
default), however long the list is. A longer list makes more false hits, never other results.

A null URL, an empty one, or one without `://` has an empty host and path, fits no rule and is on no
list: it is allowed. Any length, repeated rows and repeated keys are judged row by row; an empty
table gives an empty result, an empty list blocks nothing. Only key and URL are read, so names of other
columns cannot clash. There are no ties: of two rules of one length, the one of the longer host goes first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parameters that name a visit, not a page. Fixed values.
TRACKING = ("utm_", "gclid=", "fbclid=", "ref=")
_WORDS = 4


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """The host without a port that says nothing and without `www.`."""
    return F.regexp_replace(host, r"^www\.|:(80|443)?$", "")


def canonical(url: Column) -> Column:
    """Site, path without a closing slash or page name ending, and the parameters that name a page
    in alphabetical order; null for an empty host."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit("^(" + "|".join(TRACKING) + ")")))
    asked = F.array_join(F.array_sort(kept), "&")
    path = F.regexp_replace(path_of(url), r"(/|/index\.html?|\.html?)$", "")
    whole = F.concat(site_of(host_of(url)), F.lit("/"), F.regexp_replace(path, "^/", ""), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(F.lit("")))
    return F.when(host_of(url) != "", whole)


def forms(url: Column) -> Column:
    """Everything whose presence on a list blocks the URL: its canonical form and its sites."""
    labels = F.split(site_of(host_of(url)), r"\.")
    places = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    sites = F.transform(places, lambda i: F.concat(F.array_join(F.slice(labels, i, F.size(labels)), "."), F.lit("/")))
    return F.array_distinct(F.concat(F.array(canonical(url)), sites))


def _bits(form: str, block_bits: int) -> list[Column]:
    """The block of a form and the bits it sets in each word of it: two each, from six bits of the hash."""
    code = f"xxhash64({form})"
    words = [
        f"shiftleft(1L, cast(shiftrightunsigned({code}, {12 * i}) & 63 AS int)) | shiftleft(1L, cast(shiftrightunsigned({code}, {12 * i + 6}) & 63 AS int))"
        for i in range(_WORDS)
    ]
    return [F.expr(f"cast(shiftrightunsigned({code}, {64 - block_bits}) AS int)"), *map(F.expr, words)]


def bloom(listed: DataFrame, form: str, block_bits: int = 16) -> DataFrame:
    """`(block, w0 ... w3)` of all forms; blocks without one have no row. `block_bits` from 1 to 16."""
    if not 1 <= block_bits <= 16:
        raise ValueError("block_bits must be between 1 and 16")
    block, *words = _bits(form, block_bits)
    rows = listed.select(block.alias("block"), *(w.alias(f"w{i}") for i, w in enumerate(words)))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)))


def possible(rows: DataFrame, form: str, filter_: DataFrame, block_bits: int = 16) -> DataFrame:
    """The rows whose `form` may be in the filter: all that are, and a few others."""
    block, *words = _bits(form, block_bits)
    probe = rows.withColumn("_block", block)
    hit = [F.col("_block") == F.col("block")]
    hit += [F.col(f"w{i}").bitwiseAND(w) == w for i, w in enumerate(words)]
    return probe.join(F.broadcast(filter_), hit).select(*rows.columns)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct of the longest rule that fits and its verdict; null if none does.

    A rule `(host, path, verdict)` fits its host and all subdomains of it where the URL's path starts
    with the rule's.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for of, start, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r)):
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(
    pages: DataFrame, key: str, url: str, rules: Sequence[tuple[str, str, str]], listed: DataFrame, form: str, block_bits: int = 16
) -> DataFrame:
    """`(key, host, path, rule, verdict)` of every row: the verdict of its rule, else `block` if it is
    on the list of canonical forms `listed[form]`, else `allow`."""
    forms_listed = listed.select(F.col(form).alias("_form")).where("_form IS NOT NULL").distinct()
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"))
    rows = rows.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    # Rows with a rule ask no list.
    asking = rows.where("_rule IS NULL AND host <> ''").select("_url", F.explode(forms(F.col("_url"))).alias("_form"))
    maybe = possible(asking, "_form", bloom(forms_listed, "_form", block_bits), block_bits)
    found = maybe.join(forms_listed, "_form").select(F.col("_url").alias("_found")).distinct()
    judged = rows.join(found, F.col("_url") == F.col("_found"), "left")
    verdict = F.when(F.col("_found").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        F.col("_key").alias(key), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", verdict).alias("verdict")
    )
