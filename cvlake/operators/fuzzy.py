"""Similarity of strings by their longest common subsequence, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cvlake.functions.text import let, words


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: the rows of the table of prefixes, one folded into the next.

    Takes len(a) * len(b) ** 2 steps inside the row, so it is for names and short lines.
    """
    zero = lambda n: F.array_repeat(F.lit(0), n)

    def table(x: Column) -> Column:
        p, q = x["p"], x["q"]

        def next_row(row: Column, c: Column) -> Column:
            start = F.struct(F.array(F.lit(0)).alias("done"), F.lit(0).alias("last"))

            def cell(acc: Column, j: Column) -> Column:
                here = F.when(c == F.get(q, j - 1), F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), acc["last"]))
                return let(here, lambda v: F.struct(F.concat(acc["done"], F.array(v)).alias("done"), v.alias("last")))

            return F.aggregate(F.sequence(F.lit(1), F.size(q)), start, cell, lambda acc: acc["done"])

        return F.aggregate(p, zero(F.size(q) + 1), next_row, lambda row: F.get(row, F.size(q)))

    split = F.struct(F.split(a, "").alias("p"), F.split(b, "").alias("q"))
    return F.when((a == "") | (b == ""), F.lit(0)).otherwise(let(split, table))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Similarity (0 to 1) of two strings by the words that they share and those of each alone; 0 if one has none.

    Words are taken once and in order. The shared ones, followed by those of a alone and of b alone, are compared with each other
    and with the shared ones by insertions and deletions; the best of the three counts. If all words of one are in
    the other it is 1. Letter case matters.
    """

    def parts(x: Column) -> Column:
        joined = lambda w: F.array_join(F.sort_array(w), " ")
        return F.struct(joined(F.array_intersect(x["a"], x["b"])).alias("both"), joined(F.array_except(x["a"], x["b"])).alias("a"), joined(F.array_except(x["b"], x["a"])).alias("b"))

    def ratio(s: Column) -> Column:
        n, na, nb = F.length(s["both"]), F.length(s["a"]), F.length(s["b"])
        gap = F.when(n > 0, 1).otherwise(0)
        whole_a, whole_b = n + gap + na, n + gap + nb
        apart = na + nb - 2 * common_length(s["a"], s["b"])
        alone = F.lit(1.0) - apart / (whole_a + whole_b)
        shared = F.greatest(F.lit(1.0) - (gap + na) / (n + whole_a), F.lit(1.0) - (gap + nb) / (n + whole_b))
        return F.when((n > 0) & ((na == 0) | (nb == 0)), 1.0).when(n > 0, F.greatest(alone, shared)).otherwise(alone)

    tokens = F.struct(F.array_distinct(words(a)).alias("a"), F.array_distinct(words(b)).alias("b"))
    return let(tokens, lambda x: F.when((F.size(x["a"]) > 0) & (F.size(x["b"]) > 0), let(parts(x), ratio)).otherwise(0.0))
