"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic.  The cells' token
counts are raked: one margin after the other, all cells of a source (language,
topic) are scaled so that together they have its target share, until all margins
fit.  No document can be taken more than once, so a cell is held at its own tokens
where it would need more, and the others of its margins are raked on to what is
left of the targets.  A cell's raked tokens over its own tokens is the sampling
probability of its documents.  Whether a document is taken is decided by a hash of
its id, so a rerun takes the same.

A value with fewer tokens than its share of the budget gives all it has, and the
other values of the margin share the rest by their weights; such values are
named in a warning.  So is the largest gap that remains if margins contradict each
other or do not meet within the rounds.

The corpus is read twice: once to count per cell, which combines before the
shuffle so that a source with a third of all rows is one row per task, and once
to sample.  Raking works on the cells only, as joins and sums in Spark.

Null margins are a value of their own (the empty text); a null text has no
tokens and is taken with its cell's probability.  Values without a weight, null
among them, always have a share (see ``Margin``); only a weight of 0 shuts a value
out.  Documents with a null id are hashed as if the id were empty.  Repeated ids
are decided alike.  Weights of values that the table does not have go to those
that exist, in proportion.  An empty table
gives an empty sample.  Extra columns pass through.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.texts import bind
from newsloom.llm.common import WORD_GAP, staged

TOPICS = 8


@dataclass(frozen=True)
class Margin:
    """Target shares of the values of a column.

    ``weights`` gives values' shares; values not in it share what is left to 1,
    in proportion to a power of their own tokens (1 keeps them as they are, 0
    makes all equal).  Without weights all values are shared out that way.  If the
    weights leave nothing, values not in it keep their share of all tokens, and
    the weights are scaled to the remainder.  Which of the two holds depends on the
    weights alone, not on the values that a table happens to have.
    """

    column: str
    weights: Mapping[str, float] | None = None
    power: float = 0.5


def token_count(text: Column) -> Column:
    """Words of a text."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, WORD_GAP))).cast("bigint")


def lexical_topic(text: Column, topics: int = TOPICS) -> Column:
    """A topic where the table has none: the bucket that most long words of the text hash to.

    Words of seven characters or more carry the subject; ties go to the smaller
    bucket, and texts without such words have topic ''.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}{7,})"), F.lit(1))
    buckets = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(topics)).cast("int"))

    def modal(held: Column) -> Column:
        counts = [F.struct((F.size(held) - F.size(F.array_remove(held, t))).alias("n"), F.lit(-t).alias("t")) for t in range(topics)]
        return F.when(F.size(held) == 0, F.lit("")).otherwise(F.concat(F.lit("topic"), (-F.array_max(F.array(*counts))["t"]).cast("string")))

    return bind(buckets, modal)


def _shares(cells: DataFrame, margin: Margin, i: int) -> DataFrame:
    """(margin, value, tokens, share): the share of the sample that each value of one margin is to have."""
    sums = cells.groupBy(F.col(f"m{i}").alias("value")).agg(F.sum("tokens").alias("tokens"))
    listed = F.lit(None).cast("double")
    if margin.weights:
        listed = F.try_element_at(F.create_map(*(F.lit(x) for k, v in margin.weights.items() for x in (k, float(v)))), F.col("value"))
    sums = sums.select("value", "tokens", listed.alias("given"), F.pow(F.col("tokens"), F.lit(margin.power)).alias("own"))
    loose = F.col("given").isNull()
    total = sums.agg(
        F.sum("tokens").alias("all"),
        F.coalesce(F.sum("given"), F.lit(0.0)).alias("given_all"),
        F.coalesce(F.sum(F.when(loose, F.col("tokens"))), F.lit(0)).alias("loose"),
        F.sum(F.when(loose, F.col("own"))).alias("own_all"),
    )
    left = 1 - sum((margin.weights or {}).values())
    if left > 1e-9:
        whole = F.col("given_all") + F.when(F.col("own_all").isNull(), 0.0).otherwise(left)
        share = F.when(loose, left * F.col("own") / F.col("own_all")).otherwise(F.col("given")) / whole
    else:
        share = F.when(loose, F.col("tokens") / F.col("all")).otherwise((1 - F.col("loose") / F.col("all")) * F.col("given") / F.col("given_all"))
    # one row: safe to copy
    return sums.join(F.broadcast(total)).select(F.lit(i).alias("margin"), "value", "tokens", share.alias("share"))


def _reachable(shares: DataFrame, budget: float) -> DataFrame:
    """Add ``target`` tokens and ``full``: values that have too few tokens for their share give all, the others share the rest."""
    level: dict[int, float] = {r[0]: budget for r in shares.select("margin").distinct().collect()}
    while True:
        want = F.element_at(F.create_map(*(F.lit(x) for kv in level.items() for x in kv)), F.col("margin")) * F.col("share")
        full = want >= F.col("tokens") * (1 - 1e-9)
        sums = shares.groupBy("margin").agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(~full, F.col("share"))).alias("open"))
        fresh = {r["margin"]: (budget - r["full"]) / r["open"] if r["open"] else math.inf for r in sums.collect()}
        if all(math.isclose(fresh[i], level[i], rel_tol=1e-9) for i in level):
            return shares.select("*", F.when(full, F.col("tokens")).otherwise(want).alias("target"), full.alias("full"))
        level = fresh


def _warn_unreachable(targets: DataFrame, margins: Sequence[Margin], budget: float, shown: int = 20) -> None:
    short = targets.where(F.col("share") * budget > F.col("tokens") * (1 + 1e-6))
    n = short.count()
    if n:
        rows = short.orderBy((F.col("tokens") - F.col("share") * budget), "margin", "value").limit(shown).collect()
        named = ", ".join(f"{margins[r['margin']].column} '{r['value']}' {100 * r['share']:.2f} % of {100 * r['tokens'] / budget:.2f} %" for r in rows)
        warnings.warn(f"mixing: {n} targets exceed the tokens at hand (wanted of possible share): {named}{', ...' if n > shown else ''}", stacklevel=3)


def rake(cells: DataFrame, margins: Sequence[Margin], rounds: int = 21, tolerance: float = 1e-3, fraction: float | None = None) -> DataFrame:
    """Add ``raked`` tokens to ``cells`` (m0, m1, ..., tokens) so that all margins meet their targets.

    With ``fraction`` they are the tokens to take: that part of all, and never
    more of a cell than it has.  Warns of targets beyond the tokens at hand and,
    if the margins do not meet, of the largest gap that remains.
    """
    cells = cells.where("tokens > 0")
    barred = F.lit(False)
    for i, m in enumerate(margins):
        barred = barred | F.col(f"m{i}").isin([k for k, v in (m.weights or {}).items() if v <= 0])
    sizes = cells.agg(F.sum("tokens").alias("all"), F.sum(F.when(~barred, F.col("tokens"))).alias("open")).first()
    none = cells.withColumn("raked", F.lit(0.0))
    if not sizes["open"]:
        return none
    barred_cells, cells = none.where(barred), cells.where(~barred)
    shares = staged(reduce(DataFrame.union, [_shares(cells, m, i) for i, m in enumerate(margins)]), "shares")
    if fraction is None:
        targets = shares.select("*", (F.col("share") * sizes["all"]).alias("target"), F.lit(False).alias("full"))
    else:
        targets = _reachable(shares, min(fraction * sizes["all"], float(sizes["open"])))
    targets = staged(targets, "targets")
    if fraction is not None:
        _warn_unreachable(targets, margins, fraction * sizes["all"])

    below = F.lit(True) if fraction is None else F.col("rate") < 1
    taken = F.col("tokens") * (F.col("rate") if fraction is None else F.least(F.lit(1.0), F.col("rate")))

    def sums(raked: DataFrame, i: int) -> DataFrame:
        now = raked.groupBy(F.col(f"m{i}").alias("value")).agg(F.sum(taken).alias("now"), F.sum(F.when(below, taken).otherwise(0.0)).alias("open"))
        return now.join(targets.where(F.col("margin") == i).select("margin", "value", "target", "full"), "value")

    # only cells below the bound answer to a factor: one Newton step; values that must give all stay at the bound for good
    step = 1 + (F.col("target") - F.col("now")) / F.col("open")
    high = F.col("now") > F.col("target")
    step = F.when(F.col("open") > 0, F.when(high, F.greatest(step, 0.5 * F.col("target") / F.col("now"))).otherwise(step))
    scale = F.when(F.col("full"), F.lit(math.inf)).otherwise(F.coalesce(step, F.when(high, F.col("target") / F.col("now")), F.lit(1.0)))
    off = F.abs(F.col("now") - F.col("target")) / F.greatest("target", F.lit(1.0))
    raked = cells.withColumn("rate", F.lit(1.0 if fraction is None else float(fraction)))
    last = math.inf
    for _ in range(rounds):
        for i in range(len(margins)):
            factors = sums(raked, i).select(F.col("value").alias(f"m{i}"), scale.alias("scale"))
            raked = raked.join(factors, f"m{i}").withColumn("rate", F.col("rate") * F.col("scale")).drop("scale")
        # each step reads the cells twice: a written table per round keeps the plan from doubling on
        raked = staged(raked, "raked")
        worst = reduce(DataFrame.union, [sums(raked, i).select("margin", "value", off.alias("off")) for i in range(len(margins))])
        worst = worst.agg(F.max(F.struct("off", "margin", "value")).alias("w")).first()["w"]
        # margins that contradict each other would drive cells to 0 without coming closer
        if worst["off"] < tolerance or worst["off"] > 0.97 * last:
            break
        last = worst["off"]
    if worst["off"] >= tolerance:
        warnings.warn(f"mixing: margins do not meet: {margins[worst['margin']].column} '{worst['value']}' is {100 * worst['off']:.2f} % off its target", stacklevel=2)
    raked = raked.withColumn("raked", taken)
    return raked.select(none.columns).union(barred_cells)


def drawn(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a key's hash."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed)), 11) / F.lit(float(1 << 53))


def mix(df: DataFrame, margins: Sequence[Margin], fraction: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
        topic_of: Column | None = None, seed: int = 0, p_col: str = "sampling_p") -> DataFrame:
    """Sample documents so that their tokens meet the margins; adds ``p_col``.

    A margin's column may be ``topic``: then ``topic_of`` (``lexical_topic`` of
    the text, if not given) stands for it, unless the table has such a column.
    """
    topic = topic_of if topic_of is not None else lexical_topic(F.col(text_col))
    names = [F.coalesce((topic if m.column == "topic" and "topic" not in df.columns else F.col(m.column)).cast("string"), F.lit("")) for m in margins]
    keys = [f"m{i}" for i in range(len(margins))]
    held = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    rows = df.select(held, *(n.alias(k) for n, k in zip(names, keys)))
    counted = df.select(token_count(F.col(text_col)).alias("tokens"), *(n.alias(k) for n, k in zip(names, keys)))
    cells = staged(counted.groupBy(*keys).agg(F.sum("tokens").alias("tokens")), "cells")
    chances = rake(cells, margins, fraction=fraction).select(*keys, (F.col("raked") / F.col("tokens")).alias("p"))
    # cells without tokens have no rate of their own: they are taken at the common fraction
    chances = staged(cells.select(*keys).join(chances, keys, "left").withColumn("p", F.coalesce("p", F.lit(float(fraction)))), "chances")
    taken = rows.join(chances, keys).where(drawn(F.col(f"row.`{id_col}`"), seed) < F.col("p"))
    return taken.select("row.*", F.col("p").alias(p_col))
