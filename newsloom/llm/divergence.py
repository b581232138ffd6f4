"""How far the sources of a language differ in their words: chi-square-like distances in whole numbers.

For every (lang, source) group the audit gives its distance to each other
source of the language, summed over all kept terms, and the terms that stand
out most against the language.

Most terms occur in few sources, so the distances start from the value that
terms absent everywhere would give and are corrected where a term occurs.  The
corrections of terms in two sources at once come from a frequent-pattern tree:
a term's row is its non-zero counts in order of the sources, equal rows are
merged with their multiplicity, and sorted rows are inserted one after another,
so that a shared beginning is a shared path.  Each node then corrects the pair
of sources of each of its ancestors once, times its multiplicity.  Rows arrive
sorted, so a task holds the one path it is at, never the tree; what it sends on
is one sum per pair of sources.

Nothing is sampled or cut.  A term's row is as long as the sources that use it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import release, staged, text_slices
from newsloom.operators.common import top_rows

#: A term: neither ASCII control, blank, digit nor punctuation.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Shares are in billionths.
UNIT = 1_000_000_000

#: A task folds this many counts, or characters of terms, before it sends them on.
_HELD, _HELD_CHARS = 1 << 18, 1 << 25

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): partial counts of occurrences and of documents."""
    find = re.compile(TERM).findall

    def sent(held: dict) -> Iterator[pa.RecordBatch]:
        keys, values = list(held), list(held.values())
        for i in range(0, len(keys), 1 << 14):
            lang, source, term = zip(*keys[i : i + (1 << 14)])
            n, docs = zip(*values[i : i + (1 << 14)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((lang, source, term, n, docs), _COUNTS.types)], schema=_COUNTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, str], list[int]] = {}
        chars = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found: Counter = Counter()
                for piece in text_slices(text.as_py()):
                    # bytes.lower() changes A-Z only
                    found.update(find(piece.encode().lower().decode()))
                for term, n in found.items():
                    entry = held.get((lang, source, term))
                    if entry is None:
                        held[lang, source, term] = [n, 1]
                        chars += len(term)
                    else:
                        entry[0] += n
                        entry[1] += 1
                if len(held) >= _HELD or chars >= _HELD_CHARS:
                    yield from sent(held)
                    held, chars = {}, 0
        yield from sent(held)

    return docs.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def share(n: str, total: str, v: str) -> str:
    """SQL of 1 + floor(UNIT * (n + 1) / (total + v)), exact; null where no term is kept."""
    return (
        f"CAST({UNIT} AS DECIMAL(10,0)) * CAST({n} + 1 AS DECIMAL(19,0))"
        f" div CAST(nullif({total} + {v}, 0) AS DECIMAL(19,0)) + 1"
    )


def distance(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / q) of shares in billionths."""
    return f"({p} - {q}) * ({p} - {q}) div {q}"


def _pair_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _corrections(p: np.ndarray, p0: np.ndarray, q: np.ndarray, q0: np.ndarray) -> np.ndarray:
    """What a term in both sources adds beyond what each of the two adds alone."""
    f = _pair_distance
    return f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)


class _PairSums:
    """Exact sums of corrections per ordered pair of one language's sources."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}
        self.sums: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def code(self, source: str) -> int:
        return self.codes.setdefault(source, len(self.codes))

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.held += len(columns[0])
        if self.held >= 1 << 16:
            self.fold()

    def fold(self) -> None:
        if not self.parts:
            return
        a, pa_, a0, b, pb, b0, times = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.held = [], 0
        size = len(self.codes)
        for first, second, gain in ((a, b, _corrections(pa_, a0, pb, b0)), (b, a, _corrections(pb, b0, pa_, a0))):
            pair = first * size + second
            # whole numbers beyond 64 bits take Python's
            if float(np.abs(gain).max()) * float(times.max()) * len(gain) < 2.0**62:
                worth = gain * times
            else:
                worth = gain.astype(object) * times.astype(object)
            keys, place = np.unique(pair, return_inverse=True)
            sums = np.zeros(len(keys), worth.dtype)
            np.add.at(sums, place, worth)
            for key, value in zip(keys.tolist(), sums.tolist()):
                at = divmod(key, size)
                self.sums[at] = self.sums.get(at, 0) + int(value)

    def rows(self, lang: str) -> list[tuple[str, str, str, Decimal]]:
        self.fold()
        names = list(self.codes)
        return [(lang, names[a], names[b], Decimal(value)) for (a, b), value in self.sums.items()]


_TREE = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.decimal128(38, 0))])


def tree_corrections(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair corrections of (lang, path, times) rows that arrive sorted by lang and path.

    ``path`` is that of the row before, as columns; ``counts[d]`` what its node
    at depth d holds so far.  A row ends the nodes it does not share.
    """

    def ended(sums: _PairSums, path: tuple[np.ndarray, ...], counts: list[int], kept: int) -> None:
        """Nodes below depth ``kept`` are complete: one correction per node and ancestor."""
        depth = len(counts)
        if depth > max(kept, 1):
            node = np.repeat(np.arange(kept, depth), np.arange(kept, depth))
            above = np.concatenate([np.arange(d) for d in range(kept, depth)])
            source, p, p0 = path
            times = np.array(counts, np.int64)[node]
            sums.add(source[above], p[above], p0[above], source[node], p[node], p0[node], times)

    def emitted(lang: str, sums: _PairSums) -> Iterator[pa.RecordBatch]:
        rows = sums.rows(lang)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TREE.types)], schema=_TREE)

    lang, sums, items, path, counts = None, _PairSums(), [], (), []
    for batch in batches:
        for row_lang, row_items, times in zip(*(c.to_pylist() for c in batch.columns)):
            row = [(sums.code(i["source"]) if row_lang == lang else i["source"], i["p"], i["p0"]) for i in row_items]
            if row_lang != lang:
                ended(sums, path, counts, 0)
                yield from emitted(lang, sums)
                lang, sums, items, counts = row_lang, _PairSums(), [], []
                row = [(sums.code(s), p, p0) for s, p, p0 in row]
            kept = 0
            while kept < min(len(items), len(row)) and items[kept] == row[kept]:
                kept += 1
            ended(sums, path, counts, kept)
            counts = [c + times for c in counts[:kept]] + [times] * (len(row) - kept)
            items = row
            path = tuple(np.array(c, np.int64) for c in zip(*row))
    ended(sums, path, counts, 0)
    yield from emitted(lang, sums)


def _pair_values(langs: DataFrame, paths: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of a language's sources."""
    wide = "decimal(38,0)"
    one = langs.select("lang", "v", F.explode("groups").alias("a"), "groups")
    pairs = one.select("lang", "v", "a", F.explode("groups").alias("b")).where("a.source <> b.source")
    base = pairs.select(
        "lang",
        F.col("a.source").alias("source"),
        F.col("b.source").alias("item"),
        F.expr(f"CAST(coalesce(CAST(v AS DECIMAL(19,0)) * CAST({distance('a.p0', 'b.p0')} AS DECIMAL(19,0)), 0) AS {wide})").alias("value"),
    )
    # terms of one source, whatever the other holds
    single = (
        paths.select("lang", F.explode("path").alias("x"), "times")
        .groupBy("lang", "x")
        .agg(F.sum("times").cast("decimal(19,0)").alias("times"))
        .join(langs.select("lang", "groups"), "lang")
        .select("lang", "x", "times", F.explode("groups").alias("y"))
        .where("x.source <> y.source")
    )
    gains = {
        ("x", "y"): f"{distance('x.p', 'y.p0')} - {distance('x.p0', 'y.p0')}",
        ("y", "x"): f"{distance('y.p0', 'x.p')} - {distance('y.p0', 'x.p0')}",
    }
    alone = single.select(
        "lang",
        F.inline(
            F.array(
                *(
                    F.struct(F.col(f"{a}.source").alias("source"), F.col(f"{b}.source").alias("item"), F.expr(f"CAST(times * CAST({gain} AS DECIMAL(19,0)) AS {wide})").alias("value"))
                    for (a, b), gain in gains.items()
                )
            )
        ),
    )
    shared = (
        paths.where(F.size("path") > 1)
        .repartitionByRange("lang", "path")
        .sortWithinPartitions("lang", "path")
        .select("lang", "path", "times")
        .mapInArrow(tree_corrections, f"lang string, source string, item string, value {wide}")
    )
    return base.unionByName(alone).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").cast("bigint").alias("value"))


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' gives all other sources, 'term' the ``top`` terms above the language's share.

    Null language, source and text count as empty; every row is a document,
    repeated ids too.  A language that keeps no term has pairs of value 0; an
    empty table gives no rows.  Ties go to the item that is smaller in UTF-8.
    Other columns are not read.
    """
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    # one exchange: a term's counts of all sources meet where its language and itself hash to
    terms = staged(
        term_counts(docs)
        .repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .groupBy("lang", "term")
        .agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= min_docs)
        .select("lang", "term", "counts"),
        "terms",
    )
    totals = terms.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = groups.withColumn("total", F.coalesce("total", F.lit(0))).withColumn("v", F.coalesce("v", F.lit(0)))
    langs = staged(
        groups.withColumn("p0", F.expr(share("0L", "total", "v")))
        .groupBy("lang", "v")
        .agg(F.sort_array(F.collect_list(F.struct("source", "total", "p0"))).alias("groups"), F.sum("total").alias("total")),
        "languages",
    )
    by_source = F.map_from_arrays(F.col("groups.source"), F.col("groups"))
    sized = terms.join(langs.select("lang", "v", F.col("total").alias("lang_total"), by_source.alias("group_of")), "lang")
    path = f"""transform(counts, c -> named_struct(
        'source', c.source, 'p', {share("c.n", "group_of[c.source].total", "v")}, 'p0', group_of[c.source].p0))"""
    n_all = "aggregate(counts, 0L, (s, c) -> s + c.n)"
    paths = staged(sized.select("lang", "term", F.expr(path).alias("path"), F.expr(share(n_all, "lang_total", "v")).alias("q")), "shares")
    rows = staged(paths.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("times")), "paths")
    order = [F.desc("value"), F.asc("item")]
    stand_out = (
        paths.select("lang", F.col("term").alias("item"), "q", F.inline("path"))
        .where("p > q")
        .select("lang", "source", "item", F.expr(distance("p", "q")).alias("value"))
    )
    pairs = _pair_values(langs, rows)
    by_group = Window.partitionBy("lang", "source").orderBy(*order)
    columns = ("lang", "source", "part", "item", "value", "rank")
    out = pairs.withColumn("rank", F.row_number().over(by_group)).withColumn("part", F.lit("pair")).select(*columns)
    release(terms)
    return out.unionByName(top_rows(stand_out, ["lang", "source"], order, top, "rank").withColumn("part", F.lit("term")).select(*columns))
