"""User vectors, cosine top-k and similarity ranking.

Products of two vector sets run in batches.  A small side of checked size is
copied to each task and the large side passes through where it is; beyond that
size both sides are packed into blocks, and blocks meet blocks.  No pair leaves
the task unless it is among the k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators import feed as O
from newsloom.operators.common import top_rows
from newsloom.session import cut_lineage

# Parts of a user's vector.
PROFILE_WEIGHT, SAVED_WEIGHT = 1.8, 1.35
HISTORY_LIMIT = 20


def cosine(left: Column, right: Column) -> Column:
    """Cosine over the common length, six decimals; 0 for a zero vector."""
    n = F.least(F.size(left), F.size(right))
    a, b = F.slice(left, 1, n), F.slice(right, 1, n)

    def total(products: Column) -> Column:
        return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)

    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))
    norm = norm * F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.when(norm > 0, F.bround(dot / norm, 6)).otherwise(0.0)


def _matrix(vectors: pd.Series) -> np.ndarray:
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


# Numbers of the small side that may be copied to each task (64 MB), and vectors of a packed block.
MAX_COPIED_NUMBERS = 8_000_000
BLOCK_VECTORS = 4_096

_PAIRS = "l_id long, s_id long, similarity double"


def _best_pairs(l_ids: np.ndarray, a: np.ndarray, s_ids: np.ndarray, b: np.ndarray, k: int, by_large: bool) -> pd.DataFrame:
    """The k best partners of each owner between two blocks; both come in order of their ids, so ties go to the lower one."""
    norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    sims = np.round(np.divide(a @ b.T, norms, out=np.zeros(norms.shape), where=norms > 0), 6)
    scores, ids, others = (sims, l_ids, s_ids) if by_large else (sims.T, s_ids, l_ids)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    rows = np.repeat(np.arange(len(ids)), best.shape[1])
    owner, partner = ids[rows], others[best.ravel()]
    left, right = (owner, partner) if by_large else (partner, owner)
    return pd.DataFrame({"l_id": left, "s_id": right, "similarity": scores[rows, best.ravel()]})


def _beside_copy(left: DataFrame, small: DataFrame, k: int, by_large: bool) -> DataFrame:
    found = small.orderBy("s_id").collect()
    s_ids = np.array([r["s_id"] for r in found], np.int64)
    b = _matrix(pd.Series([r["s_vec"] for r in found], dtype=object)) if found else np.zeros((0, 0))

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lp in batches:
            if not lp.empty and len(s_ids):
                lp = lp.sort_values("l_id", ignore_index=True)
                yield _best_pairs(lp["l_id"].to_numpy(), _matrix(lp["l_vec"]), s_ids, b, k, by_large)

    return left.mapInPandas(multiply, _PAIRS)


def _block_by_block(left: DataFrame, small: DataFrame, n_left: int, n_small: int, k: int, by_large: bool) -> DataFrame:
    """Every block of one side meets every block of the other, by equal block numbers after the left ones are copied."""
    n_blocks = -(-n_small // BLOCK_VECTORS)

    def packed(df: DataFrame, side: str, blocks: int) -> DataFrame:
        numbered = df.withColumn("block", F.pmod(F.xxhash64(f"{side}_id"), F.lit(blocks)))
        rows = F.array_sort(F.collect_list(F.struct(f"{side}_id", f"{side}_vec")))
        return numbered.groupBy("block").agg(rows.alias(side)).select("block", F.col(f"{side}.{side}_id").alias(f"{side}_ids"), F.col(f"{side}.{side}_vec").alias(f"{side}_vecs"))

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                a, b = _matrix(pd.Series(list(row.l_vecs))), _matrix(pd.Series(list(row.s_vecs)))
                yield _best_pairs(np.asarray(row.l_ids, np.int64), a, np.asarray(row.s_ids, np.int64), b, k, by_large)

    lefts = packed(left, "l", -(-n_left // BLOCK_VECTORS)).drop("block")
    copied = lefts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))
    met = copied.join(packed(small, "s", n_blocks), "block").drop("block")
    return met.mapInPandas(multiply, _PAIRS)


def cosine_topk(large: DataFrame, small: DataFrame, large_id: str, small_id: str, k: int, per: str) -> DataFrame:
    """(large id, small id, similarity, rank): the k best partners of each ``per`` id.

    Both inputs are (id, vector), vectors of equal length.  ``small`` is meant to
    be the side that fits into a task, such as the candidate list or one vector
    per label; its size is read first, and a larger one is worked off block by
    block, with the same result.  ``per`` is the side the top-k belongs to.  Ties
    go to the lower id.
    """
    left = large.select(F.col(large_id).cast("bigint").alias("l_id"), F.col("vector").alias("l_vec"))
    right = cut_lineage(small.select(F.col(small_id).cast("bigint").alias("s_id"), F.col("vector").alias("s_vec")))
    n_small, numbers = right.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("s_vec")), F.lit(0))).first()
    by_large = per == large_id
    if numbers <= MAX_COPIED_NUMBERS:
        pairs = _beside_copy(left, right, k, by_large)
    else:
        left = cut_lineage(left)
        pairs = _block_by_block(left, right, left.count(), n_small, k, by_large)
    owner, partner = ("l_id", "s_id") if by_large else ("s_id", "l_id")
    ranked = top_rows(pairs, [owner], [F.col("similarity").desc(), F.col(partner)], k, "rank")
    return ranked.select(F.col("l_id").alias(large_id), F.col("s_id").alias(small_id), "similarity", "rank")


def label_centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, vector): mean vector per label, summed per index with map-side combine."""
    long = vectors.select(label, F.posexplode(vector).alias("idx", "x"))
    means = long.groupBy(label, "idx").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = F.array_sort(F.collect_list(F.struct("idx", "x")))
    return means.groupBy(label).agg(F.transform(packed, lambda e: e["x"]).alias("vector"))


def unit_vector(vector: Column) -> Column:
    """Vector scaled to length one, eight decimals; zero vectors stay zero."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(F.arrays_zip(vector.alias("x"), F.array_repeat(norm, F.size(vector)).alias("n")),
                       lambda e: F.when(e["n"] > 0, F.bround(e["x"] / e["n"], 8)).otherwise(0.0))


def user_embedding(
    profile_vectors: DataFrame, interactions: DataFrame, saved: DataFrame, articles: DataFrame, article_vectors: DataFrame
) -> DataFrame:
    """(user_id, vector): profile, last 20 interactions and last 20 saves, normalised.

    ``profile_vectors`` is (user_id, vector) and ``article_vectors``
    (ai_news_id, vector), both dense.  ``interactions`` carries ``weight``.  A
    user brings at most 41 vectors, so they are summed as arrays in one row.
    """
    recent = top_rows(
        interactions.select("user_id", "ai_news_id", "weight", "created_at", "seq"),
        ["user_id"], [F.col("created_at").desc(), F.col("seq").desc()], HISTORY_LIMIT,
    ).select("user_id", "ai_news_id", "weight")
    last_saves = top_rows(
        saved.select("user_id", "ai_news_id", "saved_at", "seq"), ["user_id"], [F.col("saved_at").desc(), F.col("seq").desc()], HISTORY_LIMIT
    )
    titled = last_saves.join(articles.select("ai_news_id", F.lower(F.trim(F.regexp_replace("final_title", r"\s+", " "))).alias("title")), "ai_news_id")
    key = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("ai_news_id").cast("string"))
    distinct = top_rows(titled.withColumn("key", key), ["user_id", "key"], [F.col("saved_at").desc(), F.col("seq").desc()], 1)
    history = recent.unionByName(distinct.select("user_id", "ai_news_id", F.lit(SAVED_WEIGHT).alias("weight")))
    weighted = history.where("weight <> 0").join(article_vectors, "ai_news_id").select("user_id", "weight", "vector")
    base = profile_vectors.select("user_id", F.lit(PROFILE_WEIGHT).alias("weight"), "vector")
    packed = base.unionByName(weighted).groupBy("user_id").agg(F.collect_list(F.struct("weight", "vector")).alias("vs"))
    size = F.size(F.col("vs")[0]["vector"])
    total = F.aggregate(
        "vs",
        F.array_repeat(F.lit(0.0), size),
        lambda acc, v: F.zip_with(acc, F.transform(v["vector"], lambda x: x * v["weight"]), lambda p, q: p + q),
    )
    return packed.select("user_id", total.alias("total")).select("user_id", unit_vector(F.col("total")).alias("vector"))


def similarity_rank(
    similar: DataFrame, facts: DataFrame, context: DataFrame, user_topics: DataFrame, as_of: Column, limit: int
) -> DataFrame:
    """Final order of each user's most similar candidates.

    ``similar`` is (user_id, ai_news_id, similarity) cut to the similarity
    window.  Off-topic rows and rows viewed but not saved are left out unless
    that empties the user's list.
    """
    flag = F.try_element_at("flags", F.col("ai_news_id"))
    rows = similar.join(facts, "ai_news_id").join(context.select("user_id", "flags"), "user_id", "left").join(user_topics, "user_id", "left")
    saved, viewed = (F.coalesce(flag[c], F.lit(False)) for c in ("saved", "viewed"))
    liked, disliked = (F.coalesce(flag[c], F.lit(False)) for c in ("liked", "disliked"))
    comments = F.coalesce(flag["comment_count"], F.lit(0))
    engagement = (
        F.when(saved, 1.0).otherwise(0.0)
        + F.when(liked, 1.25).when(disliked, -0.5).otherwise(0.0)
        + F.when(viewed, 0.25).otherwise(0.0)
        + F.least(comments * 0.03, F.lit(0.25))
    )
    freshness = O.freshness_48h(F.col("created_at"), as_of)
    score = O.SIMILARITY_WEIGHT * F.col("similarity") + O.ENGAGEMENT_WEIGHT * engagement + O.FRESHNESS_WEIGHT * freshness
    persona = F.lower(F.trim("target_persona"))
    topics = F.filter(F.coalesce("topics", F.array().cast("array<string>")), lambda t: t != "general")
    on_topic = (F.size(topics) == 0) | F.exists(
        topics, lambda t: (persona == t) | F.startswith(persona, F.concat(t, F.lit("|"))) | F.startswith(persona, F.concat(t, F.lit(",")))
    )
    keep = (saved | on_topic) & (~viewed | saved)
    scored = rows.select(
        "user_id", "ai_news_id", "similarity", "ai_score", F.bround(engagement, 6).alias("engagement"), freshness.alias("freshness"),
        F.bround(score, 6).alias("rank_score"), keep.alias("keep"),
    )
    any_kept = F.max("keep").over(O.Window.partitionBy("user_id"))
    kept = scored.withColumn("_any", any_kept).where(F.col("keep") | ~F.col("_any")).drop("_any", "keep")
    order = [F.col(c).desc() for c in ("rank_score", "similarity", "ai_score", "ai_news_id")]
    return top_rows(kept, ["user_id"], order, limit, "position")
