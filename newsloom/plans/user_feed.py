"""The whole personalised feed for every user in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators import feed as O
from newsloom.operators import profiles as P
from newsloom.session import cut_lineage, spread_partitions


def feed_context(
    users: DataFrame,
    enriched: DataFrame,
    raw: DataFrame,
    interaction_log: DataFrame,
    save_log: DataFrame,
    comments: DataFrame,
    as_of: Column,
    limit: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """One row per active user with all that ranking reads of it, and the candidates' own facts."""
    interactions = P.merge_interactions(interaction_log)
    # a few hundred rows that five branches use: written once, on shared storage
    candidates = cut_lineage(O.fresh_candidates(enriched, raw, as_of, limit))
    facts = O.candidate_facts(candidates)
    keys = cut_lineage(O.candidate_keys(candidates))
    profile = P.profile_from_likes(interactions, enriched, raw, as_of, wanted=keys)
    state = P.user_item_state(interactions, P.saved_state(save_log), comments)
    active = users.where("is_active").select("user_id")
    context = O.user_context(
        active, state, profile, keys, P.seen_items(interactions, as_of), P.cold_start_users(active, interactions, as_of), candidates, as_of
    )
    return context, facts


def candidate_rows(*tables, limit: int = 20, parity: bool = False, slim: bool = False) -> tuple[DataFrame, DataFrame]:
    """User × candidate rows before scoring, and the candidates' own facts; ``tables`` are those of ``feed_context``."""
    context, facts = feed_context(*tables, limit=limit)
    return O.user_candidates(context, facts, parity, slim), facts


def rank_rows(rows: DataFrame, as_of: Column) -> DataFrame:
    """Scored and ranked rows with the two profile flags that placement reads."""
    known = F.col("topic_weight").isNotNull()
    return O.rank_items(rows, as_of).withColumns({"topic_known": known, "preferred": known | F.col("source_weight").isNotNull()})


def ranked_feed(*tables, limit: int = 20, parity: bool = False) -> DataFrame:
    """All candidates of every active user with ``rank_score`` and ``rank_pos``.

    ``tables`` are those of ``feed_context`` up to ``as_of``.
    """
    rows, _ = candidate_rows(*tables, limit=limit, parity=parity)
    return rank_rows(rows, tables[-1])


def place(ranked: DataFrame, limit: int = 20, swaps: bool = True) -> DataFrame:
    """Slots, regional mix and diversity swaps: the rows that have a ``feed_pos``."""
    placed = O.region_quota(O.preference_slots(O.shortlist(ranked, limit), limit), limit)
    if swaps:
        placed = O.diversity_swaps(placed, limit, topic_bound=O.TOPIC_CAP)
    return placed.where(F.col("feed_pos").isNotNull())


def assemble(ranked: DataFrame, limit: int = 20, swaps: bool = True) -> DataFrame:
    """Placed and cleaned-up rows of wide ranked rows."""
    return O.sanitize_feed(place(ranked, limit, swaps), limit)


def slim_ranked(*tables, limit: int = 20, parity: bool = False) -> tuple[DataFrame, DataFrame]:
    """Ranked rows with the columns that placement reads only, and the candidates' own facts."""
    rows, facts = candidate_rows(*tables, limit=limit, parity=parity, slim=True)
    return _slim(rows, tables[-1]), facts


def _slim(rows: DataFrame, as_of: Column) -> DataFrame:
    return rank_rows(rows, as_of).select(
        "user_id", "ai_news_id", "category", "region", "rank_pos", "rank_score", "preferred", "topic_known", "seen", "liked", "saved", "viewed"
    )


def for_like_users(context: DataFrame, n_candidates: int, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``build(context)``, made once for users that bring nothing, whose rows differ in ``user_id`` only.

    They differ in ``cold_start`` at most, and are most users where many never
    come back.  The first of each kind stands for the others, who get copies of
    its rows.
    """
    context = cut_lineage(context)
    plain = F.lit(True)
    for name in O.USER_MAPS:
        plain = plain & F.col(name).isNull()
    kinds = context.where(plain).groupBy(F.coalesce("cold_start", F.lit(False)).alias("kind")).agg(F.min("user_id").alias("first"))
    first = F.lit(None).cast(context.schema["user_id"].dataType)
    for kind, user in kinds.collect():
        first = F.when(F.coalesce("cold_start", F.lit(False)) == kind, F.lit(user)).otherwise(first)
    led = context.withColumn("first", F.when(plain, first).otherwise(F.col("user_id")))
    leaders = led.where(F.col("first") == F.col("user_id")).drop("first")
    parts = spread_partitions(context.sparkSession, leaders.count() * n_candidates)
    built = cut_lineage(build(leaders.repartition(parts, "user_id")))
    others = led.where(F.col("first") != F.col("user_id")).select("user_id", "first")
    # at most two users' rows
    shared = built.join(F.broadcast(kinds.select(F.col("first").alias("user_id"))), "user_id", "left_semi").withColumnRenamed("user_id", "first")
    return built.unionByName(others.join(F.broadcast(shared), "first").drop("first"))


def _cleaned(ranked: DataFrame, facts: DataFrame, limit: int) -> DataFrame:
    """Placed and cleaned-up rows of slim ranked rows, which meet the candidates' facts once placed."""
    details = facts.select("ai_news_id", "language", "ai_score", "created_at", "final_title", "text_len", "image_url")
    return O.sanitize_feed(place(ranked, limit).join(details, "ai_news_id"), limit)


def user_feed(*tables, limit: int = 20, parity: bool = False) -> DataFrame:
    """(user_id, position, ai_news_id, …): at most ``limit`` rows per active user."""
    feed = _cleaned(*slim_ranked(*tables, limit=limit, parity=parity), limit)
    return feed.select(
        "user_id", "position", "ai_news_id", "category", "region", "language", "ai_score", "rank_score", "created_at", "liked",
        "saved", "viewed",
    )


def preload(*tables, limit: int = 20, parity: bool = False) -> DataFrame:
    """(user_id, preload): the ids that follow each active user's feed."""
    context, facts = feed_context(*tables, limit=limit)

    def build(users: DataFrame) -> DataFrame:
        ranked = _slim(O.user_candidates(users, facts, parity, slim=True), tables[-1])
        return O.preload_ids(ranked.select("user_id", "ai_news_id", "rank_pos"), _cleaned(ranked, facts, limit), shown=limit)

    return for_like_users(context, O.candidate_count(limit), build)
