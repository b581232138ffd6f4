"""Interaction logs folded into state, and interest profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.texts import keyword_set
from newsloom.functions.urls import hostname
from newsloom.operators.common import ordered_rank
from newsloom.session import cut_lineage, spread_partitions

# Event vocabulary, weights and limits of the behaviour model.
VALID_EVENTS = ("view", "like", "skip", "long_view")
EVENT_WEIGHTS = {"view": 1.0, "like": 3.0, "skip": -2.0, "long_view": 2.0}
LONG_DWELL_SECONDS = 10
SEEN_DAYS = 30
COLD_START_INTERACTIONS = 5
PROFILE_DAYS = 90
COUNTER_LIKE, COUNTER_VIEW, COUNTER_SKIP = 2, 1, -1

# Log positions per slice of a counter walk: bounds the rows one task sorts.
WALK_SLICE = 1_000_000

# What liked articles have of the wanted keys is copied to each task up to so many entries.
COPIED_ENTRIES = 4_000_000


def effective_interactions(log: DataFrame) -> DataFrame:
    """Rows that change state, with ``viewed`` as the write path stores it.

    A like or unlike always writes ``viewed`` (false when the event does not
    say so); a view writes true; other rows write nothing.
    """
    is_like = F.col("liked").isNotNull()
    is_view = F.coalesce(F.col("viewed"), F.lit(False)) | (F.coalesce(F.col("watch_time"), F.lit(0)) > 0)
    stored = F.when(is_like, F.coalesce(F.col("viewed"), F.col("watch_time").isNotNull())).otherwise(True)
    return log.where(is_like | is_view).withColumn("viewed", stored)


def interaction_aggregates() -> list[Column]:
    """The fold of one (user, article) log; batch and stream share it."""

    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)

    return [last("liked"), last("viewed"), last("watch_time"), last("created_at")]


def merge_interactions(log: DataFrame) -> DataFrame:
    """One row per (user, article): last like value, last viewed, last watch time."""
    return effective_interactions(log).groupBy("user_id", "ai_news_id").agg(*interaction_aggregates())


def saved_state(toggles: DataFrame) -> DataFrame:
    """Articles whose save button was pressed an odd number of times."""
    per_key = toggles.groupBy("user_id", "ai_news_id").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("created_at", "seq").alias("saved_at"), F.max("seq").alias("seq")
    )
    return per_key.where("n % 2 = 1").drop("n")


def comment_counts(comments: DataFrame) -> DataFrame:
    return comments.groupBy("ai_news_id").agg(F.count(F.lit(1)).alias("comment_count"))


def user_item_state(interactions: DataFrame, saved: DataFrame, comments: DataFrame) -> DataFrame:
    """Flags per (user, article) that the user touched or saved."""
    like = F.when(F.col("liked"), 1).when(~F.col("liked"), -1).otherwise(0)
    touched = interactions.groupBy("user_id", "ai_news_id").agg(
        F.max(like).alias("like_state"),
        F.bool_or(F.coalesce("viewed", F.lit(False))).alias("viewed"),
        F.max(F.coalesce("watch_time", F.lit(0))).alias("watch_time"),
    )
    kept = saved.select("user_id", "ai_news_id", F.lit(True).alias("saved"))
    state = touched.join(kept, ["user_id", "ai_news_id"], "full").join(comment_counts(comments), "ai_news_id", "left")
    like_state = F.coalesce("like_state", F.lit(0))
    viewed = F.coalesce("viewed", F.lit(False))
    return state.select(
        "user_id",
        "ai_news_id",
        like_state.alias("like_state"),
        viewed.alias("viewed"),
        F.coalesce("watch_time", F.lit(0)).alias("watch_time"),
        F.coalesce("saved", F.lit(False)).alias("saved"),
        F.coalesce("comment_count", F.lit(0)).alias("comment_count"),
        (like_state > 0).alias("liked"),
        ((like_state < 0) & ~viewed).alias("skipped"),
        (like_state < 0).alias("disliked"),
    )


def seen_items(interactions: DataFrame, as_of: Column) -> DataFrame:
    """Articles a user opened in the last 30 days."""
    recent = F.col("created_at") >= as_of - F.expr(f"INTERVAL {SEEN_DAYS} DAYS")
    return interactions.where(F.col("viewed") & recent).select("user_id", "ai_news_id").distinct()


def recent_interaction_counts(interactions: DataFrame, as_of: Column) -> DataFrame:
    recent = F.col("created_at") >= as_of - F.expr(f"INTERVAL {SEEN_DAYS} DAYS")
    return interactions.where(recent).groupBy("user_id").agg(F.count(F.lit(1)).alias("interaction_count"))


def cold_start_users(users: DataFrame, interactions: DataFrame, as_of: Column) -> DataFrame:
    """Users with fewer than five interactions in 30 days."""
    counts = recent_interaction_counts(interactions, as_of)
    n = F.coalesce("interaction_count", F.lit(0))
    return users.select("user_id").join(counts, "user_id", "left").select("user_id", n.alias("interaction_count")).where(
        F.col("interaction_count") < COLD_START_INTERACTIONS
    )


def valid_events(events: DataFrame) -> DataFrame:
    """Known event types only, missing dwell time as 0."""
    return events.where(F.col("event_type").isin(*VALID_EVENTS)).withColumn("dwell_time", F.coalesce("dwell_time", F.lit(0.0)))


def event_rejects(events: DataFrame) -> DataFrame:
    """One row: accepted and rejected event counts."""
    ok = F.coalesce(F.col("event_type").isin(*VALID_EVENTS), F.lit(False))
    return events.agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))


def event_weight(event_type: Column, dwell: Column) -> Column:
    weight = F.lit(0.0)
    for name, value in EVENT_WEIGHTS.items():
        weight = F.when(event_type == name, value).otherwise(weight)
    bonus = F.when(F.coalesce(dwell, F.lit(0.0)) > LONG_DWELL_SECONDS, EVENT_WEIGHTS["long_view"]).otherwise(0.0)
    return weight + bonus


def category_preferences(events: DataFrame, articles: DataFrame) -> DataFrame:
    """Sum of event weights per (user, category).

    Events are summed per (user, article) first, so a viral article reaches
    the join as one row per user.
    """
    per_item = events.groupBy("user_id", "ai_news_id").agg(
        F.sum(event_weight(F.col("event_type"), F.col("dwell_time"))).alias("w")
    )
    category = F.lower(F.trim(F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("general"))))
    joined = per_item.join(articles.select("ai_news_id", "category"), "ai_news_id", "left")
    return joined.groupBy("user_id", category.alias("category")).agg(F.sum("w").alias("preference"))


def article_hosts(articles: DataFrame, raw: DataFrame) -> DataFrame:
    """(ai_news_id, category, host) with the host of the article's raw row."""
    source = F.lower(F.trim(F.coalesce("source_url", F.lit(""))))
    return (
        articles.select("ai_news_id", "raw_news_id", F.lower(F.trim(F.coalesce("category", F.lit("")))).alias("category"))
        .join(raw.select("raw_news_id", "source_url"), "raw_news_id", "left")
        .select("ai_news_id", "category", hostname(source).alias("host"))
    )


def profile_from_likes(
    interactions: DataFrame, articles: DataFrame, raw: DataFrame, as_of: Column, wanted: DataFrame | None = None
) -> DataFrame:
    """(user, kind, key, count, last_seen) over the likes of the last 90 days.

    Keywords are the distinct tokens longer than three characters of each
    liked text.  Texts are tokenised once per liked article, not per like.

    ``wanted`` (kind, key) limits the profile to those keys; they are those of a
    bounded list, and stand as numbers until counts are made.
    """
    recent = F.col("created_at") >= as_of - F.expr(f"INTERVAL {PROFILE_DAYS} DAYS")
    likes = interactions.where(F.col("liked") & recent).select("user_id", "ai_news_id", "created_at")
    if wanted is not None:
        likes = cut_lineage(likes)
    liked_ids = likes.select("ai_news_id").distinct()
    meta = article_hosts(articles, raw)
    keys = articles.select("ai_news_id", "final_text").join(liked_ids, "ai_news_id", "left_semi").join(meta, "ai_news_id")

    def entry(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("key"))

    scalar = F.filter(
        F.array(entry("topic", F.col("category")), entry("source", F.col("host"))), lambda e: e["key"] != ""
    )
    words = F.transform(keyword_set(F.coalesce("final_text", F.lit(""))), lambda w: entry("keyword", w))
    keys = keys.select("ai_news_id", F.concat(scalar, words).alias("entries"))
    counted = F.count(F.lit(1)).alias("count"), F.max("created_at").alias("last_seen")
    if wanted is None:
        rows = likes.join(keys, "ai_news_id").select("user_id", "created_at", F.inline("entries"))
        return rows.groupBy("user_id", "kind", "key").agg(*counted)
    numbered = wanted.select("kind", "key").distinct().withColumn("code", F.row_number().over(Window.orderBy("kind", "key")))
    numbered = cut_lineage(numbered)
    found = keys.select("ai_news_id", F.inline("entries")).join(F.broadcast(numbered), ["kind", "key"])
    found = cut_lineage(found.groupBy("ai_news_id").agg(F.collect_list("code").alias("code")))
    rows = _likes_by_user(likes, found).select("user_id", "created_at", F.arrays_zip("code").alias("entries"))
    counts = rows.select("user_id", "created_at", F.inline("entries")).groupBy("user_id", "code").agg(*counted)
    return counts.join(F.broadcast(numbered), "code").select("user_id", "kind", "key", "count", "last_seen")


def _likes_by_user(likes: DataFrame, keys: DataFrame) -> DataFrame:
    """Likes with the array ``code`` of their article, all rows of a user in one place.

    The arrays fan out after that, so no row per key is shuffled.  They are
    copied to where the likes lie while they are few; beyond that each like
    takes its array along to its user.
    """
    articles, entries = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("code")), F.lit(0))).first()
    parts = spread_partitions(likes.sparkSession, likes.count() * entries // max(1, articles))
    if entries <= COPIED_ENTRIES:
        return likes.repartition(parts, "user_id").join(F.broadcast(keys), "ai_news_id")
    return likes.join(keys, "ai_news_id").repartition(parts, "user_id")


def counter_deltas(log: DataFrame, article_keys: DataFrame) -> DataFrame:
    """(user, kind, key, seq, delta, created_at): one row per counter an event moves.

    ``article_keys`` holds one array of (kind, key) entries per article.
    """
    liked = F.col("liked")
    is_view = F.coalesce(F.col("viewed"), F.lit(False)) | (F.coalesce(F.col("watch_time"), F.lit(0)) > 0)
    delta = F.when(liked, COUNTER_LIKE).when(~liked, COUNTER_SKIP).when(is_view, COUNTER_VIEW)
    moves = log.select("user_id", "ai_news_id", "seq", "created_at", delta.alias("delta")).where("delta IS NOT NULL")
    return moves.join(article_keys, "ai_news_id").select("user_id", F.inline("entries"), "seq", "delta", "created_at")


def article_counter_keys(articles: DataFrame, raw: DataFrame, keywords: DataFrame) -> DataFrame:
    """(ai_news_id, entries): topic, source host and top keywords of each article.

    ``keywords`` is (ai_news_id, keywords array), at most six per article.
    """
    meta = article_hosts(articles, raw).join(keywords, "ai_news_id", "left")

    def entry(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("key"))

    words = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda w: entry("keyword", F.lower(F.trim(w))))
    entries = F.concat(F.array(entry("topic", F.col("category")), entry("source", F.col("host"))), words)
    return meta.select("ai_news_id", F.filter(entries, lambda e: e["key"] != "").alias("entries"))


def profile_counters(deltas: DataFrame) -> DataFrame:
    """Counters that never fall below zero, in log order.

    The clamped walk has the closed form ``S_n - min(0, min S_i)`` over running
    sums S.  The walk of one key is cut into slices of the log; each slice gives
    its total and lowest running sum, and slices combine over a small window,
    so that no task sorts one user's whole history.
    """
    keys = ["user_id", "kind", "key"]
    sliced = deltas.withColumn("slice", F.floor(F.col("seq") / WALK_SLICE))
    inside = Window.partitionBy(*keys, "slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    slices = (
        sliced.withColumn("running", F.sum("delta").over(inside))
        .groupBy(*keys, "slice")
        .agg(F.sum("delta").alias("total"), F.min("running").alias("lowest"), F.max("created_at").alias("last_seen"))
    )
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    walked = slices.withColumn("lowest", F.col("lowest") + F.coalesce(F.sum("total").over(before), F.lit(0)))
    return walked.groupBy(*keys).agg(
        (F.sum("total") - F.least(F.lit(0), F.min("lowest"))).alias("count"), F.max("last_seen").alias("last_seen")
    )


def comment_tree(comments: DataFrame) -> DataFrame:
    """Depth, root, path and sibling order of every comment.

    A parent counts only when it exists under the same article and is not the
    comment itself; otherwise the comment is a root.  Ancestors are found by
    pointer jumping: each round doubles the distance covered, finished rows leave
    the joins, and each round is checkpointed, so that depth is not limited and
    hot threads do not pile up.  After as many rounds as a chain of all comments
    could need, what is left hangs on a cycle: those comments
    become roots.  Further columns, such as the text or the author's name, pass
    through.
    """
    cols = comments.select("comment_id", "ai_news_id", "user_id", "parent_comment_id", "created_at")
    further = [c for c in comments.columns if c not in cols.columns]
    parents = cols.select(F.col("comment_id").alias("pid"), F.col("ai_news_id").alias("p_article"))
    linked = cols.join(
        parents, (F.col("parent_comment_id") == F.col("pid")) & (F.col("ai_news_id") == F.col("p_article")) & (F.col("comment_id") != F.col("pid")), "left"
    ).select("comment_id", "ai_news_id", "user_id", "created_at", F.col("pid").alias("parent_id"))

    seg = F.col("comment_id").cast("string")
    state = linked.select(
        "comment_id", F.col("parent_id").alias("up"), F.lit(0).alias("depth"), seg.alias("path"), F.col("comment_id").alias("root_id")
    )
    # invariant: path covers the comment down from just below ``up``; up is null once the root is in it
    done, todo = [state.where("up IS NULL")], state.where("up IS NOT NULL")
    todo = todo.withColumn("depth", F.lit(1))
    known = done[0]
    pending = cut_lineage(todo)
    rounds = pending.count().bit_length() + 1
    while rounds and not pending.isEmpty():
        rounds -= 1
        hop = known.unionByName(pending).select(
            F.col("comment_id").alias("h_id"), F.col("up").alias("h_up"), F.col("depth").alias("h_depth"),
            F.col("path").alias("h_path"), F.col("root_id").alias("h_root"),
        )
        step = pending.join(hop, F.col("up") == F.col("h_id")).select(
            "comment_id",
            F.col("h_up").alias("up"),
            (F.col("depth") + F.col("h_depth")).alias("depth"),
            F.concat_ws("/", F.col("h_path"), F.col("path")).alias("path"),
            F.col("h_root").alias("root_id"),
        )
        step = cut_lineage(step)
        finished = step.where("up IS NULL")
        done.append(finished)
        known = known.unionByName(finished)
        pending = step.where("up IS NOT NULL")
    # no round is left: a cycle, or a thread below one
    stuck = pending.select("comment_id", F.lit(0).alias("depth"), seg.alias("path"), F.col("comment_id").alias("root_id"))
    linked = linked.join(stuck.select("comment_id", F.lit(True).alias("stuck")), "comment_id", "left")
    linked = linked.withColumn("parent_id", F.when(F.col("stuck").isNull(), F.col("parent_id"))).drop("stuck")
    resolved = reduce(DataFrame.unionByName, done).select("comment_id", "depth", "path", "root_id").unionByName(stuck)

    children = linked.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("c_id")).agg(
        F.count(F.lit(1)).alias("reply_count")
    )
    tree = linked.join(resolved, "comment_id").join(children, F.col("comment_id") == F.col("c_id"), "left").drop("c_id")
    tree = tree.withColumn("reply_count", F.coalesce("reply_count", F.lit(0)))
    if further:
        tree = tree.join(comments.select("comment_id", *further), "comment_id")
    return ordered_rank(
        tree,
        ["ai_news_id", "parent_id"],
        F.date_trunc("minute", "created_at"),
        [F.col("created_at"), F.col("comment_id")],
        "sibling_pos",
    )


def daily_impressions(events: DataFrame) -> DataFrame:
    """One row per (user, article, type, day) for impressions and skips."""
    kinds = events.where(F.col("event_type").isin("impression", "skip"))
    position = F.when(F.col("event_type") == "impression", F.col("position"))
    return kinds.groupBy("user_id", "ai_news_id", "event_type", F.to_date("created_at").alias("day")).agg(
        F.min("created_at").alias("first_at"), F.max_by(position, F.struct("created_at", "event_id")).alias("position")
    )


def engagement_flags(events: DataFrame) -> DataFrame:
    """One flag row per (user, article) from view, like, save and dwell events.

    A missing dwell time keeps the earlier one.
    """
    kind = F.col("event_type")
    is_view = kind.isin("view", "long_view")
    relevant = events.where(is_view | kind.isin("like", "save"))
    dwell_seq = F.when(is_view & F.col("dwell_time").isNotNull(), F.col("event_id"))
    return relevant.groupBy("user_id", "ai_news_id").agg(
        F.bool_or(is_view).alias("viewed"),
        F.bool_or(kind == "like").alias("liked"),
        F.bool_or(kind == "save").alias("saved"),
        F.max_by("dwell_time", dwell_seq).alias("dwell_time"),
        F.min_by("created_at", "event_id").alias("created_at"),
    )


def signal_weight(liked: Column, viewed: Column, saved: Column, watch_time: Column) -> Column:
    """Weight of one interaction in a user's vector."""
    watched = F.coalesce(watch_time, F.lit(0)).cast("double")
    return (
        F.when(viewed, 0.35).otherwise(0.0)
        + F.when(liked, 2.25).when(~liked, -1.2).otherwise(0.0)
        + F.when(saved, 1.4).otherwise(0.0)
        + F.when(watched > 0, F.least(watched / 240.0, F.lit(0.5))).otherwise(0.0)
    )
