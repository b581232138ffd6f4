"""Candidates, ranking and feed assembly for all users in one job.

A user's feed is drawn from one bounded candidate list (at most
``max(5 * limit, 250)`` rows), so each user carries that many rows and no more.
Everything a user brings (flags, profile, overlap) is folded into one row per
user first; candidates are attached to that row, and all windows that follow
partition by the user, so they share one exchange on ``user_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.texts import keyword_set
from newsloom.functions.urls import hostname
from newsloom.operators.common import top_rows
from newsloom.operators.dedup import dedupe_feed
from newsloom.session import spread_partitions

# Ranking weights, limits and terms of the feed.
FRESH_HOURS = 48
MIN_CANDIDATES = 250
CANDIDATE_FACTOR = 5
BAD_IMAGE_WORDS = ("logo", "icon", "placeholder", "default", "avatar", "thumbnail")
DECAY_PER_HOUR = 0.95
HOME_REGION = "uz"
HOME_LANGUAGE = "uz"
TOPIC_CAP = 3
PREFERRED_SHARE, EXPLORATION_SHARE = 0.7, 0.12
REGIONAL_SHARE, GLOBAL_SHARE = 0.6, 0.4
MAX_TOPIC_SHARE, NEW_TOPIC_SHARE = 0.6, 0.2
SIMILARITY_WEIGHT, ENGAGEMENT_WEIGHT, FRESHNESS_WEIGHT = 1.0, 0.45, 0.2
SIMILARITY_WINDOW = 4


def _hours(as_of: Column, ts: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / 3.6e9


def soft_image_url(url: Column) -> Column:
    """The trimmed URL when it is absolute and names no logo or placeholder, else null."""
    value = F.trim(url)
    ok = value.startswith("http://") | value.startswith("https://")
    for word in BAD_IMAGE_WORDS:
        ok = ok & ~F.lower(value).contains(word)
    return F.when(ok, value)


def candidate_count(limit: int) -> int:
    return max(limit * CANDIDATE_FACTOR, MIN_CANDIDATES)


def fresh_candidates(enriched: DataFrame, raw: DataFrame, as_of: Column, limit: int) -> DataFrame:
    """Best fresh articles in score order with ``candidate_pos`` from 1.

    The top-k runs before the join with raw rows, so only its few rows join.
    """
    fresh = enriched.where(
        (F.col("created_at") >= as_of - F.expr(f"INTERVAL {FRESH_HOURS} HOURS"))
        & (F.length(F.trim("final_title")) > 0)
        & (F.length(F.trim("final_text")) > 0)
    ).drop("source_url")
    order = [F.col("ai_score").desc(), F.col("created_at").desc(), F.col("ai_news_id")]
    top = fresh.orderBy(*order).limit(candidate_count(limit))
    top = top.join(raw.select("raw_news_id", "source_url"), "raw_news_id", "left")
    images = F.from_json("image_urls", "array<string>")
    # at most max(5 * limit, 250) rows reach this unpartitioned window
    return top.withColumn("image_url", F.get(images, F.lit(0))).withColumn(
        "candidate_pos", F.row_number().over(Window.orderBy(*order))
    )


def candidate_facts(candidates: DataFrame) -> DataFrame:
    """The narrow columns ranking needs; texts stay behind as lengths and keys."""
    source = F.lower(F.trim(F.coalesce("source_url", F.lit(""))))
    return candidates.select(
        "ai_news_id",
        "raw_news_id",
        F.lower("category").alias("category"),
        F.lower(F.trim(F.coalesce("region", F.lit("")))).alias("region"),
        F.lower(F.trim(F.coalesce("language", F.lit("")))).alias("language"),
        "target_persona",
        "ai_score",
        "created_at",
        hostname(source).alias("host"),
        "image_url",
        soft_image_url(F.col("image_url")).isNotNull().alias("image_ok"),
        "final_title",
        F.length(F.trim("final_text")).alias("text_len"),
        "candidate_pos",
        # the first place of its topic and of its host stand for them in the users' maps
        F.min("candidate_pos").over(Window.partitionBy(F.lower(F.trim("category")))).alias("topic_slot"),
        F.min("candidate_pos").over(Window.partitionBy(hostname(source))).alias("host_slot"),
        # the list is the same for all users, and so is a row's place in its topic
        F.row_number().over(Window.partitionBy(F.lower("category")).orderBy("candidate_pos")).alias("topic_count"),
    )


# what scoring and placement read; titles and addresses rejoin the placed rows
SCORING_COLUMNS = (
    "ai_news_id", "category", "region", "language", "ai_score", "created_at", "text_len", "image_ok", "candidate_pos", "topic_count",
)


def attach_candidates(users: DataFrame, facts: DataFrame) -> DataFrame:
    """Every user row times the bounded candidate list.

    The list travels as one array in a scalar subquery and is exploded beside
    each user row: no join, and the partitioning of ``users`` survives.
    """
    packed = facts.agg(F.array_sort(F.collect_list(F.struct("candidate_pos", *[c for c in facts.columns if c != "candidate_pos"]))))
    return users.withColumn("_candidates", packed.scalar()).select(*users.columns, F.inline("_candidates"))


# Profile keys that candidates have: their kind, and the map of a user that holds them.
KINDS = {"keyword": "overlaps", "topic": "topic_weights", "source": "source_weights"}


def candidate_keys(candidates: DataFrame) -> DataFrame:
    """(kind, key, slot): the profile keys that candidates have, and at whose place each one counts.

    A keyword counts for every candidate with it; topics and hosts have one
    place each, that of their first candidate.
    """
    words = candidates.select(F.explode(keyword_set(F.coalesce("final_text", F.lit("")))).alias("key"), F.col("candidate_pos").alias("slot"))
    facts = candidate_facts(candidates)
    topics = facts.select(F.trim("category").alias("key"), F.col("topic_slot").alias("slot")).distinct()
    hosts = facts.select(F.col("host").alias("key"), F.col("host_slot").alias("slot")).distinct()
    kinds = [df.select(F.lit(kind).alias("kind"), "key", "slot") for kind, df in zip(KINDS, (words, topics, hosts))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).where("key <> ''")


def profile_maps(profile: DataFrame, keys: DataFrame, as_of: Column) -> DataFrame:
    """One row per user: decayed counts of the profile keys by slot, a map per kind.

    Rows of a profile that lie with their user stay there: both sums are by user,
    and the places, which are those of one bounded candidate list, are copied to
    each task whatever the planner's threshold is.
    """
    codes = F.create_map(*[x for i, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(i))])
    weights = profile.select("user_id", "kind", "key", decayed(F.col("count"), F.col("last_seen"), as_of).alias("w"))
    place = (F.col("slot") * len(KINDS) + F.element_at(codes, F.col("kind"))).alias("place")
    places = F.broadcast(keys.groupBy("kind", "key").agg(F.collect_list(place).alias("places")))
    placed = weights.join(places, ["kind", "key"]).select("user_id", "w", F.explode("places").alias("place"))
    sums = placed.groupBy("user_id", "place").agg(F.sum("w").alias("w"))
    slot = F.struct(F.floor(F.col("place") / len(KINDS)).cast("int"), "w")

    def held(i: int) -> Column:
        return F.map_from_entries(F.collect_list(F.when(F.col("place") % len(KINDS) == i, slot)))

    return sums.groupBy("user_id").agg(*[held(i).alias(name) for i, name in enumerate(KINDS.values())])


def decayed(count: Column, last_seen: Column, as_of: Column) -> Column:
    hours = F.greatest(F.lit(0.0), F.coalesce(_hours(as_of, last_seen), F.lit(0.0)))
    return count * F.pow(F.lit(DECAY_PER_HOUR), hours)


# What a user brings to ranking besides ``cold_start``; all null where nothing is known.
USER_MAPS = ("flags", *KINDS.values(), "seen_ids")


def user_context(
    users: DataFrame, state: DataFrame, profile: DataFrame, keys: DataFrame, seen: DataFrame, cold: DataFrame, candidates: DataFrame, as_of: Column
) -> DataFrame:
    """One row per user: flags, profile weights and overlap of the candidates as maps.

    Each map holds candidates, their topics or their hosts only, so it has at
    most as many entries as there are candidates.  ``keys`` are their ``candidate_keys``.
    """
    ids = candidates.select("ai_news_id")
    flags = state.join(candidates.select("ai_news_id", "candidate_pos", F.lower("category").alias("category")), "ai_news_id")
    flag_cols = F.struct("liked", "viewed", "saved", "skipped", "disliked", "watch_time", "comment_count")
    touched = F.when((F.col("liked") | F.col("viewed")) & (F.col("category") != ""), F.struct("candidate_pos", "category", "liked", "watch_time"))
    flags = flags.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("ai_news_id", flag_cols))).alias("flags"),
        F.reverse(F.array_sort(F.collect_list(touched))).alias("touched"),
    )
    maps = profile_maps(profile, keys, as_of)
    unseen = seen.join(ids, "ai_news_id", "left_semi").groupBy("user_id").agg(F.collect_set("ai_news_id").alias("seen_ids"))
    context = users.select("user_id")
    for part in (flags, maps, unseen, cold.select("user_id", F.lit(True).alias("cold_start"))):
        context = context.join(part, "user_id", "left")
    # user rows are small but fan out 250-fold: a number of partitions that follows
    # the rows to come keeps adaptive coalescing from putting whole user ranges into one task
    context = context.withColumns(session_facts(F.col("touched"))).drop("touched")
    return context.repartition(spread_partitions(users.sparkSession, users.count() * candidates.count()), "user_id")


def user_candidates(context: DataFrame, facts: DataFrame, parity: bool = False, slim: bool = False) -> DataFrame:
    """User × candidate rows with the user's own flags looked up from the maps.

    ``slim`` carries the scoring columns only: every window that follows copies
    its rows, so their width is most of its cost.

    ``parity`` reproduces a known defect: watch time, dislike and language are
    then left unmerged.
    """
    rows = attach_candidates(context, facts)
    flag = F.try_element_at("flags", F.col("ai_news_id"))

    def known(name: str) -> Column:
        return F.coalesce(flag[name], F.lit(False))

    left_out = ("language", "host", "target_persona", "raw_news_id", "topic_slot", "host_slot")
    carried = [c for c in (SCORING_COLUMNS if slim else facts.columns) if c not in left_out]
    session = F.try_element_at("sessions", F.col("category"))
    # without watch times no dwell counts
    sessions = {n: F.coalesce(session[n], F.lit(0)) for n in SESSION_COLUMNS}
    if parity:
        sessions["topic_dwells_last"] = F.lit(0)
    return rows.select(
        "user_id",
        *carried,
        (F.lit("") if parity else F.col("language")).alias("language"),
        F.coalesce("cold_start", F.lit(False)).alias("cold_start"),
        known("liked").alias("liked"),
        known("viewed").alias("viewed"),
        known("saved").alias("saved"),
        known("skipped").alias("skipped"),
        (F.lit(False) if parity else known("disliked")).alias("disliked"),
        (F.lit(0) if parity else F.coalesce(flag["watch_time"], F.lit(0))).alias("watch_time"),
        F.coalesce(flag["comment_count"], F.lit(0)).alias("comment_count"),
        F.try_element_at("topic_weights", F.col("topic_slot")).alias("topic_weight"),
        F.try_element_at("source_weights", F.col("host_slot")).alias("source_weight"),
        F.try_element_at("overlaps", F.col("candidate_pos")).alias("overlap"),
        F.coalesce(F.array_contains("seen_ids", F.col("ai_news_id")), F.lit(False)).alias("seen"),
        "likes_last",
        *[c.alias(n) for n, c in sessions.items()],
    )


def session_facts(touched: Column) -> dict[str, Column]:
    """``sessions`` (topic → counts) and ``likes_last`` of a user's touched candidates, newest place first.

    What ``session_columns`` finds by windows over all rows of a user, from the
    few that the user touched: no row has to fan out for it.
    """
    last = F.slice(touched, 1, 3)

    def counts(topic: Column) -> Column:
        def n(rows: Column, condition=None) -> Column:
            return F.size(F.filter(rows, lambda r: (r["category"] == topic) if condition is None else (r["category"] == topic) & condition(r)))

        return F.struct(
            topic,
            F.struct(
                n(touched).alias("topic_session"),
                n(last).alias("topic_last"),
                n(last, lambda r: r["liked"]).alias("topic_likes_last"),
                n(last, lambda r: r["watch_time"] > 3).alias("topic_dwells_last"),
            ),
        )

    topics = F.array_distinct(F.transform(touched, lambda r: r["category"]))
    return {
        "sessions": F.map_from_entries(F.transform(topics, counts)),
        "likes_last": F.coalesce(F.size(F.filter(last, lambda r: r["liked"])), F.lit(0)),
    }


SESSION_COLUMNS = ("topic_session", "topic_last", "topic_likes_last", "topic_dwells_last")


def session_columns(rows: DataFrame) -> DataFrame:
    """Session facts per row, from the liked or viewed candidates of its user.

    ``topic_session``: touched items of the topic.  "Last three" follows
    candidate order, as the session walk does: ``topic_last`` counts the topic
    there, ``likes_last`` all likes, ``topic_likes_last`` and
    ``topic_dwells_last`` those of the topic.
    """
    touched = (F.col("liked") | F.col("viewed")) & (F.col("category") != "")
    # two sort orders in all: whole-partition frames share the order of the ranks
    newest = Window.partitionBy("user_id").orderBy(F.col("candidate_pos").desc())
    in_topic = Window.partitionBy("user_id", "category").orderBy("candidate_pos")
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = newest.rowsBetween(Window.unboundedPreceding, 0)

    def counted(condition: Column, window) -> Column:
        return F.sum(condition.cast("int")).over(window)

    marked = rows.withColumn("_touched", touched)
    marked = marked.withColumn("_last", F.col("_touched") & (counted(F.col("_touched"), so_far) <= 3))
    marked = marked.withColumn("likes_last", counted(F.col("_last") & F.col("liked"), newest.rowsBetween(*whole)))
    topic_wide = in_topic.rowsBetween(*whole)
    return marked.withColumns(
        {
            "topic_session": counted(F.col("_touched"), topic_wide),
            "topic_last": counted(F.col("_last"), topic_wide),
            "topic_likes_last": counted(F.col("_last") & F.col("liked"), topic_wide),
            "topic_dwells_last": counted(F.col("_last") & (F.col("watch_time") > 3), topic_wide),
            "topic_count": F.row_number().over(in_topic),
        }
    ).drop("_touched", "_last")


def session_topics(rows: DataFrame) -> DataFrame:
    """(user, topic, n, in_last_three) over touched candidates."""
    touched = rows.where((F.col("liked") | F.col("viewed")) & (F.col("category") != ""))
    recency = Window.partitionBy("user_id").orderBy(F.col("candidate_pos").desc())
    numbered = touched.withColumn("_rn", F.row_number().over(recency))
    return numbered.groupBy("user_id", F.col("category").alias("topic")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_rn") <= 3).alias("in_last_three")
    )


def freshness_48h(created_at: Column, as_of: Column) -> Column:
    """exp(-age/48 h), age not below zero, six decimals; 0 when unknown."""
    age = F.greatest(F.lit(0.0), _hours(as_of, created_at))
    return F.when(created_at.isNull(), 0.0).otherwise(F.bround(F.exp(-age / 48.0), 6))


def freshness_24h(created_at: Column, as_of: Column) -> Column:
    """exp(-age/24 h); 0.5 when unknown."""
    return F.coalesce(F.exp(-_hours(as_of, created_at) / 24.0), F.lit(0.5))


def light_score(ai_score: Column, created_at: Column, similarity: Column, preference: Column, as_of: Column) -> Column:
    """Cheap blend of quality, freshness, similarity and category preference; zero counts as missing."""
    return (
        0.3 * F.coalesce(F.nullif(ai_score, F.lit(0.0)), F.lit(0.3))
        + 0.25 * freshness_24h(created_at, as_of)
        + 0.2 * F.coalesce(F.nullif(similarity, F.lit(0.0)), F.lit(0.5))
        + 0.25 * F.coalesce(preference, F.lit(0.0))
    )


def rank_terms(as_of: Column) -> dict[str, Column]:
    """The additive terms of the rank score, by name, over ``session_columns`` rows."""

    def points(*cases: tuple[Column, float]) -> Column:
        out = F.when(cases[0][0], cases[0][1])
        for condition, value in cases[1:]:
            out = out.when(condition, value)
        return out.otherwise(0.0)

    c = F.col
    language, dwell, age = c("language"), c("watch_time"), _hours(as_of, c("created_at"))
    known_topic = c("category") != ""
    light = light_score(c("ai_score"), c("created_at"), F.lit(None).cast("double"), F.lit(None).cast("double"), as_of)
    return {
        "base": F.least(F.coalesce(c("ai_score"), F.lit(0.0)), F.lit(10.0)),
        "language": points((language == HOME_LANGUAGE, 3.0), (~language.isin("", "unknown"), -3.0)),
        "region": points((c("region") != HOME_REGION, 0.0), (c("cold_start"), 8.0), (F.lit(True), 5.0)),
        "image": points((c("image_ok"), 1.0)),
        "text": points((c("text_len") > 200, 2.0), (c("text_len") < 50, -1.0)),
        "cold_fresh": points((~c("cold_start"), 0.0), (age < 6, 2.0), (age < 24, 1.0)),
        "light": light * 0.5,
        "topic_liked": points((c("liked"), 5.0)),
        "liked": points((c("liked"), 10.0)),
        "rejected": points((c("disliked") | c("skipped"), -6.0)),
        "saved": points((c("saved"), 0.75)),
        "viewed": points((c("viewed"), 2.0)),
        "like_count": F.log1p(c("liked").cast("double")) * 1.5,
        "topic_profile": F.coalesce(c("topic_weight") * 1.5, F.lit(0.0)),
        "source_profile": F.coalesce(c("source_weight") * 2.0, F.lit(0.0)),
        "keyword_profile": F.when(c("overlap") > 0, F.least(F.lit(4.0), 2.0 + 0.25 * c("overlap"))).otherwise(0.0),
        "momentum": points((known_topic & (c("topic_session") >= 2), 5.0)),
        "micro_trend": points((known_topic & (c("topic_session") >= 3), 3.0)),
        "boredom": points((known_topic & (c("topic_session") >= 4), -3.0)),
        "next_topic": points((known_topic & (c("topic_last") >= 2), 6.0)),
        "like_burst": points(((c("likes_last") >= 2) & (c("topic_likes_last") >= 1), 4.0)),
        "dwell": points((dwell > 6, 8.0), (dwell > 3, 4.0), ((dwell > 0) & (dwell < 1), -5.0)),
        "synergy": points((c("liked") & (dwell > 3), 5.0), (c("liked") & (dwell < 1), -3.0)),
        "dwell_topic": points((known_topic & (c("topic_dwells_last") >= 2), 6.0)),
        "repeat": points((c("topic_count") >= 3, -3.0)),
    }


def rank_score(rows: DataFrame, as_of: Column, keep_terms: bool = False) -> DataFrame:
    """Add ``rank_score``, the rounded sum of all terms; session columns are made by windows where rows do not carry them."""
    terms = rank_terms(as_of)
    scored = (rows if set(SESSION_COLUMNS) <= set(rows.columns) else session_columns(rows)).withColumns({f"term_{n}": t for n, t in terms.items()})
    total = sum((F.col(f"term_{n}") for n in terms), F.lit(0.0))
    scored = scored.withColumn("rank_score", F.bround(total, 6))
    return scored if keep_terms else scored.drop(*[f"term_{n}" for n in terms])


def rank_items(rows: DataFrame, as_of: Column) -> DataFrame:
    """Scored rows with ``rank_pos`` per user: score, then recency, then id."""
    order = Window.partitionBy("user_id").orderBy(F.col("rank_score").desc(), F.col("created_at").desc(), F.col("ai_news_id"))
    return rank_score(rows, as_of).withColumn("rank_pos", F.row_number().over(order))


def drop_seen(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose (user, article) is not in the seen set.

    A user's set joins as one row, so that feeds which lie by user stay there.
    """
    sets = seen.groupBy("user_id").agg(F.collect_set("ai_news_id").alias("_seen"))
    unseen = ~F.coalesce(F.array_contains("_seen", F.col("ai_news_id")), F.lit(False))
    return df.join(sets, "user_id", "left").where(unseen).select(df.columns)


def topic_cap(df: DataFrame, n: int = TOPIC_CAP, order: str = "rank_pos") -> DataFrame:
    """First ``n`` rows per (user, category) in rank order."""
    keyed = df.withColumn("_topic", F.lower(F.trim(F.coalesce(F.nullif("category", F.lit("")), F.lit("general")))))
    return top_rows(keyed, ["user_id", "_topic"], [F.col(order)], n).drop("_topic")


def filter_feed(ranked: DataFrame, seen: DataFrame | None = None, max_per_topic: int = TOPIC_CAP, min_score: float = 0.0) -> DataFrame:
    """Readable, distinct, unseen, topic-capped rows above a score."""
    readable = ranked.where((F.length(F.trim("final_title")) >= 5) & (F.col("text_len") >= 30))
    kept = dedupe_feed(readable)
    if seen is not None:
        kept = drop_seen(kept, seen)
    return topic_cap(kept, max_per_topic).where(F.col("rank_score") >= min_score)


def shortlist(ranked: DataFrame, limit: int) -> DataFrame:
    """Rows that slots or swaps can still choose; the result of both is unchanged.

    Slots take at most three unseen rows per topic, each time the best left, so
    a chosen row is among the best three of its (topic, preferred) list.  The
    swap for new topics needs at most ``limit`` rows of the feed plus its own.
    """
    need_new = max(1, int(limit * NEW_TOPIC_SHARE))
    unseen = ranked.where(~F.col("seen"))
    in_list = Window.partitionBy("user_id", "category", "preferred").orderBy("rank_pos")
    in_new = Window.partitionBy("user_id", "topic_known").orderBy("rank_pos")
    marked = unseen.withColumns({"_a": F.row_number().over(in_list), "_b": F.row_number().over(in_new)})
    useful = (F.col("_a") <= TOPIC_CAP) | (~F.col("topic_known") & (F.col("_b") <= limit + need_new))
    return marked.where(useful).drop("_a", "_b")


def preference_slots(ranked: DataFrame, limit: int) -> DataFrame:
    """Pick ``limit`` rows per user: preferred, exploration, others, then a fill.

    ``ranked`` carries ``preferred`` (topic or host in the profile),
    ``topic_known`` (topic in the profile) and ``seen``.  Each step takes rows
    in rank order under a cap of three per topic shared by all steps; rows
    taken stay out of later steps.  A second pass over the preferred list needs
    no step of its own: when the first one ends short, all its rows left are
    over the cap.  Adds ``slot_step`` and ``slot_pos``.
    """
    pref_slots = int(limit * PREFERRED_SHARE)
    exploration = max(1, int(limit * EXPLORATION_SHARE))
    open_row = ~F.col("seen") & F.col("slot_step").isNull()
    topic = ["user_id", "category"]

    def take(df: DataFrame, step: int, eligible: Column, slots: Column) -> DataFrame:
        in_topic = Window.partitionBy(*topic, "_eligible").orderBy("rank_pos")
        capped = F.col("_eligible") & (F.col("_used") + F.row_number().over(in_topic) <= TOPIC_CAP)
        in_user = Window.partitionBy("user_id", "_capped").orderBy("rank_pos")
        out = df.withColumns({"_eligible": open_row & eligible, "_slots": slots})
        out = out.withColumn("_used", F.count("slot_step").over(Window.partitionBy(*topic)))
        out = out.withColumn("_capped", capped)
        chosen = F.col("_capped") & (F.row_number().over(in_user) <= F.col("_slots"))
        out = out.withColumn("slot_step", F.coalesce("slot_step", F.when(chosen, step)))
        return out.drop("_eligible", "_slots", "_used", "_capped")

    n_taken = F.count("slot_step").over(Window.partitionBy("user_id"))
    other_slots = limit - pref_slots
    df = ranked.withColumn("slot_step", F.lit(None).cast("int"))
    df = take(df, 1, F.col("preferred"), F.lit(pref_slots))
    df = take(df, 2, ~F.col("preferred") & ~F.col("topic_known"), F.lit(exploration))
    df = take(df, 3, ~F.col("preferred"), F.lit(other_slots) - F.greatest(F.lit(0), n_taken - pref_slots))
    df = take(df, 4, F.lit(True), F.lit(limit) - n_taken)
    picked = Window.partitionBy("user_id", F.col("slot_step").isNull()).orderBy("slot_step", "rank_pos")
    return df.withColumn("slot_pos", F.when(F.col("slot_step").isNotNull(), F.row_number().over(picked)))


def region_quota(df: DataFrame, limit: int, order: str = "slot_pos") -> DataFrame:
    """Regional and global quotas, leftovers in order, first five by score.

    Rows whose ``order`` is null pass through unplaced.  Adds ``feed_pos``.
    """
    placed = F.col(order).isNotNull()
    regional = F.col("region") == HOME_REGION
    in_region = Window.partitionBy("user_id", "_placed", "_regional").orderBy(order)
    quota = F.when(F.col("_regional"), int(limit * REGIONAL_SHARE)).otherwise(int(limit * GLOBAL_SHARE))
    group = F.when(F.row_number().over(in_region) > quota, 2).when(F.col("_regional"), 0).otherwise(1)
    in_user = Window.partitionBy("user_id", "_placed").orderBy("_group", order)
    out = df.withColumns({"_placed": placed, "_regional": regional}).withColumn("_group", group)
    out = out.withColumn("_pos", F.when(F.col("_placed"), F.row_number().over(in_user)))
    out = out.withColumn("_pos", F.when(F.col("_pos") <= limit, F.col("_pos")))
    head = F.coalesce(F.col("_pos") <= 5, F.lit(False))
    full = F.count("_pos").over(Window.partitionBy("user_id")) >= 5
    by_score = Window.partitionBy("user_id", "_head").orderBy(F.col("rank_score").desc(), "_pos")
    out = out.withColumn("_head", head & full)
    pos = F.when(F.col("_head"), F.row_number().over(by_score)).otherwise(F.col("_pos"))
    return out.withColumn("feed_pos", pos).drop("_placed", "_regional", "_group", "_pos", "_head")


def _bound_topic(df: DataFrame, max_topic: int) -> DataFrame:
    """Remove the tail of the oversized topic and append capped replacements."""
    user, topic = Window.partitionBy("user_id"), Window.partitionBy("user_id", "category")
    out = df.withColumn("_in", F.col("feed_pos").isNotNull())
    from_tail = Window.partitionBy("user_id", "category", "_in").orderBy(F.col("feed_pos").desc())
    out = out.withColumn("_topic_n", F.count("feed_pos").over(topic))
    excess = F.greatest(F.lit(0), F.col("_topic_n") - max_topic)
    out = out.withColumn("_removed", F.col("_in") & (F.row_number().over(from_tail) <= excess))
    out = out.withColumns({"_n_removed": F.sum(F.col("_removed").cast("int")).over(user), "_last": F.max("feed_pos").over(user)})
    pool = ~F.col("_in") & ~F.col("seen")
    in_pool_topic = Window.partitionBy("user_id", "category", "_pool").orderBy("rank_pos")
    out = out.withColumn("_pool", pool)
    out = out.withColumn("_fits", F.col("_pool") & (F.col("_topic_n") + F.row_number().over(in_pool_topic) <= max_topic))
    in_fits = Window.partitionBy("user_id", "_fits").orderBy("rank_pos")
    out = out.withColumn("_fit_rank", F.when(F.col("_fits"), F.row_number().over(in_fits)))
    appended = F.when(F.col("_fit_rank") <= F.col("_n_removed"), F.col("_last") + F.col("_fit_rank"))
    out = out.withColumn("feed_pos", F.when(F.col("_removed"), None).otherwise(F.coalesce("feed_pos", appended)))
    # positions stay dense
    dense = Window.partitionBy("user_id", F.col("feed_pos").isNull()).orderBy("feed_pos")
    out = out.withColumn("feed_pos", F.when(F.col("feed_pos").isNotNull(), F.row_number().over(dense)))
    return out.drop("_in", "_topic_n", "_removed", "_n_removed", "_last", "_pool", "_fits", "_fit_rank")


def diversity_swaps(df: DataFrame, limit: int, topic_bound: int | None = None) -> DataFrame:
    """Bound the largest topic and guarantee new topics; works on ``feed_pos``.

    Two swaps from the published walk, both in closed form.  (1) Only one topic
    can exceed 60 % of the slots: its lowest rows leave, and the best ranked
    unused rows of topics below that bound are appended, one per row removed.
    (2) When fewer than 20 % of the rows have a topic outside the profile, rows
    of known topics are replaced from the tail by the best unused rows of
    unknown topics, in order.

    ``topic_bound`` states how many rows of one topic the input can hold; when
    that is within the bound, (1) cannot act and is left out of the plan.
    """
    max_topic = int(limit * MAX_TOPIC_SHARE)
    need_new = max(1, int(limit * NEW_TOPIC_SHARE))
    user = Window.partitionBy("user_id")
    out = df if topic_bound is not None and topic_bound <= max_topic else _bound_topic(df, max_topic)

    # (2) swap known topics at the tail for unknown ones
    placed = F.col("feed_pos").isNotNull()
    out = out.withColumn("_missing", F.greatest(F.lit(0), F.lit(need_new) - F.sum((placed & ~F.col("topic_known")).cast("int")).over(user)))
    out = out.withColumns({"_known_in": placed & F.col("topic_known"), "_new_out": ~placed & ~F.col("topic_known") & ~F.col("seen")})
    tail = Window.partitionBy("user_id", "_known_in").orderBy(F.col("feed_pos").desc())
    best = Window.partitionBy("user_id", "_new_out").orderBy("rank_pos")
    out = out.withColumns({"_tail_rank": F.row_number().over(tail), "_new_rank": F.row_number().over(best)})
    out = out.withColumn("_n_new", F.sum(F.col("_new_out").cast("int")).over(user))
    swaps = F.least(F.col("_missing"), F.col("_n_new"))
    leaving = F.col("_known_in") & (F.col("_tail_rank") <= swaps)
    # positions given up, ordered by tail rank: at most ``limit`` entries
    given = F.array_sort(F.collect_list(F.when(leaving, F.struct("_tail_rank", "feed_pos"))).over(user))
    out = out.withColumn("_given", given)
    entering = F.col("_new_out") & (F.col("_new_rank") <= swaps)
    new_pos = (
        F.when(leaving, None)
        .when(entering, F.get("_given", F.col("_new_rank") - 1)["feed_pos"])
        .otherwise(F.col("feed_pos"))
    )
    return out.withColumn("feed_pos", new_pos).drop(
        "_missing", "_known_in", "_new_out", "_tail_rank", "_new_rank", "_n_new", "_given"
    )


def sanitize_feed(feed: DataFrame, limit: int, order: str = "feed_pos") -> DataFrame:
    """Drop blank, unscored, broken-image and repeated-title rows; renumber the rest."""
    title = F.trim(F.coalesce("final_title", F.lit("")))
    image = F.trim(F.coalesce("image_url", F.lit("")))
    good = feed.where(
        (title != "")
        & (F.col("text_len") > 0)
        & (F.coalesce("ai_score", F.lit(0.0)) > 0)
        & ((image == "") | image.rlike("(?i)^https?://[^/?#]+"))
    )
    distinct = top_rows(good.withColumn("_title", F.lower(title)), ["user_id", "_title"], [F.col(order)], 1).drop("_title")
    return top_rows(distinct, ["user_id"], [F.col(order)], limit, "position")


def display_defaults(df: DataFrame, source: str = "raw") -> DataFrame:
    """Display columns with defaults for blank title, text, image and source."""

    def filled(c: str, default: str) -> Column:
        return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))

    image = F.trim(F.coalesce("image_url", F.lit("")))
    usable = image.startswith("http://") | image.startswith("https://") | image.startswith("/")
    return df.withColumns(
        {
            "title": filled("final_title", "News update"),
            "text": filled("final_text", "News update"),
            "image": F.when(usable, image).otherwise(""),
            "source": F.coalesce(F.nullif("source_url", F.lit("")), F.lit(source)),
        }
    )


def preload_ids(ranked: DataFrame, feed: DataFrame, n: int = 3, shown: int | None = None) -> DataFrame:
    """(user, preload): the next ``n`` ranked ids that the feed does not show.

    ``shown`` is the most rows that a feed holds: of the first ``shown + n``
    ranks at least ``n`` are then not in it, so the others need not be looked at.
    """
    if shown is not None:
        ranked = ranked.where(F.col("rank_pos") <= shown + n)
    rest = drop_seen(ranked, feed)
    nxt = top_rows(rest, ["user_id"], [F.col("rank_pos")], n)
    packed = F.array_sort(F.collect_list(F.struct("rank_pos", "ai_news_id")))
    return nxt.groupBy("user_id").agg(F.transform(packed, lambda e: e["ai_news_id"]).alias("preload"))


def search_feed(feed: DataFrame, articles: DataFrame, query: str, n: int = 50, order: str = "position") -> DataFrame:
    """First ``n`` feed rows per user whose article mentions the query, ignoring case.

    Articles are searched once each, then the few hits meet the feeds.
    """
    haystack = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
                                          ("final_title", "final_text", "target_persona", "category", "raw_news_id")]))
    hits = articles.where(haystack.contains(query.strip().lower())).select("ai_news_id")
    return top_rows(feed.join(hits, "ai_news_id", "left_semi"), ["user_id"], [F.col(order)], n)


def global_feed(enriched: DataFrame, users: DataFrame, state: DataFrame, as_of: Column, limit: int) -> DataFrame:
    """Top articles of 48 hours for every user, with the user's own flags."""
    fresh = enriched.where(
        (F.col("created_at") >= as_of - F.expr(f"INTERVAL {FRESH_HOURS} HOURS"))
        & F.col("final_title").isNotNull()
        & F.col("final_text").isNotNull()
        & (F.col("ai_score") > 0.5)
    ).select("ai_news_id", "category", "ai_score", "created_at")
    order = [F.col("ai_score").desc(), F.col("created_at").desc(), F.col("ai_news_id")]
    top = fresh.orderBy(*order).limit(limit).withColumn("candidate_pos", F.row_number().over(Window.orderBy(*order)))
    flags = state.join(top.select("ai_news_id"), "ai_news_id", "left_semi")
    flag_cols = F.struct("liked", "saved", "viewed", "comment_count")
    per_user = flags.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("ai_news_id", flag_cols))).alias("flags"))
    rows = attach_candidates(users.select("user_id").join(per_user, "user_id", "left"), top)
    flag = F.try_element_at("flags", F.col("ai_news_id"))
    return rows.select(
        "user_id",
        F.col("candidate_pos").alias("position"),
        "ai_news_id",
        "category",
        "ai_score",
        "created_at",
        *[F.coalesce(flag[c], F.lit(False)).alias(c) for c in ("liked", "saved", "viewed")],
        F.coalesce(flag["comment_count"], F.lit(0)).alias("comment_count"),
    )


def pending_feed(raw: DataFrame, enriched: DataFrame, as_of: Column, limit: int) -> DataFrame:
    """Newest raw rows of seven days without an enriched row, with the total of such rows."""
    recent = raw.where((F.col("created_at") >= as_of - F.expr("INTERVAL 7 DAYS")) & F.col("title").isNotNull())
    pending = recent.select("raw_news_id", "source_url", "title", "created_at").join(
        enriched.select("raw_news_id"), "raw_news_id", "left_anti"
    )
    total = pending.agg(F.count(F.lit(1)))
    return (
        pending.orderBy(F.col("created_at").desc(), F.col("raw_news_id").desc())
        .limit(limit)
        .withColumn("total_pending", total.scalar())
    )


def exploration_noise(df: DataFrame, seed: int = 0, spread: float = 0.15, score: str = "rank_score") -> DataFrame:
    """Score plus noise in [0, spread), repeatable per (seed, user, article)."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed).cast("string"), F.col("user_id").cast("string"), F.col("ai_news_id").cast("string")), 256)
    unit = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return df.withColumn("explored_score", F.col(score) + unit * spread)
