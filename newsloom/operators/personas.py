"""Personas, audience fan-out and work-queue state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.common import first_row, top_rows
from newsloom.operators.matching import substring_matches
from newsloom.session import cut_lineage, spread_partitions

TOPIC_KEYS = ("all_topics", "topics", "custom_topics")


def user_topics(interests: Column) -> Column:
    """Distinct lower-case topics of an interests JSON, in order.

    Without any topic list the names of the truthy keys count.
    """
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(F.from_json(F.get_json_object(interests, f"$.{k}"), "array<string>"), empty) for k in TOPIC_KEYS]
    named = F.filter(F.transform(F.concat(*lists), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    falsy = ("", "false", "0", "null", "[]", "{}", "0.0")
    flags = F.map_filter(F.from_json(interests, "map<string,string>"), lambda k, v: v.isNotNull() & ~v.isin(*falsy))
    keys = F.transform(F.coalesce(F.map_keys(flags), empty), lambda k: F.lower(F.trim(k)))
    return F.when(F.size(named) > 0, F.array_distinct(named)).otherwise(keys)


# Limits of cohorts, scores, queue and first feeds.
TARGET_SCORE, MIN_SCORE = 8.0, 6.0
MAX_ATTEMPTS, CLAIM_LIMIT, STALE_MINUTES = 3, 50, 10
RETENTION_DAYS = 4
BASE_TTL_HOURS, USER_TTL_HOURS = 48, 12
SEED_POOL = 300
SEED_CAPS = {1: 40, 2: 12, 3: 16}

# Matched pairs of label and group, and articles, are copied to where users lie up to so many rows each.
COPIED_ROWS = 500_000
# Ids that one list of a label's articles spans.
LISTED_IDS = 65_536
# Articles in lists are copied up to so many times as many: one is two numbers there, no row with a label.
LISTED_FACTOR = 8
# Rows of a fan-out that no sort holds: a task gets so many times the usual ones.
STREAMED_FACTOR = 10


def profession(interests: Column) -> Column:
    return F.lower(F.trim(F.coalesce(F.get_json_object(interests, "$.profession"), F.lit(""))))


def persona_label(topic: Column, job: Column, geo: Column, country: Column) -> Column:
    """Lower-case label ``topic|profession|geo|country`` without the blank parts."""
    parts = F.array(F.coalesce(F.nullif(topic, F.lit("")), F.lit("general")), job, geo, country)
    return F.array_join(F.filter(F.transform(parts, lambda p: F.lower(F.trim(p))), lambda p: p != ""), "|")


def persona_cohort(users: DataFrame, max_personas: int | None = None) -> DataFrame:
    """Distinct persona labels of active users in user and topic order, the first ``max_personas`` of them if given."""
    active = users.where("is_active").select(
        "user_id",
        F.posexplode(_or_general(user_topics(F.col("interests")))).alias("tpos", "topic"),
        profession(F.col("interests")).alias("profession"),
        F.lower(F.trim(F.coalesce("location", F.lit("")))).alias("geo"),
        F.upper(F.trim(F.coalesce("country_code", F.lit("")))).alias("country_code"),
    )
    label = persona_label(F.col("topic"), F.col("profession"), F.col("geo"), F.col("country_code"))
    cols = ("topic", "profession", "geo", "country_code")
    first = active.groupBy(label.alias("label")).agg(
        F.min(F.struct("user_id", "tpos")).alias("at"), F.min_by(F.struct(*cols), F.struct("user_id", "tpos")).alias("p")
    )
    if max_personas is not None:
        first = first.orderBy("at").limit(max_personas)
    found = first.select("label", *[F.col(f"p.{c}") for c in cols])
    general = users.sparkSession.range(1).select(
        F.lit("general").alias("label"), F.lit("general").alias("topic"), *[F.lit("").alias(c) for c in cols[1:]]
    )
    return found.unionByName(general.where(found.agg(F.count(F.lit(1))).scalar() == 0))


def _or_general(topics: Column) -> Column:
    return F.when(F.size(topics) > 0, topics).otherwise(F.array(F.lit("general")))


def audience(users: DataFrame) -> DataFrame:
    """Active users with the normal forms that targeting compares."""
    empty = F.array().cast("array<string>")
    listed = F.coalesce(F.from_json(F.get_json_object("interests", "$.all_topics"), "array<string>"), empty)
    return users.where("is_active").select(
        "user_id",
        listed.alias("topics"),
        F.lower(F.coalesce("interests", F.lit(""))).alias("interests_text"),
        profession(F.col("interests")).alias("profession"),
        F.lower(F.coalesce("location", F.lit(""))).alias("geo"),
        F.upper(F.coalesce("country_code", F.lit(""))).alias("country"),
    )


def article_targets(articles: DataFrame) -> DataFrame:
    """(ai_news_id, ai_score, t_topic, t_profession, t_geo, t_country) from the persona label parts."""
    parts = F.split(F.lower(F.trim(F.coalesce("target_persona", F.lit("general")))), r"\|")

    def part(i: int) -> Column:
        return F.coalesce(F.get(parts, F.lit(i)), F.lit(""))

    return articles.select(
        "ai_news_id", "ai_score", part(0).alias("t_topic"), part(1).alias("t_profession"), part(2).alias("t_geo"),
        F.upper(part(3)).alias("t_country"),
    )


def _keys(people: DataFrame, topics: Column) -> DataFrame:
    """One row per key a targeted article can carry: a blank part targets everybody."""

    def or_blank(c: str) -> Column:
        return F.array_distinct(F.array(F.col(c), F.lit("")))

    keyed = people.withColumn("k_topic", F.explode(topics))
    keyed = keyed.withColumn("k_profession", F.explode(or_blank("profession")))
    return keyed.withColumn("k_country", F.explode(or_blank("country")))


def _targeted(targets: DataFrame, keyed: DataFrame) -> DataFrame:
    """(label_id, group_id) by equality of topic, profession and country; place by substring."""
    on = (
        (F.col("t_topic") == F.col("k_topic"))
        & (F.col("t_profession") == F.col("k_profession"))
        & (F.col("t_country") == F.col("k_country"))
        & ((F.col("t_geo") == "") | F.contains(F.col("geo"), F.col("t_geo")))
    )
    return targets.join(keyed, on).select("label_id", "group_id")


def _any_of_three(targets: DataFrame, groups: DataFrame) -> DataFrame:
    """(label_id, group_id) where profession, place or country alone agree."""
    cols = ("label_id", "group_id")
    by_job = targets.where("t_profession <> ''").join(groups, F.col("t_profession") == F.col("profession")).select(*cols)
    by_country = targets.where("t_country <> ''").join(groups, F.col("t_country") == F.col("country")).select(*cols)
    places = substring_matches(groups, "group_id", "geo", targets.select("t_geo"), "t_geo", (1, 2, 3))
    return by_job.unionByName(by_country).unionByName(targets.join(places, "t_geo").select(*cols)).distinct()


def feed_fanout(articles: DataFrame, users: DataFrame, existing: DataFrame) -> DataFrame:
    """(user_id, ai_news_id, ai_score, tier): who gets which enriched article.

    Tier 1 matches topic, profession, place and country; articles without any
    match try tier 2, where the topic may occur anywhere in the interests; the
    rest try tier 3: profession, place or country alone.  Rows already in the
    feed are left out; a user's rows are gathered by label for that.

    Tiers depend on an article's label and a user's attributes only.  So they
    are decided between distinct labels and distinct groups of like users, each
    tier written once.  Users meet the matched pairs, and then the articles, where
    they lie: while pairs and articles are few both are copied there, and no row
    per user and label is shuffled; beyond that they join by two ids.  Every group
    also carries the topic "general", so all topic tests are hash joins.
    """
    facts = ("topics", "interests_text", "profession", "geo", "country")
    parts = ("t_topic", "t_profession", "t_geo", "t_country")
    # parsing a user is dear and three branches need it: written once
    people = cut_lineage(audience(users).withColumn("group_id", F.md5(F.to_json(F.struct(*facts)))))
    targets = article_targets(articles).withColumn("label_id", F.md5(F.to_json(F.struct(*parts))))
    groups = cut_lineage(people.select("group_id", *facts).dropDuplicates(["group_id"]))
    labels = cut_lineage(targets.select("label_id", *parts).distinct())

    def left(tried: DataFrame, matched: DataFrame) -> DataFrame:
        return cut_lineage(tried.join(matched.select("label_id").distinct(), "label_id", "left_anti"))

    with_general = F.array_distinct(F.concat("topics", F.array(F.lit("general"))))
    tier1 = cut_lineage(_targeted(labels, _keys(groups, with_general)))
    rest2 = left(labels, tier1)
    # a blank topic occurs in all interests
    named = substring_matches(groups, "group_id", "interests_text", rest2.select("t_topic"), "t_topic", (1, 2, 3)).unionByName(
        groups.select("group_id", F.lit("").alias("t_topic"))
    )
    relaxed = groups.join(named.withColumnRenamed("t_topic", "k_named"), "group_id")
    tier2 = cut_lineage(_targeted(rest2, _keys(relaxed, F.array("k_named"))).distinct())
    tier3 = _any_of_three(left(rest2, tier2), groups)

    tiers = [df.withColumn("tier", F.lit(i)) for i, df in enumerate((tier1, tier2, tier3), 1)]
    pairs = cut_lineage(tiers[0].unionByName(tiers[1]).unionByName(tiers[2]))
    # what users already have goes to them by label, so that nothing moves after the users meet labels and articles
    served = existing.select("user_id", "ai_news_id").join(targets.select("label_id", "ai_news_id"), "ai_news_id")
    served = served.groupBy("user_id", "label_id").agg(F.collect_set("ai_news_id").alias("ids"))
    served = served.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("label_id", "ids"))).alias("served"))
    given = people.select("user_id", "group_id").join(served, "user_id", "left")
    sizes = pairs.join(people.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_users")), "group_id").join(
        targets.groupBy("label_id").agg(F.count(F.lit(1)).alias("n_articles")), "label_id"
    )
    rows = sizes.agg(F.coalesce(F.sum(F.col("n_users") * F.col("n_articles")), F.lit(0))).first()[0]
    given = given.repartition(spread_partitions(users.sparkSession, rows // STREAMED_FACTOR), "user_id")
    asked = given.join(_copied(pairs), "group_id").select(
        "user_id", "label_id", "tier", F.try_element_at("served", F.col("label_id")).alias("served")
    )
    # a label's articles lie in lists, which a match walks through instead of looking each one up
    listed = targets.groupBy("label_id", F.floor(F.col("ai_news_id") / LISTED_IDS).alias("part")).agg(
        F.collect_list(F.struct("ai_news_id", "ai_score")).alias("articles")
    )
    listed = cut_lineage(listed.select("label_id", "articles"))
    few = listed.agg(F.coalesce(F.sum(F.size("articles")), F.lit(0))).first()[0] <= COPIED_ROWS * LISTED_FACTOR
    matched = asked.join(F.broadcast(listed) if few else listed, "label_id").select("user_id", "tier", "served", F.inline("articles"))
    new = ~F.coalesce(F.array_contains("served", F.col("ai_news_id")), F.lit(False))
    return matched.where(new).select("user_id", "ai_news_id", "ai_score", "tier")


def _copied(small: DataFrame) -> DataFrame:
    """``small`` with a broadcast hint while it has few rows."""
    return F.broadcast(small) if small.count() <= COPIED_ROWS else small


def audience_counts(articles: DataFrame, users: DataFrame, existing: DataFrame) -> DataFrame:
    """Per article: active users, matches per criterion and new combined matches.

    Users are counted per attribute value before any join, so the joins carry
    one row per distinct value.
    """
    people = audience(users)
    targets = article_targets(articles)
    total = people.agg(F.count(F.lit(1)))

    def tally(column: Column, name: str) -> DataFrame:
        return people.select("user_id", column.alias(f"v_{name}")).distinct().groupBy(f"v_{name}").agg(F.count(F.lit(1)).alias(f"n_{name}"))

    with_general = F.array_distinct(F.concat("topics", F.array(F.lit("general"))))
    by_topic = tally(F.explode(with_general), "topic")
    by_job = tally(F.col("profession"), "profession")
    by_country = tally(F.col("country"), "country")
    locations = people.groupBy("geo").agg(F.count(F.lit(1)).alias("n"))
    wanted = targets.select("t_geo").where("t_geo <> ''").distinct()
    named = substring_matches(locations.withColumn("geo_text", F.col("geo")), "geo", "geo_text", wanted, "t_geo", (1, 2, 3))
    by_geo = named.join(locations, "geo").groupBy("t_geo").agg(F.sum("n").alias("n_geo"))
    # combined matches: user groups instead of users, minus those already served
    groups = _keys(people, with_general).groupBy("k_topic", "k_profession", "k_country", "geo").agg(F.count(F.lit(1)).alias("n"))
    on = (
        (F.col("t_topic") == F.col("k_topic"))
        & (F.col("t_profession") == F.col("k_profession"))
        & (F.col("t_country") == F.col("k_country"))
        & ((F.col("t_geo") == "") | F.contains(F.col("geo"), F.col("t_geo")))
    )
    combined = targets.join(groups, on).groupBy("ai_news_id").agg(F.sum("n").alias("n_all"))
    served = existing.select("user_id", "ai_news_id").join(people, "user_id").join(targets, "ai_news_id").where(
        F.array_contains(with_general, F.col("t_topic"))
        & ((F.col("t_profession") == "") | (F.col("t_profession") == F.col("profession")))
        & ((F.col("t_country") == "") | (F.col("t_country") == F.col("country")))
        & ((F.col("t_geo") == "") | F.contains(F.col("geo"), F.col("t_geo")))
    )
    served = served.groupBy("ai_news_id").agg(F.count(F.lit(1)).alias("n_served"))

    out = (
        targets.join(by_topic, F.col("t_topic") == F.col("v_topic"), "left")
        .join(by_job, F.col("t_profession") == F.col("v_profession"), "left")
        .join(by_country, F.col("t_country") == F.col("v_country"), "left")
        .join(by_geo, "t_geo", "left")
        .join(combined, "ai_news_id", "left")
        .join(served, "ai_news_id", "left")
        .withColumn("active_users", total.scalar())
    )

    def n(c: str) -> Column:
        return F.coalesce(c, F.lit(0))

    return out.select(
        "ai_news_id",
        "active_users",
        n("n_topic").alias("topic_matches"),
        n("n_profession").alias("profession_matches"),
        F.when(F.col("t_geo") == "", F.col("active_users")).otherwise(n("n_geo")).alias("geo_matches"),
        n("n_country").alias("country_matches"),
        (n("n_all") - n("n_served")).alias("combined_matches"),
    )


def upsert_enriched(new: DataFrame, existing: DataFrame, id_col: str = "ai_news_id") -> DataFrame:
    """Surviving row per (raw article, persona): an existing one always wins.

    Adds ``inserted``; rows of ``new`` whose key exists only return that id.
    """
    both = existing.withColumn("inserted", F.lit(False)).unionByName(new.withColumn("inserted", F.lit(True)))
    return first_row(both, ["raw_news_id", "target_persona"], [F.col("inserted"), F.col(id_col)])


def best_candidate(drafts: DataFrame, target: float = TARGET_SCORE, minimum: float = MIN_SCORE) -> DataFrame:
    """Per item the first draft that reaches ``target``, else the best; none below ``minimum``.

    ``drafts`` is (item, round, combined_score, …).  Both choices are partial
    aggregates, so an item with many drafts is reduced before the shuffle.
    """
    row = F.struct("round", "combined_score")
    picked = drafts.groupBy("item").agg(
        F.min(F.when(F.col("combined_score") >= target, row)).alias("first_good"),
        F.max(F.struct("combined_score", (-F.col("round")).alias("order"))).alias("best"),
    )
    best_round = F.coalesce(F.col("first_good.round"), -F.col("best.order"))
    score = F.coalesce(F.col("first_good.combined_score"), F.col("best.combined_score"))
    return picked.select("item", best_round.alias("round"), score.alias("combined_score")).where(F.col("combined_score") >= minimum)


def claimable() -> Column:
    """Rows that may be worked: unset, pending or new, or failed with attempts left."""
    status = F.col("process_status")
    tries = F.coalesce("attempt_count", F.lit(0))
    return status.isNull() | status.isin("pending", "new") | ((status == "failed") & (tries < MAX_ATTEMPTS))


def claim_queue(raw: DataFrame, as_of: Column, limit: int = CLAIM_LIMIT) -> DataFrame:
    """The newest claimable rows, marked as processing with one more attempt."""
    top = raw.where(claimable()).orderBy(F.col("created_at").desc(), F.col("raw_news_id").desc()).limit(limit)
    return top.withColumns(
        {
            "process_status": F.lit("processing"),
            "processing_started_at": as_of,
            "attempt_count": F.coalesce("attempt_count", F.lit(0)) + 1,
        }
    )


def recover_stale(raw: DataFrame, as_of: Column, ttl_minutes: int = STALE_MINUTES) -> DataFrame:
    """Rows in processing for longer than the limit go back to pending with no attempts."""
    limit = as_of - F.make_interval(mins=F.lit(max(1, ttl_minutes)))
    stale = (F.col("process_status") == "processing") & (F.coalesce("processing_started_at", "created_at") < limit)
    stale = F.coalesce(stale, F.lit(False))
    return raw.withColumn("recovered", stale).withColumns(
        {
            "process_status": F.when(F.col("recovered"), "pending").otherwise(F.col("process_status")),
            "processing_started_at": F.when(~F.col("recovered"), F.col("processing_started_at")),
            "attempt_count": F.when(F.col("recovered"), 0).otherwise(F.col("attempt_count")),
        }
    )


def apply_retention(raw: DataFrame, enriched: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop rows older than the limit; enriched rows also go with their raw row.

    Returns both tables and one row of counts (deleted_raw, deleted_by_age).
    """
    cutoff = as_of - F.make_interval(days=F.lit(days))
    raw_kept = raw.where(F.col("created_at") >= cutoff)
    fresh = enriched.where(F.col("created_at") >= cutoff)
    kept = fresh.join(raw_kept.select("raw_news_id"), "raw_news_id", "left_semi")
    old = F.count_if(F.col("created_at") < cutoff)
    counts = raw.agg(old.alias("deleted_raw")).withColumn("deleted_by_age", enriched.agg(old).scalar())
    return raw_kept, kept, counts


def article_cache_key(news_id: Column, title: Column, content: Column, head_chars: int | None = None) -> Column:
    """md5 of id, title and text, or of its first ``head_chars`` characters only."""
    body = F.coalesce(content, F.lit(""))
    body = body if head_chars is None else F.substring(body, 1, head_chars)
    return F.md5(F.concat_ws("|", news_id.cast("string"), F.coalesce(title, F.lit("")), body))


def profile_cache_key(profile_json: Column) -> Column:
    """md5 of the key-sorted profile JSON, "anon" without a profile."""
    return F.when(F.coalesce(profile_json, F.lit("")) == "", "anon").otherwise(F.md5(profile_json))


def enrichment_cache_plan(requests: DataFrame, articles: DataFrame, base_cache: DataFrame, user_cache: DataFrame, as_of: Column) -> DataFrame:
    """Per requested (article, user): user hit, base hit or miss.

    ``requests`` is (ai_news_id, user_id, profile_json); ``base_cache``
    (ai_news_id, base_key, cached_at, summary, category); ``user_cache``
    (ai_news_id, user_id, profile_key, cached_at).  Misses get the text head as
    summary and category "other".
    """
    live_base = base_cache.where(F.col("cached_at") > as_of - F.make_interval(hours=F.lit(BASE_TTL_HOURS))).drop("cached_at")
    live_user = user_cache.where(F.col("cached_at") > as_of - F.make_interval(hours=F.lit(USER_TTL_HOURS)))
    live_user = live_user.select("ai_news_id", "user_id", "profile_key", F.lit(True).alias("user_hit"))
    # keys and heads once per article; texts stay out of the request join
    heads = articles.select(
        "ai_news_id",
        article_cache_key(F.col("ai_news_id"), F.col("final_title"), F.col("final_text")).alias("base_key"),
        F.concat(F.trim(F.substring(F.coalesce("final_text", F.lit("")), 1, 200)), F.lit("...")).alias("head"),
    ).join(live_base.withColumn("base_hit", F.lit(True)), ["ai_news_id", "base_key"], "left")
    keyed = requests.withColumn("profile_key", profile_cache_key(F.col("profile_json"))).drop("profile_json")
    joined = keyed.join(heads, "ai_news_id").join(live_user, ["ai_news_id", "user_id", "profile_key"], "left")
    return joined.select(
        "ai_news_id",
        "user_id",
        "base_key",
        "profile_key",
        F.when(F.col("user_hit"), "user_hit").when(F.col("base_hit"), "base_hit").otherwise("miss").alias("plan"),
        F.coalesce("summary", "head").alias("summary"),
        F.coalesce("category", F.lit("other")).alias("category"),
    )


def seed_new_user_feed(users: DataFrame, enriched: DataFrame, existing: DataFrame, pool: int = SEED_POOL) -> DataFrame:
    """First feed of new users from the latest articles, one per raw article.

    Up to 40 articles whose persona is, or starts with, a user topic; without
    any, up to 12 general ones; without those, the 16 latest.  Tiers 2 and 3
    are the same for everybody: they are picked once and attached to the users
    that need them.
    """
    order = [F.col("created_at").desc(), F.col("ai_news_id").desc()]
    latest = enriched.select("ai_news_id", "ai_score", "raw_news_id", "created_at", F.lower(F.trim("target_persona")).alias("persona"))
    latest = latest.orderBy(*order).limit(pool)
    latest = latest.withColumn("pos", F.row_number().over(Window.orderBy(*order)))  # ``pool`` rows at most
    latest = latest.withColumn("topic", F.substring_index("persona", "|", 1)).where("persona <> ''")

    def distinct_raw(df: DataFrame, keys: list[str], cap: int) -> DataFrame:
        per_raw = top_rows(df, [*keys, "raw_news_id"], [F.col("pos")], 1)
        return top_rows(per_raw, keys, [F.col("pos")], cap, "rank")

    # users with the same topics get the same picks, made once per distinct set of topics
    people = users.select("user_id", F.array_sort(F.array_distinct(user_topics(F.col("interests")))).alias("topics"))
    wanted = people.select("topics").distinct().select("topics", F.explode("topics").alias("topic"))
    own = distinct_raw(wanted.join(latest, "topic"), ["topics"], SEED_CAPS[1]).withColumn("tier", F.lit(1))
    pick = F.struct("ai_news_id", "ai_score", "rank", "tier")
    picks = own.groupBy("topics").agg(F.collect_list(pick).alias("_own"))
    shared = latest.withColumn("all", F.lit(1))
    general = distinct_raw(shared.where("topic = 'general'"), ["all"], SEED_CAPS[2]).withColumn("tier", F.lit(2))
    anything = distinct_raw(shared, ["all"], SEED_CAPS[3]).withColumn("tier", F.lit(3))
    fallback = general.unionByName(anything)
    fallback = fallback.withColumn("best", F.min("tier").over(Window.partitionBy("all"))).where("tier = best")
    packed = fallback.agg(F.collect_list(pick).alias("rows"))
    # users meet their sets first, and only then the picks that fan out
    served = existing.groupBy("user_id").agg(F.collect_set("ai_news_id").alias("_served"))
    given = people.join(served, "user_id", "left").join(picks, "topics", "left")
    given = given.withColumn("_rows", F.coalesce("_own", packed.scalar())).select("user_id", "_served", F.inline("_rows"))
    new = ~F.coalesce(F.array_contains("_served", F.col("ai_news_id")), F.lit(False))
    return given.where(new).drop("_served")
