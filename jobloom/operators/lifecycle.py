"""Table-in, table-out changes: every one is a pure function of the current table and what changes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that an upsert writes; all others keep what the current row has. Salary columns only come with listed pay.
UPSERTED = ("title", "company", "location", "description", "apply_url", "source", "source_tier", "source_url", "score_total", "last_seen_at")
SALARY = ("salary_min_usd", "salary_max_usd", "salary_source")


def latest(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row for each key: the last by order, if there is one, and then by a hash of all values. Rows whose keys are all
    null stay."""
    rank = F.struct(*([order] if order in rows.columns else []), F.xxhash64(*rows.columns).alias("_hash"))
    none = F.when(reduce(and_, [F.col(k).isNull() for k in keys]), F.monotonically_increasing_id())
    return rows.withColumn("_none", none).groupBy(*[F.col(k).alias(f"_{k}") for k in keys], "_none").agg(F.max_by(F.struct(*rows.columns), rank).alias("r")).select("r.*")


def upsert(current: DataFrame, incoming: DataFrame, key: str = "dedup_key", order: str = "seq", flag: str | None = None) -> DataFrame:
    """current with incoming rows put in by key, one row a key. A new row takes all it has and is active. Of incoming rows
    with one key the last by order counts. A column flag, if one is named, says inserted, updated or kept."""
    incoming = latest(incoming, [key], order)
    c, i = current.alias("c"), incoming.alias("i")
    both = c.join(i, F.col(f"c.{key}") == F.col(f"i.{key}"), "full")
    has, old = F.col(f"i.{key}").isNotNull(), F.col(f"c.{key}").isNotNull()
    listed = F.coalesce(F.col("i.salary_source") == "listed", F.lit(False))

    def pick(name: str) -> Column:
        mine, theirs = F.col(f"c.{name}"), F.col(f"i.{name}") if name in incoming.columns else F.lit(None)
        if name in UPSERTED:
            return F.when(has, theirs).otherwise(mine)
        if name in SALARY:
            return F.when(has & listed, theirs).otherwise(mine)
        if name == "is_active":
            return F.when(old, mine).otherwise(F.lit(True))
        return F.when(old, mine).otherwise(theirs)

    did = [F.when(has & old, "updated").when(old, "kept").otherwise("inserted").alias(flag)] if flag else []
    return both.select(*[(F.coalesce(F.col(f"i.{key}"), F.col(f"c.{key}")) if n == key else pick(n)).alias(n) for n in current.columns], *did)


def patched(current: DataFrame, patches: DataFrame, key: str = "id", order: str = "seq", flag: str | None = None) -> DataFrame:
    """current with the values of patches that are not null; ids that current lacks are ignored. Of several patches of an
    id the last value by order counts that is not null, column by column. A column flag, if one is named, tells the rows
    that have a patch."""
    names = [n for n in patches.columns if n not in (key, order)]
    at = [F.col(order)] if order in patches.columns else []
    last = lambda n: F.max_by(n, F.when(F.col(n).isNotNull(), F.struct(*at, F.col(n))))
    p = patches.groupBy(key).agg(*[last(n).alias(f"_{n}") for n in names], F.lit(True).alias("_has"))
    rows = current.join(p, key, "left")
    hit = [F.col("_has").isNotNull().alias(flag)] if flag else []
    return rows.select(*[F.coalesce(F.col(f"_{n}"), F.col(n)).alias(n) if n in names else F.col(n) for n in current.columns], *hit)


def score_upsert(current: DataFrame, incoming: DataFrame, order: str = "seq") -> DataFrame:
    """Last write wins for each (job_id, profile_id), among incoming rows by order."""
    incoming = latest(incoming, ["job_id", "profile_id"], order).select(*current.columns)
    return current.join(incoming, ["job_id", "profile_id"], "left_anti").unionByName(incoming)


def geo_marked(postings: DataFrame, marks: DataFrame, order: str = "seq") -> DataFrame:
    """marks (id, reason): all are filtered; those with a reason are inactive and keep it. Of several reasons of an id the
    last by order counts."""
    at = [F.col(order)] if order in marks.columns else []
    last = F.max_by("reason", F.when(F.col("reason").isNotNull(), F.struct(*at, F.col("reason"))))
    rows = postings.join(marks.groupBy("id").agg(F.lit(True).alias("_m"), last.alias("_r")), "id", "left")
    marked = F.col("_m").isNotNull()
    return rows.withColumns({
        "geo_filtered": F.col("geo_filtered") | marked,
        "is_active": F.col("is_active") & ~(marked & F.col("_r").isNotNull()),
        "geo_reject_reason": F.when(marked & F.col("_r").isNotNull(), F.col("_r")).otherwise(F.col("geo_reject_reason")),
    }).drop("_m", "_r")


def _before(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def retained(postings: DataFrame, as_of: Column, inactive_after: int, delete_after: int) -> DataFrame:
    """Rows not seen for a while become inactive; rows first seen long ago go."""
    kept = postings.filter(F.col("first_seen_at") >= _before(as_of, delete_after))
    return kept.withColumn("is_active", F.col("is_active") & (F.col("last_seen_at") >= _before(as_of, inactive_after)))


def retention_flags(postings: DataFrame, as_of: Column, inactive_after: int, delete_after: int) -> DataFrame:
    """postings with what retention does to a row: _stale (active, but not seen for a while), _gone (first seen long ago).
    A row without the moment that decides is neither."""
    said = lambda c: F.coalesce(c, F.lit(False))
    stale = said(F.col("is_active") & (F.col("last_seen_at") < _before(as_of, inactive_after)))
    return postings.withColumns({"_stale": stale, "_gone": said(F.col("first_seen_at") < _before(as_of, delete_after))})


def staled(applications: DataFrame, as_of: Column, after: int) -> DataFrame:
    old = (F.col("status") == "applied") & (F.col("updated_at") < _before(as_of, after))
    return applications.withColumns({"status": F.when(old, "stale").otherwise(F.col("status")), "updated_at": F.when(old, as_of).otherwise(F.col("updated_at"))})


def activated(profiles: DataFrame, user_id: int, profile_id: int) -> DataFrame:
    """Exactly one profile of the user is active, if the profile is theirs; otherwise nothing changes."""
    own = profiles.filter((F.col("user_id") == user_id) & (F.col("id") == profile_id)).select(F.col("user_id").alias("_u")).distinct()
    rows = profiles.join(F.broadcast(own.limit(1)), F.col("user_id") == F.col("_u"), "left")
    return rows.withColumn("is_active", F.when(F.col("_u").isNotNull(), F.col("id") == profile_id).otherwise(F.col("is_active"))).drop("_u")


def activations(profiles: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """profiles after users asked for one of theirs to be the active one (wanted: user_id, id, seq), and what became of each
    request: user_id, id, seq and outcome (activated, replaced by a later request, not owned, or missing).

    A user whose requests are all refused keeps the profiles as they are; one without a request does, too.
    """
    owner = profiles.select("id", F.col("user_id").alias("_owner"))
    judged = wanted.join(owner, "id", "left").withColumn("_ok", F.col("_owner").eqNullSafe(F.col("user_id")) & F.col("_owner").isNotNull())
    last = judged.filter("_ok").groupBy("user_id").agg(F.max(F.struct("seq", "id")).alias("_last"))
    rows = profiles.join(last.select("user_id", F.col("_last.id").alias("_chosen")), "user_id", "left")
    after = rows.withColumn("is_active", F.when(F.col("_chosen").isNotNull(), F.col("id") == F.col("_chosen")).otherwise(F.col("is_active"))).select(*profiles.columns)
    is_last = F.struct("seq", "id").eqNullSafe(F.col("_last"))
    said = F.when(F.col("_owner").isNull(), "missing").when(~F.col("_ok"), "not owned").when(is_last, "activated").otherwise("replaced")
    return after, judged.join(last, "user_id", "left").select("user_id", "id", "seq", said.alias("outcome"))


def status_changes(applications: DataFrame, changes: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """changes (id, status, at): applied_at is set once, by the first change that applies; updated_at at every change, and
    the last one's status stays; unknown statuses are rejected."""
    known = changes.filter(F.col("status").isin(*statuses))
    ok = known.groupBy("id").agg(F.max_by("status", F.struct("at", "status")).alias("_s"), F.max("at").alias("_at"), F.min(F.when(F.col("status") == "applied", F.col("at"))).alias("_first"))
    rows = applications.join(ok, "id", "left")
    return rows.withColumns({
        "applied_at": F.coalesce("applied_at", "_first"),
        "status": F.coalesce("_s", "status"),
        "updated_at": F.coalesce("_at", "updated_at"),
    }).drop("_s", "_at", "_first")


def idempotent_insert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming (user_id, job_id, seq) with the flag duplicate: the pair is in current or came before; existing_id is then
    the row that is there, or none where an earlier incoming row is. Rows without a job or a user are always new.

    The first incoming row of a pair is found by an aggregate over rows that name one, so no group of nulls is made.
    """
    known = current.filter("job_id IS NOT NULL").groupBy("user_id", "job_id").agg(F.min("id").alias("existing_id"))
    first = incoming.filter("job_id IS NOT NULL AND user_id IS NOT NULL").groupBy("user_id", "job_id").agg(F.min("seq").alias("_first"))
    rows = incoming.join(first, ["user_id", "job_id"], "left")
    # Only rows that share the first seq of a pair are ranked; one of them, whichever it is, comes first.
    leads = F.coalesce(F.col("seq") == F.col("_first"), F.lit(False))
    tied = rows.filter(leads).withColumn("_late", F.row_number().over(Window.partitionBy("user_id", "job_id").orderBy("seq")) > 1)
    rows = tied.unionByName(rows.filter(~leads).withColumn("_late", F.col("_first").isNotNull())).join(known, ["user_id", "job_id"], "left")
    return rows.withColumn("duplicate", F.col("existing_id").isNotNull() | F.col("_late")).select(*incoming.columns, "duplicate", "existing_id")


#: Statuses that an application may begin with; later ones come by changes only.
INITIAL_STATUSES = ("saved", "applied")


def inserted(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """What each insert (user_id, job_id, seq, job_title_snapshot, status, at) gives: seq, outcome and the row that is there
    after it (id, user_id, job_id, job_title_snapshot, status, applied_at, updated_at).

    outcome is `created`, `duplicate` (an existing row, or the one that an earlier insert created, is given back) or
    `refused` (a status that isn't initial; no row). No status is saved. A created row has no id yet; it is applied at its
    own moment.
    """
    said = F.coalesce("status", F.lit("saved"))
    asked = incoming.withColumn("status", said)
    allowed = asked.filter(F.col("status").isin(*INITIAL_STATUSES))
    fresh = lambda r: F.struct(F.lit(None).cast("long").alias("id"), *[F.col(f"{r}{c}").alias(c) for c in ("user_id", "job_id", "job_title_snapshot", "status")], F.when(F.col(f"{r}status") == "applied", F.col(f"{r}at")).alias("applied_at"), F.col(f"{r}at").alias("updated_at"))
    marked = idempotent_insert(current, allowed).withColumn("_row", fresh(""))
    first = marked.filter("job_id IS NOT NULL AND NOT duplicate").select("user_id", "job_id", F.col("_row").alias("_made"))
    old = current.filter("job_id IS NOT NULL").groupBy("user_id", "job_id").agg(F.min_by(F.struct(*[F.col(c) for c in ("id", "user_id", "job_id", "job_title_snapshot", "status", "applied_at", "updated_at")]), "id").alias("_old"))
    rows = marked.join(first, ["user_id", "job_id"], "left").join(old, ["user_id", "job_id"], "left")
    given = F.when(F.col("duplicate"), F.coalesce("_old", "_made")).otherwise(F.col("_row"))
    done = rows.select("seq", F.when(F.col("duplicate"), "duplicate").otherwise("created").alias("outcome"), given.alias("application"))
    refused = asked.filter(~F.col("status").isin(*INITIAL_STATUSES)).select("seq", F.lit("refused").alias("outcome"), F.lit(None).cast(done.schema["application"].dataType).alias("application"))
    return done.unionByName(refused).select("seq", "outcome", "application.*")


SENTINELS = {"function_category": "Other", "seniority": "Unspecified", "vertical": "Other", "remote_status": "Unspecified"}


def geo_reset(postings: DataFrame, since: Column) -> DataFrame:
    back = (F.col("first_seen_at") >= since) & F.col("geo_reject_reason").isNotNull()
    return postings.withColumns({
        "geo_filtered": F.col("geo_filtered") & ~back,
        "is_active": F.col("is_active") | back,
        "geo_reject_reason": F.when(back, F.lit(None)).otherwise(F.col("geo_reject_reason")),
    })


def requeued(postings: DataFrame, since: Column) -> DataFrame:
    """Active rows lose the geo flag; rows of the window lose what classification gave them."""
    recent = F.col("first_seen_at") >= since
    columns = {c: F.when(~recent, F.col(c)) for c in ("function_category", "seniority", "vertical", "remote_status")}
    return postings.withColumns(columns | {"geo_filtered": F.col("geo_filtered") & ~F.col("is_active")})


def rescorable(scores: DataFrame, postings: DataFrame, since: Column, breakdown: str = "breakdown") -> DataFrame:
    """scores without the breakdown of postings of a window, so that these count as unscored again."""
    window = postings.filter(F.col("first_seen_at") >= since).select(F.col("id").alias("job_id"), F.lit(True).alias("_again")).distinct()
    rows = scores.join(window, "job_id", "left")
    return rows.withColumn(breakdown, F.when(F.col("_again").isNull(), F.col(breakdown))).select(*scores.columns)


def with_sentinels(postings: DataFrame) -> DataFrame:
    """Views show a sentinel where an enum says that nothing is classified."""
    return postings.fillna(SENTINELS)


def with_snapshots(applications: DataFrame, postings: DataFrame) -> DataFrame:
    """applications with the title of the posting, or the one kept with the application where the posting has gone."""
    live = postings.select(F.col("id").alias("job_id"), "title")
    return applications.join(live, "job_id", "left").withColumn("title", F.coalesce("title", "job_title_snapshot"))


def orphans(scores: DataFrame, profiles: DataFrame, profile: str = "profile_id") -> DataFrame:
    """scores with the flag kept: their profile is still there."""
    known = profiles.select(F.col("id").alias(profile)).distinct().withColumn("_has", F.lit(True))
    return scores.join(known, profile, "left").withColumn("kept", F.col("_has").isNotNull()).drop("_has")


def active_profiles(profiles: DataFrame) -> DataFrame:
    """The active profile of each user, the first by id."""
    return profiles.filter("is_active").groupBy("user_id").agg(F.min("id").alias("profile_id"))


def newest_first(applications: DataFrame) -> DataFrame:
    """applications with their rank for each user, the last changed first."""
    return applications.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("updated_at").desc(), "id")))


def rescore_window(postings: DataFrame, since: Column) -> DataFrame:
    """Rows of a window that were rejected for their place and are to be judged again."""
    return postings.filter((F.col("first_seen_at") >= since) & F.col("geo_reject_reason").isNotNull())


def deleted_profiles(profiles: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (id, user_id) with outcome: missing, not owned, active or deleted."""
    p = profiles.select(F.col("id"), F.col("user_id").alias("_owner"), F.col("is_active").alias("_active"))
    rows = wanted.join(p, "id", "left")
    said = F.when(F.col("_owner").isNull(), "missing").when(F.col("_owner") != F.col("user_id"), "not owned").when(F.col("_active"), "active").otherwise("deleted")
    return rows.select("id", "user_id", said.alias("outcome"))


def profile_cascade(profiles: DataFrame, scores: DataFrame, wanted: DataFrame, store: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables after profiles were deleted on demand: profiles, scores and refusals (id, user_id, outcome).

    All three follow from one table of decisions, which store() writes once, so they agree also where profiles are written
    over before the others are read. Scores of a deleted profile go with it; a profile that is asked for twice goes once.
    """
    decided = store(deleted_profiles(profiles, wanted))
    gone = decided.filter("outcome = 'deleted'").select("id").distinct()
    return profiles.join(gone, "id", "left_anti"), scores.join(gone.withColumnRenamed("id", "profile_id"), "profile_id", "left_anti").select(*scores.columns), decided.filter("outcome <> 'deleted'")


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone, keys, "left_anti")
