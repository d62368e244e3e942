"""Users, tokens, audit events and jobs as tables: listings, point reads, last state, appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Roles in order of what they may do.
ROLE_LEVELS = {"viewer": 10, "officer": 20, "knowledge_manager": 30, "admin": 40}
JOB_STATES = ("queued", "running", "succeeded", "failed")


def latest_rows(rows: DataFrame, limit: int = 100, time_col: str = "created_at", id_col: str = "id") -> DataFrame:
    """The newest rows first."""
    return rows.orderBy(F.desc(time_col), F.desc(id_col)).limit(limit)


def point_read(rows: DataFrame, **equal: object) -> DataFrame:
    """At most one row with these values."""
    for name, value in equal.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows.limit(1)


def active_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    """Tokens neither revoked nor expired."""
    return tokens.where(F.col("revoked_at").isNull() & (F.col("expires_at") > now))


def token_owner(tokens: DataFrame, users: DataFrame, token: str, now: Column) -> DataFrame:
    """The active user of an active token, found by the token's SHA-256."""
    found = active_tokens(tokens, now).where(F.col("token_hash") == F.sha2(F.lit(token), 256)).select("user_id")
    return users.where("is_active").join(found, users["id"] == found["user_id"], "left_semi")


def revoke_tokens(tokens: DataFrame, user_id: object, now: Column) -> DataFrame:
    """Tokens with the user's open ones marked as revoked."""
    return tokens.withColumn("revoked_at", F.when((F.col("user_id") == F.lit(user_id)) & F.col("revoked_at").isNull(), now).otherwise(F.col("revoked_at")))


def rotate_tokens(tokens: DataFrame, used: DataFrame, now: Column) -> DataFrame:
    """Tokens after a rotation of used (token_hash, new_id, new_hash, expires_at): each open one is revoked and followed by a new one of its user."""
    open_ = active_tokens(tokens, now).join(used.withColumnRenamed("expires_at", "new_expires"), "token_hash")
    new = open_.select(F.col("new_id").alias("id"), "user_id", F.col("new_expires").alias("expires_at"), F.lit(None).cast("timestamp").alias("revoked_at"), F.col("new_hash").alias("token_hash"))
    marked = tokens.join(open_.select("token_hash", now.alias("_at")), "token_hash", "left").withColumn("revoked_at", F.coalesce("revoked_at", "_at"))
    return marked.select(tokens.columns).unionByName(new.select(tokens.columns))


def audit_rows(actions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Rows to append to the audit log, from actions (id, actor_user_id, action, resource_type, resource_id), with the actor's email and role."""
    who = users.select(F.col("id").alias("actor_user_id"), F.col("email").alias("actor_email"), F.col("role").alias("actor_role"))
    return actions.join(who, "actor_user_id", "left").select("id", "actor_user_id", "actor_email", "actor_role", "action", "resource_type", "resource_id", now.alias("created_at"))


def has_role(role: Column, *allowed: str) -> Column:
    """Whether a role stands at or above the lowest of the allowed ones."""
    levels = F.create_map(*[F.lit(x) for kv in ROLE_LEVELS.items() for x in kv])
    return F.coalesce(F.try_element_at(levels, role) >= F.lit(min(ROLE_LEVELS[x] for x in allowed)), F.lit(False))


def public_user(users: DataFrame) -> DataFrame:
    """The columns of a user that others may see."""
    return users.select("id", "email", "full_name", "role", F.coalesce("is_active", F.lit(True)).alias("is_active"), F.coalesce("must_change_password", F.lit(False)).alias("must_change_password"), "last_login_at")


def current_state(log: DataFrame, id_col: str = "id", time_col: str = "updated_at") -> DataFrame:
    """The last row of every id in an append-only log; combined in every task before the shuffle."""
    return log.groupBy(id_col).agg(F.max_by(F.struct(*log.columns), F.struct(F.col(time_col), *[F.col(c) for c in log.columns if c not in (time_col, id_col) and dict(log.dtypes)[c] in ("string", "bigint", "int")])).alias("r")).select("r.*")


def job_transition(job: DataFrame, status: str, now: Column, result: Column | None = None, error: Column | None = None) -> DataFrame:
    """The next row of a job's log: running sets started_at, an end sets finished_at."""
    if status not in JOB_STATES:
        raise ValueError(f"no job state {status}")
    changed = {"status": F.lit(status), "updated_at": now, "result": F.lit(None) if result is None else result, "error": F.lit(None).cast("string") if error is None else error}
    if status == "running":
        changed["started_at"] = now
    if status in ("succeeded", "failed"):
        changed["finished_at"] = now
    return job.withColumns(changed)  # all from the row before


def valid_password(password: Column) -> Column:
    """Ten characters at least, with a letter and a digit."""
    return (F.length(password) >= 10) & password.rlike(r"\p{L}") & password.rlike(r"(?U)\d")


def log_lines(rows: DataFrame) -> DataFrame:
    """Each row as one line of JSON."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def sessions_by_gap(events: DataFrame, gap: str, key: str = "user_id", time_col: str = "ts") -> DataFrame:
    """Extension: an event-time session window per key."""
    return events.groupBy(key, F.session_window(time_col, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def first_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of every key in an order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
