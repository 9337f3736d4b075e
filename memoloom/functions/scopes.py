"""Users and scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memoloom.functions.columns import col
from memoloom.schemas import GLOBAL_SCOPE, USER_SCOPE_PREFIX


def user_scope(user: Column | str) -> Column:
    """`user:{id}`, or the global scope for a null or empty user."""
    user = col(user)
    return F.when(F.coalesce(user, F.lit("")) == "", F.lit(GLOBAL_SCOPE)).otherwise(
        F.concat(F.lit(USER_SCOPE_PREFIX), user)
    )


def visible_scopes(user: Column | str) -> Column:
    """Scopes a query of this user may read; null (no restriction) without a user."""
    user = col(user)
    return F.when(
        F.coalesce(user, F.lit("")) != "",
        F.array(F.lit(GLOBAL_SCOPE), F.concat(F.lit(USER_SCOPE_PREFIX), user)),
    )


def filter_scope(df: DataFrame, user: str | None, scope: str = "scope") -> DataFrame:
    """Rows a given user may see: global ones and the user's own. Without a user, every row."""
    if not user:
        return df
    return df.where(F.col(scope).isin(GLOBAL_SCOPE, USER_SCOPE_PREFIX + user))


def sample_user(sample: Column | str, override: str | None = None, prefix: str = "user_") -> Column:
    """The user a sample belongs to: the override when given, else prefix and sample number."""
    if override:
        return F.lit(override)
    return F.concat(F.lit(prefix), col(sample).cast("string"))


def session_path(user: Column | str, session: Column | str, root: str = "sessions") -> Column:
    return F.concat_ws("/", F.lit(root), col(user), col(session))


def path_user(path: Column | str) -> Column:
    """Stand-in user of a path for agent ingest."""
    return F.concat(F.lit("user_"), F.substring(F.md5(col(path).cast("binary")), 1, 8))


def column_or(df: DataFrame, name: str, default=None, as_type: str = "string") -> Column:
    """The column when the frame has it, else a typed constant."""
    return F.col(name) if name in df.columns else F.lit(default).cast(as_type)


def infer_category(path: Column | str) -> Column:
    """Category of a memory file by where it lies; the first matching rule wins."""
    path = col(path)
    name = F.lower(F.substring_index(path, "/", -1))
    return (
        F.when(path.contains("/preferences/") | name.startswith("profile"), F.lit("preference"))
        .when(path.contains("/events/"), F.lit("fact"))
        .when(path.contains("/entities/"), F.lit("entity"))
        .otherwise(F.lit("other"))
    )
