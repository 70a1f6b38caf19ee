"""Administration: dashboards, roles, settings and access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import AVATARS, SPEAKERS, py_strip


def owned(notebooks: DataFrame, user_id: Column) -> DataFrame:
    """A user's notebooks; any others do not exist for the user."""
    return notebooks.where(F.col("user_id") == user_id)


def dashboard(users: DataFrame, notebooks: DataFrame, sources: DataFrame) -> DataFrame:
    """Notebooks and sources of each user, zeros included.

    Sources are counted by notebook and notebooks by user before the joins, so each
    join meets one row for a key.
    """
    per_notebook = sources.groupBy("notebook_id").agg(F.count("*").alias("n"))
    per_user = notebooks.join(per_notebook, notebooks["id"] == per_notebook["notebook_id"], "left").groupBy("user_id").agg(F.count("*").alias("n_notebooks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_sources"))
    joined = users.join(per_user, users["id"] == per_user["user_id"], "left").drop("user_id")
    return joined.fillna(0, ["n_notebooks", "n_sources"])


def source_counts(sources: DataFrame, cap: int = 50, notebook: str = "notebook_id") -> DataFrame:
    return sources.groupBy(notebook).agg(F.count("*").alias("n_sources")).withColumn("at_cap", F.col("n_sources") >= cap)


def disabled(role: Column) -> Column:
    """The role after disabling: administrators stay."""
    return F.when(role == "admin", role).otherwise("disabled")


def enabled(role: Column) -> Column:
    return F.when(role == "disabled", "user").otherwise(role)


def may_sign_in(role: Column) -> Column:
    return ~role.eqNullSafe(F.lit("disabled"))


def valid_name(name: Column) -> Column:
    return F.length(name).between(1, 120)


def valid_password(password: Column) -> Column:
    return F.length(password).between(8, 256)


def chosen_setting(wanted: Column, current: Column, kind: str) -> Column:
    """The wanted avatar or speaker if it is on the list, else the current one."""
    wanted = py_strip(wanted)
    return F.when(wanted.isin(*(AVATARS if kind == "avatar" else SPEAKERS)), wanted).otherwise(current)


def listed_sources(sources: DataFrame) -> DataFrame:
    """The eight fields that a list of sources shows, the time in ISO form, to the microsecond if it has any."""
    time = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(F.col("created_at").cast("timestamp")) % 1_000_000
    shown = F.when(micros != 0, F.concat(time, F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(time)
    return sources.select("id", "filename", "content_type", "status", "char_count", "page_count", "error_message", shown.alias("created_at"))


def listed_users(users: DataFrame) -> DataFrame:
    """Users without their passwords, oldest first."""
    return users.drop("password_hash").orderBy("created_at", "id")


def newest_first(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("created_at"), F.desc("id"))
