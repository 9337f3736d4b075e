"""Memory entries: parse model output, fill defaults, turn payloads into stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memoloom.functions import jsons
from memoloom.functions.scopes import column_or, user_scope
from memoloom.functions.columns import col
from memoloom.functions.text import strip, unfence
from memoloom.schemas import DEFAULT_CATEGORY, GLOBAL_SCOPE, IMPORTANCE_EXTRACTED

ENTRY_TYPE = "struct<text:string,category:string,scope:string,importance:double,metadata:string>"
ENTRIES_TYPE = f"array<{ENTRY_TYPE}>"


def entry(text, category, scope, importance, metadata) -> Column:
    """One entry struct in the shape of ENTRY_TYPE."""
    return F.struct(
        text.alias("text"),
        category.alias("category"),
        scope.alias("scope"),
        importance.cast("double").alias("importance"),
        metadata.alias("metadata"),
    ).cast(ENTRY_TYPE)


def parse_entries(reply: Column | str, path: Column | str, user: Column | str | None = None) -> Column:
    """Entries of a model reply: an optionally fenced JSON array of objects, [] for anything else.

    Every entry's metadata receives the source path, and its scope is the user's when one is given.
    """
    path = col(path)
    found = jsons.objects(jsons.parse(unfence(reply)))

    def build(e: Column) -> Column:
        given = jsons.metadata_map(jsons.field(e, "metadata", "variant"))
        metadata = F.to_json(jsons.with_overrides(given, jsons.string_map({"source_path": path})))
        scope = jsons.field(e, "scope")
        if user is not None:
            owner = col(user)
            scope = F.when(F.coalesce(owner, F.lit("")) != "", user_scope(owner)).otherwise(scope)
        return entry(
            jsons.field(e, "text"),
            jsons.field(e, "category"),
            scope,
            jsons.field(e, "importance", "double"),
            metadata,
        )

    return F.coalesce(F.transform(found, build), F.array().cast(ENTRIES_TYPE))


def normalize_entries(df: DataFrame) -> DataFrame:
    """Fill the defaults of extracted entries and drop those without text. Missing columns count as null."""
    filled = df.withColumns(
        {
            "text": strip(F.coalesce(column_or(df, "text"), F.lit(""))),
            "category": F.coalesce(column_or(df, "category"), F.lit(DEFAULT_CATEGORY)),
            "scope": F.coalesce(column_or(df, "scope"), F.lit(GLOBAL_SCOPE)),
            "importance": F.coalesce(
                column_or(df, "importance").try_cast("double"), F.lit(IMPORTANCE_EXTRACTED)
            ),
            "metadata": F.coalesce(column_or(df, "metadata"), F.lit("{}")),
        }
    )
    return filled.where(F.col("text") != "")


def flatten_entries(df: DataFrame, entries: str = "entries", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per entry; null and empty lists leave no row."""
    # the outer explode infers no filter that would compute the list again
    rows = df.select(*keep, F.explode_outer(entries).alias("_entry")).where("_entry is not null")
    return rows.select(*keep, "_entry.*")


def content_id(*parts: Column) -> Column:
    """Identifier in UUID form made from the given columns: the same content always gets the same id."""
    parts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    digest = F.md5(F.concat_ws("\x1f", *parts).cast("binary"))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, length) for start, length in cuts])


def epoch_millis(value: Column | str) -> Column:
    """Milliseconds from a number, a numeric string or a date string; null when it is none of them."""
    text = col(value).cast("string")
    return F.coalesce(text.try_cast("bigint"), F.unix_millis(text.try_cast("timestamp")))


def materialize(
    df: DataFrame, now_ms: int, id_parts: tuple[str, ...] = ("source_path", "position", "text")
) -> DataFrame:
    """Payload rows as stored rows; blank text is an error.

    `now_ms` is a parameter and ids come from the content, so a recomputed partition yields equal rows.
    """
    given_time = epoch_millis(column_or(df, "timestamp"))
    timestamp = F.when(given_time > 0, given_time).otherwise(F.lit(now_ms).cast("bigint"))
    identity = content_id(*[column_or(df, name) for name in id_parts])
    text = strip("text")
    return df.withColumns(
        {
            "id": F.coalesce(F.nullif(column_or(df, "id"), F.lit("")), identity),
            "text": F.when(F.coalesce(text, F.lit("")) == "", F.raise_error(F.lit("memory text must not be blank")))
            .otherwise(text),
            "category": F.coalesce(column_or(df, "category"), F.lit(DEFAULT_CATEGORY)),
            "scope": F.coalesce(F.nullif(column_or(df, "scope"), F.lit("")), F.lit(GLOBAL_SCOPE)),
            "importance": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("importance").cast("double"))),
            "metadata": F.coalesce(column_or(df, "metadata"), F.lit("{}")),
            "timestamp": timestamp,
            "createdAt": timestamp,
        }
    )
