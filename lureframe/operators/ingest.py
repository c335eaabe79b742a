"""Submissions: validation, normalisation and derived columns (one row in, one row out)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx

def clean_urls(urls):
    """Explicit URLs with blanks removed and ends stripped; never null."""
    given = F.coalesce(urls, F.expr("cast(array() as array<string>)"))
    return F.filter(F.transform(given, lambda u: tx.strip(u)), lambda u: F.coalesce(u, F.lit("")) != "")


def _optional(df: DataFrame, name: str, kind: str = "string"):
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def validate_submissions(df: DataFrame, *, max_text: int | None = None, max_urls: int | None = None,
                         max_title: int | None = None, max_label: int | None = None) -> DataFrame:
    """Cleans ``urls`` and adds ``reject_reason`` (``no_content``, else null) and ``limit_flags``.

    Limits are those of an input form: none unless given, and what exceeds one is
    flagged, never dropped.
    """
    df = df.withColumn("urls", clean_urls(F.col("urls")))
    text = F.coalesce(F.col("text"), F.lit(""))
    over = (
        (max_text, F.length(text), "text_too_long"), (max_urls, F.size("urls"), "too_many_urls"),
        (max_title, F.length(_optional(df, "title")), "title_too_long"),
        (max_label, F.length(_optional(df, "source_label")), "source_label_too_long"),
    )
    flags = [F.when(size > most, name) for most, size, name in over if most is not None]
    empty = (tx.strip(text) == "") & (F.size("urls") == 0) & _optional(df, "image_ref").isNull()
    return df.withColumns({
        "limit_flags": F.array_compact(F.array(*flags)) if flags else F.expr("cast(array() as array<string>)"),
        "reject_reason": F.when(empty, "no_content"),
    })


def combine_text(df: DataFrame) -> DataFrame:
    """``body``: normalised message text followed by normalised text read from an image."""
    ocr = tx.normalize(_optional(df, "ocr_text"))
    return df.withColumn("body", tx.strip(F.concat_ws("\n", tx.normalize(F.col("text")), ocr)))


def describe_submissions(df: DataFrame) -> DataFrame:
    """Title, preview, fingerprint and the kinds of input present."""
    return df.withColumns({
        "title": tx.derive_title(_optional(df, "title"), F.col("text")),
        "preview": tx.preview(F.col("text")),
        "fingerprint": tx.fingerprint(F.col("text")),
        "input_types": input_types(df),
    })


def input_types(df: DataFrame):
    image = _optional(df, "image_ref")
    has_text = F.col("body") != "" if "body" in df.columns else tx.normalize(F.col("text")) != ""
    return F.array_compact(F.array(
        F.when(has_text, "text"), F.when(F.size("urls") > 0, "url"), F.when(image.isNotNull(), "image"),
    ))
