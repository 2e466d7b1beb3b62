"""Stable keys, hashes and the texts that are hashed, embedded or reranked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_id(doc_id: Column, page: Column, path: Column, text: Column) -> Column:
    digest = F.sha1(F.concat_ws("|", doc_id, F.array_join(path, "|"), text).cast("binary"))
    return F.concat(
        doc_id, F.lit(":p"), F.lpad(page.cast("string"), 4, "0"), F.lit(":"), F.substring(digest, 1, 12)
    )


def content_hash(model: str, text: Column) -> Column:
    return F.sha1(F.concat(F.lit(model + "\n"), text).cast("binary"))


def point_id(key: Column) -> Column:
    """Same key, same row: identity is all that matters."""
    return F.sha1(key.cast("binary"))


def embedding_text(title: Column, path: Column, text: Column) -> Column:
    context = F.array_join(F.concat(F.array(title), path), " > ")
    return F.concat(context, F.lit("\n"), text)


def indexed_text(path: Column, text: Column) -> Column:
    return F.concat(F.array_join(path, " "), F.lit("\n"), text)


def passage_text(path: Column, text: Column) -> Column:
    return F.when(
        F.size(path) > 0, F.concat(F.array_join(path, " > "), F.lit("\n"), text)
    ).otherwise(text)


def draw(*parts: Column | str | int) -> Column:
    """A 32-bit draw that depends only on its parts: the same on every partition and engine."""
    text = F.concat_ws(
        "|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    )
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
