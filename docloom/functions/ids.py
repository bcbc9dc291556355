"""Content hashes, ingest keys and chunk ids as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def content_hash(content: Column) -> Column:
    """SHA-256 of text (UTF-8) or bytes, in lower-case hex."""
    return F.sha2(content, 256)


def ingest_key(hash_: Column, uri: Column, version: Column, tenant: Column | None = None) -> Column:
    """SHA-256 over hash|uri|version, and |tenant if there is one; an empty tenant is none."""
    parts = [hash_, uri, version] + ([F.nullif(tenant, F.lit(""))] if tenant is not None else [])
    return F.sha2(F.concat_ws("|", *parts), 256)


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The name-based UUID (version 5) of a string."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12)
    )


def chunk_id_by_hash(key: Column, chunk_hash: Column) -> Column:
    """Tables, PDF and forms: uuid5 of key:hash."""
    return uuid5(F.concat(key, F.lit(":"), chunk_hash))


def chunk_id_by_index(key: Column, index: Column) -> Column:
    """JSON, XML and text formats: uuid5 of key:index."""
    return uuid5(F.concat(key, F.lit(":"), index.cast("string")))


def chunk_id_short(key: Column, chunk_hash: Column) -> Column:
    """E-mail: sixteen digits of each."""
    return F.concat(F.substring(key, 1, 16), F.lit("_"), F.substring(chunk_hash, 1, 16))


def chunk_id_random() -> Column:
    """Images: not idempotent."""
    return F.uuid()


def extraction_key(key: Column, template: Column, version: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, template, version.cast("string")), 256)
