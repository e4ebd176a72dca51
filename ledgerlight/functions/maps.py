"""Maps and JSON: merge, lookup, and protection of sensitive values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys whose values are never stored in clear.
SENSITIVE_KEYS = (
    "password", "passwd", "pwd",
    "api_key", "apikey", "access_key", "secret_key",
    "token", "auth_token", "bearer_token",
    "private_key", "cert", "certificate",
)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def merge(base: Column | str, override: Column | str) -> Column:
    """Both maps in one; on a shared key the second wins."""
    b, o = _col(base), _col(override)
    return F.map_concat(F.map_filter(b, lambda k, _v: ~F.map_contains_key(o, k)), o)


def lookup(values: Column | str, key: str, default: str) -> Column:
    return F.coalesce(F.try_element_at(_col(values), F.lit(key)), F.lit(default))


def json_field(text: Column | str, path: str, kind: str = "string") -> Column:
    return F.get_json_object(_col(text), path).cast(kind)


def protect(values: Column | str, key: Column | str, sensitive: tuple[str, ...] = SENSITIVE_KEYS) -> Column:
    """Encrypts the non-empty values of sensitive keys (AES-GCM, base64 text)."""
    k = _col(key)
    return F.transform_values(_col(values), lambda name, v: F.when(
        F.lower(name).isin(*sensitive) & (v != ""), F.base64(F.aes_encrypt(v, k))).otherwise(v))


def reveal(values: Column | str, key: Column | str, sensitive: tuple[str, ...] = SENSITIVE_KEYS) -> Column:
    """Undoes :func:`protect`; a value that does not decrypt is returned as it is."""
    k = _col(key)
    return F.transform_values(_col(values), lambda name, v: F.when(
        F.lower(name).isin(*sensitive) & (v != ""),
        F.coalesce(F.try_aes_decrypt(F.try_to_binary(v, F.lit("base64")), k).cast("string"), v)).otherwise(v))
