"""Who may read: status codes of a request, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions import text as T


def bearer_status(path: Column, header: Column, token: Column, exempt: tuple[str, ...] = ("/health", "/metrics")) -> Column:
    """200 below an exempt path, without a token to hold against, or with the right one; else 401."""
    free = T.any_of(*[path.startswith(p) for p in exempt])
    open_ = F.coalesce(token, F.lit("")) == ""
    right = header.eqNullSafe(F.concat(F.lit("Bearer "), token))
    return F.when(free | open_ | right, 200).otherwise(401)


def api_key_status(given: Column, expected: Column) -> Column:
    """503 while no key is set, 401 for a wrong or missing one, else 200."""
    unset = F.coalesce(expected, F.lit("")) == ""
    return F.when(unset, 503).when(given.eqNullSafe(expected), 200).otherwise(401)
