"""What of a payload may leave the host: allowed keys at the top, no forbidden key at any depth."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def normalized_key(key: str) -> str:
    return re.sub(r"[\s-]+", "_", key.strip().casefold())


def _stripped(value: object, forbidden: frozenset[str]) -> object:
    if isinstance(value, dict):
        return {k: _stripped(v, forbidden) for k, v in value.items() if normalized_key(k) not in forbidden}
    return [_stripped(v, forbidden) for v in value] if isinstance(value, list) else value


def _projected(text: str | None, allowed: dict[str, list[str] | None] | None, forbidden: frozenset[str]) -> str | None:
    try:
        payload = json.loads(text) if text is not None else None
        if allowed is not None:
            payload = {k: payload[k] for k in allowed if k in payload} if isinstance(payload, dict) else None
            for k, below in allowed.items():
                if below is not None and payload and isinstance(payload.get(k), dict):
                    payload[k] = {x: payload[k][x] for x in below if x in payload[k]}
        return None if payload is None else json.dumps(_stripped(payload, forbidden), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


#: Keys of a profile that may leave the host, with those below them where not all may.
PROFILE = {k: fixed.LOCATION_KEYS if k == "location" else None for k in fixed.PROFILE_KEYS}


def outbound(allowed: dict[str, list[str] | None] | None = PROFILE, forbidden: list[str] | None = None) -> Callable[[Column], Column]:
    """A function of a JSON payload: the payload with the allowed keys only, in the order in which they are allowed (None: all
    keys, in their own order), and without any forbidden key, however deep and in whatever spelling: case does not count,
    and spaces and hyphens are underscores. What is no JSON, or is nested too deep to be read, gives null, so that
    nothing leaves unread; so does what is no object if keys are allowed.

    Objects of any depth are rebuilt, which no built-in function does; the payloads go through Arrow batches."""
    out = frozenset(fixed.FORBIDDEN_KEYS if forbidden is None else forbidden)

    @F.pandas_udf("string")
    def strip(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda x: _projected(x, allowed, out))

    return lambda payload: strip(payload)
