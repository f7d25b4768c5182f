"""Byte-compatible event hash for chains written by the original Python
logger (``hash_version = 1``).

That logger hashed ``json.dumps(event, sort_keys=True, default=str)`` of a
dict with the keys event_id, event_type, timestamp (``str(datetime)``),
actor, action, resource, details, previous_hash. Reproducing Python's JSON
text (separators, ASCII escaping, float repr) needs Python, so this is an
Arrow-batched pandas UDF: one ``json`` round trip and one SHA-256 per row,
run in parallel across partitions. The default chain format (v2, see
``operators/audit.py``) needs no Python at all.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def python_timestamp_text(ts: Column) -> Column:
    """``str(datetime)`` of an aware UTC timestamp: microseconds only when
    non-zero, then ``+00:00``."""
    micros = F.unix_micros(ts.cast("timestamp")) % 1000000
    base = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return F.concat(base, F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
                    .otherwise(F.lit("")), F.lit("+00:00"))


def _make_reference_event_hash():
    """Build the UDF from a closure so it is shipped to the Python workers by
    value: workers need pandas, but not this package on their path."""
    def hash_one(event_id, event_type, ts_text, actor, action, resource, details, previous_hash) -> str:
        import hashlib
        import json
        payload = {
            "event_id": event_id, "event_type": event_type, "timestamp": ts_text, "actor": actor,
            "action": action, "resource": resource,
            "details": json.loads(details) if details else {},
            "previous_hash": previous_hash,
        }
        return hashlib.sha256(json.dumps(payload, sort_keys=True, default=str).encode()).hexdigest()

    def hash_batch(event_id: pd.Series, event_type: pd.Series, ts_text: pd.Series, actor: pd.Series,
                   action: pd.Series, resource: pd.Series, details: pd.Series,
                   previous_hash: pd.Series) -> pd.Series:
        return pd.Series([hash_one(*row) for row in zip(event_id, event_type, ts_text, actor, action, resource,
                                                        details, previous_hash)], dtype=object)

    return F.pandas_udf(hash_batch, T.StringType())


reference_event_hash = _make_reference_event_hash()
