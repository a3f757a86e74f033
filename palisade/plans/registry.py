"""All registered queries and oracles."""

from __future__ import annotations

from palisade.plans import (
    config_queries, detect_queries, feed_queries, governance_queries, log_queries, stream_queries,
)

MODULES = [log_queries, detect_queries, feed_queries, governance_queries, config_queries, stream_queries]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for module in MODULES:
        for name, value in getattr(module, attribute).items():
            if name in out:
                raise ValueError(f"query registered twice: {name}")
            out[name] = value
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict[str, str]:
    return _merged("ORACLES")
