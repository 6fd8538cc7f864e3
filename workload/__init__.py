"""Queries over the driver's tables, one or more per operator, with their SQL."""

from importlib import import_module

GROUPS = ("ranking", "signals", "intervals", "spans", "annotate", "music", "ingest", "timeline", "catalogue", "drafts", "routes", "streaming")


def _load():
    for g in GROUPS:
        import_module(f".{g}", __name__)
    return import_module(".registry", __name__)


def queries():
    return dict(_load().QUERIES)


def oracles():
    return dict(_load().ORACLES)
