"""shoebox: media library analytics as Spark jobs.

Names are looked up when first asked for: a worker that needs one module of the package does not load the others.
"""

from importlib import import_module

_WHERE = {
    "Library": "plans.ingest",
    "ingest_file": "plans.ingest",
    "ingest_paths": "plans.ingest",
    "library_stats": "operators.stats",
    "mark_missing": "plans.ingest",
    "more_like_this": "operators.search",
    "recover": "plans.ingest",
    "search": "operators.search",
    "search_batch": "operators.search",
    "search_text": "plans.ingest",
    "statistics": "plans.ingest",
    "sync_folder": "plans.ingest",
    "watch_changes": "streaming.watch",
    "watch_folder": "streaming.watch",
}

__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)
