"""Named queries: an operator applied to tables, with the same question as SQL where SQL can put it."""

import importlib

MODULES = ("problems", "flow", "temporal", "graph", "geography", "panels", "relations", "basics", "studies", "queues")


def load_registry():
    """The registry with all queries of this package."""
    for m in MODULES:
        importlib.import_module(f"flowquarry.plans.{m}")
    from flowquarry.plans.registry import REGISTRY

    return REGISTRY
