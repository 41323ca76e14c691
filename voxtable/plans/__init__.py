"""Query catalogue."""

from importlib import import_module

MODULES = ("intervals", "dialogue", "gates", "context", "catalog", "reports", "media", "streams", "cues")


def load() -> None:
    """Import every query module, which fills the registry."""
    for name in MODULES:
        import_module(f"voxtable.plans.{name}")
