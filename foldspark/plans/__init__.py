"""Registered queries: derived views, plans over them and their oracles."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every query module so that it registers its queries."""
    for m in pkgutil.iter_modules(__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{m.name}")
