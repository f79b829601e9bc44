"""Every query of the library with its SQL twin."""

from importlib import import_module

SECTIONS = ["shaping", "scans", "tables", "clusters", "models"]


def load() -> None:
    """Import all sections, which registers their queries."""
    for section in SECTIONS:
        import_module(f"waveline.catalog.{section}")
