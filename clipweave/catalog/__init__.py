"""Registered queries; importing the modules fills the registry."""

from __future__ import annotations

import importlib
from types import ModuleType

from clipweave.catalog import registry

MODULES = ["timelines", "voices", "clipsets", "states", "sounds", "trainsets", "writings", "streams"]


def load() -> ModuleType:
    for name in MODULES:
        importlib.import_module(f"clipweave.catalog.{name}")
    return registry
