"""Query modules; importing one registers its queries."""

import importlib

MODULES = ["data_problems", "relational", "temporal", "lifecycle", "advanced", "flows", "composites", "signals"]


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
