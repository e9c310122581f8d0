"""The subpackage's queries and the SQL for those that SQL can express."""

from __future__ import annotations

import importlib
import pkgutil

import priorweave.llm as _package

QUERIES, ORACLES = {}, {}
for _m in pkgutil.iter_modules(_package.__path__):
    if _m.name != "queries":
        _module = importlib.import_module(f"priorweave.llm.{_m.name}")
        for _name, _f in vars(_module).items():
            if _name.startswith("op") and _name[2:3].isdigit():
                QUERIES[_name] = _f
                if _name in getattr(_module, "ORACLE_SQL", {}):
                    ORACLES[_name] = _module.ORACLE_SQL[_name]
