"""All registered queries, grouped by area."""

from importlib import import_module

from .registry import ORACLE, QUERIES

MODULES = ["series", "intervals", "matching", "assembly", "records", "season", "reports", "sources"]

for _m in MODULES:
    import_module(f"{__name__}.{_m}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
