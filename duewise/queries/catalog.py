"""All registered queries. Importing the modules registers them."""

from duewise.queries import decisions, experiment, features, lifecycle, modelling, models, retrieval, stored  # noqa: F401
from duewise.queries.registry import SPECS


def all_queries():
    return {k: s.run for k, s in sorted(SPECS.items())}


def all_oracles():
    return {k: s.oracle for k, s in sorted(SPECS.items()) if s.oracle}
