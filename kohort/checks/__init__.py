"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from kohort.checks.base import REGISTRY  # noqa: F401
from kohort.checks import cleaning, clusters, contracts, explore, names, profiles, scalars, tables, texts  # noqa: F401,E402
