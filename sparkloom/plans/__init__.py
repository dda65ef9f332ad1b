"""Named queries over the driver tables, by theme."""

from sparkloom.plans import battery, composites, evaluation, modelling, storage, tables
from sparkloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "battery", "composites", "evaluation", "modelling", "storage", "tables"]
