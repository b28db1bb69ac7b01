"""repomine: mining software-repository history with Spark DataFrames."""

from repomine.plans.mining import MiningQuery, MiningTables, mine, mine_from_list
from repomine.session import build_session, configure

__all__ = [
    "MiningQuery",
    "MiningTables",
    "build_session",
    "configure",
    "mine",
    "mine_from_list",
]
