"""Queries of the library by name, and their SQL."""

from .catalogue import QUERIES as CATALOGUE, SQL as CATALOGUE_SQL
from .cycles import QUERIES as CYCLES, SQL as CYCLES_SQL
from .feeds import QUERIES as FEEDS, SQL as FEEDS_SQL
from .names import QUERIES as NAMES, SQL as NAMES_SQL
from .rankings import QUERIES as RANKINGS, SQL as RANKINGS_SQL
from .relational import QUERIES as RELATIONAL, SQL as RELATIONAL_SQL
from .structures import QUERIES as STRUCTURES, SQL as STRUCTURES_SQL
from .upkeep import QUERIES as UPKEEP, SQL as UPKEEP_SQL

QUERIES = FEEDS | NAMES | RELATIONAL | UPKEEP | CYCLES | RANKINGS | STRUCTURES | CATALOGUE
SQL = FEEDS_SQL | NAMES_SQL | RELATIONAL_SQL | UPKEEP_SQL | CYCLES_SQL | RANKINGS_SQL | STRUCTURES_SQL | CATALOGUE_SQL
