"""All registered queries."""

from tallyforge.checks import files, imports, ledger, planning, text  # noqa: F401
from tallyforge.checks.registry import ORACLES, QUERIES  # noqa: F401
