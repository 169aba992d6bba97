"""Feature budgets: how many features a fold may select, or ``all`` of them.

A budget is written as one word; ``BUDGET`` is its only definition, used for Python
values here and for columns in ``barcodes.budget_value``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

ALL = "all"
#: Group 1 is the word for everything, group 2 a count without leading zeros.
BUDGET = r"^\s*(?:([aA][lL][lL])|\+?0*([1-9][0-9]{0,8}))\s*$"


def parse_budget(value: str | int) -> int | str:
    """The count, or ``all``."""
    found = None if isinstance(value, bool) else re.match(BUDGET, str(value))
    if found is None:
        raise ValueError(f"{value!r} is no budget: write a count from 1 on, or {ALL}")
    return int(found[2]) if found[2] else ALL


def parse_budgets(values: Iterable[str | int]) -> list[int | str]:
    """The budgets in the order given; each may come once."""
    counted = Counter(map(parse_budget, values))
    twice = [str(budget) for budget, n in counted.items() if n > 1]
    if twice:
        raise ValueError(f"duplicates among the budgets: {', '.join(twice)}")
    return list(counted)
