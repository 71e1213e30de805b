"""The comparison metrics from their definitions, over multisets of typed cells, for checking the Spark job.

A result is a list of rows of Python values. Cells are compared with their
type (numbers and booleans by value, text as text, null as null); a row is
compared as the multiset of its cells, so column order does not count.
"""

from collections import Counter
from fractions import Fraction


def typed(cell):
    kind = "null" if cell is None else "number" if isinstance(cell, (bool, int, float)) else "text"
    return kind, None if cell is None else float(cell) if kind == "number" else str(cell)


def bag(row):
    return frozenset(Counter(map(typed, row)).items())


def cells(result):
    return {typed(c) for row in result for c in row}


def share(part, whole):
    return round(part / whole, 3)


def places(result, common):
    """Rank of each common row by the first place at which it stands in the result."""
    first = {}
    for place, row in enumerate(result):
        first.setdefault(tuple(map(typed, row)), place)
    order = sorted(common, key=first.__getitem__)
    return {row: rank for rank, row in enumerate(order)}


def order_agreement(t, p):
    common = {tuple(map(typed, r)) for r in t} & {tuple(map(typed, r)) for r in p}
    if not common:
        return 0.5  # no correlation, mapped from [-1, 1] to [0, 1]
    here, there = places(t, common), places(p, common)
    gaps = sum((here[r] - there[r]) ** 2 for r in common)
    n = 2 if len(common) == 1 else len(common)
    rho = Fraction(1) - Fraction(6 * gaps, n * (n * n - 1))
    return (round(float(rho), 3) + 1) / 2


def accuracy(t, p):
    return 1.0 if len(t) == len(p) and set(map(bag, t)) == set(map(bag, p)) else 0.0


def constraint(t, p):
    there = Counter(map(bag, p))
    wanted = Counter(map(bag, t))
    return share(len([r for r in wanted if there[r] == wanted[r]]), len(wanted))


DEFINED = {
    "cell_precision": lambda t, p: share(len(cells(t) & cells(p)), len(cells(p))),
    "cell_recall": lambda t, p: share(len(cells(t) & cells(p)), len(cells(t))),
    "tuple_cardinality": lambda t, p: share(*sorted((len(t), len(p)))),
    "tuple_constraint": constraint,
    "tuple_order": order_agreement,
    "execution_accuracy": accuracy,
}


def value(metric, t, p):
    """A metric of a target and a prediction; two empty results agree, one empty result agrees in nothing."""
    if not t or not p:
        return float(len(t) == len(p))
    return DEFINED[metric](t, p)
