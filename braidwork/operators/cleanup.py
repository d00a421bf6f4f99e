"""Removal of everything that derives from marked rows, in the order that foreign keys ask for (K6)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.operators.tables import stored


@dataclass(frozen=True)
class Reference:
    """child.column refers to parent.key. What happens to the other side when one goes:

    cascade: a child goes with any parent; with_any_child: a parent goes with any child (a group with one bad member); unless_shared: a parent
    goes once all children that refer to it go, and some do.
    """

    child: str
    column: str
    parent: str
    key: str
    rule: str = "cascade"


def order(tables: list[str], references: list[Reference]) -> list[str]:
    """The tables, parents first; deletions run the other way round. A circle among tables is an error, a table that refers to itself is not."""
    waits = {t: {r.parent for r in references if r.child == t and r.parent != t} for t in tables}
    out: list[str] = []
    while waits:
        free = sorted(t for t, w in waits.items() if w <= set(out))
        if not free:
            raise ValueError(f"tables refer to each other in a circle: {sorted(waits)}")
        out += free
        for t in free:
            del waits[t]
    return out


def cleaned(tables: dict[str, DataFrame], keys: dict[str, list[str]], marked: dict[str, DataFrame], references: list[Reference], pointers: list[Reference] = ()) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(what stays, keys of what goes), by table.

    keys: the key columns of each table; marked: keys of the rows from which removal starts. First, groups with a marked member
    go (with_any_child), then what cascades from parents to children, down the order of the tables, then parents that nobody shares
    (unless_shared). pointers: columns of a table that refer to its own key; a row to which a staying row points stays. That
    comes last and is not passed on, as it only makes removal more careful. Equi-joins on keys; each table's keys are
    written once, so no plan holds the whole chain.
    """
    line = order(list(tables), references)
    gone = {t: stored(marked[t].select(*keys[t]).distinct(), f"gone-{t}") if t in marked else tables[t].select(*keys[t]).limit(0) for t in line}

    def add(t: str, rows: DataFrame) -> None:
        gone[t] = stored(gone[t].union(rows.select(*keys[t])).distinct(), f"gone-{t}")

    for r in references:
        if r.rule == "with_any_child":
            hit = tables[r.child].join(gone[r.child], keys[r.child], "left_semi").select(F.col(r.column).alias(r.key)).distinct()
            add(r.parent, tables[r.parent].join(hit, r.key, "left_semi"))
    for t in line:
        for r in references:
            if r.child == t and r.rule in ("cascade", "with_any_child"):
                up = tables[r.parent].join(gone[r.parent], keys[r.parent], "left_semi").select(F.col(r.key).alias(r.column)).distinct()
                add(t, tables[t].join(up, r.column, "left_semi"))
    for t in reversed(line):
        for r in references:
            if r.parent == t and r.rule == "unless_shared":
                child = tables[r.child]
                used = child.join(gone[r.child], keys[r.child], "left_anti").select(F.col(r.column).alias(r.key)).distinct()
                was = child.join(gone[r.child], keys[r.child], "left_semi").select(F.col(r.column).alias(r.key)).distinct()
                add(t, tables[t].join(was, r.key, "left_semi").join(used, r.key, "left_anti"))
    for r in pointers:
        t = r.parent
        staying = tables[t].join(gone[t], keys[t], "left_anti").select(F.col(r.column).alias(r.key)).where(F.col(r.key).isNotNull()).distinct()
        held = tables[t].join(staying, r.key, "left_semi").select(*keys[t])
        gone[t] = stored(gone[t].join(held, keys[t], "left_anti"), f"gone-{t}")
    return {t: tables[t].join(gone[t], keys[t], "left_anti") for t in line}, gone
