"""Datalog rules over relations: `Head(x, SUM(y)) :- A(x, z), B(z, y), x > 3.`

Rules with one head are united as sets. Recursive predicates are stepped to a fixpoint; the rules'
joins are left to Catalyst's order. Constants and repeated variables become equality conditions.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans import recursion
from tidewater.plans.sqlfront import split_list

_ATOM = re.compile(r"^([A-Za-z_]\w*)(?:@[\w*]+(?:\([^)]*\))?)?\((.*)\)$", re.S)
_AGGREGATES = {"SUM": F.sum, "COUNT": F.count, "MIN": F.min, "MAX": F.max, "AVG": F.avg}


def _atom(text: str) -> tuple[str, list[str]] | None:
    m = _ATOM.match(text.strip())
    return (m[1], split_list(m[2])) if m else None


def parse(program: str) -> list[tuple[tuple[str, list[str]], list]]:
    """(head, body) of each rule; a body's items are atoms or condition texts."""
    out = []
    for rule in re.split(r"[.;]\s*(?:\n|$)", program):
        if not rule.strip():
            continue
        head, _, body = rule.partition(":-")
        out.append((_atom(head), [_atom(x) or x for x in split_list(body)]))
    return out


def _constant(term: str) -> bool:
    return bool(re.fullmatch(r"-?\d+(?:\.\d+)?|'[^']*'|\"[^\"]*\"", term))


def _renamed(condition: str, names: dict[str, str]) -> str:
    """A condition in SQL, variables by their columns; what stands in quotes stays."""
    out = []
    for part in re.split(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\")", condition):
        quoted = part[:1] in ("'", '"')
        out.append(part if quoted else re.sub(r"[A-Za-z_]\w*", lambda m: names.get(m[0], m[0]), part).replace("==", "=").replace("!=", "<>"))
    return "".join(out)


def _rule(head, body, relations: dict[str, DataFrame]) -> DataFrame:
    parts, conditions, seen = [], [], {}
    for n, item in enumerate(body):
        if isinstance(item, str):
            conditions.append(item)
            continue
        name, terms = item
        df = relations[name].toDF(*(f"t{n}_{i}" for i in range(len(terms))))
        for i, t in enumerate(terms):
            col = f"t{n}_{i}"
            if t == "_":
                continue
            if _constant(t):
                df = df.filter(F.col(col) == F.expr(t))
            elif t in seen:
                conditions.append(f"{seen[t]} = {col}")
            else:
                seen[t] = col
        parts.append(df)
    # variables that are shared, and comparisons, become conditions of one filter, from which Catalyst makes the joins
    joined = reduce(lambda a, b: a.join(b), parts)
    if conditions:
        joined = joined.filter(" AND ".join(f"({_renamed(c, seen)})" for c in conditions))
    keys, aggs, order = [], [], []
    for i, t in enumerate(head[1]):
        m = re.match(r"^(SUM|COUNT|MIN|MAX|AVG)\((.*)\)$", t, re.I)
        if m:
            arg = F.lit(1) if m[2].strip() in ("*", "") else F.col(seen[m[2].strip()])
            aggs.append(_AGGREGATES[m[1].upper()](arg).alias(f"c{i}"))
        else:
            keys.append((F.expr(t) if _constant(t) else F.col(seen[t])).alias(f"c{i}"))
        order.append(f"c{i}")
    return (joined.groupBy(*keys).agg(*aggs) if aggs else joined.select(*keys).distinct()).select(*order)


def run(spark: SparkSession, program: str, relations: dict[str, DataFrame], max_iterations: int | None = None) -> dict[str, DataFrame]:
    """All predicates that the program's heads define."""
    rules = parse(program)
    known = dict(relations)
    heads = list(dict.fromkeys(h[0] for h, _ in rules))
    uses = {n: {b[0] for h, body in rules if h[0] == n for b in body if not isinstance(b, str)} & set(heads) for n in heads}

    def reach(n: str) -> set[str]:
        out, todo = set(), list(uses[n])
        while todo:
            m = todo.pop()
            if m not in out:
                out.add(m)
                todo += uses[m]
        return out

    left = list(heads)
    while left:
        # a predicate comes once all that it uses, but for those that use it in turn, are known
        group = next(g for g in ([n, *(m for m in left if m != n and m in reach(n) and n in reach(m))] for n in left) if all(u in known or u in g for x in g for u in uses[x]))
        if not any(n in reach(n) for n in group):
            for n in group:
                known[n] = reduce(DataFrame.union, (_rule(h, b, known) for h, b in rules if h[0] == n)).distinct()
        else:
            for n in group:
                base = [_rule(h, b, known) for h, b in rules if h[0] == n and not any(not isinstance(x, str) and x[0] in group for x in b)]
                if not base:
                    raise ValueError(f"{n} has no rule without recursion")
                known[n] = recursion.settle(reduce(DataFrame.union, base).distinct())
            for _ in recursion.rounds(max_iterations):
                new = {n: recursion.settle(reduce(DataFrame.union, [known[n], *(_rule(h, b, known) for h, b in rules if h[0] == n)]).distinct()) for n in group}
                same = all(new[n].count() == known[n].count() for n in group)
                known |= new
                if same:
                    break
        left = [n for n in left if n not in group]
    return {n: known[n] for n in heads}
