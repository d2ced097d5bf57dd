"""Python lambdas and one-expression functions as Column expressions."""

from __future__ import annotations

import ast
import inspect
import textwrap
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions import scalar

_CALLS: dict[str, Callable[..., Column]] = {
    "str": lambda x: x.cast("string"), "int": lambda x: x.cast("long"), "float": lambda x: x.cast("double"), "bool": lambda x: x.cast("boolean"), "abs": F.abs, "fabs": lambda x: F.abs(x.cast("double")), "ceil": scalar.ceil, "floor": scalar.floor, "cos": F.cos, "sin": F.sin, "tan": F.tan, "log": F.ln, "sqrt": F.sqrt, "pow": F.pow, "len": F.length, "min": F.least, "max": F.greatest, "md5": scalar.md5_long, "random": lambda: F.rand(), "workerid": F.spark_partition_id,
}
_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: scalar.divide, ast.FloorDiv: lambda a, b: F.floor(a.cast("double") / b).cast("long"), ast.Mod: scalar.mod, ast.Pow: F.pow}
_COMPARE = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}


def convert(source: str | Callable, columns: list[str | Column], udfs: dict[str, Callable[..., Column]] | None = None) -> Column:
    """The expression of a lambda or a function with one return, on the columns given as its arguments."""
    text = source if isinstance(source, str) else textwrap.dedent(inspect.getsource(source)).strip()
    start = text.find("lambda") if not text.startswith("def") else 0
    tree = None
    for end in range(len(text), start, -1):  # what follows a lambda in its line isn't part of it
        try:
            tree = ast.parse(text[start:end]).body[0]
            break
        except SyntaxError:
            continue
    if isinstance(tree, ast.FunctionDef):
        args, body = tree.args, next(s.value for s in tree.body if isinstance(s, ast.Return))
    elif isinstance(tree, ast.Expr) and isinstance(tree.value, ast.Lambda):
        args, body = tree.value.args, tree.value.body
    else:
        raise ValueError("neither a lambda nor a function")
    names = dict(zip([a.arg for a in args.args], [F.col(c) if isinstance(c, str) else c for c in columns], strict=True))
    calls = _CALLS | (udfs or {})

    def go(e: ast.expr) -> Column:
        if isinstance(e, ast.Constant):
            return F.lit(e.value)
        if isinstance(e, ast.Name):
            return names[e.id]
        if isinstance(e, ast.BinOp):
            return _BINARY[type(e.op)](go(e.left), go(e.right))
        if isinstance(e, ast.UnaryOp):
            x = go(e.operand)
            return -x if isinstance(e.op, ast.USub) else ~x if isinstance(e.op, ast.Not) else x
        if isinstance(e, ast.BoolOp):
            out = go(e.values[0])
            for v in e.values[1:]:
                out = out & go(v) if isinstance(e.op, ast.And) else out | go(v)
            return out
        if isinstance(e, ast.Compare):
            out, left = None, go(e.left)
            for op, right in zip(e.ops, e.comparators):
                right = go(right)
                one = getattr(left, _COMPARE[type(op)])(right)
                out, left = one if out is None else out & one, right
            return out
        if isinstance(e, ast.IfExp):
            return F.when(go(e.test), go(e.body)).otherwise(go(e.orelse))
        if isinstance(e, ast.Call):
            name = e.func.id if isinstance(e.func, ast.Name) else e.func.attr
            if name.lower() not in calls and name not in calls:
                raise ValueError(f"{name} has no column form")
            return calls.get(name, calls.get(name.lower()))(*map(go, e.args))
        raise ValueError(f"{type(e).__name__} has no column form")

    return go(body)
