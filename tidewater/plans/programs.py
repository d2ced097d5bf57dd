"""The imperative relational language: statements over relations, compiled to Spark SQL.

A program's statements bind names to DataFrames. Scalar expressions, comprehensions and SELECTs are
parsed here and written as Spark SQL over temporary views, so that Catalyst optimises each relation
as a whole; loops run on the driver with their state checkpointed.

Conventions: `/` is a double division, `//` truncates, `%` has the divisor's sign; SUM of nothing is
0, STDEV is of the population; with any aggregate all other emits are group keys; UNION, INTERSECT
and DIFF are of sets, UNIONALL and `+` of bags. Applied (stateful) functions and UDAs fold rows in
the order of all their columns, within one task for each group.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans import recursion
from tidewater.sources import io

_LEX = re.compile(r"(?P<space>\s+|--[^\n]*)|(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<id>[A-Za-z_]\w*)|(?P<op><-|==|!=|<>|<=|>=|//|[≤≥≠]|[-+*/%=<>(){}\[\],;:.$])", re.S)
_TYPES = {"int": "BIGINT", "long": "BIGINT", "float": "DOUBLE", "double": "DOUBLE", "string": "STRING", "boolean": "BOOLEAN", "blob": "BINARY", "datetime": "TIMESTAMP_NTZ"}
_COMPARE = {"==": "=", "=": "=", "!=": "<>", "<>": "<>", "≠": "<>", "<": "<", ">": ">", "<=": "<=", "≤": "<=", ">=": ">=", "≥": ">="}
_AGGREGATES = {"sum", "avg", "min", "max", "count", "countall", "stdev", "lexmin"}
_RELATIONAL = {"scan", "samplescan", "load", "empty", "limit", "distinct", "countall", "union", "intersect", "diff", "unionall", "cross", "join"}
#: Function templates; arguments are written in for {0}, {1}, ...
_FUNCTIONS = {
    "abs": "ABS({0})", "ceil": "CAST(CEIL({0}) AS DOUBLE)", "floor": "CAST(FLOOR({0}) AS DOUBLE)", "cos": "COS({0})", "sin": "SIN({0})", "tan": "TAN({0})", "log": "LN({0})", "sqrt": "SQRT({0})", "pow": "POWER({0}, {1})", "len": "LENGTH({0})", "substr": "SUBSTRING({0}, {1} + 1, {2} - {1})", "byterange": "SUBSTRING({0}, {1} + 1, {2} - {1})", "concat": "CONCAT({0}, {1})",
    "lesser": "LEAST({0}, {1})", "greater": "GREATEST({0}, {1})", "year": "CAST(YEAR(CAST({0} AS DATE)) AS BIGINT)", "month": "CAST(MONTH(CAST({0} AS DATE)) AS BIGINT)", "day": "CAST(DAY(CAST({0} AS DATE)) AS BIGINT)", "head": "LEFT({0}, {1})", "tail": "RIGHT({0}, {1})", "md5": "CAST(CONV(SUBSTRING(MD5(CAST({0} AS STRING)), 1, 16), 16, 10) AS DECIMAL(20, 0))", "random": "RAND()", "worker_id": "SPARK_PARTITION_ID()", "flip": "(RAND() < {0})",
    "split": "EXPLODE(SPLIT({0}, CONCAT('\\\\Q', {1}, '\\\\E')))", "sequence": "EXPLODE(CASE WHEN {0} > 0 THEN SEQUENCE(0L, CAST({0} AS BIGINT) - 1) END)", "ngram": "EXPLODE(CASE WHEN LENGTH({0}) >= {1} THEN TRANSFORM(SEQUENCE(1, LENGTH({0}) - CAST({1} AS INT) + 1), i_ -> SUBSTRING({0}, i_, CAST({1} AS INT))) END)", "theansweristolifetheuniverseandeverything": "42",
}


class LanguageError(ValueError):
    pass


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise LanguageError(f"unexpected character {text[at]!r}")
            at = m.end()
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
        self.at = 0

    def peek(self, *values: str, ahead: int = 0) -> bool:
        i = self.at + ahead
        return i < len(self.tokens) and self.tokens[i][0] != "str" and self.tokens[i][1].lower() in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, *values: str) -> str:
        if not self.peek(*values):
            got = self.tokens[self.at][1] if self.at < len(self.tokens) else "the end"
            raise LanguageError(f"expected {' or '.join(values)}, got {got!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def kind(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i][0] if i < len(self.tokens) else "end"

    def next(self, kind: str) -> str:
        if self.kind() != kind:
            raise LanguageError(f"expected {kind}, got {self.tokens[self.at][1] if self.at < len(self.tokens) else 'the end'!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def name(self) -> str:
        return self.next("id")

    def text(self) -> str:
        return re.sub(r"\\(.)", r"\1", self.next("str")[1:-1], flags=re.S)

    def many(self, item, end: str) -> list:
        out = []
        if self.take(end):
            return out
        while True:
            out.append(item())
            if self.take(end):
                return out
            self.need(",")

    # Statements ------------------------------------------------------------------------------------

    def program(self, until: tuple[str, ...] = ()) -> list:
        out = []
        while self.at < len(self.tokens) and not self.peek(*until):
            out.append(self.statement())
        return out

    def statement(self):
        if self.take("def"):
            name = self.name()
            self.need("(")
            args = self.many(self.name, ")")
            self.need(":")
            body = self.emits_in_brackets() if self.take("[") else [(None, self.expr())]
            self.need(";")
            return ("def", name.lower(), args, body)
        if self.take("const"):
            name = self.name()
            self.need(":")
            value = self.expr()
            self.need(";")
            return ("const", name, value)
        if self.peek("uda", "apply") and self.kind(1) == "id":
            kind = self.name().lower()
            name = self.name()
            self.need("(")
            args = self.many(self.name, ")")
            self.need("{")
            self.need("[")
            init = self.emits_in_brackets()
            self.need(";")
            self.need("[")
            update = self.many(self.expr, "]")
            self.need(";")
            emit = self.many(self.expr, ";") if not self.take("[") else self.many(self.expr, "]")
            self.take(";")
            self.need("}")
            self.need(";")
            return (kind, name.lower(), args, init, update, emit)
        if self.take("do"):
            body = self.program(("while", "until"))
            if self.take("while"):
                cond = self.expr()
                self.need(";")
                return ("while", body, cond)
            self.need("until")
            self.need("convergence")
            while not self.take(";"):
                self.at += 1  # SYNC, ASYNC and pull orders don't change results
            return ("converge", body)
        if self.peek("store", "sink", "dump", "export") and self.peek("(", ahead=1):
            kind = self.name().lower()
            self.need("(")
            rel, key, parts = self.name(), None, None
            if self.take(","):
                key = self.text() if self.kind() == "str" else self.key()
                if self.take(","):
                    parts = self.expr() if not self.take("[") else self.many(self.expr, "]")
            self.need(")")
            self.need(";")
            return (kind, rel, key, parts)
        name = self.name()
        self.need("=")
        if self.peek("[") and self._arrow():
            self.need("[")
            emits = self.emits_in_brackets()
            self.need("<-")
            value = self.relation()
            self.need(";")
            return ("idb", name, emits, value)
        value = self.relation()
        self.need(";")
        return ("let", name, value)

    def _arrow(self) -> bool:
        depth = 0
        for i in range(self.at, len(self.tokens)):
            v = self.tokens[i][1]
            depth += (v == "[") - (v == "]")
            if depth == 0:
                return i + 1 < len(self.tokens) and self.tokens[i + 1][1] == "<-"
        return False

    def key(self) -> str:
        parts = [self.name()]
        while self.take(":"):
            parts.append(self.name())
        return ":".join(parts)

    # Relations -------------------------------------------------------------------------------------

    def relation(self):
        out = self.relation_term()
        while self.take("+"):
            out = ("unionall", [out, self.relation_term()])
        return out

    def relation_term(self):
        if self.take("("):
            out = self.relation()
            self.need(")")
            return out
        if self.take("["):
            if self.take("from"):
                return self.comprehension()
            return ("literal", self.emits_in_brackets())
        if self.peek("select"):
            return self.select()
        if self.kind() == "id" and self.peek("(", ahead=1) and self.tokens[self.at][1].lower() in _RELATIONAL:
            f = self.name().lower()
            self.need("(")
            if f == "scan":
                out = ("scan", self.key())
            elif f == "samplescan":
                key = self.key()
                self.need(",")
                n = int(self.next("num"))
                pct = self.take("%")
                how = self.name().lower() if self.take(",") else "wr"
                out = ("sample", key, n, pct, how)
            elif f == "load":
                path = self.text()
                self.need(",")
                parser = self.name().lower()
                self.need("(")
                schema, options = [], {}
                while not self.take(")"):
                    option = self.name().lower()
                    if option == "schema":
                        self.need("(")
                        schema = self.many(self.column_def, ")")
                    else:
                        self.need("=")
                        options[option] = int(self.next("num")) if self.kind() == "num" else self.text()
                    self.take(",")
                out = ("load", path, parser, schema, options)
            elif f == "empty":
                return ("empty", self.many(self.column_def, ")"))
            elif f == "limit":
                inner = self.relation()
                self.need(",")
                out = ("limit", inner, int(self.next("num")))
            elif f in ("distinct", "countall"):
                out = (f, self.relation())
            elif f == "join":
                a = self.relation()
                self.need(",")
                left = self.refs()
                self.need(",")
                b = self.relation()
                self.need(",")
                out = ("join", a, left, b, self.refs())
            else:
                return (f, self.many(self.relation, ")"))
            self.need(")")
            return out
        return ("name", self.name())

    def refs(self) -> list:
        if self.take("("):
            return self.many(self.ref, ")")
        return [self.ref()]

    def ref(self):
        return ("pos", int(self.next("num"))) if self.take("$") else ("col", self.name())

    def column_def(self) -> tuple[str, str]:
        name = self.name()
        self.need(":")
        return name, _TYPES[self.name().lower()]

    def from_args(self) -> list:
        out = []
        while True:
            r = self.relation_term()
            self.take("as")
            alias = self.name() if self.kind() == "id" and not self.peek("where", "emit", "group", "order", "limit") else (r[1] if r[0] == "name" else None)
            out.append((alias, r))
            if not self.take(","):
                return out

    def tail(self) -> tuple[list, int | None]:
        order, limit = [], None
        if self.take("order"):
            self.need("by")
            while True:
                c = self.ref()
                order.append((c, not (self.take("desc") or not (self.take("asc") or True))))
                if not self.take(","):
                    break
        if self.take("limit"):
            limit = int(self.next("num"))
        return order, limit

    def comprehension(self):
        froms = self.from_args()
        where = self.expr() if self.take("where") else None
        self.need("emit")
        emits = self.emits()
        order, limit = self.tail()
        self.need("]")
        return ("select", False, emits, froms, where, None, order, limit)

    def select(self):
        self.need("select")
        distinct = self.take("distinct")
        emits = self.emits()
        self.need("from")
        froms = self.from_args()
        where = self.expr() if self.take("where") else None
        group = None
        if self.take("group"):
            self.need("by")
            group = [self.expr()]
            while self.take(","):
                group.append(self.expr())
        order, limit = self.tail()
        return ("select", distinct, emits, froms, where, group, order, limit)

    def emits(self) -> list:
        out = [self.emit()]
        while self.take(","):
            out.append(self.emit())
        return out

    def emits_in_brackets(self) -> list:
        return self.many(self.emit, "]")

    def emit(self):
        if self.peek("*") and not (self.kind(1) == "id" and not self.peek("from", "where", "order", "limit", ahead=1)):
            self.need("*")
            return (None, ("star",))
        if self.kind() == "id" and self.peek(".", ahead=1) and self.peek("*", ahead=2):
            t = self.name()
            self.at += 2
            return (None, ("tstar", t))
        e = self.expr()
        if self.take("as"):
            if self.take("["):
                return (self.many(self.name, "]"), e)
            return (self.name(), e)
        return (None, e)

    # Scalars ---------------------------------------------------------------------------------------

    def expr(self):
        out = self.conjunction()
        while self.take("or"):
            out = ("bin", "OR", out, self.conjunction())
        return out

    def conjunction(self):
        out = self.negation()
        while self.take("and"):
            out = ("bin", "AND", out, self.negation())
        return out

    def negation(self):
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self):
        out = self.sum()
        if self.peek(*_COMPARE):
            op = _COMPARE[self.need(*_COMPARE)]
            return ("bin", op, out, self.sum())
        if self.take("like"):
            return ("bin", "LIKE", out, self.sum())
        if self.take("between"):
            low = self.sum()
            self.need("and")
            return ("between", out, low, self.sum())
        return out

    def sum(self):
        out = self.product()
        while self.peek("+", "-"):
            op = self.need("+", "-")
            out = ("bin", op, out, self.product())
        return out

    def product(self):
        out = self.unary()
        while self.peek("*", "/", "//", "%"):
            op = self.need("*", "/", "//", "%")
            out = ("bin", op, out, self.unary())
        return out

    def unary(self):
        if self.take("-"):
            return ("neg", self.unary())
        return self.atom()

    def atom(self):
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        if self.kind() == "num":
            return ("num", self.next("num"))
        if self.kind() == "str":
            return ("str", self.text())
        if self.take("$"):
            return ("pos", int(self.next("num")))
        if self.take("*"):
            t = self.name()
            if self.take("."):
                return ("unbox", t, self.ref())
            return ("unbox", t, ("pos", 0))
        if self.take("case"):
            whens = []
            while self.take("when"):
                c = self.expr()
                self.need("then")
                whens.append((c, self.expr()))
            self.need("else")
            other = self.expr()
            self.need("end")
            return ("case", whens, other)
        if self.peek("true", "false"):
            return ("raw", self.name().upper())
        if self.peek("date") and self.kind(1) == "str":
            self.at += 1
            return ("raw", f"DATE '{self.text()}'")
        if self.peek("interval") and self.kind(1) == "str":
            self.at += 1
            n = self.text()
            return ("raw", f"INTERVAL '{n}' {self.name().upper()}")
        name = self.name()
        if self.take("("):
            if name.lower() in ("count", "countall") and self.take("*"):
                self.need(")")
                return ("call", "countall", [])
            return ("call", name.lower(), self.many(self.expr, ")"))
        if self.take("."):
            return ("dot", name, self.ref())
        return ("col", name)


class Interpreter:
    def __init__(self, spark: SparkSession, relations: dict[str, DataFrame] | None = None, max_iterations: int | None = None):
        self.spark, self.max_iterations = spark, max_iterations
        self.stored = dict(relations or {})
        self.bound: dict[str, DataFrame] = {}
        self.macros: dict[str, tuple] = {}
        self.constants: dict[str, tuple] = {}
        self.folds: dict[str, tuple] = {}
        self.dumped: list[DataFrame] = []
        self.python: dict[str, str] = {}
        self._views = itertools.count()

    def register_udf(self, name: str, func, returns: str) -> None:
        """A Python function of pandas Series, callable in expressions."""
        self.spark.udf.register(name, F.pandas_udf(func, returns))
        self.python[name.lower()] = name

    def run(self, program: str) -> dict[str, DataFrame]:
        """Runs a program; gives all names it bound."""
        for s in _Parser(program).program():
            self._statement(s)
        return self.bound

    # Statements ------------------------------------------------------------------------------------

    def _statement(self, s: tuple) -> None:
        kind = s[0]
        if kind == "def":
            self.macros[s[1]] = (s[2], s[3])
        elif kind == "const":
            self.constants[s[1]] = s[2]
        elif kind in ("uda", "apply"):
            self.folds[s[1]] = s
        elif kind == "let":
            self.bound[s[1]] = self._relation(s[2])
        elif kind == "while":
            for _ in recursion.rounds(self.max_iterations):
                for b in s[1]:
                    self._statement(b)
                for b in s[1]:
                    if b[0] == "let":
                        self.bound[b[1]] = recursion.settle(self.bound[b[1]])
                row = self._condition(s[2]).head()
                if row is None or not row[0]:
                    break
        elif kind == "converge":
            self._converge(s[1])
        elif kind == "store":
            self.stored[s[2].split(":")[-1]] = self.bound[s[1]]
        elif kind == "sink":
            self.bound[s[1]].write.format("noop").mode("overwrite").save()
        elif kind == "export":
            io.to_csv(self.bound[s[1]], s[2])
        elif kind == "dump":
            self.dumped.append(self.bound[s[1]])
        elif kind == "idb":
            self._converge([s])

    def _condition(self, e: tuple) -> DataFrame:
        if e[0] == "col" and e[1] in self.bound:
            return self.bound[e[1]]
        return self.spark.sql(f"SELECT {self._sql(e, [])}")

    def _converge(self, idbs: list) -> None:
        names = {s[1] for s in idbs}
        parts: dict[str, tuple[list, list, list]] = {}
        for _, name, emits, value in idbs:
            terms = self._terms(value)
            base = [t for t in terms if not self._mentions(t, names)]
            if not base:
                raise LanguageError(f"{name} has no part without recursion")
            parts[name] = (emits, base, [t for t in terms if self._mentions(t, names)])
        for name, (emits, base, _) in parts.items():
            rows = [self._relation(t) for t in base]
            self.bound[name] = recursion.settle(self._kept(emits, recursion_union(rows)))
        for _ in recursion.rounds(self.max_iterations):
            new = {}
            for name, (emits, _, rec) in parts.items():
                rows = [self.bound[name], *(self._relation(t) for t in rec)]
                # what's kept is itself a row of the rule: MIN of a minimum is that minimum
                new[name] = recursion.settle(self._kept(emits, recursion_union(rows)))
            same = all(new[n].exceptAll(self.bound[n]).isEmpty() for n in new)
            self.bound |= new
            if same:
                return
        raise AssertionError

    def _terms(self, r: tuple) -> list:
        return [t for x in r[1] for t in self._terms(x)] if r[0] == "unionall" else [r]

    def _mentions(self, r, names: set[str]) -> bool:
        if isinstance(r, tuple) and len(r) == 2 and r[0] == "name":
            return r[1] in names
        return isinstance(r, (tuple, list)) and any(self._mentions(x, names) for x in r)

    def _kept(self, emits: list, df: DataFrame) -> DataFrame:
        """The rows of a recursive relation: a set, or the least of some columns for each of the others."""
        df = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
        keys, least, names = [], [], []
        at = 0
        for name, e in emits:
            agg = e[0] == "call" and e[1] in ("min", "lexmin")
            refs = e[2] if agg else [e]
            for r in refs:
                col = f"c{r[1]}" if r[0] == "pos" else f"c{at}"
                (least if agg else keys).append(col)
                names.append(name if name and len(refs) == 1 else r[1] if r[0] == "col" else f"_COLUMN{at}_")
                at += 1
        if not least:
            return df.select(*keys).distinct().toDF(*map(str, names))
        order = [*keys, *least]
        out = df.groupBy(*keys).agg(F.min(F.struct(*least)).alias("m_")).select(*keys, "m_.*")
        return out.select(*sorted(order, key=lambda c: int(c[1:]))).toDF(*map(str, names))

    # Relations -------------------------------------------------------------------------------------

    def _named(self, name: str) -> DataFrame:
        if name in self.bound:
            return self.bound[name]
        raise LanguageError(f"{name} isn't bound")

    def _scan(self, key: str) -> DataFrame:
        name = key.split(":")[-1]
        return self.stored[name] if name in self.stored else self.spark.table(name)

    def _relation(self, r: tuple) -> DataFrame:
        kind = r[0]
        if kind == "name":
            return self._named(r[1])
        if kind == "scan":
            return self._scan(r[1])
        if kind == "sample":
            from tidewater.operators.relational import sample_scan

            return sample_scan(self._scan(r[1]), r[2], r[3], r[4] == "wr")
        if kind == "load":
            schema = ", ".join(f"{n} {t}" for n, t in r[3])
            o = r[4]
            if r[2] != "csv":
                raise LanguageError(f"there's no reader for {r[2]} files")
            return io.read_csv(self.spark, r[1], schema, sep=o.get("delimiter", ","), header=False, quote=o.get("quote", '"'), escape=o.get("escape", "\\"), skip=o.get("skip", 0))
        if kind == "empty":
            return self.spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in r[1]))
        if kind == "literal":
            return self._select(("select", False, r[1], [], None, None, [], None))
        if kind == "limit":
            return self._relation(r[1]).limit(r[2])
        if kind == "distinct":
            return self._relation(r[1]).distinct()
        if kind == "countall":
            return self._relation(r[1]).agg(F.count(F.lit(1)).alias("_COLUMN0_"))
        if kind == "unionall":
            return recursion_union([self._relation(x) for x in r[1]])
        if kind in ("union", "intersect", "diff", "cross"):
            a, b = map(self._relation, r[1])
            return {"union": lambda: a.union(b).distinct(), "intersect": lambda: a.intersect(b), "diff": lambda: a.subtract(b), "cross": lambda: _distinct_names(a.crossJoin(b))}[kind]()
        if kind == "join":
            a, b = self._relation(r[1]), self._relation(r[3])
            x, y = a.toDF(*(f"l{i}_" for i in range(len(a.columns)))), b.toDF(*(f"r{i}_" for i in range(len(b.columns))))
            at = lambda d, c, p: F.col(f"{p}{c[1] if c[0] == 'pos' else d.columns.index(c[1])}_")
            cond = F.lit(True)
            for c, e in zip(r[2], r[4]):
                cond = cond & (at(a, c, "l") == at(b, e, "r"))
            return _distinct_names(x.join(y, cond).toDF(*a.columns, *b.columns))
        if kind == "select":
            return self._select(r)
        raise LanguageError(kind)

    def _view(self, df: DataFrame) -> str:
        name = f"tw_view_{id(self)}_{next(self._views)}"
        df.createOrReplaceTempView(name)
        return name

    def _select(self, r: tuple) -> DataFrame:
        _, distinct, emits, froms, where, group, order, limit = r
        scope: list[tuple[str, DataFrame]] = []
        for i, (alias, rel) in enumerate(froms):
            alias = alias or f"_r{i}"
            if any(a == alias for a, _ in scope):
                raise LanguageError(f"{alias} names two relations")
            scope.append((alias, self._relation(rel)))
        # every column gets a name of its own, so that clashes and positions don't matter
        inner = [(a, d.toDF(*(f"{a}__{i}" for i in range(len(d.columns)))), d.columns) for a, d in scope]
        columns = [(a, c, f"{a}__{i}") for a, _, cs in inner for i, c in enumerate(cs)]
        out: list[tuple[str, str, bool]] = []
        stateful = False
        for name, e in emits:
            if e[0] in ("star", "tstar"):
                out += [(c, f"`{q}`", False) for a, c, q in columns if e[0] == "star" or a == e[1]]
                continue
            values = self._expand(e)
            names = name if isinstance(name, list) else [name] * len(values)
            for n, v in zip(names, values):
                fold = v[0] == "call" and v[1] in self.folds
                stateful = stateful or (fold and self.folds[v[1]][0] == "apply")
                n = n or (v[1] if v[0] == "col" else v[2][1] if v[0] == "dot" and v[2][0] == "col" else None)
                for k, text in enumerate(self._folded(v, columns) if fold else [self._sql(v, columns)]):
                    out.append((n if k == 0 and n else f"_COLUMN{len(out)}_", text, self._aggregates(v)))
        body = "SELECT " + ("DISTINCT " if distinct else "")
        seen: dict[str, int] = {}
        items = []
        for n, text, _ in out:
            seen[n] = seen.get(n, 0) + 1
            items.append(f"{text} AS `{n if seen[n] == 1 else f'{n}{seen[n] - 1}'}`")
        body += ", ".join(items)
        if inner:
            body += " FROM " + " CROSS JOIN ".join(self._view(d) for _, d, _ in inner)
        if where is not None:
            body += f" WHERE {self._sql(where, columns)}"
        if any(a for *_, a in out):
            keys = [t for _, t, a in out if not a] + [self._sql(g, columns) for g in group or []]
            keys = list(dict.fromkeys(k for k in keys if not re.fullmatch(r"[\d.]+L?|'[^']*'", k)))
            body += f" GROUP BY {', '.join(keys)}" if keys else ""
        elif group:
            body = body.replace("SELECT ", "SELECT DISTINCT ", 1) if not distinct else body
        df = self.spark.sql(body)
        if order:
            cols = [df.columns[c[1]] if c[0] == "pos" else c[1] for c, _ in order]
            df = df.orderBy(*(F.col(f"`{c}`").asc() if asc else F.col(f"`{c}`").desc() for c, (_, asc) in zip(cols, order)))
        return df.limit(limit) if limit is not None else df

    # Scalars ---------------------------------------------------------------------------------------

    def _expand(self, e: tuple) -> list:
        """An emit's expressions: several for a macro that gives several."""
        if e[0] == "call" and e[1] in self.macros and len(self.macros[e[1]][1]) > 1:
            args, body = self.macros[e[1]]
            return [self._put(b, dict(zip(args, e[2]))) for _, b in body]
        return [e]

    def _put(self, e, values: dict):
        """e with names replaced by expressions."""
        if isinstance(e, tuple):
            if e and e[0] == "col" and e[1] in values:
                return values[e[1]]
            return tuple(self._put(x, values) for x in e)
        return [self._put(x, values) for x in e] if isinstance(e, list) else e

    def _aggregates(self, e) -> bool:
        if isinstance(e, tuple) and e and e[0] == "call":
            if e[1] in _AGGREGATES or (e[1] in self.folds and self.folds[e[1]][0] == "uda"):
                return True
            if e[1] in self.macros:
                return any(self._aggregates(b) for _, b in self.macros[e[1]][1]) or any(map(self._aggregates, e[2]))
        return isinstance(e, (tuple, list)) and any(map(self._aggregates, e))

    def _column(self, name: str, columns: list, of: str | None = None) -> str:
        found = [q for a, c, q in columns if c == name and (of is None or a == of)]
        if len(found) != 1:
            raise LanguageError(f"{name} is {'unknown' if not found else 'ambiguous'}")
        return f"`{found[0]}`"

    def _sql(self, e: tuple, columns: list) -> str:
        go = lambda x: self._sql(x, columns)
        kind = e[0]
        if kind == "num":
            return e[1] + ("D" if "." in e[1] else "L")
        if kind == "str":
            return "'" + e[1].replace("\\", "\\\\").replace("'", "\\'") + "'"
        if kind == "raw":
            return e[1]
        if kind == "col":
            if e[1] in self.constants and not any(c == e[1] for _, c, _ in columns):
                return go(self.constants[e[1]])
            return self._column(e[1], columns)
        if kind == "pos":
            return f"`{columns[e[1]][2]}`"
        if kind == "dot":
            if e[2][0] == "pos":
                return f"`{[q for a, _, q in columns if a == e[1]][e[2][1]]}`"
            return self._column(e[2][1], columns, e[1])
        if kind == "unbox":
            d = self._named(e[1])
            c = d.columns[e[2][1]] if e[2][0] == "pos" else e[2][1]
            return f"(SELECT `{c}` FROM {self._view(d)})"
        if kind == "neg":
            return f"(- {go(e[1])})"
        if kind == "not":
            return f"(NOT {go(e[1])})"
        if kind == "between":
            return f"({go(e[1])} BETWEEN {go(e[2])} AND {go(e[3])})"
        if kind == "bin":
            a, b = go(e[2]), go(e[3])
            if e[1] == "/":
                return f"(CAST({a} AS DOUBLE) / {b})"
            if e[1] == "//":
                return f"CAST(CAST({a} AS DOUBLE) / {b} AS BIGINT)"
            if e[1] == "%":
                return f"((({a}) % {b} + {b}) % {b})"
            return f"({a} {e[1]} {b})"
        if kind == "case":
            return "CASE " + " ".join(f"WHEN {go(c)} THEN {go(v)}" for c, v in e[1]) + f" ELSE {go(e[2])} END"
        if kind == "call":
            return self._call(e[1], e[2], columns)
        raise LanguageError(kind)

    def _call(self, f: str, args: list, columns: list) -> str:
        if f in self.macros:
            names, body = self.macros[f]
            if len(names) != len(args):
                raise LanguageError(f"{f} takes {len(names)} arguments")
            return self._sql(self._put(body[0][1], dict(zip(names, args))), columns)
        if f in self.folds:
            return self._folded(("call", f, args), columns)[0]
        a = [self._sql(x, columns) for x in args]
        if f in _TYPES and len(a) == 1:
            return f"CAST({a[0]} AS {_TYPES[f]})"
        if f in self.python:
            return f"{self.python[f]}({', '.join(a)})"
        if f == "sum":
            return f"COALESCE(SUM({a[0]}), 0)"
        if f == "countall":
            return "COUNT(1)"
        if f == "stdev":
            return f"(CASE WHEN COUNT({a[0]}) < 2 THEN 0D ELSE STDDEV_POP({a[0]}) END)"
        if f in ("avg", "min", "max", "count"):
            return f"{f.upper()}({a[0]})"
        if f == "lexmin":
            return f"MIN(STRUCT({', '.join(a)}))"
        if f in ("greatest", "least"):
            return f"{f.upper()}({', '.join(a)})"
        if f == "safediv":
            return f"(CASE WHEN {a[1]} = 0 THEN {a[2] if len(a) > 2 else '0D'} ELSE CAST({a[0]} AS DOUBLE) / NULLIF({a[1]}, 0) END)"
        if f in _FUNCTIONS:
            return _FUNCTIONS[f].format(*a)
        raise LanguageError(f"{f} is no function")

    def _folded(self, e: tuple, columns: list) -> list[str]:
        """A UDA or a stateful function as a fold over an array of its arguments."""
        kind, name, params, init, update, emit = self.folds[e[1]]
        states = [n or f"s{i}" for i, (n, _) in enumerate(init)]
        types = ["STRING" if x[0] == "str" else "DOUBLE" if self._floats([x, update]) else "BIGINT" for _, x in init]
        row = "STRUCT(" + ", ".join(f"{self._sql(a, columns)} AS `{p}`" for p, a in zip(params, e[2])) + ")" if params else "STRUCT(1 AS `one_`)"
        start = "STRUCT(" + ", ".join(f"CAST({self._sql(x, [])} AS {t}) AS `{n}`" for n, t, (_, x) in zip(states, types, init)) + ")"
        inside = [("acc_", s, f"acc_`.`{s}") for s in states] + [("row_", p, f"row_`.`{p}") for p in params if p not in states]
        step = "STRUCT(" + ", ".join(f"CAST({self._sql(u, inside)} AS {t}) AS `{n}`" for n, t, u in zip(states, types, update)) + ")"
        finals = emit or [("col", states[0])]
        rows = f"SORT_ARRAY(COLLECT_LIST({row}))"
        if kind == "apply":
            order = ", ".join(f"`{q}`" for *_, q in columns)
            rows = f"COLLECT_LIST({row}) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        return [f"AGGREGATE({rows}, {start}, (acc_, row_) -> {step}, acc_ -> {self._sql(x, inside)})" for x in finals]

    def _floats(self, e) -> bool:
        if isinstance(e, tuple) and e and (e[0] == "num" and "." in e[1] or e[0] == "bin" and e[1] == "/"):
            return True
        return isinstance(e, (tuple, list)) and any(map(self._floats, e))


def recursion_union(parts: list[DataFrame]) -> DataFrame:
    """A bag union by position, named as the first part."""
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _distinct_names(df: DataFrame) -> DataFrame:
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        seen[c] = seen.get(c, 0) + 1
        names.append(c if seen[c] == 1 else f"{c}{seen[c] - 1}")
    return df.toDF(*names)
