"""The mapping language: JSON expressions and quality rules compiled to columns.

An expression is {"col": name}, {"lit": value} or {"fn_": name, "args": [...], ...}. Unlisted functions,
missing arguments and unknown types are errors; arguments beyond those needed are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

#: Declared type names and their Spark types.
TYPES: dict[str, T.DataType] = {
    "i64": T.LongType(),
    "i32": T.IntegerType(),
    "f64": T.DoubleType(),
    "f32": T.FloatType(),
    "str": T.StringType(),
    "utf8": T.StringType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
    "date32": T.DateType(),
    "datetime": T.TimestampNTZType(),
}
#: strptime directives and the layout letters that stand for them.
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "b": "MMM", "B": "MMMM", "H": "HH", "M": "mm", "S": "ss", "j": "DDD"}


class MappingError(ValueError):
    """A request that cannot be compiled."""


def spark_type(name: str) -> T.DataType:
    if name not in TYPES:
        raise MappingError(f"unsupported dtype in target schema: {name}")
    return TYPES[name]


def type_name(kind: T.DataType) -> str:
    """The declared name of a Spark type; others give Spark's own name."""
    for name, own in TYPES.items():
        if own == kind:
            return name
    return kind.simpleString()


def java_layout(fmt: str) -> str:
    """A strptime format as a Spark date layout."""
    out, literal, i = [], "", 0

    def flush():
        nonlocal literal
        if literal:
            out.append("'" + literal.replace("'", "''") + "'" if any(ch.isalpha() or ch == "'" for ch in literal) else literal)
            literal = ""

    while i < len(fmt):
        if fmt[i] == "%":
            i += 1
            if i == len(fmt):
                raise MappingError(f"dangling % in date format {fmt!r}")
            if fmt[i] == "%":
                literal += "%"
            elif fmt[i] == "F":
                flush()
                out.append("yyyy-MM-dd")
            elif fmt[i] in DIRECTIVES:
                flush()
                out.append(DIRECTIVES[fmt[i]])
            else:
                raise MappingError(f"unsupported directive %{fmt[i]} in date format {fmt!r}")
        else:
            literal += fmt[i]
        i += 1
    flush()
    return "".join(out)


def literal(value) -> Column:
    """A JSON value; lists and objects become their JSON text."""
    if isinstance(value, (list, dict)):
        return F.lit(json.dumps(value, separators=(",", ":"), ensure_ascii=False))
    return F.lit(value)


def _is_text(kind: T.DataType | None) -> bool:
    return isinstance(kind, T.StringType)


class Compiler:
    """Compiles expressions against the columns of a frame."""

    def __init__(self, frame: DataFrame):
        self.types = {f.name: f.dataType for f in frame.schema.fields}

    def __call__(self, e: dict) -> Column:
        return self.compile(e)[0]

    def compile(self, e: dict) -> tuple[Column, T.DataType | None]:
        """The column and, where known, its type."""
        if "col" in e:
            if e["col"] not in self.types:
                raise MappingError(f"unknown column: {e['col']}")
            return F.col(f"`{e['col']}`"), self.types[e["col"]]
        if "lit" in e:
            v = e["lit"]
            kind = T.StringType() if isinstance(v, (str, list, dict)) else T.BooleanType() if isinstance(v, bool) else T.LongType() if isinstance(v, int) else T.DoubleType() if isinstance(v, float) else None
            return literal(v), kind
        name = e.get("fn_")
        if not isinstance(name, str):
            raise MappingError(f"not an expression: {e!r}")
        if name in ("+", "-", "*", "/"):
            return self._arithmetic(name, *self._args(e, 2))
        if name in ("==", "!=", ">", ">=", "<", "<="):
            return self._compare(name, *self._args(e, 2)), T.BooleanType()
        if name == "cast":
            (value, _), = self._args(e, 1)
            to = e.get("to")
            if to not in TYPES:
                raise MappingError(f"unsupported cast: {to}")
            return coerce(value, TYPES[to], strict_date=False), TYPES[to]
        if name == "to_date":
            (value, _), = self._args(e, 1)
            return F.try_to_timestamp(value.cast("string"), F.lit(java_layout(e.get("fmt") or "%Y-%m-%d"))).cast("date"), T.DateType()
        if name == "zfill":
            (value, _), = self._args(e, 1)
            return X.zfill(value, int(e.get("len") if e.get("len") is not None else 2)), T.StringType()
        if name == "when":
            if e.get("pred") is None or e.get("then") is None:
                raise MappingError("when needs pred and then")
            then, kind = self.compile(e["then"])
            other, other_kind = self.compile(e["else"]) if e.get("else") is not None else (F.lit(None), None)
            return F.when(self.compile(e["pred"])[0], then).otherwise(other), kind or other_kind
        if name == "is_null":
            return self._args(e, 1)[0][0].isNull(), T.BooleanType()
        if name == "is_not_null":
            return self._args(e, 1)[0][0].isNotNull(), T.BooleanType()
        raise MappingError(f"unsupported fn: {name}")

    def _args(self, e: dict, n: int):
        args = e.get("args") or []
        if len(args) < n:
            raise MappingError(f"missing arg for {e['fn_']}")
        return [self.compile(a) for a in args[:n]]

    def _arithmetic(self, name, left, right):
        (a, ta), (b, tb) = left, right
        if name == "+" and _is_text(ta) and _is_text(tb):
            return F.concat(a, b), T.StringType()
        numbers = [x if not _is_text(t) else X.parse_number(x) for x, t in (left, right)]
        whole = all(isinstance(t, (T.LongType, T.IntegerType, T.ShortType)) for t in (ta, tb))
        kind = T.LongType() if whole and name != "/" else T.DoubleType()
        numbers = [x.try_cast(kind) for x in numbers]
        op = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[name]
        return op(*numbers), kind

    @staticmethod
    def _compare(name, left, right) -> Column:
        (a, ta), (b, tb) = left, right
        # Text against a number compares as numbers; text that is none is NULL.
        if _is_text(ta) and tb is not None and not _is_text(tb):
            a = coerce(a, tb, strict_date=False)
        elif _is_text(tb) and ta is not None and not _is_text(ta):
            b = coerce(b, ta, strict_date=False)
        return {"==": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[name]


def coerce(c: Column, kind: T.DataType, strict_date: bool = True) -> Column:
    """Non-strict conversion to a declared type: what cannot be converted is NULL."""
    if isinstance(kind, T.DateType):
        return X.parse_any_date(c)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        s = c.cast("string")
        return F.when(s.rlike(r"^[+-]?(NaN|Infinity|inf|nan)$") | s.rlike(X.NUMBER), s.try_cast(kind))
    if isinstance(kind, (T.LongType, T.IntegerType)):
        s = c.cast("string")
        # A double is cut to its whole part; text has to be a whole number.
        return F.when(s.rlike(X.INTEGER), s.try_cast(kind)).when(F.typeof(c).isin("double", "float") & s.rlike(X.NUMBER), s.try_cast("double").try_cast(kind))
    if isinstance(kind, T.BooleanType):
        return F.when(F.lower(c.cast("string")).isin("true", "false"), F.lower(c.cast("string")).try_cast("boolean"))
    return c.try_cast(kind)


def empty_to_null(c: Column) -> Column:
    """NULL where the value's text is empty."""
    return F.when(F.length(c.cast("string")) == 0, None).otherwise(c)


def enforce_schema(df: DataFrame, fields: list[dict]) -> DataFrame:
    """Exactly the declared columns in their order and types: missing ones NULL, others dropped."""
    out = []
    for f in fields:
        kind = spark_type(f["type"])
        if f["name"] not in df.columns:
            out.append(F.lit(None).cast(kind).alias(f["name"]))
            continue
        c = F.col(f"`{f['name']}`")
        out.append((c.cast("string") if isinstance(kind, T.StringType) else coerce(empty_to_null(c), kind)).alias(f["name"]))
    return df.select(*out)


def check_coverage(fields: list[dict], columns: list[dict]) -> None:
    """The mapped targets have to be exactly the target's fields."""
    want, have = [f["name"] for f in fields], [c["target"] for c in columns]
    for name in want:
        if name not in have:
            raise MappingError(f"mapping missing target column: {name}")
    for name in have:
        if name not in want:
            raise MappingError(f"mapping defines extra target column: {name}")


def rule_code(column: str, op: str) -> str:
    return f"DQ_{column}_{op}"


def violation(rule: dict, targets: dict[str, Column], types: dict[str, T.DataType]) -> Column:
    """Whether a row breaks a rule; NULL where the comparison is."""
    name, op, value = rule["column"], rule["op"], rule.get("value")
    if name not in targets:
        raise MappingError(f"DQ rule on unknown column: {name}")
    c = targets[name]
    if op == "is_not_null":
        return c.isNull()
    if op == "is_null":
        return c.isNotNull()
    if op not in (">", ">=", "<", "<=", "==", "!="):
        raise MappingError(f"unsupported DQ op: {op}")
    if value is None:
        value = 0 if op in (">", ">=", "<", "<=") else None
    if value is None:
        return F.lit(None).cast("boolean")
    kind = T.StringType() if isinstance(value, (str, list, dict)) else T.BooleanType() if isinstance(value, bool) else T.DoubleType()
    return ~Compiler._compare(op, (c, types.get(name)), (literal(value), kind))


def identity_mapping(source: list[dict], target: list[dict]) -> list[dict]:
    """Each target from the source column of the same name, or NULL."""
    have = {f["name"] for f in source}
    return [{"target": f["name"], "expr": {"col": f["name"]} if f["name"] in have else {"lit": None}} for f in target]


def build_expression(mode: str, column: str | None = None, **options) -> dict:
    """The expression that an editor's mode stands for: identity, cast, to_date, zfill, math, compare, when."""
    col = {"col": column} if column is not None else {"lit": None}
    side = lambda v: v if isinstance(v, dict) else {"lit": v}
    if mode == "identity":
        return col
    if mode == "cast":
        return {"fn_": "cast", "args": [col], "to": options["to"]}
    if mode == "to_date":
        return {"fn_": "to_date", "args": [col], "fmt": options.get("fmt", "%Y-%m-%d")}
    if mode == "zfill":
        return {"fn_": "zfill", "args": [col], "len": options.get("len", 2)}
    if mode in ("math", "compare"):
        return {"fn_": options["op"], "args": [col, side(options["right"])]}
    if mode == "when":
        return {"fn_": "when", "pred": options["pred"], "then": side(options["then"]), "else": side(options.get("else_"))}
    if mode == "advanced":
        return options["expr"]
    raise MappingError(f"unknown mode: {mode}")
