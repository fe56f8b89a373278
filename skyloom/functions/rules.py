"""Replacement rules: a small expression language compiled to one CASE column.

A rule is a comparison and a result, both arithmetic over numbers, constants and
statistics of the variable.  Expressions are parsed by precedence climbing and
evaluated on the driver; a plan only ever holds the resulting numbers.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the language.
CONSTANTS = {"nan": math.nan, "inf": math.inf, "pi": math.pi, "e": math.e}
STATISTICS = ("min", "max", "mean", "std", "median", "p50", "p95")
FUNCTIONS = {"abs": abs, "ceil": math.ceil, "floor": math.floor}
MAX_NODES = 64
MAX_EXPONENT = 32
COMPARISONS = {"<=": operator.le, ">=": operator.ge, "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt}

_TOKEN = re.compile(r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<sign>\*\*|[-+*/%()]))")
_BINARY = {"+": (1, operator.add), "-": (1, operator.sub), "*": (2, operator.mul), "/": (2, operator.truediv), "%": (2, operator.mod)}


class RuleError(ValueError):
    """Text that is not a rule, or a result that is not a number."""


@dataclass(frozen=True)
class Expression:
    """Parsed arithmetic: nested tuples whose first entry names the node."""

    text: str
    tree: tuple

    @property
    def statistics(self) -> frozenset[str]:
        """Statistics that the expression refers to."""
        found, todo = set(), [self.tree]
        while todo:
            node = todo.pop()
            if node[0] == "name" and node[1] not in CONSTANTS:
                found.add(node[1])
            todo += [x for x in node[1:] if isinstance(x, tuple)]
        return frozenset(found)

    def value(self, statistics: Mapping[str, float] | None = None) -> float:
        """The number that the expression stands for."""
        if unknown := sorted(self.statistics - set(STATISTICS)):
            raise RuleError(f"unknown names: {', '.join(unknown)}")
        if missing := sorted(self.statistics - set(statistics or {})):
            raise RuleError(f"no statistics for: {', '.join(missing)}")
        try:
            out = float(_value(self.tree, {**(statistics or {}), **CONSTANTS}))
        except (ArithmeticError, TypeError) as error:
            raise RuleError(f"{self.text!r}: {error}") from error
        if not math.isfinite(out) and not re.search("nan|inf", self.text, re.IGNORECASE):
            raise RuleError(f"{self.text!r} is not finite")
        return out


def _value(node: tuple, names: Mapping[str, float]) -> float:
    kind = node[0]
    if kind == "number":
        return node[1]
    if kind == "name":
        return float(names[node[1]])
    if kind == "call":
        return float(FUNCTIONS[node[1]](_value(node[2], names)))
    if kind == "negate":
        return -_value(node[1], names)
    left, right = _value(node[1], names), _value(node[2], names)
    if kind == "**":
        if abs(right) > MAX_EXPONENT:
            raise RuleError(f"exponents lie within {MAX_EXPONENT}")
        return left**right
    return _BINARY[kind][1](left, right)


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at, self.nodes = text, [], 0, 0
        end = 0
        while end < len(text.rstrip()):
            found = _TOKEN.match(text, end)
            if found is None:
                raise RuleError(f"{text!r} is not an expression")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            end = found.end()

    def _node(self, *parts) -> tuple:
        self.nodes += 1
        if self.nodes > MAX_NODES:
            raise RuleError(f"{self.text!r} is too long")
        return parts

    def _next(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "sign" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self) -> tuple:
        out = self.chain(1)
        if self.at < len(self.tokens):
            raise RuleError(f"{self.text!r} is not an expression")
        return out

    def chain(self, level: int) -> tuple:
        """Left-associative operators of a precedence level."""
        if level > 2:
            return self.signed()
        left = self.chain(level + 1)
        while sign := self._next(*(s for s, (own, _) in _BINARY.items() if own == level)):
            left = self._node(sign, left, self.chain(level + 1))
        return left

    def signed(self) -> tuple:
        if sign := self._next("+", "-"):
            inner = self.signed()
            return self._node("negate", inner) if sign == "-" else inner
        base = self.atom()
        return self._node("**", base, self.signed()) if self._next("**") else base

    def atom(self) -> tuple:
        if self._next("("):
            inner = self.chain(1)
            if not self._next(")"):
                raise RuleError(f"{self.text!r}: a bracket is open")
            return inner
        if self.at >= len(self.tokens):
            raise RuleError(f"{self.text!r} ends too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return self._node("number", float(text))
        if kind == "name" and text in FUNCTIONS:
            if not self._next("("):
                raise RuleError(f"{text} takes one argument")
            inner = self.chain(1)
            if not self._next(")"):
                raise RuleError(f"{text} takes one argument")
            return self._node("call", text, inner)
        if kind == "name":
            return self._node("name", text)
        raise RuleError(f"{self.text!r} is not an expression")


def parse_expression(text: str) -> Expression:
    """Numbers, constants, statistics, ``+ - * / % **``, signs, brackets and abs/ceil/floor."""
    return Expression(text.strip(), _Parser(text).whole())


@dataclass(frozen=True)
class Rule:
    """Replace what compares so with the threshold by the result."""

    comparison: str
    threshold: Expression
    result: Expression


def _items(text: str) -> list[str]:
    """Entries between the commas that are outside brackets."""
    if not text.strip():
        return []
    depth, out = 0, [""]
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            break
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    if depth:
        raise RuleError(f"{text!r}: brackets do not match")
    if not all(x.strip() for x in out):
        raise RuleError(f"{text!r} has an empty entry")
    return [x.strip() for x in out]


def parse_rules(conditions: str, results: str) -> tuple[Rule, ...]:
    """Rules from two comma lists of the same length; the first that matches wins."""
    left, right = _items(conditions), _items(results)
    if len(left) != len(right):
        raise RuleError(f"{len(left)} conditions but {len(right)} results")
    rules = []
    for condition, result in zip(left, right, strict=True):
        bare = condition.replace(" ", "")
        sign = next((s for s in COMPARISONS if bare.startswith(s)), None)
        if sign is None:
            raise RuleError(f"{condition!r} starts with none of {' '.join(COMPARISONS)}")
        rules.append(Rule(sign, parse_expression(bare[len(sign) :]), parse_expression(result)))
    return tuple(rules)


def needs_statistics(rules: tuple[Rule, ...]) -> frozenset[str]:
    """Statistics that the rules refer to; any makes them depend on the data."""
    return frozenset().union(*(r.threshold.statistics | r.result.statistics for r in rules)) if rules else frozenset()


def finite(value: Column) -> Column:
    """The value if it is a finite number, else NULL."""
    wide = value.cast("double")
    return F.when(wide.isNotNull() & ~F.isnan(wide) & (F.abs(wide) != F.lit(math.inf)), wide)


def statistics_columns(value: Column, wanted: Iterable[str] = STATISTICS) -> list[Column]:
    """The wanted statistics of the finite values, in one aggregation (population deviation, exact percentiles)."""
    v = finite(value)
    every = {"min": F.min(v), "max": F.max(v), "mean": F.avg(v), "std": F.stddev_pop(v), "median": F.percentile(v, 0.5), "p50": F.percentile(v, 0.5), "p95": F.percentile(v, 0.95)}
    return [every[name].alias(name) for name in STATISTICS if name in set(wanted)]


def statistics(cells: DataFrame, value: str, wanted: Iterable[str] = STATISTICS) -> dict[str, float]:
    """The wanted statistics as numbers, NaN if no value is finite or it is not wanted.

    Percentiles count every distinct value in one place, so they are left out
    unless a rule names them.
    """
    columns = statistics_columns(F.col(value), wanted)
    row = cells.agg(*columns).first().asDict() if columns else {}
    return {k: math.nan if row.get(k) is None else float(row[k]) for k in STATISTICS}


def apply_rules(value: Column, kind: T.DataType, rules: tuple[Rule, ...], statistics: Mapping[str, float] | None = None) -> Column:
    """First matching rule on the original value; missing and infinite values stay.

    Literals take the column's type first, so float columns compare as floats;
    integer columns become double.
    """
    out_type = kind if isinstance(kind, (T.FloatType, T.DoubleType)) else T.DoubleType()
    typed = value.cast(out_type)
    if not rules:
        return typed
    chain = F
    for rule in rules:
        threshold = F.lit(rule.threshold.value(statistics)).cast(out_type)
        chain = chain.when(COMPARISONS[rule.comparison](typed, threshold), F.lit(rule.result.value(statistics)).cast(out_type))
    return F.when(finite(value).isNotNull(), chain.otherwise(typed)).otherwise(typed)
