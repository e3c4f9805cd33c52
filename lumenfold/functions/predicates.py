"""Predicates in a closed subset of Python: names, attributes, subscripts, comparisons, membership, `and`, `or`, `not`.

Whatever lies outside the subset gives null: calls, arithmetic, `is`, literals alone, text that doesn't parse. Python's own
parser reads them, so a Pandas UDF does the work, on Arrow batches."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TURNED = {ast.Eq: ast.NotEq, ast.NotEq: ast.Eq, ast.Lt: ast.GtE, ast.GtE: ast.Lt, ast.Gt: ast.LtE, ast.LtE: ast.Gt, ast.In: ast.NotIn, ast.NotIn: ast.In}
NAMED = (ast.Name, ast.Attribute, ast.Subscript)


class Outside(ValueError):
    """An expression that isn't of the subset."""


def _operand(node: ast.expr) -> ast.expr:
    inner = node
    while isinstance(inner, (ast.Attribute, ast.Subscript)):
        if isinstance(inner, ast.Subscript) and not isinstance(inner.slice, (ast.Constant, *NAMED)):
            raise Outside
        inner = inner.value
    if not isinstance(inner, (ast.Name, ast.Constant)):
        raise Outside
    return node


def _flat(op: ast.boolop, parts: list[ast.expr]) -> ast.expr:
    """One node for nested ones of the same kind."""
    out: list[ast.expr] = []
    for p in parts:
        out += p.values if isinstance(p, ast.BoolOp) and type(p.op) is type(op) else [p]
    return out[0] if len(out) == 1 else ast.BoolOp(op, out)


def _read(node: ast.expr, no: bool) -> ast.expr:
    """The node, or its negation with `not` moved down to the atoms."""
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return _read(node.operand, not no)
    if isinstance(node, ast.BoolOp):
        other = {ast.And: ast.Or, ast.Or: ast.And}[type(node.op)]
        return _flat((other if no else type(node.op))(), [_read(v, no) for v in node.values])
    if isinstance(node, ast.Compare):
        ends = [_operand(x) for x in (node.left, *node.comparators)]
        if any(type(op) not in TURNED for op in node.ops):
            raise Outside
        steps = [ast.Compare(a, [TURNED[type(op)]() if no else op], [b]) for a, op, b in zip(ends, node.ops, ends[1:], strict=False)]
        return _flat(ast.Or() if no else ast.And(), steps)
    if isinstance(node, NAMED):
        return ast.UnaryOp(ast.Not(), _operand(node)) if no else _operand(node)
    raise Outside


def _written(node: ast.expr) -> str:
    """The text of a read node, with brackets only where `or` stands in `and`."""
    if isinstance(node, ast.BoolOp):
        inner = [f"({_written(v)})" if isinstance(node.op, ast.And) and isinstance(v, ast.BoolOp) else _written(v) for v in node.values]
        return (" and " if isinstance(node.op, ast.And) else " or ").join(inner)
    return f"not {ast.unparse(node.operand)}" if isinstance(node, ast.UnaryOp) else ast.unparse(node)


def rendered(text: str | None, negate: bool) -> str | None:
    try:
        return _written(_read(ast.parse((text or "").strip(), mode="eval").body, negate))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def negated(expression: Column) -> Column:
    """The negation by dual operators and De Morgan's laws; null outside the subset."""
    return F.pandas_udf(lambda s: pd.Series([rendered(x, True) for x in s], dtype="object"), "string")(expression)


def plain(expression: Column) -> Column:
    """The expression itself in one form: blanks, brackets and chained comparisons resolved; null outside the subset."""
    return F.pandas_udf(lambda s: pd.Series([rendered(x, False) for x in s], dtype="object"), "string")(expression)
