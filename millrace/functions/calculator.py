"""Arithmetic on expression strings, and only that.

A parsed expression may hold numbers, + - * / // % **, signs, and the functions
abs, round and sqrt. Division and remainder floor as in Python. Exponents go up
to 20 in size. A complex result counts as an error.
"""

from __future__ import annotations

import ast
import math
import operator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

BINARY = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv,
    ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow,
}
FUNCTIONS = {"abs": abs, "round": round, "sqrt": math.sqrt}
LARGEST_EXPONENT = 20


def _value(node: ast.AST) -> float:
    match node:
        case ast.Expression(body=body):
            return _value(body)
        case ast.Constant(value=int() | float() as v):
            return v
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -_value(x)
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return +_value(x)
        case ast.BinOp(left=a, op=op, right=b) if type(op) in BINARY:
            x, y = _value(a), _value(b)
            if isinstance(op, ast.Pow) and abs(y) > LARGEST_EXPONENT:
                raise ValueError("exponent too large")
            return BINARY[type(op)](x, y)
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS:
            return FUNCTIONS[name](*map(_value, args))
    raise ValueError(f"not allowed: {type(node).__name__}")


def evaluate(expression: str | None) -> dict:
    """{success, result, error_type, error}; never raises."""
    try:
        out = _value(ast.parse((expression or "").strip(), mode="eval"))
        if isinstance(out, complex):
            raise ValueError("complex result")
        return {"success": True, "result": float(out), "error_type": None, "error": None}
    except Exception as e:  # noqa: BLE001  any fault of the expression is data
        return {"success": False, "result": None, "error_type": type(e).__name__, "error": str(e)}


_KIND = T.StructType([T.StructField("success", T.BooleanType()), T.StructField("result", T.DoubleType()), T.StructField("error_type", T.StringType()), T.StructField("error", T.StringType())])


def _frame(expressions: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([evaluate(x) for x in expressions], columns=_KIND.names)


def calculate(expressions) -> Column:
    """``evaluate`` on a column."""
    ship(SparkSession.active())
    return F.pandas_udf(_frame, _KIND)(expressions)
