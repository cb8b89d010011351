"""The few forms that no built-in expresses: syntax-tree digests and the gestalt ratio of sequences. Arrow batches, distinct inputs."""

from __future__ import annotations

import ast
import difflib
import hashlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tree_digest(code: str | None) -> str:
    """SHA-256 of the syntax tree without places; empty where code is empty or doesn't parse."""
    try:
        return hashlib.sha256(ast.dump(ast.parse(code or "")).encode()).hexdigest() if code and code.strip() else ""
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return ""


@F.pandas_udf(T.StringType())
def ast_hash(code: pd.Series) -> pd.Series:
    return code.map(tree_digest)


def shows(value: ast.AST) -> bool:
    """Whether an expression prints or draws."""
    if not isinstance(value, ast.Call):
        return False
    return value.func.id == "print" if isinstance(value.func, ast.Name) else draws(value)


def draws(value: ast.AST | None) -> bool:
    return isinstance(value, ast.Call) and isinstance(value.func, ast.Attribute) and value.func.attr == "draw"


def without_presentation(code: str | None) -> str | None:
    """Code without print calls, draw calls, and drawings under names that are never read; None where it or the rest doesn't parse."""
    try:
        tree = ast.parse(code or "")
        read = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)}

        def unread(statement: ast.stmt) -> bool:
            targets = statement.targets if isinstance(statement, ast.Assign) else [statement.target] if isinstance(statement, ast.AnnAssign) else None
            return targets is not None and draws(statement.value) and not read & {n.id for t in targets for n in ast.walk(t) if isinstance(n, ast.Name)}

        for node in ast.walk(tree):
            for name in ("body", "orelse", "finalbody"):
                block = getattr(node, name, None)
                if isinstance(block, list):
                    setattr(node, name, [x for x in block if not (isinstance(x, ast.Expr) and shows(x.value)) and not unread(x)])
        out = ast.unparse(tree).strip() + "\n"
        compile(out, "<stripped>", "exec")
        return out
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


@F.pandas_udf(T.StringType())
def presentation_stripped(code: pd.Series) -> pd.Series:
    return code.map(without_presentation)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched elements over all elements of two arrays; two empty ones are alike."""
    return pd.Series([difflib.SequenceMatcher(None, list(x), list(y), autojunk=False).ratio() for x, y in zip(a, b, strict=True)])
