"""What needs Python on a text: syntax trees, JSON inside prose, dialogues. As functions and as Arrow-batched UDFs."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What generated code may import and must not call; the bound on a dialogue.
IMPORTS = {"math", "cmath", "fractions", "decimal", "statistics", "itertools", "collections", "functools", "operator", "sympy", "numpy", "scipy"}
CALLS = {"open", "exec", "eval", "compile", "input", "breakpoint", "__import__", "globals", "locals", "vars", "help", "dir"}
DIALOGUE_CHARS = 24_000


class _Finder(ast.NodeVisitor):
    """Collects what a tree does that it must not."""

    def __init__(self):
        self.found: list[str] = []

    def visit_Import(self, node):
        self.found += [f"import of {a.name}" for a in node.names if a.name.partition(".")[0] not in IMPORTS]

    def visit_ImportFrom(self, node):
        if (node.module or "").partition(".")[0] not in IMPORTS:
            self.found.append(f"import of {node.module}")

    def visit_Call(self, node):
        name = getattr(node.func, "id", None)
        if name in CALLS:
            self.found.append(f"call of {name}")
        self.generic_visit(node)

    def visit_Attribute(self, node):
        if node.attr[:2] == "__":
            self.found.append(f"use of {node.attr}")
        self.generic_visit(node)


def check_code(source: str | None) -> tuple[bool, str]:
    """May this code run? If not, the first reason."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError) as x:
        return False, f"syntax: {x}"
    finder = _Finder()
    finder.visit(tree)
    return not finder.found, finder.found[0] if finder.found else "ok"


def show_last_expression(source: str) -> str:
    """The code with its last statement printed, if that is a bare expression other than a call of print."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return source
    last = tree.body[-1] if tree.body else None
    if not isinstance(last, ast.Expr) or ast.unparse(last.value).startswith("print("):
        return source
    head = tree.body[:-1]
    return "\n".join([*map(ast.unparse, head), f"print({ast.unparse(last.value)})"])


def last_object(text: str | None) -> str | None:
    """The last JSON object that starts anywhere in a text, as JSON; NULL if there is none."""
    found, decoder = None, json.JSONDecoder()
    at = (text or "").find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            found = json.dumps(value, ensure_ascii=False)
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return found


def turn_text(step: dict) -> str:
    """A step as the assistant's message."""
    kind = step.get("action_type")
    if kind not in ("code", "answer"):
        return step.get("raw_response") or ""
    fence, body = ("python", step.get("code")) if kind == "code" else ("answer", step.get("final_answer"))
    return f"Reasoning step: {step.get('reasoning') or ''}\n```{fence}\n{body or ''}\n```"


def dialogue(system: str, problem: str, steps: list[dict], closing: str = "", max_chars: int = DIALOGUE_CHARS) -> list[dict]:
    """The messages before the next turn. Beyond ``max_chars`` the oldest pairs after the problem go, down to four messages."""
    head = [{"role": "system", "content": system}, {"role": "user", "content": f"Solve this problem:\n\n{problem}"}]
    tail = []
    for s in steps:
        tail.append({"role": "assistant", "content": turn_text(s)})
        if s.get("action_type") == "code":
            tail.append({"role": "user", "content": f"Observation:\n{s.get('observation') or ''}"})
        elif s.get("action_type") == "none":
            tail.append({"role": "user", "content": f"Controller feedback: {s.get('observation') or s.get('error') or 'No valid action was found.'}"})
    if closing:
        tail.append({"role": "user", "content": closing})
    size = sum(len(m["content"]) for m in head + tail)
    drop = 0
    while size > max_chars and len(head) + len(tail) - drop > 4:
        size -= sum(len(m["content"]) for m in tail[drop : drop + 2])
        drop += 2
    return head + tail[drop:]


def _batched(function, kind: str):
    """A column function that applies ``function`` to Arrow batches of texts."""

    def apply(column: Column) -> Column:
        if kind == "check":
            return F.pandas_udf(lambda s: pd.DataFrame([function(x) for x in s], columns=["ok", "reason"]), "ok boolean, reason string")(column)
        return F.pandas_udf(lambda s: s.map(function), "string")(column)

    return apply


code_check = _batched(check_code, "check")
shown_code = _batched(lambda s: show_last_expression(s or ""), "text")
last_json_object = _batched(last_object, "text")
