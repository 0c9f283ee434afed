"""What only a Python parser can tell of a program: literals, functions, input spans. Plain functions of one value.

Nothing here runs the text it is given: literals are built by walking a syntax tree.
"""

from __future__ import annotations

import ast
import json
import math
import re
from functools import lru_cache

from traceloom.functions import patterns as P

_PAIRS = {")": "(", "]": "[", "}": "{"}


def literal_value(text: str):
    """The value of a Python literal; the names inf and nan and signs are understood, anything else is a ValueError."""

    def build(node):
        match node:
            case ast.Constant(value=v):
                return v
            case ast.Name(id="inf" | "nan" as name):
                return math.inf if name == "inf" else math.nan
            case ast.List(elts=items):
                return [build(x) for x in items]
            case ast.Tuple(elts=items):
                return tuple(build(x) for x in items)
            case ast.Set(elts=items):
                return {build(x) for x in items}
            case ast.Dict(keys=keys, values=values) if None not in keys:
                return {build(k): build(v) for k, v in zip(keys, values, strict=True)}
            case ast.UnaryOp(op=ast.USub() | ast.UAdd() as sign, operand=x):
                value = build(x)
                return -value if isinstance(sign, ast.USub) else +value
        raise ValueError(f"not a literal: {type(node).__name__}")

    try:
        return build(ast.parse(text.strip(), mode="eval").body)
    except (SyntaxError, TypeError, RecursionError, MemoryError) as e:
        raise ValueError(str(e)) from e


def list_after_inputs(text: str) -> str | None:
    """The bracketed literal that follows the first 'inputs =', brackets matched and strings skipped; None if it doesn't close."""
    start = re.search(P.INPUTS_ASSIGNMENT, text)
    at = text.find("[", start.end()) if start else -1
    if at < 0:
        return None
    open_now: list[str] = []
    # a string, a bracket, or anything else
    for m in re.finditer(r"'(?:[^'\\]|\\.)*(?:'|\Z)|\"(?:[^\"\\]|\\.)*(?:\"|\Z)|[\[\](){}]", text[at:], re.S):
        c = m[0]
        if c in "[({":
            open_now.append(c)
        elif c in _PAIRS:
            if not open_now or open_now.pop() != _PAIRS[c]:
                return None
            if not open_now:
                return text[at : at + m.end()]
    return None


def test_inputs(text: str) -> list[str]:
    """The inputs of a test as literals' texts; none if there is no list that can be read."""
    shaped = re.search(P.INPUTS_BEFORE_RESULTS, text)
    for found in (shaped and shaped[1], list_after_inputs(text)):
        if found:
            try:
                return [repr(x) for x in literal_value(found)]
            except (ValueError, TypeError):
                continue
    return []


def tagged(value) -> object:
    """A literal as JSON: tuples, sets and numbers that JSON lacks carry a tag."""
    if isinstance(value, (tuple, set, frozenset)):
        items = sorted(value, key=repr) if isinstance(value, (set, frozenset)) else value
        return {"#": "tuple" if isinstance(value, tuple) else "set", "items": [tagged(x) for x in items]}
    if isinstance(value, list):
        return [tagged(x) for x in value]
    if isinstance(value, dict):
        return {"#": "dict", "items": [[tagged(k), tagged(v)] for k, v in value.items()]}
    if isinstance(value, float) and not math.isfinite(value):
        return {"#": "float", "items": [repr(value)]}
    return value if isinstance(value, (int, float, str, bool)) or value is None else {"#": type(value).__name__, "items": [repr(value)]}


def parsed_or_text(line: str) -> str:
    """JSON of a literal line; the line itself, as a JSON string, if it is none."""
    try:
        return json.dumps(tagged(literal_value(line)))
    except ValueError:
        return json.dumps(line)


def sequence_items(text: str) -> list[str]:
    """Items of a list literal as texts, bare block names understood; [] for what can't be read, one item for another value."""
    repaired = re.sub(r"(?<!['\w])(B\d+)(?!['\w])", r"'\1'", text.replace('"', "'"))
    for t in (text, repaired):
        try:
            value = literal_value(t)
        except ValueError:
            continue
        if value is None or value == [] or value == ():
            return []
        return [str(x) for x in value] if isinstance(value, (list, tuple)) else [str(value)]
    return []


@lru_cache(maxsize=4)
def tree_of(code: str) -> ast.Module:
    """The syntax tree of a program; one parse for all that is asked of it in a row. Not to be changed."""
    return ast.parse(code)


def syntax(code: str) -> tuple[bool, str]:
    try:
        tree_of(code)
    except (SyntaxError, ValueError, RecursionError) as e:
        return False, str(e)
    return True, ""


def functions(code: str) -> list[tuple[int, str, int, int, bool]]:
    """(ordinal, name, required, positional, takes any number) of the functions at top level; none if the code doesn't parse."""
    if not syntax(code)[0]:
        return []
    defs = [n for n in tree_of(code).body if isinstance(n, ast.FunctionDef)]
    sized = [(d, len(d.args.posonlyargs) + len(d.args.args)) for d in defs]
    return [(i, d.name, n - len(d.args.defaults), n, d.args.vararg is not None) for i, (d, n) in enumerate(sized)]


def arity(literal: str) -> int:
    try:
        value = literal_value(literal)
    except ValueError:
        return 1
    return len(value) if isinstance(value, (list, tuple)) else 1


def called_function(code: str, inputs: list[str] | None = None, preferred: str | None = None, default: str | None = None) -> str | None:
    """The function that a runner calls: the preferred one, else the last that takes all inputs, else the last."""
    found = functions(code)
    if not found:
        return default
    if preferred in {f[1] for f in found}:
        return preferred
    sizes = {arity(x) for x in inputs or []}
    fits = [name for _, name, need, most, any_number in found if sizes and all(need <= n and (any_number or n <= most) for n in sizes)]
    return (fits or [f[1] for f in found])[-1]


def inputs_span(code: str) -> tuple[int, int] | None:
    """First and last line (from 1) of the top-level assignment to inputs."""
    if not syntax(code)[0]:
        return None
    for node in tree_of(code).body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "inputs" for t in node.targets):
            return node.lineno, node.end_lineno
    return None


def with_inputs(code: str, literals: list[str]) -> str | None:
    """code with its inputs replaced by literals; None if it has none."""
    span = inputs_span(code)
    if span is None:
        return None
    lines = code.split("\n")
    block = ["inputs = [", *[f"    {x.rstrip(',')}," for x in literals], "]"]
    return "\n".join([*lines[: span[0] - 1], *block, *lines[span[1] :]])


def shallow(value, depth: int = 2) -> str:
    """A rendering that goes depth containers deep."""
    if not isinstance(value, (list, tuple, set, frozenset, dict)):
        return repr(value)
    if depth <= 0:
        return f"<{type(value).__name__} of {len(value)}>"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{shallow(k, depth - 1)}: {shallow(v, depth - 1)}" for k, v in value.items()) + "}"
    ends = {"list": "[]", "tuple": "()"}.get(type(value).__name__, "{}")
    return ends[0] + ", ".join(shallow(x, depth - 1) for x in value) + ends[1]
