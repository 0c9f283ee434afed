"""Programs that report their own writes: a rewrite of the syntax tree, without a tracer.

After every statement that writes to variables a call of the hook is put, with an iid for each variable and its value then;
loop targets, `with` targets, caught exceptions and captures of `match` report at the start of their bodies, a walrus in place.
A write to an item or an attribute is a write to the variable it is reached from. The iid-to-span map has the target's place in
the original source. Definitions, imports, parameters and the targets of comprehensions are no writes.
"""

from __future__ import annotations

import ast
import copy

from traceloom.functions.programs import tree_of

HOOK = "_write_event"


def _leaves(target: ast.expr) -> list[ast.expr]:
    """The names, items and attributes that an assignment to target writes, left to right."""
    match target:
        case ast.Tuple(elts=items) | ast.List(elts=items):
            return [leaf for x in items for leaf in _leaves(x)]
        case ast.Starred(value=x):
            return _leaves(x)
    return [target]


def _variable(leaf: ast.expr) -> str | None:
    """The variable that a leaf writes, or is reached from; None if that is no name, as in f().x = 1."""
    while isinstance(leaf, ast.Subscript | ast.Attribute):
        leaf = leaf.value
    return leaf.id if isinstance(leaf, ast.Name) else None


def _captures(pattern: ast.AST) -> list[ast.AST]:
    """The places of a case pattern that bind a name, in order."""
    own = [pattern] if getattr(pattern, "rest", None) or isinstance(pattern, ast.MatchAs | ast.MatchStar) and pattern.name else []
    return [found for child in ast.iter_child_nodes(pattern) for found in _captures(child)] + own


class _Rewrite(ast.NodeTransformer):
    def __init__(self):
        self.spans: list[tuple[int, str, int, int, int, int]] = []

    def event(self, node: ast.AST, name: str, value: ast.expr | None = None) -> ast.Call:
        """A call of the hook for a write to name at node; the hook returns the value."""
        iid = len(self.spans) + 1
        self.spans.append((iid, name, node.lineno, node.col_offset, node.end_lineno, node.end_col_offset))
        call = ast.Call(ast.Name(HOOK, ast.Load()), [ast.Constant(iid), value or ast.Name(name, ast.Load())], [])
        return ast.copy_location(call, node)

    def after(self, *targets: ast.expr) -> list[ast.stmt]:
        """Events of the variables that targets write, one each."""
        calls = [self.event(leaf, name) for t in targets for leaf in _leaves(t) if (name := _variable(leaf))]
        return [ast.copy_location(ast.Expr(c), c) for c in calls]

    def visit_Assign(self, node: ast.Assign):
        self.generic_visit(node)
        return [node, *self.after(*node.targets)]

    def visit_AugAssign(self, node: ast.AugAssign):
        self.generic_visit(node)
        return [node, *self.after(node.target)]

    def visit_AnnAssign(self, node: ast.AnnAssign):
        self.generic_visit(node)
        return [node, *self.after(node.target)] if node.value else node

    def visit_NamedExpr(self, node: ast.NamedExpr):
        self.generic_visit(node)
        node.value = self.event(node.target, node.target.id, node.value)
        return node

    def visit_For(self, node):
        first = self.after(node.target)
        self.generic_visit(node)
        node.body = first + node.body
        return node

    visit_AsyncFor = visit_For

    def visit_With(self, node):
        first = self.after(*[x.optional_vars for x in node.items if x.optional_vars])
        self.generic_visit(node)
        node.body = first + node.body
        return node

    visit_AsyncWith = visit_With

    def visit_ExceptHandler(self, node: ast.ExceptHandler):
        first = [ast.copy_location(ast.Expr(self.event(node, node.name)), node)] if node.name else []
        self.generic_visit(node)
        node.body = first + node.body
        return node

    def visit_match_case(self, node: ast.match_case):
        calls = [self.event(x, getattr(x, "rest", None) or x.name) for x in _captures(node.pattern)]
        self.generic_visit(node)
        node.body = [ast.copy_location(ast.Expr(c), c) for c in calls] + node.body
        return node


def instrumented(code: str) -> tuple[str | None, list[tuple[int, str, int, int, int, int]]]:
    """The program with hooks, and (iid, variable, start line, start column, end line, end column) of each write, columns in characters.

    None, and no spans, for code that doesn't parse.
    """
    try:
        tree = tree_of(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None, []
    rewrite = _Rewrite()
    new = ast.unparse(ast.fix_missing_locations(rewrite.visit(copy.deepcopy(tree))))
    lines = [x.encode() for x in code.splitlines(keepends=True)]
    column = lambda line, at: len(lines[line - 1][:at].decode(errors="replace")) if line <= len(lines) else at
    return new + "\n", [(iid, name, a, column(a, b), c, column(c, d)) for iid, name, a, b, c, d in rewrite.spans]
