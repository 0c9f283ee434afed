"""Basic blocks of a program: a walk over its functions that yields blocks, edges and each line's block.

Which block owns a line is settled after the walk: of the blocks that claim it the one of the highest rank, the
earliest claim among equals. Block numbers, the joins that a branch leaves out and the lines that inner loops don't
win are part of the format that traces refer to.
"""

from __future__ import annotations

import ast
import dataclasses
from collections.abc import Iterable

from traceloom.functions.patterns import BLOCK_RANKS as RANKS
from traceloom.functions.programs import tree_of


@dataclasses.dataclass
class Block:
    number: int
    kind: str
    first: int
    last: int
    after: dict[int, None] = dataclasses.field(default_factory=dict)

    @property
    def name(self) -> str:
        return f"B{self.number}"


class Flow:
    """blocks in order of number; claims: (line, block number) in order of the walk."""

    def __init__(self, code: str):
        self.lines = code.splitlines()
        self.blocks: list[Block] = []
        self.claims: list[tuple[int, int]] = []
        try:
            tree = tree_of(code)
        except (SyntaxError, ValueError, RecursionError):
            return
        for f in self._outer_functions(tree):
            self._body(f.body, self._open("entry", f.lineno, f.lineno, None))

    @staticmethod
    def _outer_functions(tree: ast.AST) -> Iterable[ast.FunctionDef | ast.AsyncFunctionDef]:
        """Functions and methods that are in no other function, in source order."""
        todo = [tree]
        while todo:
            node = todo.pop()
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield node
            else:
                todo += reversed(list(ast.iter_child_nodes(node)))

    def _open(self, kind: str, first: int, last: int, before: Block | None) -> Block:
        block = Block(len(self.blocks), kind, first, last)
        self.blocks.append(block)
        self._claim(block, first, last)
        if before is not None:
            before.after[block.number] = None
        return block

    def _claim(self, block: Block, first: int, last: int) -> None:
        self.claims += [(n, block.number) for n in range(first, last + 1)]

    def _part(self, kind: str, body: list[ast.stmt], before: Block | None) -> Block:
        """A block over a body's lines, and then what is in it; the block where it ends."""
        return self._body(body, self._open(kind, body[0].lineno, body[-1].end_lineno, before))

    def _body(self, body: list[ast.stmt], at: Block | None) -> Block | None:
        for s in body:
            match s:
                case ast.If():
                    test = self._open("condition", s.lineno, s.lineno, at)
                    end = self._part("then", s.body, test)
                    # with an else, what follows is joined to the else alone
                    at = self._part("else", s.orelse, test) if s.orelse else end
                case ast.For() | ast.While():
                    head = self._open("loop_head", s.lineno, s.lineno, at)
                    self._part("loop_body", s.body, head).after[head.number] = None
                    at = head
                case ast.Return():
                    at = self._open("return", s.lineno, s.end_lineno, at)
                case ast.Try():
                    at = self._part("try", s.body, at)  # handlers are not followed
                case _ if at is not None and at.kind == "normal":
                    at.last = s.end_lineno
                    self._claim(at, s.lineno, s.end_lineno)
                case _:
                    at = self._open("normal", s.lineno, s.end_lineno, at)
        return at

    def owners(self) -> dict[int, int]:
        """Line to block number."""
        best: dict[int, int] = {}
        for line, number in self.claims:
            if line not in best or RANKS[self.blocks[number].kind] > RANKS[self.blocks[best[line]].kind]:
                best[line] = number
        return best

    def rows(self) -> list[tuple[str, str, int, int, list[int], list[str], str]]:
        """The blocks as CFG_BLOCKS rows; lines: those that a block held at some time of the walk."""
        held: dict[int, list[int]] = {b.number: [] for b in self.blocks}
        best: dict[int, int] = {}
        for line, number in self.claims:
            if line not in best or RANKS[self.blocks[number].kind] > RANKS[self.blocks[best[line]].kind]:
                best[line] = number
                if line not in held[number]:
                    held[number].append(line)
        text = lambda b: "\n".join(x.rstrip() for x in self.lines[b.first - 1 : b.last])
        return [(b.name, b.kind, b.first, b.last, held[b.number], [f"B{n}" for n in b.after], text(b)) for b in self.blocks]
