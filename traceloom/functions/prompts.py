"""Prompts as column templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _told(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


ANSWER = "\n\nGive the answer between <result> and </result> and nothing else."


def equivalent(code: Column) -> Column:
    return _told("Rewrite this Python program so that it reads differently and prints the same for every input. Keep its functions' names.\n\n", code, ANSWER)


def non_equivalent(code: Column, inputs: Column) -> Column:
    return _told("Change this Python program in one small, natural way, so that at least one of the inputs below gives another output. It has to run without errors.\n\n", code, "\n\nInputs, one per line:\n", inputs, ANSWER)


def repair(code: Column, mutant: Column, inputs: Column, outputs: Column, reason: Column) -> Column:
    return _told("This change of a program was rejected: ", reason, "\n\nOriginal:\n", code, "\n\nRejected:\n", mutant, "\n\nInputs:\n", inputs, "\n\nOutputs of the original:\n", outputs, "\n\nWrite another version whose outputs differ on at least one input.", ANSWER)


def feedback(code: Column, mutant: Column, examples: Column) -> Column:
    return _told("The second program was to behave as asked of the first but doesn't on these cases:\n", examples, "\n\nFirst:\n", code, "\n\nSecond:\n", mutant, "\n\nCorrect the second.", ANSWER)


def predict_output(script: Column) -> Column:
    return _told("What does this program print? One line per output, in order.\n\n", script, ANSWER)


def predict_variables(script: Column) -> Column:
    return _told("List each variable of this program with the values that it takes in order, as 'name': [values], one variable per line.\n\n", script, ANSWER)


def predict_blocks(script: Column, cfg: Column, variable: Column) -> Column:
    return _told("These are the basic blocks of the program below:\n", cfg, "\n\nProgram:\n", script, "\n\nGive the blocks in the order in which they run as 'block_sequence': [...], and the values of ", variable, " as '", variable, "': [...].", ANSWER)
