"""Three small tasks of our own for the stages that run programs, and answers for the replay predictor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ARITHMETIC = "def fun1(n):\n    result = 0\n    for i in range(n):\n        if i % 2 == 0:\n            result += i\n        else:\n            result -= 1\n    return result\n"
MUTATION = "def helper(x):\n    return x * 2\n\n\ndef fun1(items, extra=1):\n    items.append(extra)\n    result = [helper(x) for x in items]\n    return result\n"
ENDLESS = "def fun1(n):\n    while True:\n        n += 1\n    return n\n"

#: task_id, code, test, test_list, an equivalent variant, a non-equivalent variant, a variant that must be rejected.
TASKS = [
    ("task_1", ARITHMETIC, "inputs = [[2], [3], [0]]\nresults = [-1, 1, 0]\nfor i, (inp, exp) in enumerate(zip(inputs, results)):\n    assertion(fun1(*inp), exp, 0)", ["assert fun1(2) == -1"], ARITHMETIC.replace("result -= 1", "result = result - 1"), ARITHMETIC.replace("result -= 1", "result -= 2"), ARITHMETIC.replace("    return result", "    return result + ")),
    ("task_2", MUTATION, "inputs = [[[1, 2]], [[], 'a']]\nresults = [[2, 4, 2], ['aa']]\nassertion(fun1([1, 2]), [2, 4, 2], 0)", ["assert helper(1) == 2", "assert fun1([]) == [2]"], MUTATION.replace("x * 2", "x + x"), MUTATION.replace("x * 2", "x * 3"), MUTATION),
    ("task_10", ENDLESS, "inputs = [[1]]\nresults = [1]\n", ["fun1(1)"], ENDLESS, ENDLESS.replace("while True:", "while n < 5:"), ENDLESS),
]


def tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TASKS, "task_id string, code string, test string, test_list array<string>, equivalent string, non_equivalent string, rejected string")
