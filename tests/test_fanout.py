"""Concurrent calls: time, order, rate, and answers that outlive the task that got them."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from traceloom.operators import execute, fanout


@pytest.fixture
def server():
    """A slow service that answers with the prompt, and what it was asked."""
    asked, lock, now, most = Counter(), threading.Lock(), [0], [0]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"]
            with lock:
                asked[prompt] += 1
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.05 if prompt.startswith("quick") else 0.4)
            with lock:
                now[0] -= 1
            body = json.dumps({"choices": [{"message": {"content": f"<result>\n{prompt}\n</result>"}}]}).encode()
            self.send_response(500 if prompt == "bad" else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    found = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=found.serve_forever, daemon=True).start()
    found.asked, found.most = asked, most
    yield found
    found.shutdown()


def prompts(spark, n, name="slow"):
    return spark.createDataFrame([(i, f"k{i}", f"{name} {i}") for i in range(n)], "n long, k string, prompt string").coalesce(1)


def service(server):
    address = f"http://127.0.0.1:{server.server_address[1]}"
    return lambda: execute.Service(address, "m")


def test_calls_of_a_partition_overlap(spark, server):
    took = {}
    for at_once in (1, 6):
        execute.predict(prompts(spark, 1, "quick"), ["n", "k"], service(server), 1, 1, at_once).collect()  # workers are up
        began = time.monotonic()
        rows = execute.predict(prompts(spark, 12), ["n", "k"], service(server), 1, 1, at_once).collect()
        took[at_once] = time.monotonic() - began
        assert {(r.n, r.k, r.status, r.result) for r in rows} == {(i, f"k{i}", "ok", f"slow {i}") for i in range(12)}
    assert took[1] > 12 * 0.4 and took[6] < took[1] / 3
    assert server.most[0] == 6


def test_answers_come_in_order_of_completion_and_items_are_drawn_late():
    drawn, running = [], []

    def items():
        for i in range(20):
            drawn.append(i)
            yield i

    def call(i):
        running.append(i)
        time.sleep(0.3 if i == 0 else 0.01)
        return -i

    got = []
    for x, y in fanout.completed(items(), call, 3):
        assert y == -x and len(drawn) - len(got) <= 3
        got.append(x)
    assert sorted(got) == list(range(20)) and got[0] != 0
    assert list(fanout.completed([], call, 3)) == []


def test_an_error_ends_the_calls():
    def call(i):
        if i == 4:
            raise RuntimeError("four")
        return i

    with pytest.raises(RuntimeError, match="four"):
        list(fanout.completed(range(1000), call, 2))


def test_pace_spreads_starts():
    slept, now = [], [10.0]
    pace = fanout.Pace(4, clock=lambda: now[0], sleep=slept.append)
    for _ in range(5):
        pace.wait()
    assert slept == [0.25, 0.5, 0.75, 1.0]
    now[0] = 100.0
    pace.wait()
    assert len(slept) == 4
    fanout.Pace(None, sleep=slept.append).wait()
    assert len(slept) == 4


def test_the_rate_is_that_of_all_partitions_together(spark, server):
    execute.predict(prompts(spark, 2, "quick"), ["n"], service(server), 1, 4, 4).collect()
    began = time.monotonic()
    rows = execute.predict(prompts(spark, 20, "quick"), ["n"], service(server), 1, 4, 4, per_second=10).collect()
    assert len(rows) == 20 and time.monotonic() - began > 0.9


def dying(after, make):
    """A predictor that answers a few prompts, then ends its process as a lost executor would."""

    class Dying:
        def __init__(self):
            self.left, self.inner = after, make()

        def answer(self, key, prompt):
            import os

            self.left -= 1
            if self.left < 0:
                os._exit(1)
            return self.inner.answer(key, prompt)

    return Dying


def test_answers_outlive_their_task(spark, server, tmp_path):
    folder = f"file://{tmp_path}/journal"
    asked = prompts(spark, 10, "quick")
    make = service(server)
    with pytest.raises(Exception):
        execute.predict(asked, ["n", "k"], dying(4, make), 1, 1, journal=folder).collect()
    before = sum(server.asked.values())
    assert before == 4
    rows = execute.predict(asked, ["n", "k"], make, 1, 1, 3, journal=folder).collect()
    assert {(r.n, r.result) for r in rows} == {(i, f"quick {i}") for i in range(10)}
    assert sum(server.asked.values()) == 10 and max(server.asked.values()) == 1
    again = execute.predict(asked, ["n", "k"], make, 1, 1, 3, journal=folder).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows)) and sum(server.asked.values()) == 10
    changed = execute.predict(asked.selectExpr("n", "k", "'quick other ' || n AS prompt"), ["n", "k"], make, 1, 1, 3, journal=folder).collect()
    assert {r.result for r in changed} == {f"quick other {i}" for i in range(10)}


def test_failures_and_empty_prompts_are_no_answers(spark, server, tmp_path):
    rows = spark.createDataFrame([(1, "bad"), (2, None), (None, "quick x")], "n long, prompt string")
    for _ in range(2):
        got = {r.n: (r.status, r.result) for r in execute.predict(rows, ["n"], service(server), 1, 2, 2, journal=f"file://{tmp_path}/j").collect()}
        assert got[1] == ("empty", "ERROR: empty") and got[None] == ("ok", "quick x")
    assert server.asked["bad"] == 2 and server.asked["quick x"] == 1


def test_a_torn_line_is_passed_over(tmp_path):
    log = fanout.Journal(f"file://{tmp_path}", 3)
    for i in range(20):
        log.put("k", f"p{i}", f"a{i}")
    log.close()
    files = sorted(tmp_path.glob("part-000003-*"))
    assert len(files) == 3
    files[0].write_bytes(files[0].read_bytes()[:-9])
    back = fanout.Journal(f"file://{tmp_path}", 3)
    assert len(back.known) == 19 and not fanout.Journal(f"file://{tmp_path}", 4).known
