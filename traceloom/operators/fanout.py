"""Many slow calls at once from inside a partition: a bounded pool, a shared rate, and a journal of what was answered.

A partition keeps at most so many calls in flight and gives answers back in the order in which they come, with the rows they
belong to. A rate limit is dealt out to the tasks that can run at a time. A journal in a folder that all executors
see has each answer as soon as it is there: a task that runs again, or a query, asks only what has no answer yet.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

from pyarrow import fs


def completed[T, R](items: Iterable[T], call: Callable[[T], R], at_once: int) -> Iterator[tuple[T, R]]:
    """(item, call(item)) in order of completion, at most at_once calls in flight; items are drawn as calls end."""
    if at_once <= 1:
        for x in items:
            yield x, call(x)
        return
    pool = ThreadPoolExecutor(at_once)
    running: dict[Future, T] = {}
    try:
        for x in items:
            running[pool.submit(call, x)] = x
            if len(running) >= at_once:
                for f in wait(running, return_when=FIRST_COMPLETED).done:
                    yield running.pop(f), f.result()
        while running:
            for f in wait(running, return_when=FIRST_COMPLETED).done:
                yield running.pop(f), f.result()
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


class Pace:
    """Starts at most so many calls a second, evenly; None: any number. Threads share one."""

    def __init__(self, per_second: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap = 1 / per_second if per_second else 0.0
        self.next, self.lock, self.clock, self.sleep = 0.0, threading.Lock(), clock, sleep

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            now = self.clock()
            at = max(self.next, now)
            self.next = at + self.gap
        if at > now:
            self.sleep(at - now)


class Journal:
    """Answers of one partition in a folder (any file system that Arrow opens), by the digest of key and prompt.

    Each attempt writes files of its own, one every few answers, since object stores keep a file only when it is closed; a torn
    last line is passed over. What an earlier attempt answered is read once, when a partition begins.
    """

    #: Answers in a file.
    EVERY = 8

    def __init__(self, folder: str, partition: int):
        self.files, self.path = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.path, recursive=True)
        self.name, self.out, self.held = f"part-{partition:06d}-", None, 0
        self.known: dict[str, str] = {}
        for info in self.files.get_file_info(fs.FileSelector(self.path)):
            if info.base_name.startswith(self.name):
                with self.files.open_input_stream(info.path) as f:
                    for line in f.read().split(b"\n"):
                        try:
                            digest, answer = json.loads(line)
                        except ValueError:
                            continue
                        self.known[digest] = answer

    @staticmethod
    def digest(key: str, prompt: str) -> str:
        return hashlib.sha256(f"{len(key)}:{key}{prompt}".encode("utf-8", "surrogatepass")).hexdigest()

    def put(self, key: str, prompt: str, answer: str) -> None:
        if self.out is None:
            self.out, self.held = self.files.open_output_stream(f"{self.path}/{self.name}{uuid.uuid4().hex}.jsonl"), 0
        self.out.write(json.dumps([self.digest(key, prompt), answer]).encode() + b"\n")
        self.out.flush()
        self.held += 1
        if self.held >= self.EVERY:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
