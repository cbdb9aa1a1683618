"""A task's calls of a slow function: several at once, with time limits and repeated tries."""

from __future__ import annotations

import heapq
import itertools
import queue
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class CallPolicy:
    """How a task calls: `in_flight` calls at once, each with at most `seconds` for a try.

    A call that raises or runs out of time is tried `tries` times in all, after `backoff` seconds
    and twice as many before each further try. With `keyed`, the function also gets the call's key.
    """

    in_flight: int = 1
    seconds: float | None = None
    tries: int = 1
    backoff: float = 1.0
    keyed: bool = False


@dataclass
class Answer:
    """What came of a call."""

    row: Any
    response: Any
    error: str | None
    tries: int
    finished_at: float


#: Calls that ran out of time and still hang; beyond these the task fails, and Spark repeats it elsewhere.
MOST_HANGING = 256


def answers(rows: Iterable, call: Callable[[Any], Any], policy: CallPolicy) -> Iterator[Answer]:
    """The answers to `call(row)` as they come, for rows that are read only when there is room for their calls."""
    if policy.in_flight == 1 and policy.seconds is None:
        yield from (_answered(row, call, policy) for row in rows)
        return
    rows, numbers = iter(rows), itertools.count()
    come: queue.SimpleQueue = queue.SimpleQueue()
    later: list[tuple[float, int, Any, int]] = []  # what is tried again: when, which, row, tries so far
    running: dict[int, tuple[Any, int, float]] = {}
    hanging, more = set(), True

    def run(number: int, row: Any) -> None:
        try:
            come.put((number, call(row), None))
        except Exception as error:
            come.put((number, None, str(error)))

    def start(row: Any, tries: int) -> None:
        number = next(numbers)
        until = time.monotonic() + policy.seconds if policy.seconds else float("inf")
        running[number] = (row, tries + 1, until)
        threading.Thread(target=run, args=(number, row), daemon=True).start()

    def ended(number: int, response: Any, error: str | None) -> Iterator[Answer]:
        row, tries, _ = running.pop(number)
        if error is not None and tries < policy.tries:
            ready = time.monotonic() + policy.backoff * 2 ** (tries - 1)
            heapq.heappush(later, (ready, number, row, tries))
        else:
            yield Answer(row, response, error, tries, time.time())

    while more or later or running:
        while len(running) < policy.in_flight:
            if later and later[0][0] <= time.monotonic():
                _, _, row, tries = heapq.heappop(later)
                start(row, tries)
                continue
            try:
                row = next(rows)
            except StopIteration:
                more = False
                break
            start(row, 0)
        room = len(running) < policy.in_flight
        times = [until for *_, until in running.values()] + ([later[0][0]] if later and room else [])
        wait = min(times, default=0.0) - time.monotonic()
        try:
            number, response, error = come.get(timeout=None if wait == float("inf") else max(wait, 0.0))
        except queue.Empty:
            number = None
        if number in running:
            yield from ended(number, response, error)
        hanging.discard(number)  # too late
        for number in [n for n, (*_, until) in running.items() if until <= time.monotonic()]:
            hanging.add(number)
            yield from ended(number, None, f"no answer within {policy.seconds} seconds")
        if len(hanging) > MOST_HANGING:
            raise TimeoutError(f"{len(hanging)} calls hang")


def _answered(row: Any, call: Callable[[Any], Any], policy: CallPolicy) -> Answer:
    """One call at a time, in this thread."""
    for tries in range(1, policy.tries + 1):
        try:
            return Answer(row, call(row), None, tries, time.time())
        except Exception as error:
            message = str(error)
        if tries < policy.tries:
            time.sleep(policy.backoff * 2 ** (tries - 1))
    return Answer(row, None, message, policy.tries, time.time())
