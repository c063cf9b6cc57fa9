"""Calls to clients outside Spark from inside a task: some at once, in order, tried again where that can help."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Retry:
    """How often a call is tried, the wait before the second try, and its growth from try to try.

    ``worth`` says for an exception if another try can help.
    """

    tries: int = 1
    wait: float = 0.5
    growth: float = 2.0
    worth: Callable[[Exception], bool] = lambda failure: True

    def call(self, run: Callable[..., Any], *arguments: Any) -> tuple[Any, str | None]:
        """What ``run`` gives, and None; or None, and the text of the last error."""
        wait = self.wait
        for left in range(max(1, self.tries) - 1, -1, -1):
            try:
                return run(*arguments), None
            except Exception as failure:
                if not left or not self.worth(failure):
                    return None, str(failure)
            time.sleep(wait)
            wait *= self.growth
        raise AssertionError("unreachable")


def in_order(
    run: Callable[..., Any], items: Iterable[tuple], in_flight: int = 1, retry: Retry = Retry()  # noqa: B008
) -> Iterator[tuple[Any, str | None]]:
    """Result and error of ``run(*item)`` for each item, in the order of the items.

    At most ``in_flight`` calls run at once and at most twice as many items are held, so items may be a long stream. With
    more than one the client has to bear calls from several threads.
    """
    if in_flight <= 1:
        for item in items:
            yield retry.call(run, *item)
        return
    with ThreadPoolExecutor(in_flight) as pool:
        waiting: deque[Future] = deque()
        for item in items:
            waiting.append(pool.submit(retry.call, run, *item))
            if len(waiting) >= 2 * in_flight:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()
