"""Retries of what the driver does itself; tasks are retried by Spark."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from importlib import import_module
from typing import Any, TypeVar

from ..spec import RetryOptions

log = logging.getLogger(__name__)
R = TypeVar("R")


class NoRetry:
    """Every failure is final."""

    def pause_ms(self) -> int:
        return -1


class ExponentialRetry:
    """Pauses that double, until they add up to the total; the first pause is always taken."""

    def __init__(self, base_delay_ms: int, total_delay_ms: int):
        if base_delay_ms > total_delay_ms:
            raise ValueError("the base delay is longer than the total delay")
        self.base, self.total, self.paused, self.attempts = base_delay_ms, total_delay_ms, 0, 0

    def pause_ms(self) -> int:
        """The next pause, or -1 if there is none."""
        if self.attempts and self.paused >= self.total:
            return -1
        left = self.total - self.paused
        pause = self.base if not self.attempts else min(left, self.base << min(self.attempts, 62))
        self.attempts += 1
        self.paused += pause
        return pause


Strategy = Callable[[], Any]


def strategy(options: RetryOptions | None) -> Strategy:
    """A maker of fresh strategies: ``exponential``, ``none``, or module.Class of (base, total); anything that cannot be
    made means no retries."""
    if options is None:
        return NoRetry
    try:
        if options.impl == "none":
            return NoRetry
        if options.impl == "exponential":
            made: Strategy = lambda: ExponentialRetry(options.base_delay_ms, options.total_delay_ms)
        else:
            module, _, cls = options.impl.rpartition(".")
            kind = getattr(import_module(module), cls)
            made = lambda: kind(options.base_delay_ms, options.total_delay_ms)
        made()
        return made
    except Exception:  # noqa: BLE001
        log.warning("no retries: %s cannot be made", options.impl, exc_info=True)
        return NoRetry


def retry(call: Callable[[], R], make: Strategy = NoRetry, but_not: tuple[type[BaseException], ...] = (), sleep: Callable[[float], None] = time.sleep) -> R:
    """Calls until it succeeds or the strategy gives up; errors of the types ``but_not`` are raised at once."""
    own = make()
    while True:
        try:
            return call()
        except Exception as error:
            pause = -1 if isinstance(error, but_not) else own.pause_ms()
            if pause < 0:
                raise
            log.warning("trying again in %d ms: %s", pause, error)
            sleep(pause / 1000)
