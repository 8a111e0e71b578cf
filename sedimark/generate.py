"""Calling text generators that may fail for a while."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

log = logging.getLogger(__name__)


class Unavailable(RuntimeError):
    """A failure that may pass: too many requests, a server error, high demand."""


def with_retries(models: list[Callable[[str], str]], attempts: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """A generator that tries each model up to ``attempts`` times, waiting twice as long after each failure, then the next.

    Only :class:`Unavailable` is tried again; a model that fails otherwise is left at once. The last failure is raised
    where none answers.
    """

    def generate(prompt: str) -> str:
        last: Exception = Unavailable("there is no model")
        for number, model in enumerate(models):
            for turn in range(attempts):
                try:
                    return model(prompt)
                except Unavailable as error:
                    last = error
                    log.warning("model %d failed, attempt %d: %s", number, turn + 1, error)
                    if turn + 1 < attempts:
                        sleep(wait * 2**turn)
                except Exception as error:
                    last = error
                    log.warning("model %d failed: %s", number, error)
                    break
        raise last

    return generate
