"""What stands between ``translate`` and an outside engine: retries, pieces, batches by number, and a chain of engines."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass

from ..functions import semijson as J
from ..functions.service import batch_prompt
from .glossary import split_for_limit


class Unavailable(Exception):
    """A failure that may pass; ``wait`` is what the service asked for, in seconds."""

    def __init__(self, message: str, wait: float | None = None):
        super().__init__(message)
        self.wait = wait


@dataclass(frozen=True)
class Answer:
    """A translation, the engine that gave it, and what a reader should know; ``text`` is None where all engines failed."""

    text: str | None
    engine: str
    warn: str = ""


def retried(call: Callable[[str], str], attempts: int = 3, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> Callable[[str], str]:
    """``call`` again after failures that may pass: after what the service asks, else half a second doubling, ten seconds at most."""

    def run(text: str) -> str:
        for k in range(attempts):
            try:
                return call(text)
            except Unavailable as e:
                if k + 1 == attempts:
                    raise
                sleep(min(10.0, e.wait if e.wait else 0.5 * 2**k + 0.1 * jitter()))
        raise AssertionError

    return run


def in_pieces(call: Callable[[str], str], limit: int = 480) -> Callable[[str], tuple[str, str]]:
    """``call`` on pieces of at most ``limit`` characters, joined again, with a warning where there were several."""

    def run(text: str) -> tuple[str, str]:
        if len(text) <= limit:
            return call(text), ""
        parts = split_for_limit(text, limit)
        return "".join(call(p) for p in parts), f"{len(text)} characters are more than {limit}: translated in {len(parts)} pieces"

    return run


def chain(engines: list[tuple[str, Callable[[str], str | tuple[str, str]]]]) -> Callable[[str], Answer]:
    """The first engine that answers; an empty answer is a failure. If all fail, the answer says why each did."""

    def run(text: str) -> Answer:
        faults = []
        for name, call in engines:
            try:
                said = call(text)
                said, warn = said if isinstance(said, tuple) else (said, "")
                if said and said.strip():
                    return Answer(said.strip(), name, warn)
                faults.append(f"{name}: empty answer")
            except Exception as e:  # an engine's own errors are as many as engines
                faults.append(f"{name}: {e}")
        return Answer(None, "failed", "; ".join(faults))

    return run


def batched(ask: Callable[[str], str], one: Callable[[str], str], lang: str = "zh-CN") -> Callable[[list[str]], list[str | None]]:
    """A list of texts in one request, matched by the numbers of its answers; what it left out is asked for one by one.

    ``ask`` takes a prompt, ``one`` a text. A failure of a single text leaves None in its place, so the others are not lost.
    """

    def run(texts: list[str]) -> list[str | None]:
        try:
            said = J.answers_of(ask(batch_prompt(texts, lang)), len(texts))
        except Unavailable:  # the texts are asked for on their own
            said = [None] * len(texts)

        def alone(t: str) -> str | None:
            try:
                return one(t) or None
            except Unavailable:
                return None

        return [s or alone(t) for s, t in zip(said, texts, strict=True)]

    return run
