"""Steps of work with their results as marks: what is done is skipped, a deadline stops a queue, a failure stops its own condition only."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass


class Stopped(Exception):
    """A step ended at the deadline, with its progress kept."""


@dataclass(frozen=True)
class Step:
    """``done`` tells whether the result exists; ``run`` gets the seconds left and makes it, or raises Stopped."""

    name: str
    done: Callable[[], bool]
    run: Callable[[float], None]


def run_steps(steps: list[Step], deadline: float, clock: Callable[[], float] = time.monotonic) -> list[str]:
    """Runs the steps not done yet, in order, and names them; a step that ends without its result fails."""
    ran = []
    for step in steps:
        if step.done():
            continue
        left = deadline - clock()
        if left <= 0:
            raise Stopped(step.name)
        step.run(left)
        if not step.done():
            raise RuntimeError(f"{step.name} ended without its result")
        ran.append(step.name)
    return ran


def run_queue(conditions: dict[str, list[Step]], deadline: float, clock: Callable[[], float] = time.monotonic) -> dict[str, dict]:
    """The outcome of each condition: done with the steps that ran, incomplete at a step, failed with its error, or not started."""
    out, waiting = {}, list(conditions)
    while waiting:
        name = waiting.pop(0)
        try:
            out[name] = {"status": "done", "ran": run_steps(conditions[name], deadline, clock)}
        except Stopped as stop:
            out[name] = {"status": "incomplete", "at": str(stop)}
            out.update({rest: {"status": "not started"} for rest in waiting})
            break
        except Exception as error:  # noqa: BLE001  one condition's failure is reported, the others go on
            out[name] = {"status": "failed", "error": f"{type(error).__name__}: {error}"}
    return out


def exit_code(outcome: dict[str, dict]) -> int:
    """1 if a condition failed, 3 if one is left, else 0."""
    states = {x["status"] for x in outcome.values()}
    return 1 if "failed" in states else 3 if states - {"done"} else 0
