"""Runs named steps with dependencies: independent ones side by side, dependents after them, skipped where one failed."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass

QUERIES: dict = {}
#: Words of errors that another try does not mend.
FINAL = ("PATH_NOT_FOUND", "UNRESOLVED_COLUMN", "No module named")


@dataclass
class Step:
    name: str
    run: Callable[[], int]
    needs: tuple[str, ...] = ()


def run(steps: list[Step], tries: int = 3, pause_s: float = 5.0) -> list[tuple[str, str, int, float, str]]:
    """(name, status, rows, seconds, error) of each step; status is ok, failed or skipped. Cyclic steps are skipped."""
    done: dict[str, tuple] = {}

    def attempt(step: Step) -> tuple:
        began, error = time.time(), ""
        for i in range(tries):
            try:
                return step.name, "ok", step.run(), time.time() - began, ""
            except Exception as e:  # the log tells; dependents are skipped
                error = f"{type(e).__name__}: {e}"[:500]
                if any(w in error for w in FINAL):
                    break
                if i + 1 < tries:
                    time.sleep(pause_s)
        return step.name, "failed", 0, time.time() - began, error

    with ThreadPoolExecutor() as pool:
        open_, running = {s.name: s for s in steps}, {}
        while open_ or running:
            for s in list(open_.values()):
                states = [done.get(n) for n in s.needs]
                if any(x and x[1] != "ok" for x in states):
                    done[s.name] = (s.name, "skipped", 0, 0.0, "")
                elif all(states):
                    running[pool.submit(attempt, s)] = s.name
                else:
                    continue
                del open_[s.name]
            if running:
                for f in wait(running, return_when=FIRST_COMPLETED).done:
                    done[running.pop(f)] = f.result()
            elif open_ and not any(n in done for s in open_.values() for n in s.needs):
                done |= {n: (n, "skipped", 0, 0.0, "needs a step that never runs") for n in open_}
                open_ = {}
    return [done[s.name] for s in steps]
