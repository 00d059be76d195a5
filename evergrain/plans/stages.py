"""The stage machine: ordered stages, each isolated; a failure of a guarding stage stops the run, others leave it partial."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

GUARDS = ("snapshot", "migrate")
ORDER = ("snapshot", "migrate", "harvest", "injection_scan", "review", "compile", "autolabel", "embed", "tripwires", "promote", "excerpt_render", "maintain", "dataset_mine", "dataset_export")


@dataclass
class Run:
    status: str = "ok"
    stages: list[dict] = field(default_factory=list)


def run_stages(stages: dict[str, Callable[[], dict]], only: tuple[str, ...] = ORDER, budget_seconds: float | None = None, clock: Callable[[], float] = time.monotonic) -> Run:
    """Runs the named stages in order and records what each returned or raised; past the budget the rest is skipped."""
    run, began = Run(), clock()
    for name in (n for n in ORDER if n in only and n in stages):
        if budget_seconds is not None and clock() - began > budget_seconds:
            run.stages.append({"stage": name, "state": "skipped"})
            run.status = "partial" if run.status == "ok" else run.status
            continue
        try:
            run.stages.append({"stage": name, "state": "done", "result": stages[name]()})
        except Exception as e:  # noqa: BLE001  a stage's failure is its result
            run.stages.append({"stage": name, "state": "failed", "error": f"{type(e).__name__}: {e}"})
            if name in GUARDS:
                run.status = "aborted"
                return run
            run.status = "partial"
    return run
