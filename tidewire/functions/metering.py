"""A meter around producers: one line of costs for each call, whatever its outcome."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import TypeVar

from tidewire import config as C

T = TypeVar("T")
PREFIX = "budget "


def whole(value: float | None) -> int:
    """A whole number that isn't negative; anything else is 0."""
    try:
        return int(value + 0.5) if value >= 0 and value != float("inf") else 0
    except (TypeError, ValueError, OverflowError):
        return 0


def line(p: str, ok: int, numbers: dict[str, float], st: str | None = None) -> str:
    out = {"p": p, "ok": 1 if ok == 1 else 0, **{k: whole(numbers.get(k, 0)) for k in C.BUDGET_KEYS[2:]}}
    if p == "ssvc":
        out["st"] = st if st in C.SSVC_STATES else "failed"
    return PREFIX + json.dumps(out, separators=(",", ":"))


def metered(p: str, run: Callable[[], T], describe: Callable[[T], dict], emit: Callable[[str], None] = print) -> T:
    """What `run` returns, or its error as it is; either way one line goes to `emit`. Describing and emitting never change the outcome."""
    wall, cpu = time.perf_counter(), time.process_time()

    def spent() -> dict[str, float]:
        return {"ms": (time.perf_counter() - wall) * 1000, "cpuMs": (time.process_time() - cpu) * 1000}

    def tell(ok: int, more: Callable[[], dict]) -> None:
        cost = spent()
        try:
            extra = more()
            emit(line(p, extra.pop("ok", ok), {**extra, **cost}, extra.pop("st", None)))
        except Exception:  # logging isn't the producer's business
            pass

    try:
        value = run()
    except BaseException:
        tell(0, dict)
        raise
    tell(1, lambda: dict(describe(value)))
    return value
