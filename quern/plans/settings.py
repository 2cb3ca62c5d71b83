"""Small parsers and rules of the command line and the service functions."""

from __future__ import annotations

import os


def parse_ints(text: str, least: int | None = None) -> list[int]:
    """A comma-separated list; an empty list, or a value below ``least``, is an error."""
    out = [int(x) for x in text.split(",") if x.strip()]
    if not out or (least is not None and min(out) < least):
        raise ValueError(f"no list of whole numbers: {text!r}")
    return out


def clamp_k(value: str | None, default: int = 10, most: int = 100) -> int:
    """The number of results asked for: the default where it is none or not positive, ``most`` where it is larger."""
    try:
        k = int(value or "")
    except ValueError:
        return default
    return default if k <= 0 else min(k, most)


def window_margin(longest: int | None, max_len: int | None, reserve: int = 128) -> str:
    """'ok' if the longest text and a reserve fit the model's window, 'refuse' if not, 'unverifiable' if either is unknown."""
    if not longest or not max_len or longest <= 0 or max_len <= 0:
        return "unverifiable"
    return "ok" if longest + reserve <= max_len else "refuse"


def medium_of(rotational: str | None) -> str:
    """Storage medium by the kernel's flag."""
    return {"1": "rotational", "0": "ssd"}.get((rotational or "").strip(), "unknown")


def storage_medium(path: str) -> str:
    """Medium of the device that holds ``path``; 'unknown' where the kernel does not tell."""
    try:
        dev = os.stat(path).st_dev
        base = f"/sys/dev/block/{os.major(dev)}:{os.minor(dev)}"
        for p in (f"{base}/queue/rotational", f"{base}/../queue/rotational"):
            if os.path.exists(p):
                with open(p) as f:
                    return medium_of(f.read())
    except OSError:
        pass
    return "unknown"


def verdict_overlap(mean: float, n_empty: int, loads: int = 0) -> bool:
    return mean >= 0.90 and n_empty == 0 and loads == 0


def verdict_hybrid(recall: float, dense_recall: float, p95: float, dense_p95: float) -> bool:
    return recall >= dense_recall - 0.005 and p95 <= 1.2 * dense_p95


def verdict_insert(rebuilt: list[float], incremental: list[float]) -> bool:
    return max(a - b for a, b in zip(rebuilt, incremental)) <= 0.01
