"""What a caller may write for settings, checked."""

from __future__ import annotations


def roi(value: str) -> tuple[float, float, float, float]:
    """Four shares x0,y0,x1,y1 of the frame, each pair in order."""
    parts = tuple(float(v) for v in value.split(","))
    if len(parts) != 4 or not (0 <= parts[0] < parts[2] <= 1 and 0 <= parts[1] < parts[3] <= 1):
        raise ValueError(f"not four shares in order: {value}")
    return parts


def quality(value: str) -> str:
    """lossless, or a rate factor from 0 to 51."""
    text = value.strip().lower()
    if text != "lossless" and not (text.isdigit() and int(text) <= 51):
        raise ValueError(f"neither lossless nor 0 to 51: {value}")
    return text


def run_ids(value: str) -> tuple[int, ...]:
    ids = tuple(int(v) for v in value.split(",") if v.strip())
    if any(i < 0 for i in ids):
        raise ValueError(f"run ids aren't negative: {value}")
    return ids


def text_value(value: str) -> float | None:
    """auto (None) or a level from 0 to 255."""
    if value.strip().lower() == "auto":
        return None
    level = float(value)
    if not 0 <= level <= 255:
        raise ValueError(f"neither auto nor 0 to 255: {value}")
    return level
