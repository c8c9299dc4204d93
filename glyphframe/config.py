"""Settings, as frozen records whose values become literals in the plans."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RegionConfig:
    """How detections become regions, and regions runs. None switches a limit off, or for min_track means half a second."""

    pad: int = 12
    grid: int = 16
    merge_gap: int = 24
    min_height: int = 8
    min_area: int = 120
    roi: tuple[float, float, float, float] | None = None
    max_tilt: float | None = 4.0
    max_motion: float | None = 0.02
    rec_score: float = 0.55
    rec_min_chars: int = 2
    track_score: float = 0.60
    min_track: int | None = None
    max_gap: int = 3
    sticky_iou: float = 0.8
    link_iou: float = 0.3
    link_horizon: int = 12


@dataclass(frozen=True)
class CompositeConfig:
    mask_low: float = 0.35
    mask_high: float = 0.65
    binary: bool = False
    dilate: float = 0.70
    feather: float = 0.70
    heal: bool = False
    heal_radius: int = 6
    opacity: float = 1.0
    text_value: float | None = None


@dataclass(frozen=True)
class FrameSize:
    width: int = 1920
    height: int = 1080
    fps: float = 24.0


def resolve_min_track(cfg: RegionConfig, fps: float) -> int:
    """The least number of observed frames: as set, or half a second rounded half to even, two at least."""
    return max(1, int(cfg.min_track)) if cfg.min_track is not None else max(2, round(0.5 * fps))
