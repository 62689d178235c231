"""Which settings the sweeps run over, and how a run is named."""

from __future__ import annotations

from anchorline.operators.features import Windows

# fixed values: hours after the anchor
AFTER_HOURS = [48, 72, 96, 120, 144]


def run_name(anchor: str, vitals: tuple[int, int], labs: tuple[int, int]) -> str:
    return f"{anchor}_vb_{vitals[0]}_va_{vitals[1]}_lb_{labs[0]}_la_{labs[1]}"


def window_runs(anchor: str, before: int = 24, after_hours=AFTER_HOURS) -> dict[str, Windows]:
    """Run id -> windows, for every number of hours after the anchor."""
    return {
        run_name(anchor, (before, after), (before, after)): {"vital": (before, after), "lab": (before, after)}
        for after in after_hours
    }
