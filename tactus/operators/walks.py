"""Walks over times in order whose state is a few numbers, for series in a sorted partition and for streams."""

from __future__ import annotations

import math

#: Periods by which a tempo walk moves on one by one, as sums are rounded.
STEPS = 4096


class CollapseWalk:
    """Of peaks closer than `gap` to the kept one before, only the strongest stays; a stronger one takes its time and value."""

    def __init__(self, gap: float):
        self.gap, self.state = gap, {}

    def peak(self, t: float, v: float) -> list[tuple[float, float]]:
        """A kept peak that this one, the next in order, can't change any more."""
        done = self.close(t)
        if "t" not in self.state or v > self.state["v"]:
            self.state = {"t": t, "v": v}
        return done

    def close(self, now: float) -> list[tuple[float, float]]:
        """The kept peak, once nothing from `now` on is near it."""
        if "t" not in self.state or now - self.state["t"] < self.gap:
            return []
        kept, self.state = (self.state["t"], self.state["v"]), {}
        return [kept]

    def due(self) -> float | None:
        """When close() has something to give."""
        return self.state["t"] + self.gap if "t" in self.state else None


class TempoWalk:
    """Peaks that a steady beat picks, see operators.scans.follow_tempo."""

    def __init__(self, share: float, least: float):
        self.share, self.least, self.state = share, least, {}

    def peak(self, t: float, v: float, period: float | None) -> list[float]:
        """Picked times that this peak, the next in order, settles. The first peak's period holds."""
        s = self.state
        if not s:
            step = float(period) if period is not None else 0.0
            s.update(step=step, half=max(self.share * step, self.least), want=t)
        if not (0 < s["step"] < math.inf):
            return [t]
        done = self.close(t)
        for _ in range(STEPS):
            if t < s["want"] + s["half"]:
                break
            s["want"] += s["step"]
        if t >= s["want"] + s["half"]:
            s["want"] += (math.floor((t - s["half"] - s["want"]) / s["step"]) + 1) * s["step"]
        if s["want"] - s["half"] <= t and ("t" not in s or v > s["v"]):
            s.update(t=t, v=v)
        return done

    def close(self, now: float = math.inf) -> list[float]:
        """The pick of the open window, once that ends at `now` or before."""
        s = self.state
        if "t" not in s or now < s["want"] + s["half"]:
            return []
        picked = s.pop("t")
        del s["v"]
        s["want"] = picked + s["step"]
        return [picked]

    def due(self) -> float | None:
        return self.state["want"] + self.state["half"] if "t" in self.state else None
