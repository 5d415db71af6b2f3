"""The part of image files that is asked for: only that is read."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


@dataclass
class Box:
    """Inclusive bounds of each axis and, where they are named, the images."""

    low: dict[str, int] = field(default_factory=dict)
    high: dict[str, int] = field(default_factory=dict)
    images: set[str] | None = None

    @classmethod
    def of_options(cls, options) -> Box:
        """Options x0, nx, y0, ny, z0, nz, and images, a JSON list of paths."""
        out = cls()
        for a in "xyz":
            out.low[a] = int(options.get(a + "0") or 0)
            if options.get("n" + a) is not None:
                out.high[a] = out.low[a] + int(options.get("n" + a)) - 1
        if options.get("images") is not None:
            out.images = set(json.loads(options.get("images")))
        return out

    def has(self, image: str) -> bool:
        return self.images is None or image in self.images

    def span(self, axis: str, n: int) -> tuple[int, int]:
        """First and one past the last of the n places of an axis; empty spans have both equal."""
        first = min(max(self.low[axis], 0), n)
        return first, max(first, min(n, self.high.get(axis, n - 1) + 1))


def options_of(images: list[str] | None = None, **bounds: int | tuple[int, int] | None) -> dict[str, str]:
    """Options for x, y, z given as one place or as (first, last)."""
    out = {} if images is None else {"images": json.dumps(list(images))}
    for a, told in bounds.items():
        if told is not None:
            first, last = told if isinstance(told, tuple) else (told, told)
            first = max(first, 0)
            out |= {a + "0": str(first), "n" + a: str(max(0, last - first + 1))}
    return out
