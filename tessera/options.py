"""Settings of a conversion, checked when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass

FORMATS = ("auto", "step", "fbx")


@dataclass(frozen=True)
class Options:
    """What to convert and how; ValueError says which setting is wrong.

    out_dir: folder of the tileset; content_subdir, tile_prefix: names of tile
    files, not empty; input_format: one of ``FORMATS`` in any case; viewer_sse:
    screen-space error that the viewer aims at, above 0; min_size_ratio: items
    smaller than this share of their tile are left out, finite and 0 or more.
    """

    input_path: str
    out_dir: str = "out"
    content_subdir: str = "tiles"
    tile_prefix: str = "tile_"
    input_format: str = "auto"
    evidence_dir: str | None = None
    viewer_sse: float = 80.0
    min_size_ratio: float = 0.0
    keep_glb: bool = False
    verbose: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "input_format", self.input_format.lower())
        checks = {
            "input_path": isinstance(self.input_path, str) and self.input_path != "",
            "content_subdir": self.content_subdir != "",
            "tile_prefix": self.tile_prefix != "",
            "input_format": self.input_format in FORMATS,
            "viewer_sse": self.viewer_sse > 0,
            "min_size_ratio": math.isfinite(self.min_size_ratio) and self.min_size_ratio >= 0,
        }
        for name, ok in checks.items():
            if not ok:
                raise ValueError(f"{name}: {getattr(self, name)!r} is not allowed")

    def uri(self, tile_id: int) -> str:
        """The address of a tile's content, relative to the tileset."""
        return f"{self.content_subdir.rstrip('/')}/{self.tile_prefix}{tile_id}.b3dm"
