"""Options of a conversion: defaults, bounds, and what follows from them."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from ..operators.planner import OUTPUTS

#: Source codecs whose SVS output keeps JPEG 2000. Fixed values.
J2K_SOURCES = ("J2K", "JP2", "JPEG2000", "JXL")
#: Numeric options: default, least, most. Fixed values.
BOUNDS = {"memory_budget_mb": (6144, 1024, 65536), "tile_size": (256, 16, 4096), "main_quality": (90, 1, 100), "preview_quality": (70, 1, 100), "pyramid_quality": (60, 1, 100), "parallel_wsi": (1, 1, 8)}
#: Strip heights of SVS output by memory budget: up to so many MB, so many rows. Fixed values.
SVS_STRIPS = ((4096, 512), (6144, 1024), (None, 1536))


@dataclass(frozen=True)
class Options:
    output_format: str = "ome_tiff"
    recursive: bool = True
    svs_codec: str = "auto"
    svs_use_bigtiff: bool | str = "auto"
    tile_size: int = 256
    memory_budget_mb: int = 6144
    main_quality: int = 90
    preview_quality: int = 70
    pyramid_quality: int = 60
    parallel_wsi: int = 1
    continue_on_error: bool = True
    compatible_only: bool = False
    chunk_size: int | None = None
    encoder_workers: int | None = None
    queue_size: int | None = None
    selected: tuple[str, ...] | None = None
    overrides: dict = field(default_factory=dict)

    @classmethod
    def from_request(cls, request: dict) -> "Options":
        """Options of a request; unreadable numbers count as the default, others are clamped."""
        chosen = str(request.get("output_format", "ome_tiff"))
        if chosen not in OUTPUTS:
            raise ValueError(f"unsupported output_format: {chosen}")

        def number(name: str) -> int:
            default, low, high = BOUNDS[name]
            try:
                value = int(request.get(name, default))
            except (TypeError, ValueError):
                value = default
            return max(low, min(high, value))

        selected = request.get("selected_input_paths")
        return cls(output_format=chosen, recursive=bool(request.get("recursive", True)), compatible_only=bool(request.get("convert_compatible_only", False)), selected=None if selected is None else tuple(map(str, selected)), overrides=dict(request.get("channel_overrides") or {}), **{n: number(n) for n in BOUNDS})

    def codec(self, source: str | None = None) -> str:
        """SVS codec: as asked, or by the source's own."""
        if self.svs_codec != "auto":
            return self.svs_codec
        return "aperio_j2k" if (source or "").upper() in J2K_SOURCES else "jpeg_rgb"

    def tile(self, source: str | None = None) -> int:
        """Tile size of the output: SVS has 240 instead of the default 256 unless its codec is JPEG 2000; channel sets always have 256."""
        if self.output_format in ("fluorescence_svs", "afi"):
            return 256
        if self.output_format == "svs" and self.tile_size == 256 and self.codec(source) == "jpeg_rgb":
            return 240
        return self.tile_size

    def workers(self) -> int:
        if self.encoder_workers is not None:
            return max(1, self.encoder_workers)
        return 1 if self.memory_budget_mb <= 4096 else max(1, min(4, os.cpu_count() or 4))

    def strip(self) -> int:
        """Rows read at a time."""
        tile = self.tile()
        if self.chunk_size is not None:
            return max(tile, self.chunk_size)
        if self.output_format == "svs":
            return max(tile, next(rows for most, rows in SVS_STRIPS if most is None or self.memory_budget_mb <= most))
        return 2048 if self.workers() <= 2 else 1024

    def queue(self) -> int:
        return max(1, self.queue_size) if self.queue_size is not None else max(2, self.workers())

    def bigtiff(self) -> bool:
        return self.output_format == "svs" and self.svs_use_bigtiff is True

    def parallel(self) -> int:
        return max(1, min(8, self.parallel_wsi))

    def buffer_bytes(self) -> int:
        return self.queue() * self.tile() ** 2 * 3
