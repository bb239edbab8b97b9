"""One-way, repeat-safe mirroring of keyed records between tables, on Spark."""

from mirrorkit.spec import MirrorSpec, specs_frame

__all__ = ["MirrorSpec", "specs_frame"]
