"""Image headers: a JSON object with channels, lines, pixels, format and path, and rest where the last line is unfinished."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass

from ..errors import FileMissing, InvalidArgs, InvalidHeader, IoFailure

FORMATS = ("Bip", "Bsq")
ITEM = 4  # bytes of a little-endian float32


@dataclass(frozen=True)
class ImageHeader:
    """pixels are samples in a line; a band-interleaved-by-pixel (Bip) file has each pixel's channels together.

    rest: samples of a last line that is unfinished, which comes after `lines` whole ones; a header file has it only if there is one.
    """

    channels: int
    lines: int
    pixels: int
    path: str
    format: str = "Bip"
    rest: int = 0

    def __post_init__(self):
        if self.format not in FORMATS:
            raise InvalidHeader(f"unknown format {self.format!r}")
        for k in ("rest", "channels", "pixels", "lines"):
            v, least = getattr(self, k), int(k != "rest" and not (k == "lines" and self.rest))
            if not isinstance(v, int) or isinstance(v, bool) or v < least:
                raise InvalidArgs(f"{k} must be a whole number of at least {least}, not {v!r}")
        if self.rest >= self.pixels:
            raise InvalidArgs(f"an unfinished line of {self.rest} samples, where {self.pixels} are a whole one")

    @property
    def n_pixels(self) -> int:
        return self.lines * self.pixels + self.rest

    @property
    def all_lines(self) -> int:
        """Lines with the unfinished one, if there is one."""
        return self.lines + (self.rest > 0)

    @property
    def pixel_bytes(self) -> int:
        return self.channels * ITEM

    @property
    def size(self) -> int:
        return self.n_pixels * self.pixel_bytes

    def pixel_offset(self, line: int, sample: int) -> int:
        """The byte at which a pixel begins in a Bip file."""
        return (line * self.pixels + sample) * self.pixel_bytes

    def channel_length(self) -> int:
        """Values of a channel."""
        return self.n_pixels

    def channel_offset(self, channel: int) -> int:
        """The value at which a channel begins in a Bsq file."""
        return channel * self.channel_length()

    def check_file(self) -> None:
        """Raise unless the data file exists and has the size that the header says."""
        if not os.path.exists(self.path):
            raise FileMissing(self.path)
        if (found := os.path.getsize(self.path)) != self.size:
            raise IoFailure(f"{self.path} has {found} bytes; {self.channels} x {self.n_pixels} values need {self.size}")

    def cropped(self, rows: tuple[int, int] | None, cols: tuple[int, int] | None, path: str) -> ImageHeader:
        """The header of a crop of this image (see crop) in a file of its own."""
        r, c = rows or (0, self.all_lines), cols or (0, self.pixels)
        width = c[1] - c[0]
        rest = min(max(self.rest - c[0], 0), width) if r[0] <= self.lines < r[1] else 0
        whole = 0 < rest == width
        return ImageHeader(self.channels, min(r[1], self.lines) - r[0] + whole, width, path, self.format, 0 if whole else rest)

    def save(self, path: str) -> None:
        write_json(path, {k: v for k, v in asdict(self).items() if v or k != "rest"})

    @classmethod
    def load(cls, path: str) -> ImageHeader:
        found = read_json(path, InvalidHeader)
        try:
            return cls(**{k: found[k] for k in ("channels", "lines", "pixels", "path", "format")}, rest=found.get("rest", 0))
        except (KeyError, TypeError, InvalidArgs) as e:
            raise InvalidHeader(f"{path}: {e}") from e


def read_json(path: str, kind: type[Exception]):
    try:
        with open(path) as f:
            return json.load(f)
    except FileNotFoundError as e:
        raise FileMissing(path) from e
    except ValueError as e:
        raise kind(f"{path}: {e}") from e


def write_json(path: str, value) -> None:
    """Write whole or not at all."""
    try:
        with open(f"{path}.new", "w") as f:
            json.dump(value, f)
        os.replace(f"{path}.new", path)
    except OSError as e:
        raise IoFailure(str(e)) from e
