"""Settings of the engine."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Limits:
    """Admission limits; page_range is 1-based and inclusive."""

    max_num_pages: int = 2**31 - 1
    max_file_size: int = 2**63 - 1
    page_range: tuple[int, int] = (1, 2**31 - 1)
    enforce_file_size: bool = True

    def __post_init__(self) -> None:
        start, end = self.page_range
        if start < 1 or end < start:
            raise ValueError(f"page range {self.page_range}: start must be 1 or more, end not before it")


@dataclass(frozen=True)
class LayoutOptions:
    keep_empty_clusters: bool = False
    skip_cell_assignment: bool = False
    create_orphan_clusters: bool = True
    passes: int = 3


@dataclass(frozen=True)
class OcrOptions:
    """Engine names and score thresholds are passed to the registered engine."""

    engine: str = "auto"
    force_full_page_ocr: bool = False
    bitmap_area_threshold: float = 0.05
    full_page_coverage: float = 0.75
    text_score: float = 0.5
    confidence_threshold: float = 0.5
    lang: tuple[str, ...] = ()


@dataclass(frozen=True)
class TableOptions:
    """Passed to the table stage registered for this type."""

    do_cell_matching: bool = True
    mode: str = "accurate"


@dataclass(frozen=True)
class GridOptions:
    """Tables by where their texts stand; the stage for it is built in."""


@dataclass(frozen=True)
class FigureOptions:
    """Passed to the figure stage registered for this type."""

    classes: tuple[str, ...] = ()


@dataclass(frozen=True)
class EnrichmentOptions:
    """Passed to the enrichment stage registered for this type: item types that it reads, and how far their boxes grow."""

    types: tuple[str, ...] = ("figure", "formula", "code")
    expansion: float = 0.0


@dataclass(frozen=True)
class ReadingOptions:
    """``columns``: page headers, two columns at most, footers. ``cuts``: any number of columns and sidebars, by recursive cuts."""

    method: str = "columns"
    slack: float = 1.0

    def __post_init__(self) -> None:
        if self.method not in ("columns", "cuts"):
            raise ValueError(f"no reading order {self.method}; there are columns, cuts")


@dataclass(frozen=True)
class Options:
    limits: Limits = field(default_factory=Limits)
    layout: LayoutOptions = field(default_factory=LayoutOptions)
    ocr: OcrOptions = field(default_factory=OcrOptions)
    table: TableOptions | GridOptions = field(default_factory=TableOptions)
    figure: FigureOptions = field(default_factory=FigureOptions)
    enrichment: EnrichmentOptions = field(default_factory=EnrichmentOptions)
    reading: ReadingOptions = field(default_factory=ReadingOptions)
    allowed_formats: tuple[str, ...] | None = None
    raises_on_error: bool = True
    document_timeout: float | None = None
    wall_clock_limit: float | None = None
    images_scale: float = 1.0
    page_images: bool = False
    table_images: bool = False
    figure_images: bool = True
    score_threshold: float = 0.3

    def key(self) -> str:
        """Hash under which anything built from these options can be kept."""
        return hashlib.md5(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


#: Ready-made settings by name: what differs from the defaults.
PRESETS: dict[str, dict] = {
    "default": {},
    "fast": {"layout": LayoutOptions(passes=1), "table": TableOptions(mode="fast")},
    "layout_only": {"layout": LayoutOptions(skip_cell_assignment=True, create_orphan_clusters=False)},
    "scans": {"ocr": OcrOptions(force_full_page_ocr=True)},
}


def preset(name: str, **changes) -> Options:
    """Options of a preset, with changes on top."""
    if name not in PRESETS:
        raise ValueError(f"no preset {name}; there are {sorted(PRESETS)}")
    return Options(**(PRESETS[name] | changes))
