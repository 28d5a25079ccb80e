"""Errors raised while a plan is built."""


class GridError(ValueError):
    """Any misuse of grids."""


class IncompatibleViewSizes(GridError):
    """Grids that are combined cell by cell differ in size."""

    def __init__(self, *sizes):
        super().__init__(f"sizes differ: {', '.join(map(str, sizes))}")
        self.sizes = sizes


class InvalidRange(GridError):
    """A region is not inside the grid."""

    def __init__(self, region, whole):
        super().__init__(f"{region} is not inside {whole}")
        self.region, self.whole = region, whole


class SliceOutOfRange(GridError):
    """A slice is taken beyond the end of an axis."""

    def __init__(self, at, length):
        super().__init__(f"slice {at} of {length}")
        self.at, self.length = at, length


class BorderTooWide(GridError):
    """A mirrored border reaches farther than the axis is long."""
