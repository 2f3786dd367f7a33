"""Bitemporal claim analytics on Spark DataFrames."""

from .operators.project import LogView, StatedView, project
from .operators.provenance import history, recent, trace
from .operators.resolve import clock_grid, resolve_point, standing, stated
from .plans import EntitySpec, GroupedSpec, Model

__all__ = ["EntitySpec", "GroupedSpec", "LogView", "Model", "StatedView", "clock_grid",
           "history", "project", "recent", "resolve_point", "standing", "stated", "trace"]
