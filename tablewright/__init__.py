"""Data profiling, cleaning, versioning and validation as Spark jobs."""

from tablewright.session import build_session

__all__ = ["build_session"]
