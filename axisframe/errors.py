"""Errors of the library's contract."""

from __future__ import annotations


class AxisFrameError(Exception):
    """Base of all contract errors."""


class SelectionError(AxisFrameError, ValueError):
    """A selection is invalid or has an invalid shape."""


class UnknownColumnError(SelectionError, KeyError):
    """A name is not among a source's columns."""


class UnknownSourceError(AxisFrameError, KeyError):
    """A source, layer or key does not exist."""


class DuplicateNameError(SelectionError):
    """Names that must be distinct are not."""


class NameRepairError(SelectionError):
    """Generated names clash."""


class IncompatibleAxisError(AxisFrameError, ValueError):
    """Inputs belong to different axes, or to one that the verb does not take."""


class SizeMismatchError(AxisFrameError, ValueError):
    """Values do not fit an axis."""


class JoinRelationshipError(AxisFrameError, ValueError):
    """A join breaks its declared relationship, or a policy is unknown."""
