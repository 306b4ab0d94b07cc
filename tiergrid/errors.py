"""Errors of the engine; each is also the built-in error that a caller would expect."""


class TierGridError(Exception):
    """Base of all errors here."""


class FeatureKeyError(TierGridError, KeyError):
    """A feature that isn't there, or whose kind clashes."""


class FeatureOperationError(TierGridError, ValueError):
    """An operation that features don't allow."""


class ViewOperationError(TierGridError, ValueError):
    """Views that can't be combined."""


class StructureLevelError(TierGridError, ValueError):
    """An unknown level."""


class IndexInvalidError(TierGridError, ValueError):
    """Indices of a wrong form."""


class IndexMismatchError(TierGridError, ValueError):
    """Tables whose lengths don't agree."""


class IndexOutOfBoundsError(TierGridError, IndexError):
    """Indices outside their table."""
