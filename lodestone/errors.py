"""Errors that the engine raises on the driver."""


class LodestoneError(Exception):
    """Of all errors here."""


class OptionError(LodestoneError, ValueError):
    """An option or argument is out of its range."""


class UnknownFieldError(LodestoneError, KeyError):
    """A plan names a field that the corpus mapping doesn't have."""

    def __str__(self) -> str:
        return str(self.args[0])


class SpaceMismatchError(LodestoneError, ValueError):
    """Vectors of different embedding spaces meet."""


class VectorFormatError(LodestoneError, ValueError):
    """A vector or its encoding is malformed."""


class RecordVersionError(LodestoneError, ValueError):
    """A record or encoding is of a version that isn't known."""


class TokenLimitError(LodestoneError, ValueError):
    """A text doesn't fit the model's token limit."""


class ModelSourceError(LodestoneError, ValueError):
    """A model's files can't be found or read."""


class ModelOutputError(LodestoneError, ValueError):
    """A model returned a tensor of an unknown shape."""


class PlanError(LodestoneError, ValueError):
    """A retrieval plan is incomplete or contradicts itself."""
