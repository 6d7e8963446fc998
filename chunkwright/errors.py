"""What can go wrong, as exceptions."""

from __future__ import annotations


class ArrayError(Exception):
    """Base of all errors of the array engine."""


class MetadataError(ArrayError):
    """A metadata document is missing or isn't valid."""


class StoreError(ArrayError):
    """A store failed; absence of a key is no failure."""


class UnsupportedOperationError(StoreError):
    """The store or format can't do what was asked."""


class CodecError(ArrayError):
    """A chunk can't be decoded."""


class SliceError(ArrayError):
    """A selection doesn't fit the array."""


class MissingChunkError(ArrayError):
    """A chunk is absent and the read is strict."""

    def __init__(self, key: str):
        super().__init__(f"missing chunk: {key}")
        self.key = key

    def __reduce__(self):
        return (MissingChunkError, (self.key,))


class RetryExhaustedError(StoreError):
    """A retryable operation failed at every attempt."""

    def __init__(self, attempts: int, cause: object):
        super().__init__(f"failed after {attempts} attempt(s): {cause}")
        self.attempts = attempts
