"""Errors of the query, change-set and baseline operators."""

from __future__ import annotations


class ColonnadeError(Exception):
    """Base of all errors of this package."""


class QueryError(ColonnadeError):
    """A query that doesn't fit its table: which option, which field, what was wanted and found."""

    def __init__(self, op: str, field: str | None = None, want: str | None = None, got: str | None = None):
        self.op, self.field, self.want, self.got = op, field, want, got
        parts = [op]
        if field is not None:
            parts.append(f"field {field!r}")
        if want is not None or got is not None:
            parts.append(f"want {want}, got {got}")
        super().__init__(": ".join(parts))


class FieldNotFoundError(QueryError):
    """A predicate names a column that the table lacks."""


class TypeMismatchError(QueryError):
    """A predicate's or target's kind differs from the column's."""


class UnsupportedError(QueryError):
    """An option where it has no meaning, or a column kind that can't be queried."""


class PatchError(ColonnadeError):
    """Base of the errors of change sets."""


class InvalidPatchError(PatchError):
    """A change set that contradicts itself or the rows it is applied to."""


class SchemaMismatchError(PatchError):
    """A change set made for another schema."""


class BaseMismatchError(PatchError):
    """A change set made for other rows."""


class BaselineRequiredError(PatchError):
    """A change set without a base fingerprint, which a registry needs."""


class BaselineEvictedError(PatchError):
    """A change set whose base the registry doesn't hold (any more)."""
