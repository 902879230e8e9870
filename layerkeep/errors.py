"""Outcomes and errors. Reads and builds raise; loads report a status."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Code(Enum):
    OK = "ok"
    CANCELLED = "cancelled"
    INVALID_ARGUMENT = "invalid_argument"
    NOT_FOUND = "not_found"
    FAILED_PRECONDITION = "failed_precondition"
    INTERNAL = "internal"
    UNAVAILABLE = "unavailable"
    UNKNOWN = "unknown"


class LayerError(RuntimeError):
    """Base of all errors; ``code`` tells the kind."""

    code = Code.UNKNOWN


class Cancelled(LayerError):
    code = Code.CANCELLED


class InvalidArgument(LayerError, ValueError):
    code = Code.INVALID_ARGUMENT


class NotFound(LayerError, LookupError):
    code = Code.NOT_FOUND


class FailedPrecondition(LayerError):
    code = Code.FAILED_PRECONDITION


class Internal(LayerError):
    code = Code.INTERNAL


class Unavailable(LayerError):
    code = Code.UNAVAILABLE


ERRORS = {e.code: e for e in (Cancelled, InvalidArgument, NotFound, FailedPrecondition, Internal, Unavailable, LayerError)}


@dataclass(frozen=True)
class Status:
    """A code with a message. Success carries none: success with a message is of unknown kind."""

    code: Code = Code.OK
    message: str = ""

    def __post_init__(self):
        if self.code is Code.OK and self.message:
            object.__setattr__(self, "code", Code.UNKNOWN)

    @property
    def ok(self) -> bool:
        return self.code is Code.OK

    def raise_for_error(self) -> None:
        if not self.ok:
            raise ERRORS[self.code](self.message)

    @classmethod
    def of(cls, error: BaseException) -> Status:
        return cls(getattr(error, "code", Code.UNKNOWN), str(error) or type(error).__name__)
