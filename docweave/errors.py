"""Errors of the document API."""

from __future__ import annotations


class DocweaveError(Exception):
    """Base of all errors."""


class ConfigurationError(DocweaveError):
    pass


class InvalidOperation(DocweaveError):
    pass


class InvalidName(DocweaveError):
    pass


class CollectionInvalid(DocweaveError):
    pass


class InvalidDocument(DocweaveError):
    pass


class OperationFailure(DocweaveError):
    def __init__(self, message: str, code: int | None = None, details: dict | None = None):
        super().__init__(message)
        self.code, self.details = code, details


class WriteError(OperationFailure):
    pass


class DuplicateKeyError(WriteError):
    def __init__(self, message: str, code: int = 11000, details: dict | None = None):
        super().__init__(message, code, details)


class BulkWriteError(OperationFailure):
    def __init__(self, details: dict):
        super().__init__("batch op errors occurred", 65, details)
