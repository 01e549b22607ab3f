"""Exceptions, and the prefixes under which callers see them."""

from __future__ import annotations


class SiltstoneError(Exception):
    """The root of all errors of this library."""


class ValidationError(SiltstoneError, ValueError):
    prefix = "Validation error:"


class CollectionError(SiltstoneError):
    prefix = "Storage error:"


class CollectionNotFound(CollectionError):
    pass


class CollectionExists(CollectionError):
    pass


class DocumentNotFound(CollectionError):
    pass


class StorageError(CollectionError):
    pass


class SearchError(SiltstoneError):
    prefix = "Search error:"


class EmbeddingError(SiltstoneError):
    prefix = "Search error:"


class ParseError(SiltstoneError):
    prefix = "Document parse error:"


class UnsupportedDocument(ParseError):
    pass


class UnsupportedProvider(SiltstoneError):
    prefix = "Validation error:"


class CompletionError(SiltstoneError):
    """A language model failed, or answered with something else than JSON records."""

    prefix = "LLM error:"


def told(error: Exception) -> str:
    """What a caller is told."""
    return f"{getattr(error, 'prefix', 'Unexpected error:')} {error}"
