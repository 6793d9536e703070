"""Schemas of the data model, and its errors."""

from __future__ import annotations

WAL_RECORD = "segment string, seq long, op string, ts_ns long, key binary, value binary"
RING_ENTRY = "h long, node_id string"
HINT = "target_node string, op string, key string, value string, ts timestamp, seq long"


class TidemarkError(Exception):
    """Base of all errors of this package."""


class KeyNotFound(TidemarkError):
    """A get of an absent or deleted key."""


class InvalidKey(TidemarkError):
    """An empty key."""


class NilValue(TidemarkError):
    """A put without a value."""


class CursorClosed(TidemarkError):
    """A step of a closed cursor."""


class NotOpen(TidemarkError):
    """Use of a store that is not open."""


class AlreadyOpen(TidemarkError):
    """A second open."""


class UnknownEngine(TidemarkError):
    """A storage kind that does not exist."""


class InvalidJSON(TidemarkError):
    """Text that is not a JSON object."""


class EmptyDocument(TidemarkError):
    """A document without fields."""


class InvalidOption(TidemarkError):
    """A bad limit, offset, sort or number of options."""


class InvalidAggregate(TidemarkError):
    """A bad aggregate expression."""


class BadRequest(TidemarkError):
    """A request that lacks or misuses a parameter."""


class MethodNotAllowed(TidemarkError):
    """A request of a kind that the path does not take."""


class LogError(TidemarkError):
    """A change log that cannot be decoded."""


class BadMagic(LogError):
    """The record does not start with the magic number."""


class BadVersion(LogError):
    """A record version that is not supported."""


class BadChecksum(LogError):
    """A record whose checksum does not match."""


class TruncatedLog(LogError):
    """A log that ends inside a record."""


class CorruptRecord(LogError):
    """An unknown operation or an impossible length."""
