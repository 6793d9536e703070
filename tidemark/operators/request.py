"""Query strings to document queries, with the checks that a service makes before it answers."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import parse_qs

from pyspark.sql import DataFrame

from ..types import BadRequest, InvalidAggregate, MethodNotAllowed
from .documents import DocumentCollection, parse_aggregate


@dataclass
class Request:
    field: str
    value: str
    aggregate: str | None = None
    limit: int = -1
    offset: int = 0
    sort: str | None = None


def _count(given: dict, name: str, default: int) -> int:
    if name not in given:
        return default
    try:
        n = int(given[name])
    except ValueError:
        n = -1
    if n < 0:
        raise BadRequest(f"invalid {name} parameter")
    return n


def parse_request(query: str) -> Request:
    """Of repeated parameters the first counts, empty ones are present; with an aggregate limit and offset aren't looked at."""
    given = {k: v[0] for k, v in parse_qs(query, keep_blank_values=True).items()}
    if "field" not in given and "value" not in given:
        raise MethodNotAllowed("method not allowed")
    for name in ("field", "value"):
        if name not in given:
            raise BadRequest(f"missing {name} parameter")
    request = Request(given["field"], given["value"], sort=given.get("sort"))
    if "aggregate" in given:
        try:
            parse_aggregate(given["aggregate"])
        except InvalidAggregate as e:
            raise BadRequest("invalid aggregate parameter") from e
        request.aggregate = given["aggregate"]
        return request
    request.limit, request.offset = _count(given, "limit", -1), _count(given, "offset", 0)
    return request


def answer(documents: DocumentCollection, query: str) -> DataFrame:
    r = parse_request(query)
    if r.aggregate is not None:
        return documents.aggregate(r.field, r.value, r.aggregate)
    return documents.find(r.field, r.value, r.limit, r.offset, r.sort)


def key_of_path(path: str, prefix: str = "/v1/kv/") -> str:
    """The key in a path: slashes inside it stay, those around it go."""
    key = path.removeprefix(prefix).strip("/") if path.startswith(prefix) else ""
    if not key:
        raise BadRequest("missing key")
    return key
