"""What write operations return."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class InsertOneResult:
    inserted_id: Any
    acknowledged: bool = True


@dataclass(frozen=True)
class InsertManyResult:
    inserted_ids: list
    acknowledged: bool = True


@dataclass(frozen=True)
class UpdateResult:
    raw_result: dict = field(default_factory=dict)
    acknowledged: bool = True

    @property
    def matched_count(self) -> int:
        return 0 if self.upserted_id is not None else self.raw_result.get("n", 0)

    @property
    def modified_count(self) -> int:
        return self.raw_result.get("nModified", 0)

    @property
    def upserted_id(self):
        return self.raw_result.get("upserted")


@dataclass(frozen=True)
class DeleteResult:
    deleted_count: int
    acknowledged: bool = True

    @property
    def raw_result(self) -> dict:
        return {"n": self.deleted_count}


@dataclass(frozen=True)
class BulkWriteResult:
    bulk_api_result: dict
    acknowledged: bool = True

    @property
    def inserted_count(self) -> int:
        return self.bulk_api_result.get("nInserted", 0)

    @property
    def matched_count(self) -> int:
        return self.bulk_api_result.get("nMatched", 0)

    @property
    def modified_count(self) -> int:
        return self.bulk_api_result.get("nModified", 0)

    @property
    def deleted_count(self) -> int:
        return self.bulk_api_result.get("nRemoved", 0)

    @property
    def upserted_count(self) -> int:
        return self.bulk_api_result.get("nUpserted", 0)

    @property
    def upserted_ids(self) -> dict:
        return {u["index"]: u["_id"] for u in self.bulk_api_result.get("upserted", ())}
