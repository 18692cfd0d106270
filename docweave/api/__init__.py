"""Clients, databases, collections and cursors over document collections."""

from docweave.api.client import Client
from docweave.api.collection import Collection
from docweave.api.cursor import Cursor, CursorType
from docweave.api.database import Database
from docweave.api.listview import QueryList
from docweave.api.results import DeleteResult, InsertManyResult, InsertOneResult, UpdateResult

ASCENDING, DESCENDING = 1, -1

__all__ = [
    "ASCENDING", "DESCENDING", "Client", "Collection", "Cursor", "CursorType", "Database", "DeleteResult", "InsertManyResult", "InsertOneResult", "QueryList", "UpdateResult",
]
