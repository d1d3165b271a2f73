"""Accounts, folders and notes of a corpus as three lazy tables that are opened together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from quire.sources import stores


@dataclass(frozen=True)
class Catalog:
    accounts: DataFrame
    folders: DataFrame
    notes: DataFrame

    @classmethod
    def open(cls, objects: DataFrame, entities: DataFrame, bodies: DataFrame) -> Catalog:
        return cls(stores.accounts(objects, entities), stores.folders(objects, entities), stores.notes(objects, entities, bodies))
