"""Papers from a remote archive as a batch data source; the fetcher is the caller's.

One partition for each id, so a lost executor repeats single downloads.  All requests of
the landing pages go through one partition, which keeps their spacing.
"""

from __future__ import annotations

import importlib
import json
import time

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def polite(fetch, key: str, spacing: float, retries: int = 2, wait=time.sleep, busy: tuple[int, ...] = (429, 503)):
    """``fetch(key)`` -> (status, body) after ``spacing`` seconds; busy answers are asked again after 3 (n + 2) seconds; failure is None."""
    wait(spacing)
    for n in range(retries + 1):
        try:
            status, body = fetch(key)
        except OSError:
            return None
        if status not in busy:
            return body if status == 200 else None
        if n < retries:
            wait(3.0 * (n + 2))
    return None


class _Ids(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.ids = json.loads(options["ids"])
        self.module, _, self.name = options["fetcher"].rpartition(".")
        self.spacing = float(options.get("spacing", "3"))
        self.together = options.get("together", "false") == "true"

    def partitions(self):
        return [_Ids(self.ids)] if self.together else [_Ids([i]) for i in self.ids]

    def read(self, partition):
        fetch = getattr(importlib.import_module(self.module), self.name)
        for i in partition.ids:
            body = polite(fetch, i, self.spacing)
            yield (i, body if body is None or isinstance(body, bytes) else str(body).encode())


class RemotePapers(DataSource):
    """Options: ids (JSON list), fetcher (dotted name of a function id -> (status, body)), spacing, together."""

    @classmethod
    def name(cls):
        return "remote_papers"

    def schema(self):
        return "paper_id string, content binary"

    def reader(self, schema):
        return _Reader(self.options)
