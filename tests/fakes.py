"""Clients that stand in for brokers and services; their data lies in files, so that tasks see it too."""

from __future__ import annotations

import json
from pathlib import Path

from streamgraph.sources.brokers import Queue, Shards
from streamgraph.sources.services import Pushed, Records, Sobjects


class FileShards(Shards):
    """Shard ``s`` is the file ``s.jsonl`` of [key, content]; commits go to ``commits.jsonl``."""

    def partitions(self):
        return sorted(p.stem for p in Path(self.options["path"]).glob("s*.jsonl"))

    def _rows(self, shard):
        return [json.loads(x) for x in (Path(self.options["path"]) / f"{shard}.jsonl").read_text().splitlines()]

    def end(self, shard):
        return len(self._rows(shard))

    def records(self, shard, start, end):
        for at, (key, content) in list(enumerate(self._rows(shard)))[start:end]:
            yield at, key, content

    def commit(self, positions):
        with (Path(self.options["path"]) / "commits.jsonl").open("a") as f:
            f.write(json.dumps(positions) + "\n")


class Service:
    def __init__(self, path):
        self.path = Path(path)

    def lookup(self, name):
        return name if self.path.exists() else None

    def create(self, name):
        self.path.write_text("[]")
        return name

    def frames(self, topic, after):
        return [(k, json.dumps({"data": {"sobject": {"Id": str(k)}}})) for k in range(1, 6) if k > after]

    def receive(self, handle, n, wait_s, visibility_s):
        rows = json.loads(self.path.read_text())
        self.path.write_text(json.dumps(rows[n:]))
        return [tuple(r) for r in rows[:n]]

    def delete(self, handle, receipts):
        with self.path.with_suffix(".deleted").open("a") as f:
            f.writelines(f"{r}\n" for r in receipts)

    def list(self, kind):
        return [{"uuid": "u1", "state": "open", "total_in_cents": 5, "extra": 1}] if kind == "invoices" else [{"company_name": "c", "account_code": "a", "x": 2}]

    def query(self, soql):
        return [{"Id": "1", "attributes": {"type": "x"}, "Name": "n"}]


def queue(options):
    return Queue(Service(options["path"]), "words", options["path"] + ".batches", options.get("json_group_key"), int(options.get("most", 1000)))


def invoices(options):
    return Records(Service("/none"), "invoices")


def accounts(options):
    return Records(Service("/none"), "accounts")


def sobjects(options):
    return Sobjects(Service("/none"), "SELECT Id FROM X")


def pushed(options):
    return Pushed(Service("/none"), "updates")


class Throttled:
    """Takes a record when it is put the second time; refuses keys ``bad``."""

    def __init__(self, options):
        self.seen = set()

    def put(self, records):
        out = []
        for key, _ in records:
            out.append("refused" if key == "bad" else None if key in self.seen else "retry")
            self.seen.add(key)
        return out
