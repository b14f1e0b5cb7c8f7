"""Jobs polled from a queue that forgets what it hands out, as a stream with offsets.

    spark.dataSource.register(queue.JobQueue)
    spark.readStream.format("job_queue").option("poll", "package.module:function").option("path", "a folder that all executors share")

The function is given the stream's options (names in lower case; a queue's address may be one) and returns the next job, as a mapping of
the envelope's fields, or None where there is none now. What it gave is written to a
numbered segment of the folder before the stream learns of its number, so a job that was polled is read again after a restart until the
batch that holds it is done; then its segment is deleted. Lost is only what the queue had handed out when the driver died before the
segment was written.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from importlib import import_module

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

MOST_JOBS = 1000  # of a segment; one segment is one task
MOST_SEGMENTS = 16  # of one poll


class Segment(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


def _envelope(job: object, seq: int) -> tuple:
    """A row of what the queue gave; what is no envelope keeps its place, so that it is told as rejected."""
    job = job if isinstance(job, dict) else {}
    version, job_id, operation, payload = (job.get(k) for k in ("contract_version", "job_id", "operation", "payload"))
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    whole = isinstance(version, int) and not isinstance(version, bool) and abs(version) < 2**31
    return version if whole else None if version is None else -1, text(job_id), seq, text(operation), text(payload)


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        if "path" not in self.options or ":" not in self.options.get("poll", ""):
            raise ValueError("job_queue needs the options path and poll (package.module:function)")
        self.most = int(self.options.get("mostjobs", MOST_JOBS))

    def _folder(self) -> tuple[fs.FileSystem, str]:
        path = self.options["path"]
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("file:", "/")) else (fs.LocalFileSystem(), path)

    def _poll(self) -> Callable[[dict[str, str]], dict | None]:
        module, name = self.options["poll"].split(":", 1)
        return getattr(import_module(module), name)

    def _name(self, folder: str, number: int) -> str:
        return f"{folder}/{number:012d}.jsonl"

    def _last(self, files: fs.FileSystem, folder: str) -> int:
        """The largest number that was ever given: of a segment, or of those that are done."""
        names = [f.base_name for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True))]
        return max((int(n.split(".")[0]) for n in names if n.endswith((".jsonl", ".done"))), default=0)

    def initialOffset(self) -> dict:
        return {"segment": 0}

    def latestOffset(self) -> dict:
        files, folder = self._folder()
        files.create_dir(folder, recursive=True)
        number, poll, more = self._last(files, folder), self._poll(), True
        for _ in range(MOST_SEGMENTS):
            jobs = []
            while more and len(jobs) < self.most:
                job = poll(self.options)
                more = job is not None
                if more:
                    jobs.append(job)
            if not jobs:
                break
            number += 1
            name = self._name(folder, number)
            with files.open_output_stream(name + ".new") as out:
                out.write("".join(json.dumps(j, ensure_ascii=False) + "\n" for j in jobs).encode("utf-8", "backslashreplace"))
            files.move(name + ".new", name)
        return {"segment": number}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return [Segment(n) for n in range(start["segment"] + 1, end["segment"] + 1)]

    def read(self, partition: Segment) -> Iterator[tuple]:
        files, folder = self._folder()
        with files.open_input_stream(self._name(folder, partition.value)) as source:
            lines = source.read().decode("utf-8").split("\n")
        for i, line in enumerate(lines[:-1]):
            yield _envelope(json.loads(line), partition.value * 2**32 + i)

    def commit(self, end: dict) -> None:
        """Segments that are done go; an empty mark keeps the last number, so that no number is given twice."""
        files, folder = self._folder()
        done = end["segment"]
        if not done:
            return
        with files.open_output_stream(f"{folder}/{done:012d}.done"):
            pass
        for f in files.get_file_info(fs.FileSelector(folder)):
            stem, _, kind = f.base_name.partition(".")
            if kind == "jsonl" and int(stem) <= done or kind == "done" and int(stem) < done:
                files.delete_file(f.path)

    def stop(self) -> None:
        pass


class JobQueue(DataSource):
    """Options: poll, path, and mostJobs, how many jobs a segment holds at most. seq rises in the order of polling."""

    @classmethod
    def name(cls) -> str:
        return "job_queue"

    def schema(self) -> str:
        return "contract_version int, job_id string, seq long, operation string, payload string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(dict(self.options))
