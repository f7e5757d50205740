"""Answers that are filed as they come, so that no question is asked twice.

The ledger is a folder of JSON lines below buckets, which are the first digits of a question's digest.  A task holds whole
buckets: it reads what a bucket has on file, asks what is missing, and files new answers every second.  A
task that Spark runs again, or a job that starts again with the same ledger, thus asks only what was not
filed.  Failures are not filed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from unitloom.session import cut_lineage
from unitloom.sources.listing import file_system

#: Hexadecimal digits of a bucket (16 ** DIGITS tasks can ask at once), and seconds after which new answers are filed.
DIGITS, FILED_AFTER = 2, 1.0


def digest_of(prompt: Column, apart: list[str]) -> Column:
    """What tells questions apart: the prompt, and columns that make equal prompts different questions."""
    return F.sha2(F.to_json(F.struct(prompt.alias("prompt"), *apart)).cast("binary"), 256)


class Bucket:
    """The answers on file below one folder."""

    def __init__(self, ledger: str, name: str):
        from pyarrow import fs

        self.opened, base = file_system(ledger)
        self.folder, self.known, self.new, self.since = f"{base}/{name}", {}, [], time.monotonic()
        for entry in self.opened.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            if entry.type == fs.FileType.File and entry.base_name.endswith(".jsonl"):
                with self.opened.open_input_stream(entry.path) as stream:
                    for line in stream.read().decode().splitlines():
                        found = json.loads(line)
                        self.known[found["digest"]] = found["answer"]

    def add(self, digest: str, answer: str | None, error: str | None) -> None:
        if error is None:
            self.new.append(json.dumps({"digest": digest, "answer": answer}))

    def due(self) -> bool:
        return time.monotonic() - self.since >= FILED_AFTER

    def file(self) -> None:
        """Write new answers as one file, which is whole or not there."""
        if self.new:
            self.opened.create_dir(self.folder, recursive=True)
            name = f"{self.folder}/{uuid.uuid4().hex}"
            with self.opened.open_output_stream(f"{name}.part") as stream:
                stream.write("\n".join(self.new).encode())
            self.opened.move(f"{name}.part", f"{name}.jsonl")
        self.new, self.since = [], time.monotonic()


def ask_once(df: DataFrame, prompt: str, ledger: str, caller: Callable, answer: str, error: str, apart: list[str] | None = None,
             partitions: int | None = None, at_once: int = 1, digits: int = DIGITS) -> DataFrame:
    """``df`` with the answer to each row's prompt, where equal prompts are one question.

    ``caller`` builds, once per task, a function from a list of prompts to a list of (answer, error).  Only digests and distinct
    prompts go through Python; the other columns meet the answers in a join.
    """
    digest = digest_of(F.col(prompt), apart or [])
    keyed = df.withColumn("_digest", F.when(F.col(prompt).isNotNull(), digest))
    questions = keyed.where("_digest IS NOT NULL").groupBy("_digest").agg(F.first(prompt).alias("prompt"))
    questions = questions.withColumn("_bucket", F.substring("_digest", 1, digits))

    def ask(batches):
        import pyarrow as pa

        call, bucket, name = caller(), None, None

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*found)], names=["_digest", answer, error])

        try:
            for batch in batches:
                waiting, done = [], []

                def answer_waiting():
                    for (key, _), (value, message) in zip(waiting, call([text for _, text in waiting])):
                        bucket.add(key, value, message)
                        done.append((key, value, message))
                    waiting.clear()

                for key, text, home in zip(*[column.to_pylist() for column in batch.columns]):
                    if home != name:
                        if bucket is not None:
                            answer_waiting()
                            bucket.file()
                        bucket, name = Bucket(ledger, home), home
                    if key in bucket.known:
                        done.append((key, bucket.known[key], None))
                        continue
                    waiting.append((key, text))
                    if len(waiting) >= at_once:
                        answer_waiting()
                    if bucket.due() and done:
                        bucket.file()
                        yield rows(done)
                        done = []
                if bucket is not None:
                    answer_waiting()
                    bucket.file()
                if done:
                    yield rows(done)
        finally:
            getattr(call, "close", lambda: None)()

    spread = questions.repartition(partitions, "_bucket") if partitions else questions.repartition("_bucket")
    asked = spread.sortWithinPartitions("_bucket").select("_digest", "prompt", "_bucket").mapInArrow(
        ask, f"_digest string, `{answer}` string, `{error}` string")
    # written once, and one row per question, so a prompt that many rows share is split by the join
    return keyed.join(cut_lineage(asked, "asked"), "_digest", "left").drop("_digest")
