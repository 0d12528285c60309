"""Evaluation cases as folders: a Spark data source that writes what ``evalfiles.load_cases`` reads.

Each case is a folder with ``reference.txt``, ``reference_turns.json``, ``case.json`` and ``audio.*``. Tasks write whole folders below a
hidden one, row by row; the commit moves them to their place, a failed job leaves nothing there.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from parlance.session import parallelism

FORMAT = "case_folders"
ROWS = "case string, side int, audio_path string, meta string, start double, end double, speaker string, text string"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    cases: list[str]


class CaseFolderWriter(DataSourceWriter):
    def __init__(self, path: str, replace: bool):
        self.path, self.replace = path, replace
        self.waiting = f"{path.rstrip('/')}/_cases-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        """Rows in order of (case, side, start): a case's facts first, then its turns."""
        system, root = _files(f"{self.waiting}/{uuid.uuid4().hex}")
        cases: list[str] = []
        lines = turns = None
        some_line = some_turn = False

        def closed() -> None:
            if lines is not None:
                lines.close()
                turns.write(b"]\n")
                turns.close()

        for row in rows:
            if not cases or cases[-1] != row["case"]:
                closed()
                cases.append(row["case"])
                folder = posixpath.join(root, row["case"])
                system.create_dir(folder, recursive=True)
                lines, turns = (system.open_output_stream(f"{folder}/{name}") for name in ("reference.txt", "reference_turns.json"))
                turns.write(b"[")
                some_line = some_turn = False
            if row["side"] == 0:
                with system.open_output_stream(f"{folder}/case.json") as facts:
                    facts.write((row["meta"] or "{}").encode())
                self._copy(row["audio_path"], system, folder)
                continue
            said = (row["text"] or "").strip()
            if said:
                lines.write((("\n" if some_line else "") + said).encode())
                some_line = True
            turn = {"start": row["start"], "end": row["end"], "speaker": row["speaker"], "text": row["text"]}
            turns.write((("," if some_turn else "") + json.dumps(turn, ensure_ascii=False)).encode())
            some_turn = True
        closed()
        return Written(root, cases)

    @staticmethod
    def _copy(audio: str, system, folder: str) -> None:
        source, inside = _files(audio)
        suffix = posixpath.splitext(inside)[1] or ".opus"
        with source.open_input_stream(inside) as read, system.open_output_stream(f"{folder}/audio{suffix}") as write:
            while piece := read.read(1 << 20):
                write.write(piece)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _files(self.path)
        for message in messages:
            for case in message.cases if message else ():
                target = posixpath.join(root, case)
                if system.get_file_info(target).type.name != "NotFound":
                    if not self.replace:
                        self.abort(messages)
                        raise FileExistsError(f"case {case!r} is there already")
                    system.delete_dir(target)
                system.move(posixpath.join(message.folder, case), target)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, waiting = _files(self.waiting)
        if system.get_file_info(waiting).type.name != "NotFound":
            system.delete_dir(waiting)


class CaseFolders(DataSource):
    """``df.write.format("case_folders").mode("append" | "overwrite").save(folder)``; see ``write_cases`` for the rows."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> CaseFolderWriter:
        return CaseFolderWriter(self.options["path"], overwrite)


@dataclass
class Attempt(WriterCommitMessage):
    name: str


class CaseLinesWriter(DataSourceWriter):
    """Tasks write below a hidden folder beside the path; the commit renames it. Attempts that failed leave a mark, and no lines."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        above, name = posixpath.split(self.path)
        self.waiting = f"{above}/_{name}-{uuid.uuid4().hex}"
        self._refuse()

    def _refuse(self) -> None:
        system, root = _files(self.path)
        if system.get_file_info(root).type.name != "NotFound":
            raise FileExistsError(f"{self.path!r} is there already")

    def write(self, rows: Iterator[Row]) -> Attempt:
        """Rows in order of (case, start): a line of the reference, where there is one, and a turn."""
        from pyspark import TaskContext

        system, root = _files(self.waiting)
        task = TaskContext.get()
        attempt = f"part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}"
        system.create_dir(f"{root}/_attempts/{attempt}", recursive=True)
        case, streams = None, {}

        def closed() -> None:
            for stream in streams.values():
                stream.close()
            streams.clear()

        def add(kind: str, suffix: str, value: str) -> None:
            if kind not in streams:
                folder = f"{root}/{kind}/{case}"
                system.create_dir(folder, recursive=True)
                streams[kind] = system.open_output_stream(f"{folder}/{attempt}.{suffix}")
            streams[kind].write(value.encode() + b"\n")

        for row in rows:
            if (now := partition_folder("case", row["case"])) != case:
                closed()
                case = now
            if row["line"] is not None:
                add("reference", "txt", row["line"])
            add("turns", "json", row["turn"])
        closed()
        return Attempt(attempt)

    def commit(self, messages: list[Attempt | None]) -> None:
        from pyarrow import fs

        self._refuse()
        system, root = _files(self.waiting)
        for kind in ("reference", "turns", "_attempts"):
            system.create_dir(f"{root}/{kind}", recursive=True)
        begun = {info.base_name for info in system.get_file_info(fs.FileSelector(f"{root}/_attempts"))}
        if lost := begun - {m.name for m in messages if m}:
            for kind in ("reference", "turns"):
                for info in system.get_file_info(fs.FileSelector(f"{root}/{kind}", recursive=True)):
                    if info.base_name.rsplit(".", 1)[0] in lost:
                        system.delete_file(info.path)
        system.delete_dir(f"{root}/_attempts")
        system.move(root, _files(self.path)[1])

    def abort(self, messages: list[Attempt | None]) -> None:
        system, root = _files(self.waiting)
        if system.get_file_info(root).type.name != "NotFound":
            system.delete_dir(root)


def partition_folder(column: str, value: str | None) -> str:
    """The folder of a partition value, as Spark names and reads it."""
    if not value:
        return f"{column}=__HIVE_DEFAULT_PARTITION__"
    odd = lambda c: c < " " or c in "\"#%'*/:=?\\\x7f{[]^"
    return f"{column}=" + "".join(f"%{ord(c):02X}" if odd(c) else c for c in value)


class CaseLines(DataSource):
    """``df.write.format("case_lines").mode("append").save(folder)`` of ``case, line, turn`` to a new folder, a folder per case."""

    @classmethod
    def name(cls) -> str:
        return "case_lines"

    def writer(self, schema: StructType, overwrite: bool) -> CaseLinesWriter:
        return CaseLinesWriter(self.options["path"])


def write_cases(turns: DataFrame, facts: DataFrame, folder: str, replace: bool = False) -> None:
    """Write cases: ``turns`` (``case, pos, start, end, speaker, text``) and ``facts`` (``case, audio_path``, ``meta`` a map of texts).

    Only cases with facts are written. A case's rows pass through one task, since its texts are one file, one row at a time. A case that
    is there already is an error, unless ``replace``.
    """
    spark = turns.sparkSession
    spark.dataSource.register(CaseFolders)
    none = F.lit(None)
    head = facts.select("case", F.lit(0).alias("side"), none.cast("long").alias("pos"), "audio_path", F.to_json("meta").alias("meta"), none.cast("double").alias("start"), none.cast("double").alias("end"), none.cast("string").alias("speaker"), none.cast("string").alias("text"))
    body = turns.join(facts.select("case"), "case", "left_semi").select(
        "case", F.lit(1).alias("side"), F.col("pos").cast("long").alias("pos"), none.cast("string").alias("audio_path"), none.cast("string").alias("meta"),
        F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "speaker", "text",
    )
    rows = head.unionByName(body).repartition(parallelism(turns), "case").sortWithinPartitions("case", "side", "start", "pos")
    rows.drop("pos").write.format(FORMAT).mode("overwrite" if replace else "append").save(folder)
