"""Acting on a reclaim plan as a Spark sink: df.write.format("reclaim"), rows (keep, remove, size).

A journal is a folder that driver and executors see by the same path; it holds the plan, written once, and what came of each step. The step `claim`
moves each file to a name of its own beside it (for hard links: makes the link under that name), the step `finish` deletes it, moves it to the trash or
puts the link in its place. The name follows from journal and path, so a task that runs twice, or twice at once, acts once, and a run that broke goes
on where it was. Until the claim is committed, undo() puts every file back. A step's outcomes count once the driver has named the files that hold
them; what attempts that failed wrote is not among those. No file goes while the one that is kept is not there.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import stat
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

STEPS = ("claim", "finish")
OUTCOMES = "keep string, remove string, size long, dev string, inode string, error string"
_ARROW = pa.schema([("keep", pa.string()), ("remove", pa.string()), ("size", pa.int64()), ("dev", pa.string()), ("inode", pa.string()), ("error", pa.string())])


def save_json(path: str, value) -> None:
    """Written whole or not at all."""
    trial = f"{path}.{uuid.uuid4().hex}"
    with open(trial, "w") as f:
        json.dump(value, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(trial, path)


def load_json(path: str):
    """What was saved; None if nothing was."""
    try:
        with open(path) as f:
            return json.load(f)
    except FileNotFoundError:
        return None


class Acts:
    """Claiming, finishing and undoing of single files; each may be repeated."""

    def __init__(self, journal: str, action: str, trash: str | None = None):
        self.journal, self.action, self.trash = os.path.abspath(journal), action, trash

    def key(self, path: str) -> str:
        return hashlib.blake2b(f"{self.journal}\0{path}".encode("utf-8", "surrogateescape"), digest_size=12).hexdigest()

    def beside(self, path: str) -> str:
        return os.path.join(os.path.dirname(path), f".granary-{self.key(path)}")

    def _kept(self, keep: str) -> None:
        if not os.path.lexists(keep):
            raise FileNotFoundError(f"what is kept is not there: {keep}")

    def claim(self, keep: str, path: str) -> tuple[int | None, int | None]:
        """(dev, inode) of what was claimed; none for hard links."""
        own = self.beside(path)
        if self.action == "hardlink":
            if os.path.lexists(own) and not os.path.samefile(own, keep):
                os.unlink(own)
            try:
                os.link(keep, own)
            except FileExistsError:  # an earlier or a second attempt's
                pass
            return None, None
        if not os.path.lexists(own):
            self._kept(keep)
            try:
                if stat.S_ISDIR(os.lstat(path).st_mode):
                    raise IsADirectoryError(f"a folder is not reclaimed: {path}")
                os.rename(path, own)
            except FileNotFoundError:
                if not os.path.lexists(own):
                    raise
        s = os.lstat(own)
        return s.st_dev, s.st_ino

    def undo(self, path: str) -> None:
        own = self.beside(path)
        if not os.path.lexists(own):
            return
        if self.action == "hardlink":
            os.unlink(own)
        elif not os.path.lexists(path):
            os.rename(own, path)

    def _to_trash(self, own: str, path: str) -> None:
        if not self.trash:
            raise OSError("no trash folder is set")
        for part in ("files", "info"):
            os.makedirs(f"{self.trash}/{part}", exist_ok=True)
        name = f"{os.path.basename(path)}.{self.key(path)[:8]}"
        there, trial = f"{self.trash}/files/{name}", f"{self.trash}/files/.{self.key(path)}"
        with open(f"{self.trash}/info/{name}.trashinfo", "w", errors="surrogateescape") as f:
            f.write(f"[Trash Info]\nPath={os.path.abspath(path)}\n")
        if os.path.lexists(own):  # a copy between file systems may have broken off
            if os.path.lexists(trial):
                os.unlink(trial)
            shutil.move(own, trial)
        if os.path.lexists(trial):
            os.replace(trial, there)

    def finish(self, keep: str, path: str, dev: int | None, inode: int | None) -> None:
        own = self.beside(path)
        if self.action == "hardlink":
            if os.path.lexists(own):
                os.replace(own, path)
                if os.path.lexists(own):  # both were links of one file already
                    os.unlink(own)
            elif not os.path.samefile(keep, path):
                raise FileNotFoundError(f"its link is gone: {path}")
            return
        if not os.path.lexists(own) and os.path.lexists(path):
            s = os.lstat(path)
            if (s.st_dev, s.st_ino) == (dev, inode):  # an attempt before this one put it back
                os.rename(path, own)
        try:
            if os.path.lexists(own):
                self._kept(keep)
            if self.action == "delete":
                os.unlink(own)
            else:
                self._to_trash(own, path)
        except OSError as e:
            if isinstance(e, FileNotFoundError) and self.action == "delete" and not os.path.lexists(own):
                return  # gone already
            self.undo(path)
            raise


@dataclass
class _Written(WriterCommitMessage):
    name: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, journal: str, action: str, trash: str | None, step: str):
        self.journal, self.action, self.trash, self.step = journal, action, trash, step

    def _outcome(self, acts: Acts, row: dict) -> dict:
        out = {"keep": row["keep"], "remove": row["remove"], "size": row["size"] or 0, "dev": row.get("dev"), "inode": row.get("inode"), "error": row.get("error")}
        if out["error"] is not None:
            return out
        number = lambda x: None if x is None else int(x)
        try:
            if self.step == "claim":
                out["dev"], out["inode"] = (None if x is None else str(x) for x in acts.claim(row["keep"], row["remove"]))
            else:
                acts.finish(row["keep"], row["remove"], number(row["dev"]), number(row["inode"]))
        except OSError as e:
            out["error"] = str(e)
        return out

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        acts, rows, name = Acts(self.journal, self.action, self.trash), 0, f"{uuid.uuid4().hex}.parquet"
        with pq.ParquetWriter(f"{self.journal}/{self.step}/{name}", _ARROW) as out:
            for batch in iterator:
                done = [self._outcome(acts, row) for row in batch.to_pylist()]
                rows += len(done)
                out.write_batch(pa.RecordBatch.from_pylist(done, schema=_ARROW))
        return _Written(name, rows)

    def commit(self, messages: list) -> None:
        save_json(f"{self.journal}/{self.step}.json", [m.name for m in messages if m is not None and m.rows])

    def abort(self, messages: list) -> None:
        """Outcomes of a job that failed are no outcomes; its claims stay for the run that goes on, or for undo()."""
        for m in messages:
            if m is not None and os.path.exists(f"{self.journal}/{self.step}/{m.name}"):
                os.unlink(f"{self.journal}/{self.step}/{m.name}")


class ReclaimSink(DataSource):
    """Options: journal, action (delete, trash or hardlink), trash (a folder), step (claim or finish). Mode append."""

    @classmethod
    def name(cls) -> str:
        return "reclaim"

    def writer(self, schema, overwrite: bool) -> _Writer:
        o = self.options
        if overwrite or o.get("step") not in STEPS:
            raise ValueError("the reclaim sink appends, in the steps claim and finish")
        if not os.path.isdir(f"{o['journal']}/{o['step']}"):
            raise FileNotFoundError(f"no journal that is seen from here: {o['journal']}")
        return _Writer(o["journal"], o["action"], o.get("trash") or None, o["step"])
