"""Getting space back from duplicates: the plan is a DataFrame, acting on it is a write to the sink `reclaim` and happens only if asked for."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import paths
from granary.operators.duplicates import LARGEST
from granary.shipping import ship
from granary.sources.reclaim_sink import OUTCOMES, Acts, ReclaimSink, load_json, save_json

ACTIONS = ("delete", "trash", "hardlink")


@dataclass
class ReclaimReport:
    removed: int = 0
    reclaimed: int = 0
    errors: list[str] = field(default_factory=list)
    dry_run: bool = True

    def add(self, other: ReclaimReport) -> None:
        self.removed += other.removed
        self.reclaimed = min(LARGEST, self.reclaimed + other.reclaimed)
        self.errors += other.errors


def checked_action(action: str) -> str:
    if action not in ACTIONS:
        raise ValueError(f"unknown action: {action}")
    return action


def plan(found: DataFrame) -> DataFrame:
    """(hash, keep, remove, size): a row per file to act on, from members()."""
    return found.filter("path != keep").select("hash", "keep", F.col("path").alias("remove"), "size")


def jobs(found: DataFrame) -> DataFrame:
    """(keep, remove, size): a row per group with all its paths to act on as an array, for display."""
    return plan(found).groupBy("hash", "keep", "size").agg(F.array_sort(F.collect_list("remove")).alias("remove")).select("keep", "remove", "size")


def dry_run(planned: DataFrame) -> DataFrame:
    """One row, what acting on a plan would give: removed, reclaimed (at most the largest long)."""
    total = F.sum(F.col("size").cast("decimal(38,0)"))
    return planned.agg(F.count("*").alias("removed"), F.least(F.coalesce(total, F.lit(0)), F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("reclaimed"))


def to_trash(path: str, trash: str | None) -> None:
    """Move a path into a trash folder laid out as files and info."""
    if not trash:
        raise OSError("no trash folder is set")
    os.makedirs(f"{trash}/files", exist_ok=True)
    os.makedirs(f"{trash}/info", exist_ok=True)
    name = f"{os.path.basename(path.rstrip('/'))}.{uuid.uuid4().hex[:8]}"
    with open(f"{trash}/info/{name}.trashinfo", "w", errors="surrogateescape") as f:
        f.write(f"[Trash Info]\nPath={os.path.abspath(path)}\n")
    shutil.move(path, f"{trash}/files/{name}")


def link_over(keep: str, path: str) -> None:
    """Make path a hard link of keep; path is there, old or new, at every moment."""
    trial = f"{path}.{uuid.uuid4().hex[:8]}.link"
    try:
        os.link(keep, trial)
        os.replace(trial, path)
    except OSError:
        if os.path.lexists(trial):
            os.unlink(trial)
        raise


def reclaim(keep: str, remove: Iterable[str], size: int, action: str = "delete", dry_run: bool = True, trash: str | None = None) -> ReclaimReport:
    """Act on each path of remove, but never on keep. size: bytes that each gives back."""
    act: Callable[[str], None] = {"delete": os.unlink, "trash": lambda p: to_trash(p, trash), "hardlink": lambda p: link_over(keep, p)}[checked_action(action)]
    report = ReclaimReport(dry_run=dry_run)
    for path in remove:
        if path == keep:
            continue
        if not dry_run:
            try:
                act(path)
            except OSError as e:
                report.errors.append(f"{path}: {e}")
                continue
        report.removed += 1
        report.reclaimed = min(LARGEST, report.reclaimed + size)
    return report


def new_journal(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names, or a temporary one where all runs on one machine."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("driver and executors share no folder that is known: name a journal")
        return tempfile.mkdtemp(prefix="granary-reclaim-")
    place = urlparse(named)
    if place.scheme not in ("", "file"):
        raise ValueError(f"tasks can't write to {named} by path: name a journal")
    folder = f"{unquote(place.path)}/reclaim-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


def _step(rows: DataFrame, journal: str, job: dict, step: str) -> None:
    rows.sparkSession.dataSource.register(ReclaimSink)
    os.makedirs(f"{journal}/{step}", exist_ok=True)
    rows.write.format("reclaim").mode("append").options(journal=journal, action=job["action"], trash=job["trash"] or "", step=step).save()


def outcomes(spark: SparkSession, journal: str, step: str = "finish") -> DataFrame:
    """(keep, remove, size, dev, inode, error) of a step that is done; error is null where it went well."""
    names = load_json(f"{journal}/{step}.json")
    if names is None:
        raise ValueError(f"the step {step} is not done: {journal}")
    if not names:
        return spark.createDataFrame([], OUTCOMES)
    return spark.read.schema(OUTCOMES).parquet(*(f"file://{journal}/{step}/{name}" for name in names))


def report(spark: SparkSession, journal: str) -> ReclaimReport:
    """What a finished journal has done. Totals are an aggregation; errors, ordered by path, are all listed."""
    done = outcomes(spark, journal)
    total = dry_run(done.filter("error is null")).first()
    failed = done.filter("error is not null").select("remove", "error").orderBy(paths.sort_key(F.col("remove")))
    return ReclaimReport(total["removed"], total["reclaimed"], [f"{r['remove']}: {r['error']}" for r in failed.toLocalIterator()], False)


def resume(spark: SparkSession, journal: str) -> ReclaimReport:
    """Go on with a journal whose plan is written, from wherever it broke off; a finished one is only reported again."""
    journal = os.path.abspath(journal)
    job = load_json(f"{journal}/job.json")
    if job is None:
        raise ValueError(f"no plan is written in {journal}")
    ship(spark)
    if load_json(f"{journal}/claim.json") is None:
        _step(spark.read.parquet(f"file://{journal}/plan"), journal, job, "claim")
    if load_json(f"{journal}/finish.json") is None:
        _step(outcomes(spark, journal, "claim"), journal, job, "finish")
    return report(spark, journal)


def undo(spark: SparkSession, journal: str) -> None:
    """Put back what a journal has claimed, by tasks. ValueError once the claim is committed: finishing may have begun."""
    journal = os.path.abspath(journal)
    job = load_json(f"{journal}/job.json")
    if job is None or load_json(f"{journal}/claim.json") is not None:
        raise ValueError(f"nothing that can be put back: {journal}")
    ship(spark)

    def back(batches):
        acts = Acts(journal, job["action"], job["trash"])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                acts.undo(path)
            yield batch.slice(0, 0)

    spark.read.parquet(f"file://{journal}/plan").select("remove").mapInArrow(back, "remove string").count()


def apply(planned: DataFrame, action: str, trash: str | None = None, journal: str | None = None) -> ReclaimReport:
    """Act on a plan, by tasks, at most once a path; rows without a path, or that would act on what they keep, are left out.

    The plan is written to the journal first, so that what is done doesn't depend on reading again files that change meanwhile. A journal that is not
    named is removed at the end; after a failure it stays, and resume() goes on with it.
    """
    checked_action(action)
    spark = planned.sparkSession
    folder = os.path.abspath(journal) if journal else new_journal(spark)
    try:
        job = load_json(f"{folder}/job.json")
        if job is None:
            os.makedirs(folder, exist_ok=True)
            rows = planned.select("keep", "remove", "size").filter("remove is not null and keep is not null and remove != keep")
            # Dealt by path, so that a large group is many tasks' work.
            rows.repartition("remove").dropDuplicates(["remove"]).write.mode("overwrite").parquet(f"file://{folder}/plan")
            save_json(f"{folder}/job.json", {"action": action, "trash": trash})
        elif job != {"action": action, "trash": trash}:
            raise ValueError(f"the journal is of another job: {folder}")
        done = resume(spark, folder)
    except Exception as e:
        e.add_note(f"the journal is {folder}")
        raise
    if not journal:
        shutil.rmtree(folder)
    return done
