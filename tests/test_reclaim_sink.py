"""The reclaim sink: what it does equals acting file by file, however often a task runs and wherever a run breaks off."""

import os

import pytest

from granary.operators import reclaim
from granary.sources.reclaim_sink import Acts

PLAN = "hash string, keep string, remove string, size long"


@pytest.fixture
def tree(tmp_path):
    """Three groups of eight copies; one path of the plan is missing and one is a folder."""
    (tmp_path / "t/folder").mkdir(parents=True)
    rows = []
    for g in range(3):
        for k in range(8):
            (tmp_path / f"t/{g}-{k}").write_bytes(bytes([g]) * 10)
            rows.append((f"h{g}", f"{tmp_path}/t/{g}-0", f"{tmp_path}/t/{g}-{k}", 10))
    rows += [("h0", f"{tmp_path}/t/0-0", f"{tmp_path}/t/none", 10), ("h0", f"{tmp_path}/t/0-0", f"{tmp_path}/t/folder", 10)]
    return tmp_path, rows


def listed(folder):
    return sorted(os.listdir(folder))


KEPT = ["0-0", "1-0", "2-0", "folder"]


def test_acts_once_a_path(spark, tree):
    at, rows = tree
    plan = spark.createDataFrame([*rows, rows[1], ("h0", None, rows[1][2], 10), ("h0", rows[0][1], None, 10)], PLAN)
    done = reclaim.apply(plan, "delete")
    assert (done.removed, done.reclaimed, done.dry_run) == (21, 210, False)
    assert listed(at / "t") == KEPT
    assert [e.split(":")[0] for e in done.errors] == [f"{at}/t/folder", f"{at}/t/none"]


@pytest.mark.parametrize("action", reclaim.ACTIONS)
def test_a_task_that_dies_and_a_run_that_goes_on(spark, tree, action):
    at, rows = tree
    rows = [r for r in rows if r[2].rsplit("/", 1)[1] not in ("none", "folder")]
    journal, trash, marker = str(at / "journal"), str(at / "trash"), str(at / "died")
    plan = spark.createDataFrame(rows, PLAN)

    def deadly(batches):
        for batch in batches:
            yield batch.slice(0, 5)
            open(marker, "w").close()
            os._exit(1)

    os.makedirs(f"{journal}/claim")
    job = {"action": action, "trash": trash}
    before = listed(at / "t")
    with pytest.raises(Exception):
        reclaim._step(plan.select("keep", "remove", "size").filter("keep != remove").coalesce(1).mapInArrow(deadly, "keep string, remove string, size long"), journal, job, "claim")
    assert os.path.exists(marker) and not os.path.exists(f"{journal}/claim.json")
    # Some files of the plan lie under names of their own already.
    acts = Acts(journal, action, trash)
    for r in rows[1:4]:
        acts.claim(r[1], r[2])
    assert listed(at / "t") != before
    done = reclaim.apply(plan, action, trash, journal)
    assert (done.removed, done.reclaimed, done.errors) == (21, 210, [])
    assert reclaim.resume(spark, journal) == done
    if action == "hardlink":
        assert listed(at / "t") == before
        assert all(os.path.samefile(keep, path) for _, keep, path, _ in rows)
    else:
        assert listed(at / "t") == KEPT
    if action == "trash":
        assert len(listed(at / "trash/files")) == len(listed(at / "trash/info")) == 21
    with pytest.raises(ValueError):
        reclaim.apply(plan, "delete" if action != "delete" else "hardlink", trash, journal)
    with pytest.raises(ValueError):
        reclaim.undo(spark, journal)


def test_finishing_may_break_off_too(spark, tree):
    at, rows = tree
    journal, plan = str(at / "journal"), spark.createDataFrame(rows, PLAN)
    job = {"action": "delete", "trash": None}
    os.makedirs(journal)
    plan.filter("keep != remove").select("keep", "remove", "size").write.parquet(f"{journal}/plan")
    reclaim.save_json(f"{journal}/job.json", job)
    reclaim._step(spark.read.parquet(f"{journal}/plan"), journal, job, "claim")
    acts = Acts(journal, "delete")
    for r in reclaim.outcomes(spark, journal, "claim").filter("error is null").limit(6).collect():
        acts.finish(r.keep, r.remove, int(r.dev), int(r.inode))
    done = reclaim.resume(spark, journal)
    assert (done.removed, len(done.errors)) == (21, 2) and listed(at / "t") == KEPT


@pytest.mark.parametrize("action", ["delete", "hardlink"])
def test_claims_can_be_undone(spark, tree, action):
    at, rows = tree
    journal, plan, before = str(at / "journal"), spark.createDataFrame(rows, PLAN), listed(tree[0] / "t")
    os.makedirs(journal)
    plan.filter("keep != remove").select("keep", "remove", "size").write.parquet(f"{journal}/plan")
    reclaim.save_json(f"{journal}/job.json", {"action": action, "trash": None})
    acts = Acts(journal, action)
    for r in rows[1:8]:
        acts.claim(r[1], r[2])
    reclaim.undo(spark, journal)
    assert listed(at / "t") == before
    with pytest.raises(ValueError):
        reclaim.undo(spark, str(at / "no journal"))


def test_what_is_kept_has_to_be_there(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_bytes(b"x")
    a, b, c = (f"{tmp_path}/{x}" for x in "abc")
    plan = spark.createDataFrame([("h", a, b, 1), ("h", b, a, 1), ("h", f"{tmp_path}/gone", c, 1)], PLAN)
    done = reclaim.apply(plan, "delete")
    assert os.path.exists(c) and (os.path.exists(a) or os.path.exists(b))
    assert done.removed <= 1 and len(done.errors) == 3 - done.removed
    assert not [x for x in os.listdir(tmp_path) if x.startswith(".granary")]


def test_a_file_put_back_and_a_name_taken_again(tmp_path):
    (tmp_path / "k").write_bytes(b"x")
    (tmp_path / "p").write_bytes(b"x")
    k, p = f"{tmp_path}/k", f"{tmp_path}/p"
    acts = Acts(str(tmp_path / "j"), "trash")  # without a trash folder
    dev, inode = acts.claim(k, p)
    with pytest.raises(OSError):
        acts.finish(k, p, dev, inode)
    assert os.path.exists(p)
    with pytest.raises(OSError):  # once more
        acts.finish(k, p, dev, inode)
    assert os.path.exists(p)
    acts = Acts(str(tmp_path / "j"), "delete")
    dev, inode = acts.claim(k, p)
    (tmp_path / "p").write_bytes(b"another")
    acts.finish(k, p, dev, inode)
    acts.finish(k, p, dev, inode)
    assert (tmp_path / "p").read_bytes() == b"another"


def test_empty_plans_and_the_sink_alone(spark, tmp_path):
    empty = spark.createDataFrame([], PLAN)
    assert reclaim.apply(empty, "delete") == reclaim.ReclaimReport(dry_run=False)
    with pytest.raises(ValueError):
        reclaim.apply(empty, "shred")
    with pytest.raises(ValueError):
        reclaim.resume(spark, str(tmp_path))
