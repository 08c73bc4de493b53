import hashlib
import json
import subprocess

import pytest

from statefold.sources import files, results


def test_trees_digests_and_words(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bin").write_bytes(b"\x00abc")
    (tmp_path / "b.txt").write_text("# names\n\n one\t\n\u3000two\n\t# more\n")
    got = {r.path.rsplit("/", 1)[1]: (r["size"], r.sha256) for r in files.file_digests(spark, str(tmp_path)).collect()}
    assert got["a.bin"] == (4, hashlib.sha256(b"\x00abc").hexdigest()) and len(got) == 2
    assert files.sha256_of(str(tmp_path / "b.txt")) == got["b.txt"][1]
    assert {r.word for r in files.read_words(spark, str(tmp_path / "b.txt")).collect()} == {"one", "two"}


def test_tracked_tree_and_revision(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    assert files.revision(str(tmp_path)) is None
    git("init", "-q")
    (tmp_path / "é a.txt").write_text("x")
    (tmp_path / "new.txt").write_text("x")
    git("add", "é a.txt")
    git("-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "x")
    assert [tuple(r) for r in files.tracked_tree(spark, str(tmp_path)).collect()] == [("é a.txt", 1, False, False)]
    (tmp_path / "private").mkdir()
    (tmp_path / "private" / "k.PNG").write_text("xy")
    every = {tuple(r) for r in files.tracked_tree(spark, str(tmp_path), untracked=True).collect()}
    assert every == {("é a.txt", 1, False, False), ("new.txt", 1, False, False), ("private/k.PNG", 2, True, True)}
    (tmp_path / "é a.txt").unlink()
    assert files.tracked_tree(spark, str(tmp_path)).first().passed_over
    assert len(files.revision(str(tmp_path))) == 40
    (tmp_path / "sub").mkdir()
    assert files.revision(str(tmp_path / "sub")) is None


def test_weights_are_resolved(tmp_path):
    with pytest.raises(FileNotFoundError):
        files.resolve_weights(str(tmp_path))
    (tmp_path / "model.safetensors").write_bytes(b"")
    assert files.resolve_weights(str(tmp_path)) == files.resolve_weights(str(tmp_path / "model.safetensors"))


def test_records_and_samples(spark, tmp_path):
    record = results.run_record(spark, ["a", "b"], "f" * 64, "/w/m", ["run", "--checkpoint", "/w/m", "--checkpoint=/w/m"], {"a": {"acc": 0.5, "é": 1}}, limit=3)
    results.write_record(record, str(tmp_path / "out"))
    r = spark.read.json(str(tmp_path / "out")).first()
    assert (r.label, r.command, r.smoke_test, r.checkpoint_sha256) == ("SMOKE-limit3-a+b", "run --checkpoint <checkpoint> --checkpoint=<checkpoint>", True, "f" * 64)
    assert json.loads(r.results)["a"]["é"] == 1
    samples = spark.createDataFrame([("a", 1, "é"), ("b", 2, None)], "task string, doc int, answer string")
    results.write_samples(samples, str(tmp_path / "s"))
    assert {(r.task, r.doc, r.answer) for r in spark.read.json(str(tmp_path / "s")).collect()} == {("a", 1, "é"), ("b", 2, None)}
