"""Versions without renames, and the manifest tree of a session."""

import json
import os

import pytest

from attesta.sources import manifest, tables, versions


def rows(spark, path):
    return {r["i"] for r in tables.read_jsonl(spark, path, spark.createDataFrame([], "i int").schema)[0].collect()}


def test_readers_between_any_two_steps(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    make = lambda *n: spark.createDataFrame([(i,) for i in n], "i int")
    assert versions.current(spark, path) is None
    assert tables.publish_jsonl(make(1, 2), path) == 1 and rows(spark, path) == {1, 2}
    # Before the pointer is created, the version before is read; a pointer that isn't done counts for nothing.
    create, seen = versions._create, []

    def watched(s, at, text):
        seen.append(rows(spark, path))
        if at.endswith("2"):  # another writer is first, and dies in the middle of its pointer
            assert create(s, at, text[:9])
            seen.append(rows(spark, path))
        made = create(s, at, text)
        seen.append(rows(spark, path))
        return made

    monkeypatch.setattr(versions, "_create", watched)
    assert tables.publish_jsonl(make(3), path) == 3
    assert seen == [{1, 2}, {1, 2}, {1, 2}, {1, 2}, {3}]
    monkeypatch.undo()
    assert not versions._create(spark, f"{path}/{versions.HEADS}/{3:012d}", "{}") and rows(spark, path) == {3}
    tables.publish_jsonl(make(4), path)
    assert len(versions.prune(spark, path, 1)) == 2 and rows(spark, path) == {4} and len([d for d in os.listdir(tmp_path / "t") if d.startswith("v-")]) == 1


def test_crash_between_renames(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    tables.write_jsonl(spark.createDataFrame([(1,)], "i int"), path)
    os.rename(tmp_path / "w", tmp_path / "w.old")
    assert rows(spark, path) == {1}


@pytest.fixture
def session(spark, tmp_path):
    for section in manifest.ENTRIES.values():
        for entry, path in section.items():
            if entry not in ("panel_consensus", "refuted_claims"):
                (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
                (tmp_path / path).write_text(f"{entry}\n")
    (tmp_path / "artifacts/panel_consensus.jsonl").mkdir()
    for i in range(3):
        (tmp_path / f"artifacts/panel_consensus.jsonl/part-{i}").write_text(f"{i}\n")
    return tmp_path


def told(spark, models=("m2", "m1", None)):
    sources = spark.createDataFrame([("s1", "p", "h"), ("s2", None, None)], "id string, snapshot_path string, content_hash string")
    verdicts = spark.createDataFrame([(m, f"p{i}") for i, m in enumerate(models)], "model_id string, verifier_prompt_hash string")
    risk = spark.createDataFrame([(2, "later"), (1, "rules"), (0, None)], "_ord int, gazetteer_hash string")
    return manifest.facts(sources, verdicts, risk)


def test_manifest_tree(spark, session, monkeypatch):
    base, args = f"file://{session}", (["b", "a"], {"gate": "1"})
    about = told(spark)
    assert about["model_ids"] == ["m1", "m2"] and about["verifier_prompt_hashes"] == ["p0", "p1", "p2"] and about["gazetteer"] == "rules"
    made, leaves = manifest.build(spark, base, *args, about, {"x": 1})
    assert made["sections"]["outputs"]["refuted_claims"] is None and made["sections"]["inputs"]["sources"].startswith("sha256:") and made["enabled_producers"] == ["a", "b"]
    made = json.loads(json.dumps(made))
    check = lambda m=made, a=about, c=args[1], **k: manifest.check(spark, base, m, leaves, args[0], c, a, {"x": 1}, **k)
    for whole in (False, True):
        drift, files = check(whole=whole)
        assert drift == [] and files.count() == 0
    assert manifest.refreshed(manifest.listed(spark, base), leaves)[1].count() == 0  # nothing is hashed again
    (session / "artifacts/panel_consensus.jsonl/part-1").write_text("one\n")
    os.remove(session / "artifacts/panel_consensus.jsonl/part-2")
    (session / "outputs/refuted_claims.json").write_text("[]")
    assert {r["file"] for r in manifest.refreshed(manifest.listed(spark, base), leaves)[1].collect()} == {"part-1", ""}
    drift, files = check()
    assert drift == ["inputs.panel_consensus", "outputs.refuted_claims"]
    assert {(r["entry"], r["file"], r["drift"]) for r in files.collect()} == {("panel_consensus", "part-1", "changed"), ("panel_consensus", "part-2", "missing"), ("refuted_claims", "", "added")}
    # A change that keeps length and time is found by hashing all.
    stat = os.stat(session / "sources/sources.jsonl")
    (session / "sources/sources.jsonl").write_text("SOURCES\n")
    os.utime(session / "sources/sources.jsonl", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert "inputs.sources" not in check()[0] and "inputs.sources" in check(whole=True)[0]
    drift, _ = check({**made, "enabled_producers": ["a"]}, told(spark, ("m9",)), {"gate": "2"})
    assert drift[0] == "signature" and {"about.model_ids", "code_versions.gate", "enabled_producers"} <= set(drift)
    assert check(None)[0] == ["manifest absent"]
