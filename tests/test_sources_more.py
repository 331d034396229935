import json
import subprocess

import pytest

from lodeglass.functions.tokens import count_tokens
from lodeglass.sources import checkout, corpus, store


def git(folder, *args):
    subprocess.run(["git", "-c", "user.email=a@b.test", "-c", "user.name=n", *args], cwd=folder, check=True, capture_output=True)


def test_checkouts(tmp_path):
    plain, repo = tmp_path / "plain", tmp_path / "repo"
    plain.mkdir()
    repo.mkdir()
    assert checkout.probe(str(plain)).mode == "filesystem"
    git(repo, "init", "-q", "-b", "main")
    git(repo, "commit", "-q", "--allow-empty", "-m", "one")
    main = checkout.probe(str(repo))
    assert (main.mode, main.branch_ref) == ("git-branch", "main") and len(main.head_oid) == 40
    git(repo, "worktree", "add", "-q", str(tmp_path / "tree"), "-b", "side")
    assert checkout.probe(str(tmp_path / "tree")).mode == "git-worktree"
    git(repo, "checkout", "-q", "--detach")
    now = checkout.probe(str(repo))
    assert now.mode == "git-detached" and checkout.moved(main, now) and not checkout.moved(now, checkout.probe(str(repo)))

    def none(folder, args):
        raise FileNotFoundError("git")

    assert checkout.probe(str(repo), none).mode == "git-unavailable"


CARD = "---\nid: t1\nslice: bench\nquery: \"where is it\"\nallowedPaths: [a.ts, b.ts]\nsuccessCriteria:\n  - finds it\n  - 'quickly'\ntargets:\n  - kind: symbol\n    value: f\n---\n# Body\n"


def test_corpus(spark, tmp_path):
    fields, body = corpus.front_matter(CARD)
    assert fields["allowedPaths"] == ["a.ts", "b.ts"] and fields["targets"] == [{"kind": "symbol", "value": "f"}] and fields["successCriteria"] == ["finds it", "quickly"] and body == "# Body\n"
    with pytest.raises(ValueError):
        corpus.front_matter("no front matter")
    folder = tmp_path / "tasks"
    folder.mkdir()
    (folder / "t1.md").write_text(CARD)
    (folder / "t2.md").write_text("nothing")
    (folder / "t3.md").write_text(CARD.replace("t1", "t3"))
    task = lambda i, s: {"id": i, "path": f"tasks/{i}.md", "slice": s, "workflows": ["w"], "allowedPaths": [], "targets": [{"kind": "symbol", "value": "f", "mode": "exact"}]}
    (tmp_path / "m.json").write_text(json.dumps({"schemaVersion": 1, "benchmark": "b", "repo": "r", "repoSha": "0", "tokenizer": "t", "tasks": [task("t1", "other"), task("t9", "x")]}, indent=1))
    manifest, cards = corpus.read_manifest(spark, str(tmp_path / "m.json")), corpus.read_cards(spark, str(folder))
    assert manifest.count() == 2 and {r.id for r in cards.collect()} == {"t1", None, "t3"}
    assert {(r.id, r.problem) for r in corpus.corpus_problems(manifest, cards).collect() if r.id != "t2.md"} == {("t1", "another slice"), ("t9", "no card"), ("t3", "no task")}


def test_archive(spark, tmp_path):
    for k in ("a/x", "b"):
        p = tmp_path / "root" / k
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(k)
    plan = spark.createDataFrame([("a/x", 1), ("gone", 1)], "key string, bytes bigint")
    root, kept = str(tmp_path / "root"), str(tmp_path / "kept")
    assert store.archive(plan, root, kept) == ["a/x"] and (tmp_path / "root/a/x").exists()
    assert store.archive(plan, root, kept, dry_run=False) == ["a/x"] and not (tmp_path / "root/a/x").exists()
    assert store.restore(root, kept, "a/x") and not store.restore(root, kept, "a/x") and (tmp_path / "root/a/x").read_text() == "a/x"


def test_token_counts(spark):
    rows = spark.createDataFrame([("hello world, hello",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(count_tokens("t")).collect()][:2] == [5, 1]
    tokenizers = pytest.importorskip("public_tokenizers")
    exact = rows.select(count_tokens("t", tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)).collect()
    assert [r[0] for r in exact] == [4, 0, None]
