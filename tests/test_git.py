"""A repository made here, read as tables, against what git itself says."""

import shutil
import subprocess

import pytest

from evergrain.sources import gitrepo
from evergrain.sources.store import Store

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="no git to make a repository with")


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("git")

    def git(*args, **env):
        made = {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null", "PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(root)} | env
        return subprocess.run(["git", "-C", str(root), *args], capture_output=True, text=True, check=True, env=made).stdout

    def commit(name, message, when):
        git("add", "-A")
        who = {"GIT_AUTHOR_NAME": name, "GIT_AUTHOR_EMAIL": f"{name.lower()}@x.org", "GIT_COMMITTER_NAME": "C", "GIT_COMMITTER_EMAIL": "c@x.org", "GIT_AUTHOR_DATE": f"{when} +0000", "GIT_COMMITTER_DATE": f"{when} +0000"}
        git("commit", "-q", "--allow-empty", "-m", message, **who)

    git("init", "-q", "-b", "main")
    long = [f"line {k} of a long file that changes little" for k in range(400)]
    for k in range(14):
        (root / "src" / "deep").mkdir(parents=True, exist_ok=True)
        (root / "big.txt").write_text("\n".join([*long[: k * 20], f"changed {k}", *long[k * 20 :]]) + "\n")
        (root / "src" / "deep" / f"f{k % 4}.py").write_text(f"x = {k}\n" * (k + 1))
        if k == 5:
            (root / "bin.dat").write_bytes(b"\0\1\2" * 50)
        if k == 9:
            (root / "bin.dat").unlink()
        commit("Ada" if k % 2 else "Bob", f"change {k}\n\nwhy {k}" + ("\n\nGenerated-By: robot" if k == 7 else ""), 1_700_000_000 + k)
    git("gc", "-q", "--aggressive")
    git("checkout", "-q", "-b", "side", "HEAD~3")
    (root / "side.txt").write_text("side\nü\n")
    commit("Ada", "side work: password: hunter2hunter2", 1_700_001_000)
    git("checkout", "-q", "main")
    (root / "after.txt").write_text("after\n")
    commit("Ada", "after gc", 1_700_001_001)
    git("merge", "-q", "--no-ff", "-m", "merge side", "side", GIT_AUTHOR_NAME="Ada", GIT_AUTHOR_EMAIL="a", GIT_COMMITTER_NAME="C", GIT_COMMITTER_EMAIL="c")
    git("checkout", "-q", "-b", "lost")
    commit("Ada", "not on main", 1_700_002_000)
    git("checkout", "-q", "main")
    return root, git


def test_objects_and_history(spark, repo, tmp_path):
    root, git = repo
    found = gitrepo.objects(spark, f"{root}/.git").cache()
    want = {tuple(line.split(" ")[:2]) for line in git("cat-file", "--batch-all-objects", "--batch-check=%(objectname) %(objecttype)").splitlines()}
    assert {(r["sha"], r["kind"]) for r in found.select("sha", "kind").collect()} == want
    assert any(root.glob(".git/objects/pack/*.pack"))
    commits = gitrepo.commits(found).cache()
    store = Store(spark, f"{tmp_path}/s")
    marked = gitrepo.reachable(store, commits, gitrepo.heads(spark, f"{root}/.git"))
    assert {r["sha"] for r in marked.collect()} == set(git("log", "--format=%H").split())
    assert marked.count() < commits.count()

    changed = gitrepo.line_counts(gitrepo.changed_files(store, commits.join(marked, "sha", "left_semi"), gitrepo.entries(found)), found)
    got = {(r["sha"], r["path"], r["added"], r["removed"]) for r in changed.collect()}
    plain, sha = set(), None
    for line in git("log", "--first-parent", "-m", "--numstat", "--no-renames", "--format=commit %H").splitlines() + git("log", "side", "-1", "--numstat", "--no-renames", "--format=commit %H").splitlines():
        if line.startswith("commit "):
            sha = line[7:]
        elif line:
            a, d, path = line.split("\t")
            plain.add((sha, path, None if a == "-" else int(a), None if d == "-" else int(d)))
    assert got == plain

    turns = {r["sha"]: r for r in gitrepo.commit_turns(commits.join(marked, "sha", "left_semi"), changed, "repo", ["Ada"], ["Generated-By: robot"]).collect()}
    ours = set(git("log", "--no-merges", "--author", "Ada", "--format=%H").split())
    robot = set(git("log", "--grep", "robot", "--format=%H").split())
    assert set(turns) == ours - robot
    side = next(r for r in turns.values() if r["voice"].startswith("side work"))
    assert "hunter2" not in side["voice"] and side["prompt"] == "Write a commit message for these changes:\nside.txt | +2 -0"
    assert next(r for r in turns.values() if r["voice"].startswith("change 5"))["voice"] == "change 5\n\nwhy 5"
    found.unpersist()
    commits.unpersist()
