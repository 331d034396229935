"""What kind of checkout a folder is, asked of git on the driver, and whether that has changed."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable, Sequence
from dataclasses import dataclass

# Kinds of checkouts.
MODES = ("git-branch", "git-detached", "git-worktree", "filesystem", "git-unavailable")
Runner = Callable[[str, Sequence[str]], str]


@dataclass(frozen=True)
class Checkout:
    mode: str
    root: str
    head_oid: str | None = None
    branch_ref: str | None = None
    diagnostic: str | None = None

    @property
    def identity(self) -> tuple:
        """What makes two states of a checkout the same."""
        return self.mode, self.root, self.head_oid, self.branch_ref


def run_git(folder: str, args: Sequence[str], timeout: float = 1.0) -> str:
    return subprocess.run(["git", *args], cwd=folder, capture_output=True, text=True, timeout=timeout, check=True).stdout.strip()


def probe(folder: str, run: Runner = run_git) -> Checkout:
    """The checkout a folder belongs to; a folder without git, or a machine without it, is an answer too."""
    here = os.path.realpath(folder)
    try:
        root = os.path.realpath(run(here, ["rev-parse", "--show-toplevel"]))
    except subprocess.CalledProcessError as e:
        return Checkout("filesystem", here, diagnostic=(e.stderr or str(e)).strip())
    except (OSError, subprocess.SubprocessError) as e:
        return Checkout("git-unavailable", here, diagnostic=str(e))
    try:
        head = run(root, ["rev-parse", "HEAD"])
        try:
            branch = run(root, ["symbolic-ref", "--quiet", "--short", "HEAD"]) or None
        except subprocess.CalledProcessError:
            branch = None
        own, common = (os.path.realpath(os.path.join(root, run(root, ["rev-parse", a]))) for a in ("--git-dir", "--git-common-dir"))
    except (OSError, subprocess.SubprocessError) as e:
        return Checkout("git-unavailable", root, diagnostic=str(e))
    return Checkout("git-worktree" if own != common else "git-branch" if branch else "git-detached", root, head, branch)


def moved(before: Checkout, now: Checkout) -> bool:
    """Whether everything must be looked at again: another head, branch, root or kind of checkout."""
    return before.identity != now.identity
