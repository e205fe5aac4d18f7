"""Getting a repository onto disk, before any table exists: driver-side, one repository at a time."""

from __future__ import annotations

import os
import shutil
import subprocess

from .source_tree import SKIPPED_FOLDERS


def _git(*args: str, folder: str | None = None) -> str:
    return subprocess.run(["git", *(["-C", folder] if folder else []), *args], check=True, capture_output=True, text=True, env={**os.environ, "GIT_TERMINAL_PROMPT": "0"}).stdout.strip()


def is_local(url: str) -> bool:
    return url.startswith(("/", "~/"))


def acquire(url: str, folder: str, token: str | None = None) -> tuple[str, str]:
    """(folder, commit): the repository of ``url`` in ``folder``.

    A folder that holds a repository already is pulled, and kept as it is if that fails. A local path is copied without
    what is no source and committed to a repository of its own; any other URL is cloned. ``token`` goes to https hosts in
    a header, never into the stored address.
    """
    if os.path.isdir(os.path.join(folder, ".git")):
        try:
            _git("pull", "--ff-only", folder=folder)
        except subprocess.CalledProcessError:
            pass  # no network or no remote: the version at hand counts
    elif is_local(url):
        shutil.copytree(os.path.expanduser(url), folder, ignore=shutil.ignore_patterns(*SKIPPED_FOLDERS), dirs_exist_ok=True)
        _git("init", "-q", folder=folder)
        _git("add", "-A", folder=folder)
        _git("-c", "user.name=stratacode", "-c", "user.email=stratacode@localhost", "commit", "-q", "--allow-empty", "-m", "local copy", folder=folder)
    else:
        header = ["-c", f"http.extraHeader=Authorization: Bearer {token}"] if token and url.startswith("https://") else []
        _git(*header, "clone", "-q", url if url.endswith(".git") else url + ".git", folder)
    return folder, _git("rev-parse", "HEAD", folder=folder)


def repo_root(project_id: int, repo_url: str | None, folders: list[str]) -> str | None:
    """Where a project's files lie: its local path, ``repo_<id>`` or a folder of the repository's name in ``folders``; None if nowhere."""
    if repo_url and is_local(repo_url) and os.path.isdir(os.path.expanduser(repo_url)):
        return os.path.expanduser(repo_url)
    name = (repo_url or "").rstrip("/").removesuffix(".git").rsplit("/", 1)[-1].rsplit(":", 1)[-1]
    for base in folders:
        for candidate in (f"repo_{project_id}", name):
            if candidate and os.path.isdir(os.path.join(base, candidate)):
                return os.path.join(base, candidate)
    return None
