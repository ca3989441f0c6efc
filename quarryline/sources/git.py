"""What git knows of a folder, for the driver; empty text where it knows nothing."""

from __future__ import annotations

import subprocess


def _git(folder: str, *args: str) -> str:
    try:
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.TimeoutExpired):
        return ""
    return done.stdout.strip() if done.returncode == 0 else ""


def root(folder: str) -> str:
    """The repository's root, or the folder itself."""
    return _git(folder, "rev-parse", "--show-toplevel") or folder


def origin(folder: str) -> str:
    return _git(folder, "config", "--get", "remote.origin.url")


def head(folder: str) -> str:
    return _git(folder, "rev-parse", "HEAD")
