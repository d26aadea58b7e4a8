"""Where a source tree comes from: a local folder or a GitHub address."""

from __future__ import annotations

import logging
import re
import shutil
import subprocess
from pathlib import Path

from ..functions import fixed

log = logging.getLogger(__name__)


def github_name(source: str) -> tuple[str, str] | None:
    m = re.match(fixed.GITHUB_URL, source)
    return (m[1], m[2]) if m else None


def resolve(source: str, clone_root: str = "_repos", run=subprocess.run) -> Path:
    """The folder of a source: an existing path as it is, else a shallow clone of a GitHub repository. ValueError for anything else, RuntimeError if cloning fails; a failed update keeps the clone there is."""
    if Path(source).exists():
        return Path(source).resolve()
    if not (name := github_name(source)):
        raise ValueError(f"{source!r} is neither an existing path nor a GitHub address")
    target = Path(clone_root).resolve() / f"{name[0]}__{name[1]}"
    if target.exists():
        if run(["git", "-C", str(target), "pull", "--ff-only", "--depth=1"], capture_output=True).returncode:
            log.warning("could not update %s; using what is there", target)
        return target
    target.parent.mkdir(parents=True, exist_ok=True)
    done = run(["git", "clone", "--depth=1", f"https://github.com/{name[0]}/{name[1]}.git", str(target)], capture_output=True)
    if done.returncode:
        shutil.rmtree(target, ignore_errors=True)
        raise RuntimeError(f"cloning {source} failed: {(done.stderr or b'').decode(errors='replace').strip()}")
    return target
