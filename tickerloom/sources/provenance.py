"""Who made a row: run, commit and time, as literals of one run."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the zone of ``generated_at_bjt``.
BEIJING = timezone(timedelta(hours=8))


def commit_sha(env: Mapping[str, str], root: str = ".") -> str:
    """The environment's commit, else that of the working copy (12 characters), else ``unknown``."""
    if found := env.get("GITHUB_SHA", "").strip():
        return found[:12]
    try:
        out = subprocess.run(["git", "rev-parse", "HEAD"], cwd=root, capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return "unknown"
    return out[:12] or "unknown"


def run_id(env: Mapping[str, str], now: datetime) -> str:
    """The prefixes, by where the id comes from."""
    for name, prefix in (("GITHUB_RUN_ID", "gh_"), ("GITHUB_RUN_NUMBER", "ghno_")):
        if found := env.get(name, "").strip():
            return prefix + found
    return now.strftime("local_%Y%m%d%H%M%S")


@dataclass(frozen=True)
class RunContext:
    run_id: str
    commit_sha: str
    created_at_utc: str
    generated_at_bjt: str
    version: int = 1
    model_version: str | None = None
    data_snapshot: str | None = None

    @classmethod
    def here(cls, env: Mapping[str, str] = os.environ, root: str = ".", now: datetime | None = None, **more) -> RunContext:
        now = now or datetime.now(timezone.utc)
        return cls(run_id(env, now), commit_sha(env, root), now.strftime("%Y-%m-%dT%H:%M:%SZ"), now.astimezone(BEIJING).strftime("%Y-%m-%d %H:%M:%S%z"), **more)

    def stamp(self, df: DataFrame, *columns: str) -> DataFrame:
        """``df`` with these of the run's columns; values that are there and not null stay."""
        stamped = {c: F.lit(getattr(self, c)) for c in columns}
        return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in stamped.items()})
