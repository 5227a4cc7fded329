"""Project convention files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Which files hold a project's rules, in output order.
RULE_FILES = ("CLAUDE.md", "AGENTS.md", ".cursorrules", ".github/copilot-instructions.md", ".claude/settings.json")
RULE_FOLDERS = (".claude/rules", ".claude/skills")
PROJECT_VARIABLES = ("PROJECT_ROOT", "ZED_WORKTREE_ROOT")


def project_path(environ: dict[str, str] | None = None, cwd: str | None = None) -> str:
    """The current project: the first usable environment variable, else the working directory."""
    environ = os.environ if environ is None else environ
    for name in PROJECT_VARIABLES:
        if environ.get(name) not in (None, "", "/"):
            return environ[name]
    return cwd if cwd is not None else os.getcwd()


def checked_root(project: str | None, environ: dict[str, str] | None = None, cwd: str | None = None) -> str:
    root = project or project_path(environ, cwd)
    if root in ("/", "unknown"):
        raise ValueError("Cannot determine the project root; pass the project path.")
    return root


def _collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for project in batch["project"]:
            names = list(RULE_FILES)
            for folder in RULE_FOLDERS:
                found = []
                for base, _, files in os.walk(os.path.join(project, folder), followlinks=True):
                    found += [os.path.relpath(os.path.join(base, f), project) for f in files if f.endswith(".md") and f != ".md"]
                names += sorted(found)
            for order, name in enumerate(names):
                try:
                    with open(os.path.join(project, name), encoding="utf-8", newline="") as f:
                        content = f.read()
                except (OSError, UnicodeDecodeError):
                    continue
                yield pd.DataFrame([(project, order, name, content)], columns=["project", "ord", "path", "content"])


def rules(projects: DataFrame) -> DataFrame:
    """(project, ord, path, content, block): one row per rules file, blocks in reading order."""
    rows = projects.select("project").distinct().mapInPandas(
        _collect, "project string, ord int, path string, content string"
    )
    return rows.withColumn("block", F.concat(F.lit("--- "), "path", F.lit(" ---\n"), "content", F.lit("\n\n")))
