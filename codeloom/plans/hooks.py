"""Hook commands: a JSON payload in, a JSON envelope out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans import views
from codeloom.sources import gittext
from codeloom.sources.store import CodeStore

# Command → the event its answer belongs to.
EVENTS = {
    "hook:context": "SessionStart",
    "hook:prompt": "UserPromptSubmit",
    "hook:pre-read": "PreToolUse",
    "hook:pre-edit": "PreToolUse",
    "hook:post-edit": "PostToolUse",
    "hook:post-compact": "PostCompact",
}


def _texts(df: DataFrame, column: str = "context") -> list[str]:
    ordered = df.orderBy("file_path") if "file_path" in df.columns else df
    return [row[0] for row in ordered.select(column).toLocalIterator()]


def context(spark: SparkSession, store: CodeStore, command: str, payload: dict) -> str | None:
    """The text a hook adds, or None when it has nothing to say."""
    cwd = payload.get("cwd") or ""
    roots = spark.createDataFrame([(cwd,)], "project string")
    view = store.view()
    files, imports = view.files(cwd), view.imports(cwd)
    if command == "hook:context":
        guide = "Ask the import graph about structure before searching file contents."
        status = _texts(views.session_context(files, imports, roots)) if cwd else []
        return "\n\n".join([guide, *status])
    if files.isEmpty():
        return None
    if command == "hook:prompt":
        prompt = payload.get("prompt")
        if not prompt:
            return None
        prompts = spark.createDataFrame([(0, cwd, prompt)], "prompt_id bigint, project string, prompt string")
        parts = _texts(views.prompt_context(files, imports, prompts))
    elif command in ("hook:pre-read", "hook:pre-edit"):
        path = (payload.get("tool_input") or {}).get("file_path")
        if not isinstance(path, str) or not path:
            return None
        path = path if path.startswith("/") else f"{cwd}/{path}"
        touched = spark.createDataFrame([(cwd, path)], "project string, file_path string")
        action = "Reading" if command == "hook:pre-read" else "Editing"
        parts = _texts(views.tool_context(files, imports, touched, action))
    else:
        changed = gittext.parse_numstat(gittext.command_lines(roots, gittext.NUMSTAT))
        if command == "hook:post-edit":
            parts = _texts(views.post_edit_lines(imports, files, changed), "line")
        else:
            parts = _texts(views.compact_context(files, imports, changed))
    return "\n".join(parts) or None


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def run(spark: SparkSession, store: CodeStore, command: str, payload_text: str) -> str:
    """Answer one hook call. Unreadable payloads give an envelope without context."""
    if command not in EVENTS:
        raise SystemExit(f"unknown command {command}; known: {', '.join(EVENTS)}")
    envelope: dict = {"continue": True, "suppressOutput": True}
    try:
        payload = json.loads(payload_text)
    except ValueError:
        payload = None
    text = context(spark, store, command, payload) if isinstance(payload, dict) else None
    if text is not None:
        envelope["hookSpecificOutput"] = {"hookEventName": EVENTS[command], "additionalContext": text}
    return json.dumps(envelope, separators=(",", ":"), ensure_ascii=False)
