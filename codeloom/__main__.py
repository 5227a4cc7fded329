"""``python -m codeloom hook:<name>``: answer a hook call from standard input."""

from __future__ import annotations

import os
import sys

from codeloom.plans.hooks import EVENTS, run
from codeloom.session import spark_session
from codeloom.sources.store import CodeStore


def main() -> int:
    command = sys.argv[1] if len(sys.argv) > 1 else ""
    if command not in EVENTS:
        print(f"usage: python -m codeloom {{{'|'.join(EVENTS)}}} < payload.json", file=sys.stderr)
        return 1
    spark = spark_session()
    store = CodeStore(spark, location=os.environ.get("CODELOOM_LOCATION"))
    print(run(spark, store, command, sys.stdin.read()), end="")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
