"""Print the names of the registered queries of one suite module."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from suite import all_queries  # noqa: E402

print(" ".join(n for n, f in all_queries().items() if f.__module__ == f"suite.{sys.argv[1]}"))
