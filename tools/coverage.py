"""Print the table of inventory rows and the queries that exercise them, for the README."""

import pathlib
import re
import sys

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from hustings import catalog  # noqa: E402


def main() -> None:
    rows: dict[str, list[str]] = {}
    for q in catalog.load().values():
        for item in q.covers.split():
            rows.setdefault(item, []).append(q.name + ("" if q.sql else " (rows)"))
    key = lambda k: (re.match(r"[A-Z]+", k).group(), int(re.search(r"\d+", k).group()), k)
    print("| Row | Queries |\n|---|---|")
    for item in sorted(rows, key=key):
        print(f"| {item} | {', '.join(sorted(rows[item]))} |")


if __name__ == "__main__":
    main()
