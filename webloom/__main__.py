"""python -m webloom list | show QUERY DIR [ROWS] | explain QUERY DIR | write QUERY DIR OUT: the registered queries over a folder of parquet tables."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from webloom import plans
    from webloom.session import session

    if args[:1] == ["list"]:
        print("\n".join(sorted(plans.QUERIES)))
        return 0
    if len(args) < 3 or args[0] not in ("show", "explain", "write") or args[1] not in plans.QUERIES:
        print(__doc__)
        return 2
    spark = session()
    frame = plans.QUERIES[args[1]](spark, args[2])
    if args[0] == "show":
        frame.show(int(args[3]) if len(args) > 3 else 20, truncate=80)
    elif args[0] == "explain":
        frame.explain("formatted")
    else:
        frame.write.parquet(args[3])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
