"""`python -m strandloom <program> <input> [<output folder>]`"""

from __future__ import annotations

import sys

from strandloom.plans.programs import PROGRAMS
from strandloom.plans.session import build_session
from strandloom.sources.text import write_ordered


def main() -> None:
    if len(sys.argv) < 2 or sys.argv[1] not in PROGRAMS:
        sys.exit("programs: " + " ".join(sorted(PROGRAMS)))
    spark = build_session()
    lines = PROGRAMS[sys.argv[1]](spark, *sys.argv[2:3])
    if len(sys.argv) > 3:
        write_ordered(lines, ["n"], "value", sys.argv[3])
    else:
        for row in lines.orderBy("n").toLocalIterator():
            print(row.value)


if __name__ == "__main__":
    main()
