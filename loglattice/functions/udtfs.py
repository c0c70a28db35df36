"""A table function: the runs of a tool that a shell command makes."""

from __future__ import annotations

import re
import shlex
from collections.abc import Iterator

from pyspark.sql.functions import udtf

#: What sets commands apart in a line, and an assignment before a command.
APART, ASSIGNED = re.compile(r"[|&;\n]+"), re.compile(r"[A-Za-z_][A-Za-z0-9_]*=")


def tool_runs(command: str | None, tool: str, verbs: frozenset[str]) -> Iterator[tuple[str, list[str]]]:
    """(op, argv) of each run of ``tool`` at command position: where a command's first word, assignments left out, is the tool by whatever path.

    ``op`` is the first of the ``verbs`` among its arguments; a run without one is none. Part of a line that is no shell command gives nothing.
    """
    for part in APART.split(command or ""):
        try:
            words = shlex.split(part)
        except ValueError:
            continue
        first = next((k for k, w in enumerate(words) if not ASSIGNED.match(w)), len(words))
        argv = words[first:]
        if not argv or argv[0].rsplit("/", 1)[-1] != tool:
            continue
        op = next((w for w in argv[1:] if w in verbs), None)
        if op:
            yield op, argv


@udtf(returnType="op string, argv array<string>", useArrow=False)
class ToolRuns:
    """``SELECT … FROM t, LATERAL tool_runs(command, 'tool', array('query', …))``: a row a run; none for a null command."""

    def eval(self, command: str, tool: str, verbs: list):
        yield from tool_runs(command, tool, frozenset(verbs or ()))
