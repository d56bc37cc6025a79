"""Every parameter of a public function is read by its body, or is one that can't change a result."""

import ast
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1] / "tabulon"
#: Hints on copies, sort algorithms and layouts of the local interface that mean nothing for immutable distributed rows.
HINTS = {"self", "cls", "deep", "copy", "kind", "exc", "verbose", "max_cols", "null_counts", "sortorder", "col_level", "col_fill"}


def unread(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if not isinstance(node, ast.FunctionDef) or node.name.startswith("_") and node.name != "__init__":
            continue
        a = node.args
        names = {x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg] if x}
        read = {n.id for b in node.body for n in ast.walk(b) if isinstance(n, ast.Name)}
        for name in sorted(names - read - HINTS):
            yield f"{path.name}:{node.lineno} {node.name}({name})"


@pytest.mark.parametrize("module", ["frame.py", "series.py", "groupby.py", "api.py", "sources/readers.py", "sources/sinks.py", "plot.py"])
def test_parameters_are_read(module):
    assert list(unread(ROOT / module)) == []
