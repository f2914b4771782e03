"""Every module of the library says each name once."""

import ast
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("path", sorted(str(p.relative_to(ROOT)) for p in (ROOT / "palisade").rglob("*.py")))
def test_no_name_is_defined_twice(path):
    def check(body, where):
        names = [n.name for n in body if isinstance(n, ast.FunctionDef | ast.ClassDef)]
        assert len(names) == len(set(names)), where
        for n in body:
            if isinstance(n, ast.ClassDef):
                check(n.body, f"{where}.{n.name}")

    check(ast.parse((ROOT / path).read_text()).body, path)
