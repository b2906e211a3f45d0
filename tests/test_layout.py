import ast
from pathlib import Path

ROOT = Path(__file__).parent.parent


def imported(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            yield node.module
            yield from (f"{node.module}.{a.name}" for a in node.names)


def test_only_the_entry_point_imports_llm():
    for path in [*(ROOT / "tokensift").rglob("*.py"), ROOT / "bench.py", *(ROOT / "tests").glob("*.py")]:
        if "llm" not in path.relative_to(ROOT).parts:
            assert not any(name.startswith("tokensift.llm") for name in imported(path)), path


def test_no_machine_local_checkpoints():
    for path in (ROOT / "tokensift").rglob("*.py"):
        assert "localCheckpoint" not in path.read_text(), path
