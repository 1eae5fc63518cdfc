"""The driver's file works whatever the optional parts lack."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SAYS = "import sys; sys.path.insert(0, {root!r}); {block}import __spark_entry__ as e; print(len([q for q in e.queries() if not q.startswith(('op', 'pipeline'))]), len(e.queries()), len(e.oracle_sql()))"


def counted(block: str) -> list[int]:
    done = subprocess.run([sys.executable, "-c", SAYS.format(root=str(ROOT), block=block)], capture_output=True, text=True, timeout=120, check=True)
    return list(map(int, done.stdout.split()))


def test_queries_stay_where_a_library_of_the_optional_part_is_missing():
    whole = counted("")
    for missing in ("public_tokenizers", "tiktoken", "xxhash", "lectern.llm"):
        plain, every, oracles = counted(f"sys.modules[{missing!r}] = None; ")
        assert plain == every == whole[0] and plain <= oracles + 0
    plain, every, _ = counted("sys.modules['corpus_pipeline'] = None; ")
    assert plain == whole[0] and every <= whole[1]
