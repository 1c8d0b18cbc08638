"""Memory that the groups of substring deduplication leave behind."""

import pyarrow as pa

from textquarry.llm import substring


def test_every_group_gives_its_memory_back(monkeypatch):
    """Workers are kept for later tasks and held on to what a group had taken."""
    given = []
    monkeypatch.setattr(substring, "give_back", lambda: given.append(1))
    docs = pa.table({"doc_id": [1, 2], "text": ["a b c d " * 9, "a b c d " * 9], "chunk": pa.array([0, 0], pa.int32())})
    asked = substring._released(substring._ask_minimizers(20, 4))(docs)
    repeated = substring._released(substring._repeated_minimizers)(asked)
    placed = substring._released(substring._ask_windows(20, 4))(docs, repeated)
    answers = substring._released(substring._earliest)(placed)
    parsed = substring._released(substring._parse(20, ()))(docs, answers)
    assert len(given) == 5 and parsed["n_removed"].to_pylist()[1] == 36
