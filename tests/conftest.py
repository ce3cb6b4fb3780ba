import json
import os
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE.parent))
# Python workers load the functions of the test modules by name.
os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE.parent), str(HERE), os.environ.get("PYTHONPATH", "")])

from glossmill.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(4, "tests", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines_file(tmp_path):
    """Write records (dicts) or raw strings as a JSON-lines file."""

    def write(items, name="in.jsonl", end="\n"):
        path = tmp_path / name
        text = end.join(i if isinstance(i, str) else json.dumps(i, ensure_ascii=False) for i in items)
        path.write_bytes((text + end).encode("utf-8"))
        return str(path)

    return write


def record(id="r", text="alpha beta gamma", entities=(), relations=(), lang="en", **more):
    """A raw record in the input format."""
    ents = [
        {"id": e[0], "label": e[1], f"{lang}_term": e[2], f"{lang}_start_token_idx": e[3], f"{lang}_end_token_idx": e[4]}
        for e in entities
    ]
    rels = [{"label": r[0], "subject_id": r[1], "object_id": r[2]} for r in relations]
    return {"id": id, f"{lang}_sentence_str": text, "entities": ents, "relations": rels, **more}
