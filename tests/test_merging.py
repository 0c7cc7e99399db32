"""Modules of a program merged by name, from texts to facts."""

import pytest

from ferrule.cli import Options, load
from ferrule.operators import merge

BODY = """{head} @`{name}` : $`Int` {{
bb0:
  v = new $`{type}`
  return v
}}
"""


def program(spark, folder, modules):
    for module, functions in modules.items():
        texts = [BODY.format(head="func" if a is None else f"func [{a}]", name=n, type=t) for n, a, t in functions]
        (folder / module).write_text("ir_stage raw\n\n" + "\n".join(texts))
    return load(spark, Options(str(folder), str(folder / "out")))


def bodies(p):
    return {(r.func, r.alloc_type) for r in p.facts["stmt"].where("kind = 'new'").collect()}


def test_models_stand_for_stubs(spark, tmp_path):
    p = program(
        spark,
        tmp_path,
        {
            "a.ir": [("lib", "stub", "Stub"), ("own", None, "Own"), ("same", None, "First"), ("declared", "stub", "Stub")],
            "b.ir": [("lib", "model", "Model"), ("own", "model", "Override"), ("same", None, "Second"), ("declared", None, "Body"), ("idle", "model", "Idle")],
        },
    )
    assert bodies(p) == {("lib", "Model"), ("own", "Override"), ("same", "First"), ("declared", "Body")}
    ids = [r.stmt_id for r in p.facts["stmt"].collect()]
    assert len(ids) == len(set(ids))


def test_versions_that_are_no_one_function(spark, tmp_path):
    with pytest.raises(merge.MergeConflict):
        program(spark, tmp_path, {"a.ir": [("f", "stub", "S")], "b.ir": [("f", "model", "M")], "c.ir": [("f", "model", "N")]})
