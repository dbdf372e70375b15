import os
import re

from factloom import session


def test_tables_in_the_shared_folder(spark):
    rows, path = session.stage_table(spark.range(5), "five")
    assert path.startswith("file:///") and rows.count() == 5
    session.clean(spark)
    assert not os.path.exists(path[7:])


def test_nothing_outside_imports_llm():
    root = os.path.join(os.path.dirname(session.__file__))
    for folder, _, names in os.walk(root):
        for name in names:
            if name.endswith(".py") and os.sep + "llm" not in folder:
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"\bllm\b", f.read()), name
