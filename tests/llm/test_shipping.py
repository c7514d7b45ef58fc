"""Workers that cannot import this package: everything they need comes with the task."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = f"""
import sys
sys.path.insert(0, {REPO!r})
from vellum.llm import langid, quality
from vellum.session import session
spark = session("local[2]", "shipping", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
rows = [(i, ("bada gado " if i % 2 else "skrit klunk ") * 9, "ab"[i % 2], i % 2) for i in range(60)]
docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
assert langid.predict(docs, langid.fit(docs)).count() == 60
assert quality.score(docs, quality.fit(docs, docs)).count() == 60
print("done")
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert got.stdout.strip().endswith("done"), got.stderr[-2000:]
