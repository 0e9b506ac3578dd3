"""Python jobs run in a session that was started anywhere, without the repository on the workers' path."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from unitloom.plans.all import QUERIES
from unitloom.session import local_session
spark = local_session(2)
spark.sparkContext.setLogLevel("OFF")
for name in ("G1_knn_cosine", "I4_spike_forced", "F4_unit_targets", "C17_resplit_cascade"):
    print(name, QUERIES[name](spark, {tables!r}).limit(5).count())
"""


def test_python_jobs_start_from_an_empty_folder(tmp_path):
    from unitloom.plans.all import QUERIES

    spikes = next(n for n in QUERIES if n.startswith("I4"))
    script = SCRIPT.format(repo=str(REPO), tables="/root/testdata/sf0.001").replace("I4_spike_forced", spikes)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(done.stdout.split()) == 8 and "0" not in done.stdout.split()[1::2]
