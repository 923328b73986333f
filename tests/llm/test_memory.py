"""Python workers idle beside later stages: what a task has freed must not stay with them."""

import os
import subprocess
import sys

SCRIPT = """
import random, re
import pyarrow as pa
from markloom.llm import neardup

r = random.Random(1)
words = [f"w{k}" for k in range(3000)]
texts = [" ".join(r.choices(words, k=700)) for _ in range(5000)]
size = lambda: sum(map(int, re.findall(r"Pss_(?:Anon|Shmem): +([0-9]+)", open("/proc/self/smaps_rollup").read()))) / 1024
column = lambda texts: pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(t.encode() for t in texts)], ["id", "text"])
for out in neardup._full_sets(iter([column(texts[:10])])):
    pass
del out
before, n = size(), 0
for out in neardup._full_sets(column(texts) for _ in range(2)):
    n += out.num_rows
del out
print(n, size() - before)
"""


def test_a_task_keeps_little():
    done = subprocess.run([sys.executable, "-c", SCRIPT], capture_output=True, text=True, env=os.environ, timeout=300, check=True)
    n, kept = done.stdout.split()
    assert int(n) == 10000 and float(kept) < 40
