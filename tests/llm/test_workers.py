"""Executors need not have this package: all that tasks use travels with them."""

import gc
import os
import subprocess
import sys
import weakref

SCRIPT = """
import sys
from pyspark.sql import SparkSession
sys.path.insert(0, sys.argv[1])
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    if name.startswith("op"):
        print(name, query(spark, sys.argv[2]).count(), flush=True)
"""


def test_queries_without_the_package_on_executors(sf, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    (tmp_path / "run.py").write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME", "PYSPARK_GATEWAY_PORT")}
    done = subprocess.run([sys.executable, "run.py", root, sf], cwd=tmp_path, env=env, capture_output=True, text=True,
                          timeout=900)
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith("op"))
    assert len(counts) == 13, done.stderr[-2000:]


def test_what_a_worker_held_goes_before_the_next_is_made():
    from loanlab.llm import common

    class Ring:
        def __init__(self):
            self.me = self
    gone, there = weakref.ref(common.worker_slot(("ring",), Ring)), []
    gc.disable()
    try:
        assert common.worker_slot(("next",), lambda: there.append(gone()) or 1) == 1 and there == [None]
    finally:
        gc.enable()


def test_the_memo_of_an_encoder_keeps_its_bound():
    from loanlab.llm.byte_bpe import Encoder
    ranks = {bytes([b]): b for b in range(256)}
    import public_tokenizers
    encoder = Encoder(ranks, public_tokenizers.PATTERN, 10)
    text = "".join(f" {a}{b}" for a in "abcdefgh" for b in "klmnopq") * 2
    assert encoder.decode(encoder.encode(text)) == text.encode()
    memo = encoder.pieces.spaced
    assert 0 < len(memo) <= 10 and len(memo.old) <= 10
