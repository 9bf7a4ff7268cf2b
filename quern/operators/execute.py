"""Running code samples in subprocesses. Off unless asked for: the code is untrusted, and the only guards here are a time
limit, an own working folder and Python's isolated mode. Run it on machines that hold nothing else."""

from __future__ import annotations

import subprocess
import sys
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Seconds a script may take (fixed values of the suites).
TIMEOUTS = {"humaneval": 5.0, "mbpp": 5.0, "ds1000": 10.0}


def passed(script: str | None, timeout: float) -> bool:
    """Whether the script ends with exit code 0 in time; a null script, a timeout or any error is a failure."""
    if script is None:
        return False
    with tempfile.TemporaryDirectory() as work:  # the script's own scratch, gone with it
        try:
            done = subprocess.run([sys.executable, "-I", "-"], input=script.encode("utf-8", "surrogatepass"), cwd=work, env={"PATH": "/usr/bin:/bin"}, capture_output=True, timeout=timeout)
            return done.returncode == 0
        except (subprocess.SubprocessError, OSError, UnicodeError):
            return False


def outcomes(scripts: DataFrame, suite: str = "humaneval", allow_untrusted_code: bool = False) -> DataFrame:
    """(task_id, sample_idx, passed) of (task_id, sample_idx, script)."""
    if not allow_untrusted_code:
        raise PermissionError("samples are untrusted code; pass allow_untrusted_code=True where running it is safe")
    timeout = TIMEOUTS[suite]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(passed=[passed(s, timeout) for s in pdf["script"]])[["task_id", "sample_idx", "passed"]]

    return scripts.select("task_id", "sample_idx", "script").mapInPandas(run, "task_id string, sample_idx int, passed boolean")
