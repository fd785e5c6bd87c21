"""A Python session for generated code: one process per action, with limits.

State lasts between actions by replaying those that succeeded, without their
output; a failed action leaves nothing. Code that the syntax check refuses is
not run.
"""

from __future__ import annotations

import resource
import subprocess
import sys
import tempfile
import time
from dataclasses import dataclass

from .code import check_code, show_last_expression

_MARK = "\x1e"


@dataclass(frozen=True)
class Result:
    ok: bool
    stdout: str
    stderr: str
    elapsed: float = 0.0
    timed_out: bool = False
    blocked: bool = False


class Session:
    def __init__(self, seconds: float = 20.0, megabytes: int = 3072):
        self.seconds, self.megabytes, self.history = seconds, megabytes, []

    def _limits(self) -> None:
        size, cpu = self.megabytes << 20, int(self.seconds) + 1
        resource.setrlimit(resource.RLIMIT_AS, (size, size))
        resource.setrlimit(resource.RLIMIT_CPU, (cpu, cpu))
        resource.setrlimit(resource.RLIMIT_CORE, (0, 0))

    def run(self, source: str) -> Result:
        """Run one action in the state that the earlier ones left."""
        allowed, reason = check_code(source)
        if not allowed:
            return Result(False, "", reason, blocked=not reason.startswith("syntax"))
        program = "\n".join([*self.history, f"print({_MARK!r}, end='')", show_last_expression(source)])
        began = time.monotonic()
        with tempfile.TemporaryDirectory() as folder:
            try:
                done = subprocess.run([sys.executable, "-I", "-c", program], cwd=folder, capture_output=True, text=True, timeout=self.seconds, preexec_fn=self._limits, env={}, check=False)
            except subprocess.TimeoutExpired:
                return Result(False, "", "", time.monotonic() - began, timed_out=True)
        out, ok = done.stdout.rpartition(_MARK)[2], done.returncode == 0
        if ok:
            self.history.append(source)
        return Result(ok, out, done.stderr, time.monotonic() - began)
