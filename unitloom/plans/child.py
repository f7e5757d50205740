"""Calls in a child process, which can be ended whatever it does.

A function that hangs in native code, or ignores signals, cannot be stopped from within.  It is therefore built and
called in a process of its own, a session leader, which serves one call after the other; at the limit that session
is killed and the next call starts another.  The next rows of a task are not affected.
"""

from __future__ import annotations

import os
import pickle
import select
import signal
import struct
import subprocess
import sys
import time
from collections.abc import Callable

_HEAD = struct.Struct("<Q")


def _send(fd: int, value: bytes) -> None:
    with os.fdopen(os.dup(fd), "wb") as pipe:
        pipe.write(_HEAD.pack(len(value)) + value)


def _read(fd: int, size: int, deadline: float | None) -> bytes:
    """So many bytes; a TimeoutError at the deadline, an EOFError if the other side is gone."""
    found, waiting = bytearray(), select.poll()
    waiting.register(fd, select.POLLIN)
    while len(found) < size:
        left = None if deadline is None else max(0.0, deadline - time.monotonic()) * 1000
        if not waiting.poll(left):
            raise TimeoutError
        part = os.read(fd, min(size - len(found), 1 << 20))
        if not part:
            raise EOFError
        found += part
    return bytes(found)


def _receive(fd: int, deadline: float | None = None):
    return _read(fd, _HEAD.unpack(_read(fd, _HEAD.size, deadline))[0], deadline)


def serve(inward: int, outward: int) -> None:
    """What the child does: build the function, then answer calls until the other side is gone."""
    from pyspark import cloudpickle

    try:
        fn = pickle.loads(_receive(inward))()
        _send(outward, b"")
        while True:
            value = pickle.loads(_receive(inward))
            try:
                reply = True, fn(value)
            except Exception as raised:
                reply = False, raised
            try:
                packed = cloudpickle.dumps(reply)
                pickle.loads(packed)
            except Exception:
                packed = cloudpickle.dumps((False, RuntimeError(str(reply[1]))))
            _send(outward, packed)
    except EOFError:
        pass


class LimitedCalls:
    """Calls of a function that ``make_fn`` builds, each of ``seconds`` at most, then a TimeoutError."""

    def __init__(self, make_fn: Callable[[], Callable], seconds: float):
        from pyspark import cloudpickle

        self.made, self.seconds, self.process = cloudpickle.dumps(make_fn), seconds, None

    def _start(self) -> None:
        theirs_in, self.outward = os.pipe()
        self.inward, theirs_out = os.pipe()
        code = f"from unitloom.plans.child import serve; serve({theirs_in}, {theirs_out})"
        self.process = subprocess.Popen(
            [sys.executable, "-c", code], pass_fds=(theirs_in, theirs_out), start_new_session=True, stdin=subprocess.DEVNULL,
            stdout=subprocess.DEVNULL, env={**os.environ, "PYTHONPATH": os.pathsep.join(path for path in sys.path if path)})
        os.close(theirs_in)
        os.close(theirs_out)
        _send(self.outward, self.made)
        try:
            _receive(self.inward)  # building is not part of a call
        except EOFError:
            self.close()
            raise RuntimeError("the function could not be built") from None

    def __call__(self, value):
        from pyspark import cloudpickle

        if self.process is None:
            self._start()
        try:
            _send(self.outward, cloudpickle.dumps(value))
            good, reply = pickle.loads(_receive(self.inward, time.monotonic() + self.seconds))
        except TimeoutError:
            self.close()
            raise
        except (EOFError, BrokenPipeError):
            code = self.close()
            raise RuntimeError(f"the process of the call ended with {code}") from None
        if not good:
            raise reply
        return reply

    def close(self) -> int | None:
        """End the child, and what it has started, if there is one."""
        if self.process is None:
            return None
        process, self.process = self.process, None
        try:
            os.killpg(process.pid, signal.SIGKILL)
        except ProcessLookupError:
            pass
        code = process.wait()
        os.close(self.inward)
        os.close(self.outward)
        return code
