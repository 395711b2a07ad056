"""Text generators that a library may use for summaries and answers; none is needed."""

from __future__ import annotations

import os
import subprocess
import tempfile
from typing import Protocol

from .config import ModelUnavailable


class Provider(Protocol):
    name: str

    def generate(self, prompt: str, max_tokens: int, temperature: float) -> str: ...


class NullProvider:
    name = "null"

    def generate(self, prompt: str, max_tokens: int, temperature: float) -> str:
        raise ModelUnavailable("no language model is set")


class FakeProvider:
    """Echoes the end of the prompt; for tests."""

    name = "fake"

    def generate(self, prompt: str, max_tokens: int, temperature: float) -> str:
        return f"[fake] {prompt[-200:]}"


class CommandProvider:
    """A program that reads a prompt file: ``command`` with {prompt}, {max_tokens} and {temperature} filled in."""

    name = "command"

    def __init__(self, command: list[str], timeout: int = 300):
        self.command, self.timeout = command, timeout

    def generate(self, prompt: str, max_tokens: int, temperature: float) -> str:
        fd, path = tempfile.mkstemp(suffix=".txt")
        try:
            with os.fdopen(fd, "w") as f:
                f.write(prompt)
            args = [a.format(prompt=path, max_tokens=max_tokens, temperature=temperature) for a in self.command]
            try:
                done = subprocess.run(args, capture_output=True, text=True, timeout=self.timeout)
            except (OSError, subprocess.TimeoutExpired) as e:
                raise ModelUnavailable(str(e)) from e
            if done.returncode:
                raise ModelUnavailable(done.stderr[-500:])
            return done.stdout.strip()
        finally:
            os.unlink(path)
