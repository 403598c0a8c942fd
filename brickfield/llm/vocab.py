"""Public tokenizer files. The paths are parameters of the operators.

A worker serves one operator after another, and a loaded vocabulary is large, so it holds one at a time: loading another one, or
a task that loads none, lets the one before go.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Hashable

import public_tokenizers
from pyspark import TaskContext

_held: dict[Hashable, object] = {}
_used_by: list[int] = []


def default_path(name: str) -> str:
    return public_tokenizers.path(name)


def _task() -> int:
    context = TaskContext.get()
    return context.taskAttemptId() if context else -1


def hold(key: Hashable, make: Callable[[], object]):
    """The thing of that key, made if the worker doesn't hold it."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    _used_by[:] = [_task()]
    return _held[key]


def let_go() -> None:
    """Forgets what this task hasn't asked for."""
    if _used_by != [_task()]:
        _held.clear()


def load_ranks(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def ranks_encoding(path: str):
    """A tiktoken encoding from a file of base64 tokens and ranks, and the ranks."""
    return hold(("ranks", path), lambda: load_ranks(path))


def json_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
