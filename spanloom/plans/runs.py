"""A bounded run of requests: attempts, slots and one deadline, kept in a ledger that a later run takes up."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import tempfile
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

MOST_ATTEMPTS, ATTEMPTS_A_KEY, SLOTS, SECONDS, MOST_SECONDS, MOST_REPLY_BYTES = 12, 2, 4, 240, 2_160, 1 << 20
VERSION = "run.v1"


def replace_file(path: Path, text: str) -> None:
    """Write a file so that a reader sees the old or the new one."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(handle, "w", encoding="utf-8") as file:
        file.write(text)
        file.flush()
        os.fsync(file.fileno())
    os.replace(name, path)


@dataclass
class Run:
    """Calls ``send`` for requests, each at most twice and twelve times in all, and keeps what was validated."""

    ledger: Path
    identity: str
    seconds: int = SECONDS
    clock: Callable[[], float] = time.time
    state: dict = field(init=False)
    _guard: threading.Lock = field(init=False, default_factory=threading.Lock, repr=False)

    def __post_init__(self) -> None:
        self.state = {"version": VERSION, "identity": self.identity, "deadline": self.clock() + min(self.seconds, MOST_SECONDS), "attempts": {}, "done": {}}
        with self._held():
            self._keep()

    @contextmanager
    def _held(self) -> Iterator[None]:
        """The ledger as it stands, for this thread and process alone."""
        self.ledger.parent.mkdir(parents=True, exist_ok=True)
        with self._guard, self.ledger.with_name(self.ledger.name + ".lock").open("a") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            if self.ledger.exists():
                kept = json.loads(self.ledger.read_text(encoding="utf-8"))
                if kept.get("version") != VERSION or kept.get("identity") != self.identity:
                    raise ValueError("the ledger is of another run")
                if any(n > ATTEMPTS_A_KEY for n in kept["attempts"].values()) or sum(kept["attempts"].values()) > MOST_ATTEMPTS:
                    raise ValueError("the ledger exceeds its limits")
                self.state = kept
            yield

    def _keep(self) -> None:
        replace_file(self.ledger, json.dumps(self.state, sort_keys=True))

    @staticmethod
    def key(request: str) -> str:
        return hashlib.sha256(request.encode()).hexdigest()

    def call(self, request: str, send: Callable[[str], str], validate: Callable[[str], object]) -> str:
        """The validated reply to a request: stored, or sent for while attempts and time last."""
        key = self.key(request)
        error: Exception | None = None
        while (stored := self._reserve(key, error)) is None:
            try:
                reply = send(request)
                if len(reply.encode()) > MOST_REPLY_BYTES:
                    raise ValueError("the reply exceeds its size")
                validate(reply)
            except (ValueError, ConnectionError) as e:
                error = e
                continue
            with self._held():
                self.state["done"][key] = reply
                self._keep()
            return reply
        return stored

    def _reserve(self, key: str, error: Exception | None) -> str | None:
        """The stored reply, or None once an attempt is counted and kept, which comes before anything is sent."""
        with self._held():
            if key in self.state["done"]:
                return self.state["done"][key]
            attempts = self.state["attempts"]
            if attempts.get(key, 0) >= ATTEMPTS_A_KEY:
                raise error or RuntimeError("no attempt is left for this request")
            if sum(attempts.values()) >= MOST_ATTEMPTS:
                raise RuntimeError("no attempt is left in this run")
            if self.clock() >= self.state["deadline"]:
                raise TimeoutError("the run's time is over")
            attempts[key] = attempts.get(key, 0) + 1
            self._keep()
            return None

    def parallel(self, requests: list[str], send: Callable[[str], str], validate: Callable[[str], object]) -> list[str]:
        """Replies in the order of the requests, over at most four slots; equal requests are sent once, the first failure ends the run.

        More requests than the run has attempts left are refused before any is sent.
        """
        distinct = list(dict.fromkeys(requests))
        with self._held():
            missing = sum(self.key(r) not in self.state["done"] for r in distinct)
            if missing > MOST_ATTEMPTS - sum(self.state["attempts"].values()):
                raise RuntimeError("no attempt is left in this run")
        replies: dict[str, str] = {}
        with ThreadPoolExecutor(max_workers=SLOTS) as pool:
            waiting = {pool.submit(self.call, r, send, validate): r for r in distinct}
            try:
                for done in as_completed(waiting):
                    replies[waiting[done]] = done.result()
            except BaseException:
                pool.shutdown(cancel_futures=True)
                raise
        return [replies[r] for r in requests]


def run_seconds(writers: int, edited: bool = True) -> int:
    """Seconds of a run: those of a request for each wave of slots, and for the editor."""
    return min(MOST_SECONDS, SECONDS * (-(-writers // SLOTS) + edited))


def state_folder(out: Path, identity: str, given: Path | None = None) -> Path:
    """Where a plan keeps its ledger: the folder that is given, or one of its own beside the output, so that no plan meets another's budget."""
    return given if given is not None else out.with_suffix(".state") / identity


def narrate(out: Path, requests: list[str], approve: Callable[[int, int], bool], send: Callable[[str], str], validate: Callable[[str], object], merge: Callable[[list[str]], str] | None = None) -> list[str] | None:
    """Prepare, ask, write and check: the validated replies, and the editor's behind them where ``merge`` makes its request; None if they are not approved.

    ``approve`` is asked once with the number of requests and their bytes, before anything is sent.
    """
    identity = Run.key("\0".join(requests))
    calls = len(requests) + (merge is not None)
    if not approve(calls, sum(len(r.encode()) for r in requests)):
        return None
    folder = state_folder(out, identity)
    run = Run(folder / "run.json", identity, run_seconds(len(requests), merge is not None))
    replies = run.parallel(requests, send, validate)
    return replies if merge is None else [*replies, run.call(merge(replies), send, validate)]
