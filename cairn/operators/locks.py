"""The pair of lock files that keeps a deletion and an update of a repository apart."""

from __future__ import annotations

import fcntl
import os


class LockHeld(RuntimeError):
    """Another process holds the lock."""


class FileLock:
    """An exclusive lock on a file, without waiting. The file stays when the lock goes: removing it would let a third
    process lock a new file of that name while another still holds the old one."""

    def __init__(self, path: str):
        self.path, self._fd = path, None

    def acquire(self) -> None:
        if self._fd is not None:
            return
        fd = os.open(self.path, os.O_CREAT | os.O_RDWR, 0o600)
        try:
            fcntl.flock(fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError as error:
            os.close(fd)
            raise LockHeld(self.path) from error
        self._fd = fd

    def release(self) -> None:
        if self._fd is not None:
            os.close(self._fd)
            self._fd = None

    @property
    def held(self) -> bool:
        return self._fd is not None


class RepositoryLocks:
    """The collection lock, then the update lock; the first goes again if the second can't be had."""

    def __init__(self, spool_dir: str):
        self.collection, self.update = FileLock(f"{spool_dir}/is_collecting.lock"), FileLock(f"{spool_dir}/is_updating.lock")

    def acquire(self) -> None:
        self.collection.acquire()
        try:
            self.update.acquire()
        except BaseException:
            self.collection.release()
            raise

    def release(self) -> None:
        self.update.release()
        self.collection.release()

    @property
    def held(self) -> bool:
        return self.collection.held

    def __enter__(self) -> RepositoryLocks:
        self.acquire()
        return self

    def __exit__(self, *_) -> None:
        self.release()
