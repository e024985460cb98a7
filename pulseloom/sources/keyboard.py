"""Keys of a terminal as controls of a recording (O-REC-5): lines in a pipe that a stream reads."""

from __future__ import annotations

import os
import select
import sys
import threading
import time

#: A key that is held repeats itself faster than this; a longer silence is its release.
RELEASE_S = 0.7


class Keys:
    """While open, the label key writes ``toggle`` to ``pipe``, or ``press`` and ``release`` where it is to be held, and
    the quit key ``quit``. Without a terminal there are no keys, and only ``say`` writes. ``fd`` is the standard input."""

    def __init__(self, pipe: str, label_key: str, quit_key: str, hold: bool = False, fd: int | None = None) -> None:
        # Reading as well, so that opening does not wait for a reader.
        self.out = os.open(pipe, os.O_RDWR | os.O_NONBLOCK | os.O_APPEND)
        self.label_key, self.quit_key, self.hold = label_key, quit_key, hold
        try:
            self.fd = sys.stdin.fileno() if fd is None else fd
        except (OSError, ValueError):
            self.fd = -1
        self.before, self.thread, self.stopped = None, None, threading.Event()

    def say(self, action: str) -> None:
        os.write(self.out, f"{action}\n".encode())

    def __enter__(self) -> Keys:
        if self.fd >= 0 and os.isatty(self.fd) and (self.label_key or self.quit_key):
            import termios
            import tty

            self.before = termios.tcgetattr(self.fd)
            tty.setcbreak(self.fd)
            self.thread = threading.Thread(target=self._run, name="keys", daemon=True)
            self.thread.start()
        return self

    def _run(self) -> None:
        last = None
        while not self.stopped.is_set():
            there = select.select([self.fd], [], [], 0.1)[0]
            key = os.read(self.fd, 1).decode("utf-8", "replace") if there else ""
            if last is not None and key != self.label_key and time.monotonic() - last > RELEASE_S:
                self.say("release")
                last = None
            if key and key == self.quit_key:
                self.say("quit")
            elif key and key == self.label_key:
                if not self.hold:
                    self.say("toggle")
                elif last is None:
                    self.say("press")
                last = time.monotonic() if self.hold else None

    def __exit__(self, *_) -> None:
        self.stopped.set()
        if self.thread is not None:
            import termios

            self.thread.join(2)
            termios.tcsetattr(self.fd, termios.TCSADRAIN, self.before)
        os.close(self.out)
