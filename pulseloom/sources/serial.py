"""A line device as a streaming source that reconnects and replays, and a single-owner lock (O-SRC-1..5, O-STR-4/7/10)."""

from __future__ import annotations

import json
import os
import re
import select
import stat
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from glob import glob

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Device names that are tried, in this order.
PORT_PATTERNS = ("/dev/tty.usb*", "/dev/tty.SLAB*", "/dev/tty.wchusbserial*", "/dev/ttyUSB*", "/dev/ttyACM*", "COM*")
BAUD = 230400
SAMPLE_HZ = 250
#: Most bytes that one micro-batch reads.
MOST_BYTES = 8 << 20
#: Most lines of a device that wait to be taken, and that a micro-batch takes.
MOST_LINES = 1 << 20
#: Lines of a journal's file.
SEGMENT_LINES = 4096


def find_port(port: str | None = None, patterns: tuple[str, ...] = PORT_PATTERNS) -> str:
    """The port that is named, else the first device found."""
    found = port or next((p for pattern in patterns for p in sorted(glob(pattern))), None)
    if not found:
        raise RuntimeError("no serial port found; name one")
    return found


class Reconnecting:
    """A source that is opened again after errors, waiting longer each time up to a limit (O-SRC-4). What it opens has
    ``read()`` and ``close()``; both, and opening, may raise ``OSError``."""

    def __init__(self, open_source: Callable, initial_s: float = 0.25, factor: float = 1.8, most_s: float = 3.0, sleep: Callable[[float], object] = time.sleep) -> None:
        self.open_source, self.initial_s, self.factor, self.most_s, self.sleep = open_source, initial_s, factor, most_s, sleep
        self.delay, self.source, self.state, self.last_error, self.connects = initial_s, None, "CONNECTING", None, 0

    def connect(self) -> bool:
        self.state = "CONNECTING"
        try:
            self.source = self.open_source()
        except OSError as e:
            self.state, self.last_error = "DISCONNECTED_RETRYING", str(e)
            self.sleep(self.delay)
            self.delay = min(self.delay * self.factor, self.most_s)
            return False
        self.state, self.last_error, self.delay, self.connects = "CONNECTED", None, self.initial_s, self.connects + 1
        return True

    def read(self):
        """What the source has, or None while there is none."""
        if self.source is None and not self.connect():
            return None
        try:
            return self.source.read()
        except OSError as e:
            self.last_error = str(e)
            self.close()
            return None

    def close(self) -> None:
        if self.source is not None:
            try:
                self.source.close()
            except OSError as e:
                self.last_error = str(e)
        self.source, self.state = None, "DISCONNECTED_RETRYING"


class Port:
    """An open device, terminal or pipe: whole lines as they arrive, each with the host's time. A line that is cut off by
    a lost connection is not one."""

    def __init__(self, path: str, baud: int = BAUD, timeout_s: float = 0.1) -> None:
        self.timeout_s, self.rest = timeout_s, b""
        self.fd = os.open(path, os.O_RDONLY | os.O_NOCTTY | os.O_NONBLOCK)
        self.plain = stat.S_ISREG(os.fstat(self.fd).st_mode)
        if os.isatty(self.fd):
            self._raw(baud)

    def _raw(self, baud: int) -> None:
        """No echo, no editing, no signals; the speed where the system knows it."""
        import termios
        import tty

        tty.setraw(self.fd, termios.TCSANOW)
        speed = getattr(termios, f"B{baud}", None)
        if speed is not None:
            mode = termios.tcgetattr(self.fd)
            mode[4] = mode[5] = speed
            termios.tcsetattr(self.fd, termios.TCSANOW, mode)

    def read(self) -> list[tuple[float, str]]:
        if not self.plain and not select.select([self.fd], [], [], self.timeout_s)[0]:
            return []
        data = os.read(self.fd, 1 << 16)
        if not data:
            if not self.plain:
                raise OSError("the device hung up")
            time.sleep(self.timeout_s)
        now = time.time()
        *whole, self.rest = (self.rest + data).split(b"\n")
        return [(now, x.decode("utf-8", "replace").strip()) for x in whole]

    def close(self) -> None:
        os.close(self.fd)


def put_whole(path: str, text: str) -> None:
    """Writes a file that nobody ever sees half."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.new", "w") as f:
        f.write(text)
    os.replace(f"{path}.new", path)


#: Number, host's time and text.
Arrived = tuple[int, float, str]


class Journal:
    """Lines that arrived and are not committed, in files of up to ``SEGMENT_LINES`` named by their first number. A line
    is there before anyone is told its number; one that was written in part is not there."""

    def __init__(self, folder: str) -> None:
        self.folder, self.file, self.n = folder, None, 0

    def segments(self) -> list[int]:
        names = os.listdir(self.folder) if os.path.isdir(self.folder) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"lines-(\d+)\.jsonl", n)))

    def _path(self, first: int) -> str:
        return os.path.join(self.folder, f"lines-{first}.jsonl")

    def rows(self, after: int, upto: int | None = None) -> list[Arrived]:
        out, firsts = [], self.segments()
        for first, following in zip(firsts, [*firsts[1:], None]):
            if (upto is None or first <= upto) and (following is None or following > after + 1):
                with open(self._path(first)) as f:
                    whole = [json.loads(x) for x in f if x.endswith("\n")]
                out += [(seq, host, line) for seq, host, line in whole if seq > after and (upto is None or seq <= upto)]
        return out

    def put(self, rows: list[Arrived]) -> None:
        if self.file is None or self.n >= SEGMENT_LINES:
            self.close()
            os.makedirs(self.folder, exist_ok=True)
            self.file, self.n = open(self._path(rows[0][0]), "w"), 0
        self.file.write("".join(json.dumps(r) + "\n" for r in rows))
        self.file.flush()
        self.n += len(rows)

    def sync(self) -> None:
        if self.file is not None:
            os.fsync(self.file.fileno())

    def drop(self, upto: int) -> None:
        firsts = self.segments()
        for first, following in zip(firsts, firsts[1:]):
            if following <= upto + 1:
                os.unlink(self._path(first))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.file = None


class DeviceThread:
    """Reads a device in the background, so that no line is missed while a micro-batch runs, numbers lines from ``after``
    on, and keeps them until they are taken. With ``MOST_LINES`` waiting it reads no more, and the device's own buffer
    fills. Lines of the journal that were not taken before come first."""

    def __init__(self, path: str, baud: int, after: int, journal: Journal | None = None, status: str | None = None) -> None:
        self.journal, self.status, self.said, self.stopped = journal, status, None, threading.Event()
        self.lines: deque[Arrived] = deque(journal.rows(after) if journal else ())
        self.last = max(after, self.lines[-1][0] if self.lines else 0)
        self.device = Reconnecting(lambda: Port(path, baud), sleep=self.stopped.wait)
        self.thread = threading.Thread(target=self._run, name=f"device {path}", daemon=True)
        self.thread.start()

    def _run(self) -> None:
        while not self.stopped.is_set():
            if len(self.lines) >= MOST_LINES:
                self.stopped.wait(0.02)
                continue
            rows = [(self.last + i + 1, host, line) for i, (host, line) in enumerate(self.device.read() or ())]
            if rows:
                self.last = rows[-1][0]
                if self.journal:
                    self.journal.put(rows)
                self.lines.extend(rows)
            self._tell()
        self.device.close()

    def _tell(self) -> None:
        """The connection's state, where it changed, for those who watch the stream."""
        now = {"state": self.device.state, "last_error": self.device.last_error, "connects": self.device.connects}
        if self.status and now != self.said:
            put_whole(self.status, json.dumps(now))
            self.said = now

    def take(self, most: int) -> list[Arrived]:
        taken = [self.lines.popleft() for _ in range(min(most, len(self.lines)))]
        if taken and self.journal:
            self.journal.sync()
        return taken

    def stop(self) -> None:
        self.stopped.set()
        self.thread.join(5)


Line = tuple[str, int, "float | None", str]


class DeviceReader(SimpleDataSourceStreamReader):
    """Lines of a device that can't be read again (O-SRC-1/2/10): an offset is the number of the last line taken. What a
    micro-batch took is kept until it is committed. With a ``journal``, a folder, lines are written there as they arrive,
    and both a batch that failed and a query that was started again get the same lines, none lost between. Without one
    only the running query can repeat a batch. Empty lines have numbers but are no rows."""

    def __init__(self, path: str, session: str, baud: int = BAUD, journal: str | None = None, status: str | None = None) -> None:
        self.path, self.session, self.baud, self.status = path, session, baud, status
        self.journal = Journal(journal) if journal else None
        self.thread: DeviceThread | None = None
        self.held: deque[Arrived] = deque()

    def __getstate__(self) -> dict:
        # The thread and its lines stay where the device is.
        return self.__dict__ | {"thread": None, "held": deque()}

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def _rows(self, lines: list[Arrived]) -> Iterator[Line]:
        return iter([(self.session, seq, host, line) for seq, host, line in lines if line])

    def read(self, start: dict) -> tuple[Iterator[Line], dict]:
        if self.thread is None:
            self.thread = DeviceThread(self.path, self.baud, start["seq"], self.journal, self.status)
        taken = self.thread.take(MOST_LINES)
        self.held.extend(taken)
        return self._rows(taken), {"seq": taken[-1][0]} if taken else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[Line]:
        low, high = start["seq"], end["seq"]
        found = [r for r in self.held if low < r[0] <= high]
        if len(found) < high - low and self.journal:
            found = self.journal.rows(low, high)
        if len(found) < high - low:
            raise RuntimeError(f"some of the lines {low + 1} to {high} of {self.path} are not kept any more")
        return self._rows(found)

    def commit(self, end: dict) -> None:
        while self.held and self.held[0][0] <= end["seq"]:
            self.held.popleft()
        if self.journal:
            self.journal.drop(end["seq"])


class LineReader(SimpleDataSourceStreamReader):
    """Lines of a file that can be read again, numbered as they arrive; an offset is a byte position and a line number.
    Empty lines are nothing."""

    def __init__(self, path: str, session: str) -> None:
        self.path, self.session = path, session

    def initialOffset(self) -> dict:
        return {"at": 0, "seq": 0}

    def _rows(self, start: dict, end: int | None = None) -> tuple[list[Line], dict]:
        with open(self.path, "rb") as f:
            f.seek(start["at"])
            data = f.read(MOST_BYTES if end is None else end - start["at"])
        whole = data[: data.rfind(b"\n") + 1]
        lines = whole.decode("utf-8", "replace").split("\n")[:-1]
        rows = [(self.session, start["seq"] + i + 1, None, x.strip()) for i, x in enumerate(lines) if x.strip()]
        return rows, {"at": start["at"] + len(whole), "seq": start["seq"] + len(lines)}

    def read(self, start: dict) -> tuple[Iterator[Line], dict]:
        rows, end = self._rows(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[Line]:
        return iter(self._rows(start, end["at"])[0])

    def commit(self, end: dict) -> None:
        """The file keeps its lines."""


class LineSource(DataSource):
    """``spark.readStream.format("device_lines").option("path", ..)``: a device, terminal or pipe, there already or not, or
    a file. Options: ``session``, ``baud``, and for devices ``journal``, a folder for lines that are not committed (the
    query's own: beside its checkpoint), and ``status``, a file that says how the connection is. ``host_time_s`` is when
    a line came from a device; null for a file."""

    @classmethod
    def name(cls) -> str:
        return "device_lines"

    def schema(self) -> str:
        return "session string, arrival_seq bigint, host_time_s double, line string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        path, session = self.options["path"], self.options.get("session", "live")
        if os.path.isfile(path):
            return LineReader(path, session)
        return DeviceReader(path, session, int(self.options.get("baud", BAUD)), self.options.get("journal"), self.options.get("status"))


def file_lines(spark: SparkSession, path: str, session: str) -> DataFrame:
    """``(session, arrival_seq, host_time_s, line)`` of a file of device lines. A line may begin with the host's time in
    seconds and a tab; else its time is its number over the device's rate."""
    rows = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n")).alias("at")).where("trim(value) != ''")
    numbered = rows.select("value", F.row_number().over(Window.partitionBy(F.lit(session)).orderBy("at")).cast("bigint").alias("arrival_seq"))
    parts = F.split("value", "\t", 2)
    host = F.when(F.size(parts) == 2, F.get(parts, 0).try_cast("double"))
    line = F.when(host.isNotNull(), F.get(parts, 1)).otherwise(F.col("value"))
    return numbered.select(F.lit(session).alias("session"), "arrival_seq", F.coalesce(host, (F.col("arrival_seq") - 1) / SAMPLE_HZ).alias("host_time_s"), F.trim(line).alias("line"))


class PortInUse(RuntimeError):
    """Another process owns the port."""


class PortLock:
    """A lock file with the owner's process id; that of a dead process is taken over."""

    def __init__(self, folder: str, port: str) -> None:
        self.path = os.path.join(folder, re.sub(r"[^A-Za-z0-9_.-]", "_", port) + ".lock")
        self.port, self.owned = port, False

    def acquire(self) -> None:
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        for _ in range(2):
            try:
                with os.fdopen(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                    json.dump({"pid": os.getpid(), "port": self.port, "created_at": time.time()}, f)
                self.owned = True
                return
            except FileExistsError:
                if self._alive():
                    raise PortInUse(f"{self.port} is in use") from None
                os.unlink(self.path)
        raise PortInUse(f"{self.port} is in use")

    def _alive(self) -> bool:
        try:
            with open(self.path) as f:
                os.kill(int(json.load(f)["pid"]), 0)
            return True
        except (ProcessLookupError, ValueError, KeyError):
            return False
        except PermissionError:
            return True

    def release(self) -> None:
        """Takes the lock away where it still is this process's own."""
        if not self.owned:
            return
        self.owned = False
        try:
            with open(self.path) as f:
                mine = int(json.load(f)["pid"]) == os.getpid()
        except (OSError, ValueError, KeyError):
            return
        if mine:
            os.unlink(self.path)
