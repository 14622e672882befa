"""A Spark stream source of syslog datagrams, by the Python data source interface.

Datagrams are kept in a bounded queue on the driver, which drops and counts when it is full, and are given to
batches by offset; a restart of the driver loses what is queued. At scale, receivers write files or a log that streams read; this one serves a single listener.
"""

from __future__ import annotations

import socket
import threading
from collections import deque

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

MOST_DATAGRAM = 64 * 1024


class SyslogUdp(DataSource):
    """``spark.dataSource.register(SyslogUdp)``, then ``readStream.format("syslog_udp")``; options host, port,
    capacity."""

    @classmethod
    def name(cls) -> str:
        return "syslog_udp"

    def schema(self) -> str:
        return "raw string, peer string, received_at timestamp"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return SyslogUdpReader(self.options)


class SyslogUdpReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.capacity = int(options.get("capacity", 100_000))
        self.queue: deque = deque()
        self.first = 0
        self.dropped = 0
        self.lock = threading.Lock()
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        self.socket.bind((options.get("host", "127.0.0.1"), int(options.get("port", 0))))
        self.port = self.socket.getsockname()[1]
        threading.Thread(target=self._receive, daemon=True).start()

    def _receive(self) -> None:
        import datetime

        from marlstone.sources.syslog import decode

        while True:
            try:
                data, peer = self.socket.recvfrom(MOST_DATAGRAM)
            except OSError:
                return
            with self.lock:
                if len(self.queue) >= self.capacity:
                    self.dropped += 1
                else:
                    self.queue.append((decode(data), peer[0], datetime.datetime.now(datetime.UTC)))

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict):
        with self.lock:
            rows = list(self.queue)[max(0, start["at"] - self.first) :]
            return iter(rows), {"at": self.first + len(self.queue)}

    def readBetweenOffsets(self, start: dict, end: dict):
        with self.lock:
            return iter(list(self.queue)[max(0, start["at"] - self.first) : max(0, end["at"] - self.first)])

    def commit(self, end: dict) -> None:
        with self.lock:
            while self.queue and self.first < end["at"]:
                self.queue.popleft()
                self.first += 1


