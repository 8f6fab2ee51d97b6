"""The line protocol over TCP on a store: python -m ledgerfen.server PATH [PORT]."""

from __future__ import annotations

import socketserver
import sys
import threading

from .db import Store, Writer
from .session import get_spark

PORT = 7777


def answer(writer: Writer, line: str) -> str:
    """The reply to a line, as ``operators.protocol.server_replies`` gives it; empty keys are keys."""
    verb, key, value = (*line.split(), "", "", "")[:3]
    bulk = lambda text: f"${len(text.encode())}\r\n{text}\r\n"
    if verb == "PING":
        return "+PONG\r\n"
    if verb == "PUT":
        writer.put(key, value)
        return "+OK\r\n"
    if verb == "DEL":
        writer.delete(key)
        return "+OK\r\n"
    if verb == "GET":
        found = writer.get(key)
        return "$-1\r\n" if found is None else bulk(found)
    return bulk(writer.stats_text()) if verb == "STATS" else "-ERR unknown command\r\n"


def serve(writer: Writer, host: str = "127.0.0.1", port: int = PORT) -> socketserver.ThreadingTCPServer:
    """A server that isn't started yet; a connection is a thread, and commands are done one after the other."""
    lock = threading.Lock()

    class Handler(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            for line in self.rfile:
                with lock:
                    reply = answer(writer, line.decode(errors="replace").rstrip("\r\n"))
                self.wfile.write(reply.encode())

    class Server(socketserver.ThreadingTCPServer):
        allow_reuse_address, daemon_threads = True, True

    return Server((host, port), Handler)


def main() -> None:
    spark = get_spark("server")
    spark.sparkContext.setLogLevel("ERROR")
    with Store(spark, sys.argv[1]).writer() as writer, serve(writer, port=int((sys.argv[2:] or [PORT])[0])) as server:
        server.serve_forever()


if __name__ == "__main__":
    main()
