"""The command shell on a store: python -m ledgerfen.shell PATH; prints a reply for each line."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from .db import Store, Writer
from .session import get_spark

HELP = "put K V, get K, delete K, stats, compact, gc, help, exit"


def answers(writer: Writer, lines: Iterable[str]) -> Iterator[str]:
    """The replies to the lines up to exit or quit, as ``operators.protocol.cli_replies`` gives them; empty lines have none."""
    for line in lines:
        words = line.split()
        if not words:
            continue
        verb, key, value = (*words, "", "")[:3]
        if verb in ("exit", "quit"):
            return
        if verb in ("put", "get", "delete") and not key:
            yield f"Error: {verb} requires key" + (" and value" if verb == "put" else "")
        elif verb == "put":
            writer.put(key, value)
            yield "OK"
        elif verb == "delete":
            writer.delete(key)
            yield "OK"
        elif verb == "get":
            found = writer.get(key)
            yield "(nil)" if found is None else found
        elif verb == "stats":
            yield writer.stats_text()
        elif verb == "compact":
            writer.compact()
            yield "OK"
        elif verb == "gc":
            writer.gc()
            yield "OK"
        else:
            yield HELP if verb == "help" else f"Unknown command: {verb}"


def main() -> None:
    spark = get_spark("shell")
    spark.sparkContext.setLogLevel("ERROR")
    with Store(spark, sys.argv[1]).writer() as writer:
        for reply in answers(writer, (x.rstrip("\n") for x in sys.stdin)):
            print(reply, flush=True)


if __name__ == "__main__":
    main()
