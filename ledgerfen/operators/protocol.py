"""The two line protocols: commands are parsed into columns and answered as a batch, in the order of their lines.

The replies are fixed values of the protocols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running


def parse(commands: DataFrame) -> DataFrame:
    """(line_no, verb, key, value) of (line_no, line): the first three words between white space; missing ones are empty, null lines too."""
    words = F.split(F.regexp_replace(F.coalesce("line", F.lit("")), r"^\s+|\s+$", ""), r"\s+")
    word = lambda i: F.coalesce(F.try_element_at(words, F.lit(i)), F.lit(""))
    return commands.select("line_no", word(1).alias("verb"), word(2).alias("key"), word(3).alias("value"))


def _seen(parsed: DataFrame, put: str, delete: str) -> DataFrame:
    """Each command with ``found``, the last put or delete of its key on an earlier line."""
    change = F.when(F.col("verb") == put, F.struct(F.lit(1).alias("vtype"), F.col("value").alias("v"))).when(F.col("verb") == delete, F.struct(F.lit(2).alias("vtype"), F.lit("").alias("v")))
    return running(parsed.withColumn("_change", change), ["key"], ["line_no"], {"found": ("last", "_change")}).drop("_change")


def server_replies(commands: DataFrame, stats: str = "") -> DataFrame:
    """(line_no, reply) of the server's commands PING, PUT, GET, DEL and STATS; empty keys are keys."""
    rows = _seen(parse(commands), "PUT", "DEL")
    bulk = lambda c: F.concat(F.lit("$"), F.octet_length(c).cast("string"), F.lit("\r\n"), c, F.lit("\r\n"))
    verb = F.col("verb")
    reply = (
        F.when(verb == "PING", "+PONG\r\n")
        .when(verb.isin("PUT", "DEL"), "+OK\r\n")
        .when((verb == "GET") & (F.col("found.vtype") == 1), bulk(F.col("found.v")))
        .when(verb == "GET", "$-1\r\n")
        .when(verb == "STATS", bulk(F.lit(stats)))
        .otherwise("-ERR unknown command\r\n")
    )
    return rows.select("line_no", reply.alias("reply"))


def cli_replies(commands: DataFrame, stats: str = "", help_text: str = "") -> DataFrame:
    """(line_no, reply) of the shell's commands put, get, delete, stats, compact, gc and help, up to the first exit or quit.

    Empty lines and exit have no reply. A key must be there; a missing value is the empty one. Compaction and reclaiming change
    nothing that can be seen. The statistics are ``stats`` after the next sequence number as of their line.
    """
    rows = parse(commands)
    last = rows.agg(F.min(F.when(F.col("verb").isin("exit", "quit"), F.col("line_no"))).alias("stop"))
    real = commands.where(F.coalesce(F.length("line"), F.lit(0)) > 0).select("line_no")
    rows = rows.join(real, "line_no", "left_semi").join(F.broadcast(last), F.col("stop").isNull() | (F.col("line_no") < F.col("stop"))).drop("stop")
    changes = F.col("verb").isin("put", "delete")
    # a change without a key is none, so it has a verb that no line can have
    rows = rows.withColumns({"typed": F.col("verb"), "verb": F.when(changes & (F.col("key") == ""), F.lit(" ")).otherwise(F.col("verb"))})
    rows = running(rows.withColumn("_change", F.when(changes & (F.col("verb") != " "), 1)), [], ["line_no"], {"before": ("count", "_change")}).drop("_change")
    rows = _seen(rows, "put", "delete")
    verb, key = F.col("typed"), F.col("key")
    ask: Column = (
        F.when((verb == "put") & (key == ""), "Error: put requires key and value")
        .when((verb == "delete") & (key == ""), "Error: delete requires key")
        .when((verb == "get") & (key == ""), "Error: get requires key")
        .when(verb.isin("put", "delete", "compact", "gc"), "OK")
        .when((verb == "get") & (F.col("found.vtype") == 1), F.col("found.v"))
        .when(verb == "get", "(nil)")
        .when(verb == "stats", F.concat(F.lit("sequence_number: "), (F.coalesce("before", F.lit(0)) + 1).cast("string"), F.lit(f"\n{stats}" if stats else "")))
        .when(verb == "help", F.lit(help_text))
        .otherwise(F.concat(F.lit("Unknown command: "), verb))
    )
    return rows.select("line_no", ask.alias("reply"))
