"""Events of a behaviour log, parsed by the same expression in batch and in streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The messages of the log and the kind of each. Sent and received data have the same wording.
EVENTS = [
    ("file_opened", r"^File Handle Opened: (.*)$"),
    ("file_created", r"^File Created: (.*)$"),
    ("process_opened", r"^Process handle opened to pid: (\d+)"),
    ("memory_written", r"^The Process wrote to the process memory of: (.*)$"),
    ("memory_read", r"^The Process read the process memory of: (.*)$"),
    ("process_ended", r"^The Process terminated the process with the pid: (\d+)"),
    ("keyboard_hook", r"^The Process installed a global (keyboard) hook"),
    ("mouse_hook", r"^The Process installed a global (mouse) hook"),
    ("socket_created", r"^The Process have created a (socket)"),
    ("data_moved", r"bytes of data to: (.*)$"),
    ("send_failed", r"tried to send data to an ip address but failed with the error code: (\d+)"),
    ("receive_failed", r"tried to receive data from an ip address but failed with the error code: (\d+)"),
]


def parse(message: Column) -> Column:
    """struct of kind, argument and n_bytes; kind other for what is no known message."""
    kind, argument = None, None
    for name, pattern in EVENTS:
        hit, value = message.rlike(pattern), F.trim(F.regexp_extract(message, pattern, 1))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        argument = F.when(hit, value) if argument is None else argument.when(hit, value)
    size = F.regexp_extract(message, r"\"(\d+)\" bytes of data", 1).try_cast("bigint")
    return F.struct(kind.otherwise("other").alias("kind"), argument.alias("argument"), size.alias("n_bytes"))


def stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a folder of captured logs as a stream of parsed events."""
    return spark.readStream.text(path).select(F.col("value").alias("message"), parse(F.col("value")).alias("event")).select("message", "event.*")


def windowed(events: DataFrame, length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by kind and window, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "kind").count()
