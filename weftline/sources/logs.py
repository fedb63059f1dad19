"""Log records as JSON lines: keys sorted, values typed, secrets out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.redact import sanitized


def isoformat(time: Column) -> Column:
    """UTC, with a fraction only where there is one."""
    fraction = F.when(F.unix_micros(time) % 1_000_000 != 0, F.date_format(time, ".SSSSSS")).otherwise(F.lit(""))
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def ascii_only(text: Column) -> Column:
    """JSON with all but printable ASCII escaped as UTF-16 units."""
    unit = lambda c: F.concat(F.lit("\\u"), F.lower(F.hex(F.encode(c, "UTF-16BE"))))
    pair = lambda c: F.concat(F.lit("\\u"), F.substring(F.lower(F.hex(F.encode(c, "UTF-16BE"))), 1, 4), F.lit("\\u"), F.substring(F.lower(F.hex(F.encode(c, "UTF-16BE"))), 5, 4))
    one = lambda c: F.when(c.rlike("^[ -~]*$"), c).when(F.length(F.encode(c, "UTF-16BE")) == 4, pair(c)).otherwise(unit(c))
    return F.when(text.rlike("^[ -~]*$"), text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def lines(records: DataFrame, time: Column, level: Column, logger: Column, event: Column, fields: list[str] | tuple[str, ...] = (), message: Column | None = None, exception_type: Column | None = None) -> Column:
    """A log line of each record: timestamp, level, logger, event (or, without one, message) and the columns ``fields``.

    A record's own fields win over the fixed ones; values keep their types, in
    structs, maps and arrays too; null is written as null; what a field's name
    or a value's form marks as secret is hidden.
    """
    text = T.StringType()
    named = F.coalesce(F.length(event) > 0, F.lit(False))
    own = {f: sanitized(F.col(f"`{f}`"), records.schema[f].dataType, f) for f in fields}
    fixed = {"timestamp": isoformat(time), "level": F.lower(level), "logger": logger}
    said = sanitized(event, text), sanitized(message if message is not None else F.lit(""), text)

    def written(extra: dict[str, Column]) -> Column:
        values = fixed | extra | own
        return ascii_only(F.to_json(F.struct(*(values[k].alias(k) for k in sorted(values))), {"ignoreNullFields": "false"}))

    def with_error(extra: dict[str, Column]) -> Column:
        if exception_type is None:
            return written(extra)
        own.pop("exception_type", None)  # the error's own type is written last
        return F.when(exception_type.isNull(), written(extra)).otherwise(written(extra | {"exception_type": exception_type}))

    return F.when(named, with_error({"event": said[0]})).otherwise(with_error({"message": said[1]}))


def write_logs(records: DataFrame, path: str) -> None:
    """Column ``line`` as text files."""
    records.select(F.col("line").alias("value")).write.mode("append").text(path)
