"""Messages between a client and a language server: framing by length, results and errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def framed(body: Column) -> Column:
    """The message with its header, in bytes."""
    raw = F.encode(body, "utf-8")
    return F.concat(F.encode(F.concat(F.lit("Content-Length: "), F.octet_length(raw).cast("string"), F.lit("\r\n\r\n")), "utf-8"), raw)


def unframed(stream: Column) -> Column:
    """The bodies (array of binary) of the whole messages that ``stream`` begins with.

    Other headers are skipped. A message that is cut off, or has no length,
    ends the list.
    """
    none = F.array().cast("array<binary>")
    latin = lambda raw: F.decode(raw, "ISO-8859-1")
    tries = F.sequence(F.lit(0), F.regexp_count(latin(stream), F.lit("Content-Length:")))

    def step(s: Column, _: Column) -> Column:
        head = F.regexp_extract(latin(s["rest"]), r"^((?:[^\r\n]+\r\n)+\r\n)", 1)
        size = F.regexp_extract(head, r"(?:^|\n)Content-Length:[ \t]*([0-9]+)[ \t]*\r\n(?![\s\S]*\nContent-Length:)", 1).try_cast("int")
        whole = (head != "") & (F.octet_length(s["rest"]) - F.length(head) >= size)
        body = F.substring(s["rest"], F.length(head) + 1, size)
        rest = F.substring(s["rest"], F.length(head) + size + 1, F.octet_length(s["rest"]))
        return F.when(F.coalesce(whole, F.lit(False)), F.struct(F.concat(s["out"], F.array(body)).alias("out"), rest.alias("rest"))).otherwise(F.struct(s["out"].alias("out"), F.lit(b"").alias("rest")))

    return F.aggregate(tries, F.struct(none.alias("out"), stream.alias("rest")), step)["out"]


def response(message: Column) -> Column:
    """A struct (result, code, error) of a JSON answer: an error has a code (else 0) and a message (else ``unknown error``), and no result."""
    parsed = F.try_parse_json(message)
    part = lambda p: F.try_variant_get(parsed, p, "variant")
    typed = lambda p, kind: F.coalesce(F.schema_of_variant(part(p)) == kind, F.lit(False))
    failed = part("$.error").isNotNull()
    code = F.coalesce(F.when(typed("$.error.code", "BIGINT"), F.try_variant_get(parsed, "$.error.code", "long")), F.lit(0).cast("long"))
    said = F.coalesce(F.when(typed("$.error.message", "STRING"), F.try_variant_get(parsed, "$.error.message", "string")), F.lit("unknown error"))
    return F.struct(F.when(~failed, F.to_json(part("$.result"))).alias("result"), F.when(failed, code).alias("code"), F.when(failed, said).alias("error"))
